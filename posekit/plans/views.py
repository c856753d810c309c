"""Views that give the shared tables the shape of pose recordings.

One SQL text serves Spark and DuckDB; a name in braces is a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "frames": """
SELECT user_id % 10 AS recording, user_id AS track,
  CASE WHEN user_id % 6 = 0 THEN 'B6VF' ELSE concat('PG', CAST(user_id % 6 AS STRING)) END AS grp,
  (user_id % 6 = 0) AS is_control,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
  event_id * 1700e0 / c.n AS time, event_type,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) END AS y
FROM {events} CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM {events}) c""",
    "points": """
SELECT f.recording, f.track, f.frame, n.node,
  f.x + n.dx AS x, f.y + n.dy AS y, CASE WHEN f.x IS NULL THEN NULL ELSE f.y / 100e0 END AS score
FROM {frames} f CROSS JOIN (SELECT 'head' AS node, 2e0 AS dx, 1e0 AS dy UNION ALL
  SELECT 'thorax', 0e0, 0e0 UNION ALL SELECT 'abdomen', -2e0, -1e0) n""",
    "bodies": """
SELECT f.recording, f.track, f.frame, n.node, CASE WHEN n.node = 'head' AND f.frame % 9 = 4 THEN NULL ELSE f.x + n.side * cos(f.a) END AS x,
  CASE WHEN n.node = 'head' AND f.frame % 9 = 4 THEN NULL ELSE f.y + n.side * sin(f.a) END AS y
FROM (SELECT *, frame * 35e-2 + coalesce(y, 0e0) / 25e0 AS a FROM {frames}) f CROSS JOIN (SELECT 'head' AS node, 2e0 AS side UNION ALL
  SELECT 'thorax', 0e0 UNION ALL SELECT 'abdomen', -2e0) n""",
    "videos": """
SELECT recording, concat('/data/', CASE WHEN recording % 4 = 3 THEN 'old' WHEN recording % 2 = 0 THEN 'PG_20240131' ELSE 'PG' END, '/',
  CASE WHEN recording % 5 = 0 THEN 'B6VF_1min' WHEN recording = 6 THEN 'PG_7_bad' ELSE concat('PG_', CAST(recording % 5 AS STRING), '_f') END, '/d1/v', CAST(recording AS STRING), '/v.h5') AS path
FROM (SELECT DISTINCT recording FROM {frames}) r""",
    "units": """
SELECT grp, is_control, recording, track, avg(x) AS v, avg(CASE WHEN event_type = 'view' THEN x END) AS v_on,
  avg(CASE WHEN event_type <> 'view' THEN x END) AS v_off
FROM {frames} GROUP BY grp, is_control, recording, track""",
    "ev": """
SELECT user_id AS fly, event_type, event_id, event_id % 7 AS cluster, value AS displacement,
  event_id % 3 AS light, ts FROM {events}""",
    "paths": """
SELECT page_id, url AS path, length(html) AS size FROM {pages}""",
    "names": """
SELECT p_partkey AS id, concat(p_name, ' (', p_brand, ')') AS name, p_type AS genotype FROM {part}""",
    "pulses": """
SELECT 'long' AS seq, CAST(5 * b + j + 1 AS INT) AS on_index, 0.5e0 + b * 660e0 + j * 75e0 AS start_s, 60.5e0 + b * 660e0 + j * 75e0 AS end_s
FROM (SELECT 0 AS b UNION ALL SELECT 1 UNION ALL SELECT 2) bs CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) js
UNION ALL
SELECT 'short', CAST(j + 1 AS INT), 0.5e0 + j * 75e0, 60.5e0 + j * 75e0
FROM (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) js""",
    "kin": """
SELECT recording, track, grp, is_control, frame, time, 0.0125e0 AS dt, x AS forward_velocity, abs(x) AS speed, y AS rotational_velocity
FROM (SELECT recording, track, grp, is_control, frame, time, x - 50e0 AS x, y - 50e0 AS y FROM {frames}) f""",
}


def needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", SQL[name])))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a base table, as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{v: load(spark, sf_dir, v) for v in needs(name)})


def with_views(names: list[str], body: str) -> str:
    """DuckDB SQL: the views as a WITH clause before the body (which may have its own WITH in parentheses)."""
    order: list[str] = []

    def visit(v: str) -> None:
        if v in SQL and v not in order:
            for w in needs(v):
                visit(w)
            order.append(v)

    for v in names:
        visit(v)
    if not order:
        return body
    ctes = ",\n".join(f"{v} AS ({re.sub(r'[{}]', '', SQL[v])})" for v in order)
    return f"WITH {ctes}\nSELECT * FROM ({body})"
