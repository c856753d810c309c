"""W10, W11, W13, X24."""

from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.operators import events as O
from posekit.plans.registry import query

KEYS = ["recording", "track"]
RUNS = "SELECT recording, track, min(frame) AS start, max(frame) AS \"end\" FROM (SELECT *, sum(CASE WHEN f <> p THEN 1 ELSE 0 END) OVER (PARTITION BY recording, track ORDER BY frame) AS b FROM (SELECT *, coalesce(lag(f) OVER (PARTITION BY recording, track ORDER BY frame), false) AS p FROM (SELECT *, coalesce(x < 60, false) AS f FROM frames))) WHERE f GROUP BY recording, track, b HAVING max(frame) - min(frame) >= 3"


@query("w10_runs", "frames", RUNS)
def w10(frames):
    return O.runs(frames, KEYS, "frame", F.col("x") < 60, 3)


@query("w11_find_events", "frames", """SELECT recording, track, s2 AS start, t AS "end", t - s2 AS duration FROM (
  SELECT recording, track, e, s2, t, count(CASE WHEN i >= s2 AND i < t THEN 1 END) AS hits FROM (
    SELECT *, CASE WHEN s >= 20 AND s < 24 AND t > 24 THEN 24 ELSE s END AS s2 FROM (
      SELECT *, min(i) OVER v AS s, max(i) OVER v AS t, count(*) OVER v AS n FROM (
        SELECT *, sum(CASE WHEN i - p > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY recording, track ORDER BY i) AS e FROM (
          SELECT *, lag(i) OVER (PARTITION BY recording, track ORDER BY i) AS p FROM (SELECT recording, track, frame - 1 AS i, x FROM frames) WHERE x > 10 AND x < 90)) WINDOW v AS (PARTITION BY recording, track, e))
    WHERE n >= 2 AND NOT (s >= 20 AND s < 24 AND t < 24)) GROUP BY ALL) WHERE t - s2 > 6 AND hits > 0.75 * (t - s2)""")
def w11(frames):
    return O.find_events(frames, KEYS, "frame", "x", (10.0, 90.0), 3, 6, omit=(20, 24))


@query("w13_contact_onsets", "frames", "SELECT recording, track, frame FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY recording, track ORDER BY frame) AS g FROM (SELECT *, lead(x) OVER (PARTITION BY recording, track ORDER BY frame) AS nx FROM frames) WHERE x < 40 AND nx < 40) WHERE g > 10")
def w13(frames):
    return O.contact_onsets(frames, KEYS, "frame", "x", 40.0, 10).select(*KEYS, "frame")


@query("x24_padded_window", "frames", "SELECT recording, track, greatest(0, min(time) - 2) AS start, least(max(d), max(time) + 2) AS end_ FROM (SELECT *, max(time) OVER (PARTITION BY recording) AS d FROM frames) WHERE event_type = 'view' GROUP BY 1, 2", "start end_")
def x24(frames):
    length = frames.groupBy("recording").agg(F.max("time").alias("d"))
    spans = frames.where("event_type = 'view'").groupBy(*KEYS).agg(F.min("time").alias("a"), F.max("time").alias("b")).join(length, "recording")
    return spans.select(*KEYS, S.padded_window("a", "b", "d").alias("w")).select(*KEYS, "w.start", F.col("w.end").alias("end_"))
