"""X12-X23."""

from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.plans.registry import query

#: Names and addresses turned into the folder names that the parsers expect.
TREE = "(SELECT page_id, concat('/data/', CASE WHEN page_id % 4 = 0 THEN 'PG' WHEN page_id % 4 = 1 THEN 'PG_20240' || CAST(101 + page_id % 30 AS STRING) WHEN page_id % 4 = 2 THEN 'other' ELSE 'PG_2024' END, '/', CASE WHEN page_id % 5 = 0 THEN 'pg_' || CAST(page_id AS STRING) || '_x' WHEN page_id % 5 = 1 THEN 'TNT_xogl7' WHEN page_id % 5 = 2 THEN 'b6vf-2' ELSE 'Line ' || CAST(page_id % 7 AS STRING) END, '/arena', CAST(page_id % 9 AS STRING), '/fly1/clip.mp4') AS path FROM paths)"


def tree(paths):
    p = F.col("page_id")
    s = lambda c: c.cast("string")
    day = F.when(p % 4 == 0, F.lit("PG")).when(p % 4 == 1, F.concat(F.lit("PG_20240"), s(101 + p % 30))).when(p % 4 == 2, F.lit("other")).otherwise(F.lit("PG_2024"))
    line = F.when(p % 5 == 0, F.concat(F.lit("pg_"), s(p), F.lit("_x"))).when(p % 5 == 1, F.lit("TNT_xogl7")).when(p % 5 == 2, F.lit("b6vf-2")).otherwise(F.concat(F.lit("Line "), s(p % 7)))
    return paths.select("page_id", F.concat(F.lit("/data/"), day, F.lit("/"), line, F.lit("/arena"), s(p % 9), F.lit("/fly1/clip.mp4")).alias("path"))


@query("x12_genotype_group", "paths", f"SELECT page_id, CASE WHEN regexp_matches(upper(g), '^PG_?[0-9]+') THEN 'PG' || regexp_extract(upper(g), '^PG_?([0-9]+)', 1) WHEN contains(upper(g), 'XOGL7') THEN 'B6XOGL7' WHEN upper(g) LIKE 'B6VF%' THEN 'B6VF' ELSE g END AS grp, contains(upper(g), 'XOGL7') OR upper(g) LIKE 'B6VF%' AS is_control FROM (SELECT page_id, split_part(path, '/', 4) AS g FROM {TREE})")
def x12(paths):
    g = tree(paths).select("page_id", S.genotype_group(S.parent("path", 3)).alias("grp"))
    return g.select("page_id", "grp", S.is_control_group("grp").alias("is_control"))


@query("x13_protocol", "paths", f"SELECT page_id, CASE WHEN s = 'PG' THEN 'short' WHEN regexp_matches(s, '^PG_[0-9]{{8}}$') THEN 'long' END AS sequence FROM (SELECT page_id, split_part(path, '/', 3) AS s FROM {TREE})")
def x13(paths):
    return tree(paths).select("page_id", S.protocol_of(S.parent("path", 4)).alias("sequence"))


FOLDERS = "(SELECT id, CASE WHEN id % 4 = 0 THEN replace(name, ' ', '-') || '_f' WHEN id % 4 = 1 THEN replace(name, ' ', '-') || '_male_x' WHEN id % 4 = 2 THEN replace(name, ' ', '-') || '_f1_' || CAST(id % 9 AS STRING) || 'd_r2' ELSE name END AS folder FROM names)"


def folders(names):
    n = F.replace("name", F.lit(" "), F.lit("-"))
    i = F.col("id")
    return names.select("id", F.when(i % 4 == 0, F.concat(n, F.lit("_f"))).when(i % 4 == 1, F.concat(n, F.lit("_male_x"))).when(i % 4 == 2, F.concat(n, F.lit("_f1_"), (i % 9).cast("string"), F.lit("d_r2"))).otherwise(F.col("name")).alias("folder"))


@query("x14_fly_metadata", "names", f"SELECT id, CASE WHEN id % 4 < 3 THEN split_part(folder, '_', 1) END AS genotype, CASE id % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS sex, CASE id % 4 WHEN 1 THEN 2 WHEN 2 THEN CAST(id % 9 AS INT) END AS age FROM {FOLDERS}")
def x14(names):
    return folders(names).select("id", S.fly_metadata("folder").alias("m")).select("id", "m.genotype", "m.sex", "m.age")


@query("x15_fly_place", "names", "SELECT id, CASE WHEN id % 3 > 0 THEN genotype END AS experiment, CAST(CASE WHEN id % 3 > 0 THEN id % 9 END AS INT) AS arena, CAST(CASE WHEN id % 3 > 0 THEN id % 6 END AS INT) AS corridor FROM names")
def x15(names):
    i = F.col("id")
    fly = F.when(i % 3 > 0, F.concat("genotype", F.lit("_arena"), (i % 9).cast("string"), F.lit("_corridor"), (i % 6).cast("string"))).otherwise(F.col("name"))
    return names.select("id", S.fly_place(fly).alias("p")).select("id", "p.experiment", "p.arena", "p.corridor")


@query("x16_dated_folder", "paths", "SELECT page_id, page_id % 4 = 1 AND 101 + page_id % 30 BETWEEN 110 AND 120 AS inside FROM paths")
def x16(paths):
    i = F.col("page_id")
    name = F.concat(F.lit("PG_20240"), (101 + i % 30).cast("string"), F.when(i % 4 == 1, F.lit("_Vglut_B6VF_1min")).otherwise(F.lit("_Vglut_B6VF_2min")))
    return paths.select("page_id", S.dated_folder(name, 20240110, 20240120).alias("inside"))


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


PLAIN = "('α ' || name || '′2 β’ (κ) Ω é')"
for letter, plain in S.GREEK.items():
    PLAIN = f"replace({PLAIN}, {_quoted(letter)}, {_quoted(plain)})"
PLAIN = f"regexp_replace(translate({PLAIN}, ' ()', '-'), '[^\\x00-\\x7F]', '', 'g')"


@query("x17_plain_name", "names", f"SELECT id, {PLAIN} AS plain, 'Ωé' AS left_over, concat_ws(', ', 'space', 'parentheses', 'non-ASCII: éΩαβκ’′') AS issues FROM names")
def x17(names):
    odd = F.concat(F.lit("α "), "name", F.lit("′2 β’ (κ) Ω é"))
    return names.select("id", S.plain_name(odd).alias("plain"), S.left_over(odd).alias("left_over"), S.name_issues(odd).alias("issues"))


@query("x18_safe_file_name", "paths", """SELECT page_id, regexp_replace(path, '[<>:"/\\\\|?*]', '_', 'g') AS safe FROM paths""")
def x18(paths):
    return paths.select("page_id", S.safe_file_name("path").alias("safe"))


@query("x19_rename_pipeline", "paths", "SELECT page_id, CASE WHEN new IS NULL THEN path ELSE new END AS name, new IS NOT NULL AS changed FROM (SELECT *, CASE WHEN path LIKE '%.html' THEN 'v1-' || regexp_replace(regexp_replace(replace(path, 'http', 'ftp'), '[0-9]+', 'N', 'g'), '\\.html$', '_done.html') END AS new FROM paths)")
def x19(paths):
    steps = [("replace", "http", "ftp"), ("regex", "[0-9]+", "N"), ("prefix", "v1-"), ("suffix", "_done")]
    # The suffix goes before the extension of the last path part.
    return paths.select("page_id", S.renamed("path", steps, "*.html").alias("r")).select("page_id", "r.name", "r.changed")


@query("x20_flat_name", "paths", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'scan' || CAST(page_id AS STRING) || '.mp4' WHEN 1 THEN 'brain' || CAST(page_id AS STRING) || '.tiff' ELSE 'own.csv' END AS flat FROM paths")
def x20(paths):
    i = F.col("page_id")
    s = i.cast("string")
    path = F.when(i % 3 == 0, F.concat(F.lit("20240101_scan"), s, F.lit(".mp4"))).when(i % 3 == 1, F.concat(F.lit("240101_brain"), s, F.lit("/sub/img.tiff"))).otherwise(F.lit("dir/sub/2024_own.csv"))
    return paths.select("page_id", F.replace(S.flat_name(path), F.lit("2024_"), F.lit("")).alias("flat"))


@query("x21_sample_label", "ev", "SELECT event_type, event_type || ' (n=' || CAST(count(*) AS STRING) || ')' AS label FROM ev GROUP BY 1")
def x21(ev):
    return ev.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", S.sample_label("event_type", "n").alias("label"))


@query("x22_composite_id", "ev", "SELECT event_id, CAST(fly AS STRING) || '_' || event_type || '_' || CAST(event_id AS STRING) AS id FROM ev")
def x22(ev):
    return ev.select("event_id", F.concat_ws("_", "fly", "event_type", F.col("event_id")).alias("id"))


@query("x23_identifier", "paths", f"SELECT page_id, CASE WHEN page_id % 4 = 1 THEN '20240' || CAST(101 + page_id % 30 AS STRING) ELSE 'Unknown' END || chr(10) || 'arena' || CAST(page_id % 9 AS STRING) || chr(10) || 'Unknown' AS identifier FROM {TREE}")
def x23(paths):
    return tree(paths).select("page_id", S.identifier("path").alias("identifier"))
