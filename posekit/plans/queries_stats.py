"""ST1-ST9, X2, X6, X25."""

from pyspark.sql import functions as F

from posekit.functions import scalars as S
from posekit.operators import joins as J
from posekit.operators import stats as O
from posekit.plans.registry import query

REPS = 100


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '0', {', '.join(parts)})), 1, 8))::BIGINT"


def _boot(keys: str, src: str, value: str, stat: str = "avg", reps: int = REPS) -> str:
    """(keys, rep, stat) of bootstrap resamples."""
    ks = [k.strip() for k in keys.split(",")]
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in ks)
    return f"""SELECT {keys}, rep, {stat}(v) AS stat FROM (
  SELECT {keys}, rep, ({_draw(text, 'CAST(rep AS VARCHAR)', 'CAST(slot AS VARCHAR)')}) % n AS pos FROM (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY md5(CAST(track AS VARCHAR)), track) - 1 AS slot, count(*) OVER (PARTITION BY {keys}) AS n FROM {src} WHERE {value} IS NOT NULL) CROSS JOIN (SELECT unnest(range(1, {reps + 1})) AS rep))
  JOIN (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY md5(CAST(track AS VARCHAR)), track) - 1 AS pos FROM {src} WHERE {value} IS NOT NULL) USING ({keys}, pos) GROUP BY {keys}, rep"""


def _perm(keys: str, src: str, value: str, plus: int = 1, reps: int = REPS, stat: str = "avg") -> str:
    """(keys, n_a, n_b, diff, p); src has arm."""
    ks = [k.strip() for k in keys.split(",")]
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in ks)
    seen = f"SELECT {keys}, count(CASE WHEN arm = 'a' THEN v END) AS n_a, count(CASE WHEN arm = 'b' THEN v END) AS n_b, {stat}(CASE WHEN arm = 'a' THEN v END) - {stat}(CASE WHEN arm = 'b' THEN v END) AS diff FROM (SELECT *, {value} AS v FROM {src} WHERE {value} IS NOT NULL) GROUP BY {keys}"
    return f"""SELECT s.*, p FROM ({seen}) s LEFT JOIN (
  SELECT {keys}, (count(CASE WHEN round(abs(d), 9) >= round(abs(diff), 9) THEN 1 END) + {plus}) / ({reps} + {plus}) AS p FROM (
    SELECT {keys}, rep, {stat}(CASE WHEN r <= n_a THEN v END) - {stat}(CASE WHEN r > n_a THEN v END) AS d FROM (
      SELECT {keys}, rep, v, n_a, row_number() OVER (PARTITION BY {keys}, rep ORDER BY {_draw(text, 'CAST(rep AS VARCHAR)', 'CAST(track AS VARCHAR)')}, track) AS r
      FROM (SELECT *, {value} AS v FROM {src} WHERE {value} IS NOT NULL) JOIN ({seen}) USING ({keys}) CROSS JOIN (SELECT unnest(range(1, {reps + 1})) AS rep) WHERE n_a > 0 AND n_b > 0) GROUP BY {keys}, rep)
    JOIN ({seen}) USING ({keys}) GROUP BY {keys}) p USING ({keys})"""


def _bh(sql: str) -> str:
    return f"SELECT * EXCLUDE (q), CASE WHEN p IS NOT NULL THEN least(min(q) OVER (PARTITION BY p IS NULL ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) END AS p_adj FROM (SELECT *, p * count(p) OVER () / row_number() OVER (PARTITION BY p IS NULL ORDER BY p) AS q FROM ({sql}))"


ARMS = "(SELECT u.*, g.test, CASE WHEN is_control THEN 'b' ELSE 'a' END AS arm FROM units u JOIN (SELECT DISTINCT grp AS test FROM units WHERE NOT is_control) g ON u.is_control OR u.grp = g.test)"


@query("st1_bootstrap_reps", "units", _boot("grp", "units", "v", "median", 300), "stat")
def st1(units):
    return O.bootstrap_reps(units, ["grp"], "track", "v", 300, "median")


@query("st2_bootstrap_ci", "units", f"SELECT grp, n, point, lo, hi FROM (SELECT grp, count(v) AS n, avg(v) AS point FROM units GROUP BY 1) LEFT JOIN (SELECT grp, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM ({_boot('grp', 'units', 'v')}) GROUP BY 1) USING (grp)", "point lo hi")
def st2(units):
    return O.bootstrap_ci(units, ["grp"], "track", "v", REPS)


MATRIX = "(SELECT track, floor(time / 200.0) * 200.0 AS tbin, avg(x) AS v FROM frames WHERE x IS NOT NULL GROUP BY 1, 2)"


@query("st3_bootstrap_band", "frames", f"""SELECT tbin, point, lo, hi FROM (SELECT tbin, avg(v) AS point FROM {MATRIX} GROUP BY 1) JOIN (SELECT tbin, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (
  SELECT rep, tbin, sum(v * w) / sum(w) AS m FROM (SELECT rep, pos, count(*) AS w FROM (SELECT rep, ({_draw("'band'", 'CAST(rep AS VARCHAR)', 'CAST(slot AS VARCHAR)')}) % n AS pos FROM (SELECT row_number() OVER (ORDER BY md5(CAST(track AS VARCHAR)), track) - 1 AS slot, count(*) OVER () AS n FROM (SELECT DISTINCT track FROM {MATRIX})) CROSS JOIN (SELECT unnest(range(1, {REPS + 1})) AS rep)) GROUP BY 1, 2)
  JOIN (SELECT track, row_number() OVER (ORDER BY md5(CAST(track AS VARCHAR)), track) - 1 AS pos FROM (SELECT DISTINCT track FROM {MATRIX})) USING (pos) JOIN {MATRIX} USING (track) GROUP BY 1, 2) GROUP BY 1) USING (tbin)""", "tbin point lo hi")
def st3(frames):
    binned = frames.where("x IS NOT NULL").groupBy("track", (F.floor(F.col("time") / 200.0) * 200.0).alias("tbin")).agg(F.avg("x").alias("v"))
    return O.bootstrap_band(binned, "track", "tbin", "v", REPS)


@query("st4_permutation_test", "units", _perm("test", ARMS, "v"), "diff p")
def st4(units):
    return O.permutation_test(J.with_pooled_control(units, "grp", "is_control"), ["test"], "track", "v", "arm", REPS)


@query("st4_permutation_median", "units", _perm("test", ARMS, "v", stat="median"), "diff p")
def st4m(units):
    return O.permutation_test(J.with_pooled_control(units, "grp", "is_control"), ["test"], "track", "v", "arm", REPS, "median")


PAIRED = f"""SELECT s.*, p FROM (SELECT grp, count(d) AS n_pairs, avg(d) AS diff FROM (SELECT *, v_on - v_off AS d FROM units) WHERE d IS NOT NULL GROUP BY 1) s LEFT JOIN (
  SELECT grp, (count(CASE WHEN round(abs(f), 9) >= round(abs(diff), 9) THEN 1 END) + 1) / ({REPS} + 1) AS p FROM (
    SELECT grp, rep, avg((1 - 2 * (({_draw('grp', 'CAST(rep AS VARCHAR)', 'CAST(track AS VARCHAR)')}) % 2)) * (v_on - v_off)) AS f FROM units CROSS JOIN (SELECT unnest(range(1, {REPS + 1})) AS rep) WHERE v_on - v_off IS NOT NULL GROUP BY 1, 2)
  JOIN (SELECT grp, avg(v_on - v_off) AS diff FROM units GROUP BY 1) USING (grp) GROUP BY 1) USING (grp)"""


@query("st5_paired_test", "units", PAIRED, "diff p")
def st5(units):
    return O.paired_test(units, ["grp"], "track", "v_on", "v_off", REPS)


BINNED = "(SELECT CAST(floor(time / 200.0) AS INT) AS time_bin, track, CASE WHEN grp = 'B6VF' THEN 'b' ELSE 'a' END AS arm, avg(x) AS v FROM frames WHERE x IS NOT NULL GROUP BY 1, 2, 3)"


@query("st6_binned_test", "frames", f"SELECT *, p_adj < 0.05 AS significant FROM ({_bh('SELECT time_bin, CASE WHEN p IS NULL THEN 0 ELSE diff END AS diff, coalesce(p, 1.0) AS p FROM (' + _perm('time_bin', BINNED, 'v', 0) + ')')})", "diff p p_adj")
def st6(frames):
    binned = frames.where("x IS NOT NULL").groupBy(F.floor(F.col("time") / 200.0).cast("int").alias("time_bin"), "track", "grp").agg(F.avg("x").alias("v"))
    return O.binned_test(binned, "time_bin", "track", "v", "grp", "B6VF", REPS)


@query("st7_bh_adjust", "units", _bh("SELECT track, CASE WHEN track % 11 = 0 THEN NULL ELSE (track * 37 % 101) / 101.0 END AS p FROM units"), "p p_adj")
def st7(units):
    return O.bh_adjust(units.select("track", F.when(F.col("track") % 11 != 0, F.col("track") * 37 % 101 / 101.0).alias("p")))


PER_STIM = "(SELECT f.grp AS g, f.is_control, f.track, p.on_index, avg(x) AS v FROM frames f JOIN pulses p ON p.seq = 'long' AND f.time >= p.start_s AND f.time < p.end_s WHERE x IS NOT NULL GROUP BY ALL)"
STIM_ARMS = f"(SELECT s.*, t.test, CASE WHEN is_control THEN 'b' ELSE 'a' END AS arm FROM {PER_STIM} s JOIN (SELECT DISTINCT g AS test FROM {PER_STIM} WHERE NOT is_control) t ON s.is_control OR s.g = t.test)"


@query("st8_per_stim_tests", "frames pulses", f"SELECT *, coalesce(p_adj < 0.05, false) AS significant FROM ({_bh('SELECT * FROM (' + _perm('test, on_index', STIM_ARMS, 'v') + ') WHERE n_a >= 3 AND n_b >= 3')})", "diff p p_adj")
def st8(frames, pulses):
    rows = J.in_intervals(frames.where("x IS NOT NULL"), pulses.where("seq = 'long'").drop("seq"), how="inner")
    stim = rows.groupBy("grp", "is_control", "track", "on_index").agg(F.avg("x").alias("v"))
    return O.pooled_control_test(J.with_pooled_control(stim, "grp", "is_control"), ["test", "on_index"], "track", "v", 3, REPS)


@query("st9_on_off_tests", "units", _bh(PAIRED), "diff p p_adj")
def st9(units):
    return O.bh_adjust(O.paired_test(units, ["grp"], "track", "v_on", "v_off", REPS))


@query("st9_group_tests", "units", _bh(_perm("test", ARMS, "v")), "diff p p_adj")
def st9b(units):
    return O.bh_adjust(O.permutation_test(J.with_pooled_control(units, "grp", "is_control"), ["test"], "track", "v", "arm", REPS))


@query("x2_logistic", "frames", "SELECT recording, track, frame, 1.0 / (1 + exp(greatest(-700, least(700, -0.01 * (time - 800))))) AS p FROM frames", "p")
def x2(frames):
    return frames.select("recording", "track", "frame", S.logistic("time", 1.0, 0.01, 800.0).alias("p"))


@query("x6_effect_size", "units", "SELECT grp, avg(v_on) - avg(v_off) AS effect, max(v_on) - min(v_off) AS min_, min(v_on) - max(v_off) AS max_ FROM units GROUP BY 1", "effect min_ max_")
def x6(units):
    s = units.groupBy("grp").agg(*[f(c).alias(f"{n}_{c}") for c in ("v_on", "v_off") for n, f in (("p", F.avg), ("lo", F.min), ("hi", F.max))])
    e = S.effect_size("p_v_on", "lo_v_on", "hi_v_on", "p_v_off", "lo_v_off", "hi_v_off")
    return s.select("grp", e.alias("e")).select("grp", "e.effect", F.col("e.min").alias("min_"), F.col("e.max").alias("max_"))


@query("x25_stars", "units", "SELECT track, CASE WHEN v IS NULL THEN '' WHEN v / 1000 < 0.001 THEN '***' WHEN v / 1000 < 0.01 THEN '**' WHEN v / 1000 < 0.05 THEN '*' ELSE 'ns' END AS stars FROM units")
def x25(units):
    return units.select("track", S.stars(F.col("v") / 1000).alias("stars"))
