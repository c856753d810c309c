"""Window expressions over a track: fills, smoothing, derivatives, bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)
PAST = (Window.unboundedPreceding, Window.currentRow)
AHEAD = (Window.currentRow, Window.unboundedFollowing)


def forward_fill(x: Column, w: WindowSpec) -> Column:
    """The last value seen; a leading gap takes the first later one."""
    return F.coalesce(F.last(x, ignorenulls=True).over(w.rowsBetween(*PAST)), F.first(x, ignorenulls=True).over(w.rowsBetween(*WHOLE)))


def interpolated_columns(df: DataFrame, columns: dict[str, str], w: WindowSpec) -> DataFrame:
    """df with new columns (by the old one's name): gaps filled linearly, ends by the nearest value. One pass for all."""
    df = df.withColumn("_i", F.row_number().over(w))
    past, ahead = w.rowsBetween(*PAST), w.rowsBetween(*AHEAD)
    found, filled = {}, {}
    for k, (c, out) in enumerate(columns.items()):
        x = F.col(c)
        at = F.when(x.isNotNull(), F.col("_i"))
        found |= {
            f"_x0_{k}": F.last(x, ignorenulls=True).over(past), f"_i0_{k}": F.last(at, ignorenulls=True).over(past),
            f"_x1_{k}": F.first(x, ignorenulls=True).over(ahead), f"_i1_{k}": F.first(at, ignorenulls=True).over(ahead),
        }
        x0, i0, x1, i1 = (F.col(f"_{n}_{k}") for n in ("x0", "i0", "x1", "i1"))
        filled[out] = F.coalesce(x, x0 + (x1 - x0) * F.try_divide(F.col("_i") - i0, i1 - i0), x0, x1)
    return df.withColumns(found).withColumns(filled).drop("_i", *found)


def interpolated(df: DataFrame, column: str, w: WindowSpec, out: str) -> DataFrame:
    """df with column `out`: gaps of `column` filled linearly, ends by the nearest value."""
    return interpolated_columns(df, {column: out}, w)


def fit_rows(window: int, order: int) -> list[list[float]]:
    """By power r: the weights of a window's values that give the coefficient of t^r of the least-squares polynomial, t from the centre."""
    h = window // 2
    xs = [k - h for k in range(window)]
    m = order + 1
    out = []
    for power in range(m):
        a = [[float(sum(x ** (r + c) for x in xs)) for c in range(m)] for r in range(m)]
        want = [float(r == power) for r in range(m)]
        for p in range(m):  # solve a * s = want
            q = max(range(p, m), key=lambda r: abs(a[r][p]))
            a[p], a[q], want[p], want[q] = a[q], a[p], want[q], want[p]
            for r in range(p + 1, m):
                f = a[r][p] / a[p][p]
                a[r] = [u - f * v for u, v in zip(a[r], a[p], strict=True)]
                want[r] -= f * want[p]
        s = [0.0] * m
        for p in reversed(range(m)):
            s[p] = (want[p] - sum(a[p][c] * s[c] for c in range(p + 1, m))) / a[p][p]
        out.append([sum(s[r] * x**r for r in range(m)) for x in xs])
    return out


def fit_weights(window: int, order: int, offset: int, derivative: int = 0) -> list[float]:
    """Weights of a window's values for the least-squares polynomial (or its first derivative) at an offset from the centre."""
    rows = fit_rows(window, order)
    at = [offset**r if derivative == 0 else (r * offset ** (r - 1) if r else 0) for r in range(order + 1)]
    return [sum(t * row[k] for t, row in zip(at, rows, strict=True)) for k in range(window)]


def savgol_columns(df: DataFrame, columns: dict[str, str], keys: list[str], order_by: str, window: int, order: int, derivative: int = 0) -> DataFrame:
    """Savitzky-Golay smoothing with polynomial edges of columns without gaps; new columns by the old one's name.

    A row takes the polynomial of its centred window at the centre. Rows at the
    ends take that of the first or last full window, off its centre: only its
    coefficients reach them. Series shorter than the window give null.
    """
    if window % 2 == 0 or order >= window:
        raise ValueError("window must be odd and longer than the order")
    h = window // 2
    w, whole = Window.partitionBy(*keys).orderBy(order_by), Window.partitionBy(*keys)
    df = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    i, last = F.col("_i"), F.col("_n") - 1 - h
    df = df.withColumns({f"_v{k}": F.collect_list(F.col(c)).over(w.rowsBetween(-h, h)) for k, c in enumerate(columns)})
    rows = [F.array(*[F.lit(v) for v in row]) for row in fit_rows(window, order)]
    dot = lambda v, row: F.aggregate(F.zip_with(v, row, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    inner = F.col("_i").between(h, F.col("_n") - 1 - h)
    coefficients = {f"_c{k}_{r}": F.when(inner if r == derivative else (i == h) | (i == last), dot(f"_v{k}", row)) for k in range(len(columns)) for r, row in enumerate(rows)}
    df = df.withColumns(coefficients)
    ends = {f"{name}_{side}": F.max(F.when(i == at, F.col(name))).over(whole) for name in coefficients for side, at in (("a", F.lit(h)), ("z", last))}
    df = df.withColumns(ends)

    def edge(k: int, side: str, t) -> Column:
        c = [F.col(f"_c{k}_{r}_{side}") for r in range(order + 1)]
        terms = [c[r] * F.pow(t, F.lit(r)) for r in range(order + 1)] if derivative == 0 else [r * c[r] * F.pow(t, F.lit(r - 1)) for r in range(1, order + 1)]
        return sum(terms[1:], terms[0])

    value = lambda k: F.when(inner, F.col(f"_c{k}_{derivative}")).when(i < h, edge(k, "a", i - h)).otherwise(edge(k, "z", i - last))
    return df.withColumns({out: F.when(F.col("_n") >= window, value(k)) for k, out in enumerate(columns.values())}).drop("_i", "_n", *coefficients, *ends, *[f"_v{k}" for k in range(len(columns))])


def savgol(df: DataFrame, column: str, keys: list[str], order_by: str, window: int, order: int, out: str, derivative: int = 0) -> DataFrame:
    """Savitzky-Golay smoothing of one column."""
    return savgol_columns(df, {column: out}, keys, order_by, window, order, derivative)


def gram_polynomials(t: Column, m: Column, order: int) -> list[Column]:
    """Discrete orthogonal polynomials of degree 0 to order on the points -m to m, at t, by their three-term recurrence."""
    out = [F.lit(1.0), F.try_divide(t.cast("double"), m)]
    for r in range(2, order + 1):
        scale = r * (2 * m - r + 1)
        out.append(F.try_divide(2.0 * (2 * r - 1) * t * out[-1] - (r - 1.0) * (2 * m + r) * out[-2], scale))
    return out[: order + 1]


def gram_norms(m: Column, order: int) -> list[Column]:
    """What a fit multiplies the moments of those polynomials by."""
    falling = lambda x, k: math.prod([x - j for j in range(k)], start=F.lit(1.0))
    return [(2 * r + 1) * F.try_divide(falling(2 * m, r), falling(2 * m + r + 1, r + 1)) for r in range(order + 1)]


def clamped_columns(df: DataFrame, columns: dict[str, str], keys: list[str], order_by: str, window: int, order: int) -> DataFrame:
    """Savitzky-Golay of series shorter than the window, by the widest odd window that fits them; else null.

    Such a series holds one window, or two if its length is even: its first
    values and its last. A fit is a few moments of the window, and a row takes
    the fit of its window at its place, so there are no tables of weights.
    """
    w, whole = Window.partitionBy(*keys).orderBy(order_by), Window.partitionBy(*keys)
    df = df.withColumns({"_n": F.count("*").over(whole), "_i": F.row_number().over(w) - 1})
    df = df.withColumn("_h", F.floor((F.col("_n") - 1) / 2))
    centre = {"a": F.col("_h"), "z": F.col("_n") - 1 - F.col("_h")}
    powers = [f"_p{side}{r}" for side in centre for r in range(order + 1)]
    df = df.withColumns(dict(zip(powers, [p for c in centre.values() for p in gram_polynomials(F.col("_i") - c, F.col("_h"), order)], strict=True)))
    inside = {side: F.abs(F.col("_i") - c) <= F.col("_h") for side, c in centre.items()}
    moments = {f"_m{side}{r}_{k}": F.sum(F.when(inside[side], F.col(f"_p{side}{r}") * F.col(c))).over(whole) for side in centre for r in range(order + 1) for k, c in enumerate(columns)}
    df = df.withColumns(moments)
    norms = gram_norms(F.col("_h"), order)
    fit = lambda side, k: sum((norms[r] * F.col(f"_p{side}{r}") * F.col(f"_m{side}{r}_{k}") for r in range(1, order + 1)), norms[0] * F.col(f"_m{side}0_{k}"))
    fits = (F.col("_n") < window) & (2 * F.col("_h") + 1 > order)
    value = lambda k: F.when(fits, F.when(F.col("_i") <= F.col("_h"), fit("a", k)).otherwise(fit("z", k)))
    return df.withColumns({out: value(k) for k, out in enumerate(columns.values())}).drop("_n", "_i", "_h", *powers, *moments)


def moving_average_columns(df: DataFrame, columns: dict[str, str], keys: list[str], order_by: str, window: int) -> DataFrame:
    """Savitzky-Golay of order 1 (or 0): interior rows are plain moving averages, edges lie on the line of the first or last window."""
    h = window // 2
    w, whole = Window.partitionBy(*keys).orderBy(order_by), Window.partitionBy(*keys)
    df = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    frame = w.rowsBetween(-h, h)
    i, last = F.col("_i"), F.col("_n") - 1 - h
    s2 = float(sum(k * k for k in range(-h, h + 1))) or 1.0
    sums = {f"_m{k}": F.avg(c).over(frame) for k, c in enumerate(columns)} | {f"_r{k}": F.sum(F.col(c) * i).over(frame) for k, c in enumerate(columns)}
    df = df.withColumns(sums)
    slope = lambda k: (F.col(f"_r{k}") - i * window * F.col(f"_m{k}")) / s2
    ends = {f"_{name}{k}_{side}": F.max(F.when(i == at, x)).over(whole) for k in range(len(columns)) for name, x in (("m", F.col(f"_m{k}")), ("b", slope(k))) for side, at in (("a", F.lit(h)), ("z", last))}
    df = df.withColumns(ends)
    edge = lambda k, side, t: F.col(f"_m{k}_{side}") + F.col(f"_b{k}_{side}") * t
    value = lambda k: F.when(i.between(h, last), F.col(f"_m{k}")).when(i < h, edge(k, "a", i - h)).otherwise(edge(k, "z", i - last))
    return df.withColumns({out: F.when(F.col("_n") >= window, value(k)) for k, out in enumerate(columns.values())}).drop("_i", "_n", *sums, *ends)


def moving_average(df: DataFrame, column: str, keys: list[str], order_by: str, window: int, out: str) -> DataFrame:
    """Moving average of one column."""
    return moving_average_columns(df, {column: out}, keys, order_by, window)


def gradient(x: Column, w: WindowSpec) -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    return F.when(first & last, F.lit(None).cast("double")).when(first, after - x).when(last, x - before).otherwise((after - before) / 2)


def unwrapped(df: DataFrame, column: str, keys: list[str], order_by: str, out: str) -> DataFrame:
    """Angles (radians) with jumps beyond pi taken out, over the rows that have one; other rows stay null."""
    w = Window.partitionBy(*keys, F.col(column).isNull()).orderBy(order_by)
    step = F.col(column) - F.lag(column).over(w)
    over = lambda s: F.ceil((s - math.pi) / (2 * math.pi))  # noqa: E731  at least 1 of a step the least beyond pi
    turns = F.when(step > math.pi, over(step)).when(step < -math.pi, -over(-step))
    df = df.withColumn("_t", F.coalesce(turns, F.lit(0)))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.col(column) - 2 * math.pi * F.sum("_t").over(w.rowsBetween(*PAST)))).drop("_t")


def running_total(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(w.rowsBetween(*PAST))


def rolling_median(x: Column, w: WindowSpec, window: int = 5) -> Column:
    """Centred median of full windows, null elsewhere."""
    h = window // 2
    frame = w.rowsBetween(-h, h)
    return F.when(F.count(x).over(frame) == window, F.percentile(x, F.lit(0.5)).over(frame))


def fill_back_then_forward(df: DataFrame, column: str, w: WindowSpec, out: str) -> DataFrame:
    x = F.col(column)
    return df.withColumn(out, F.coalesce(F.first(x, ignorenulls=True).over(w.rowsBetween(*AHEAD)), F.last(x, ignorenulls=True).over(w.rowsBetween(*PAST))))


def equal_bins(df: DataFrame, column: str, bins: int, out: str) -> DataFrame:
    """Right-closed equal-width bins over the column's whole range, numbered from 0; the least value is in bin 0."""
    limits = df.agg(F.min(column).alias("_mn"), F.max(column).alias("_mx"))
    x, mn, mx = F.col(column), F.col("_mn"), F.col("_mx")
    code = F.greatest(F.ceil((x - mn) / (mx - mn) * bins) - 1, F.lit(0))
    code = F.when(mn == mx, F.lit((bins - 1) // 2)).otherwise(code)  # one value: the middle bin
    return df.join(F.broadcast(limits)).withColumn(out, F.when(x.isNotNull(), code.cast("int"))).drop("_mn", "_mx")


def edge_bins(x: Column, edges: list[float]) -> Column:
    """Bin of (edge k, edge k+1], from 0; null outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        out = F.when((x > edges[k]) & (x <= edges[k + 1]), F.lit(k)).otherwise(out)
    return out
