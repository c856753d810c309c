"""Zero-phase recursive low-pass filters.

The recursion runs along a series, but its state is linear in what it began
with: a long series is cut into chunks that many tasks filter, and only the
states between chunks are put in order. Missing values are filled linearly
first; series not longer than the padding come back unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posekit.functions.windows import interpolated_columns
from posekit.operators.ranks import joined
from posekit.sources.io import written


def _digital(poles: np.ndarray, gain: float, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear transform of an analog all-pole low-pass with edge at cutoff (1 = half the sample rate)."""
    warped = 4.0 * np.tan(np.pi * cutoff / 2.0)
    p = poles * warped
    k = gain * warped ** len(p)
    z = (4.0 + p) / (4.0 - p)
    k = k * np.real(1.0 / np.prod(4.0 - p))
    return np.real(k * np.poly(-np.ones(len(p)))), np.real(np.poly(z))


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a Butterworth low-pass."""
    m = np.arange(-order + 1, order, 2)
    return _digital(-np.exp(1j * np.pi * m / (2 * order)), 1.0, cutoff)


def chebyshev1(order: int, ripple_db: float, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a Chebyshev low-pass with a pass-band ripple in decibels."""
    eps = np.sqrt(10 ** (0.1 * ripple_db) - 1.0)
    mu = np.arcsinh(1.0 / eps) / order
    theta = np.pi * np.arange(-order + 1, order, 2) / (2 * order)
    poles = -np.sinh(mu + 1j * theta)
    gain = np.real(np.prod(-poles))
    if order % 2 == 0:
        gain /= np.sqrt(1.0 + eps**2)
    return _digital(poles, gain, cutoff)


BLOCK = 64


@lru_cache(maxsize=32)
def _blocks(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """State-space matrices of BLOCK samples: output from state and input, next state from state and input."""
    n = len(a) - 1
    step = np.zeros((n, n))
    step[:, 0] = -np.array(a[1:])
    step[:-1, 1:] += np.eye(n - 1)
    push = np.array(b[1:]) - np.array(a[1:]) * b[0]
    powers = [np.eye(n)]
    for _ in range(BLOCK):
        powers.append(powers[-1] @ step)
    out_state = np.array([p[0] for p in powers[:BLOCK]])
    response = np.array([b[0], *[(powers[k] @ push)[0] for k in range(BLOCK - 1)]])
    out_input = np.array([[response[r - c] if r >= c else 0.0 for c in range(BLOCK)] for r in range(BLOCK)])
    next_input = np.array([powers[BLOCK - 1 - k] @ push for k in range(BLOCK)]).T
    return out_state, out_input, powers[BLOCK], next_input


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The filter over a series, BLOCK samples at a time."""
    out_state, out_input, next_state, next_input = _blocks(tuple(b.tolist()), tuple(a.tolist()))
    n = len(x)
    blocks = np.concatenate([x, np.zeros(-n % BLOCK)]).reshape(-1, BLOCK)
    out, fed, pushed = np.empty_like(blocks), blocks @ out_input.T, blocks @ next_input.T
    for k in range(len(blocks)):
        out[k] = out_state @ state + fed[k]
        state = next_state @ state + pushed[k]
    return out.reshape(-1)[:n]


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State for which a constant input of 1 gives a constant output."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward pass with odd extension at both ends."""
    pad = 3 * len(a)
    if len(x) <= pad:
        return x
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    zi = _steady(b, a)
    once = _run(b, a, ext, zi * ext[0])[::-1]
    return _run(b, a, once, zi * once[0])[::-1][pad:-pad]


#: Samples of a longer series that one row and task holds.
CHUNK = 65_536


def _companion(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and input vector of one step of the state."""
    n = len(a) - 1
    step = np.zeros((n, n))
    step[:, 0] = -np.asarray(a[1:])
    step[:-1, 1:] += np.eye(n - 1)
    return step, np.asarray(b[1:]) - np.asarray(a[1:]) * b[0]


def _end_state(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state behind a series."""
    _, _, next_state, next_input = _blocks(tuple(b.tolist()), tuple(a.tolist()))
    step, push = _companion(b, a)
    full = len(x) // BLOCK * BLOCK
    for pushed in x[:full].reshape(-1, BLOCK) @ next_input.T:
        state = next_state @ state + pushed
    for v in x[full:]:
        state = step @ state + push * v
    return state


def _chunked(df: DataFrame, keys: list[str], order_by: str, column: str, chunk: int) -> DataFrame:
    """One row a chunk: keys, _c, _n (samples of the series), _at and _x (arrays in order). Gaps are filled."""
    w = Window.partitionBy(*keys).orderBy(order_by)
    rows = df.select(*keys, order_by, F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("_v"))
    rows = interpolated_columns(rows, {"_v": "_f"}, w).withColumns({"_p": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    packed = rows.groupBy(*keys, "_n", F.floor(F.col("_p") / chunk).alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_p", F.col(order_by).alias("o"), F.col("_v").alias("v"), F.col("_f").alias("f")))).alias("_s"))
    field = lambda name: F.transform("_s", lambda s: s[name])
    return packed.select(*keys, "_n", "_c", field("o").alias("_at"), field("v").alias("_raw"), field("f").alias("_x"))


def _mapped(df: DataFrame, f: Callable[..., list], columns: list[str], out: str, kind: str = "array<double>") -> DataFrame:
    """df with one more column, made row by row from arrays of it."""
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [f(*row) for row in zip(*[pdf[c] for c in columns], strict=True)]})

    return df.mapInPandas(run, f"{fields}, `{out}` {kind}")


def _states(ends: DataFrame, keys: list[str], b: np.ndarray, a: np.ndarray, backward: bool) -> DataFrame:
    """(keys, _c, _state): the state that each chunk begins with, from the states that all leave when they begin with nothing.

    ends has a row a chunk: _c, _len, _z, and _edge: of the forward pass the
    first samples (chunk 0) or the last ones, of the backward pass the state to start with.
    """
    step, _ = _companion(b, a)
    zi, pad = _steady(b, a), 3 * len(a)
    kinds = dict(ends.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_c", ascending=not backward)
        first = np.asarray(pdf["_edge"].iloc[0], float)
        if backward:
            state = first
        else:
            lead = 2 * first[0] - first[pad:0:-1]
            state = _end_state(b, a, lead, zi * lead[0])
        begins = []
        for n, z in zip(pdf["_len"], pdf["_z"], strict=True):
            begins.append(state.tolist())
            state = np.linalg.matrix_power(step, int(n)) @ state + np.asarray(z, float)
        out = pdf[[*keys, "_c"]].assign(_state=begins, _turn=[None] * len(pdf))
        if not backward:  # behind the last sample the extension runs on and back again
            last = np.asarray(pdf["_edge"].iloc[-1], float)
            tail = _run(b, a, 2 * last[-1] - last[-2 : -pad - 2 : -1], state)[::-1]
            turned = _end_state(b, a, tail, zi * tail[0]).tolist()
            out["_turn"] = [turned] * len(out)
        return out

    fields = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "_c"])
    return ends.groupBy(*keys).applyInPandas(run, f"{fields}, _state array<double>, _turn array<double>")


def _by_scan(chunks: DataFrame, keys: list[str], b: np.ndarray, a: np.ndarray) -> DataFrame:
    """Chunks of long series with _y: each is filtered from nothing for the state that it leaves, states are carried on from chunk to chunk, and each is filtered again from its own."""
    pad, zero = 3 * len(a), np.zeros(len(a) - 1)
    first, last = F.slice("_x", 1, pad + 1), F.slice("_x", F.greatest(F.size("_x") - pad, F.lit(1)), F.lit(pad + 1))
    left = _mapped(chunks.select(*keys, "_c", "_x"), lambda x: _end_state(b, a, np.asarray(x, float), zero).tolist(), ["_x"], "_z")
    left = left.select(*keys, "_c", F.size("_x").alias("_len"), "_z", F.when(F.col("_c") == 0, first).otherwise(last).alias("_edge"))
    begun = joined(chunks, _states(left, keys, b, a, False), [*keys, "_c"])
    once = written(_mapped(begun, lambda x, s: _run(b, a, np.asarray(x, float), np.asarray(s, float)).tolist(), ["_x", "_state"], "_once").drop("_state", "_x"), "forward")
    back = _mapped(once.select(*keys, "_c", "_once", "_turn"), lambda y: _end_state(b, a, np.asarray(y, float)[::-1], zero).tolist(), ["_once"], "_z")
    back = back.select(*keys, "_c", F.size("_once").alias("_len"), "_z", F.col("_turn").alias("_edge"))
    turned = joined(once.drop("_turn"), _states(back, keys, b, a, True).drop("_turn"), [*keys, "_c"])
    return _mapped(turned, lambda y, s: _run(b, a, np.asarray(y, float)[::-1], np.asarray(s, float))[::-1].tolist(), ["_once", "_state"], "_y")


def low_pass(df: DataFrame, keys: list[str], order_by: str, column: str, b: np.ndarray, a: np.ndarray, out: str = "filtered", chunk: int | None = None) -> DataFrame:
    """Adds the filtered column to (keys, order_by, column).

    A series of up to CHUNK samples is one row, and many of them are filtered in
    a batch. A longer one is cut: its chunks are filtered by many tasks, twice
    each way, with a few numbers carried from one to the next.
    """
    chunk = max(chunk or CHUNK, 3 * len(a) + 2)
    rows = written(_chunked(df, keys, order_by, column, chunk), "series")

    def whole(x: np.ndarray) -> list:
        x = np.asarray(x, float)
        return zero_phase(b, a, x).tolist() if not np.isnan(x).any() else x.tolist()

    short, long = rows.where(F.col("_n") <= chunk), rows.where(F.col("_n") > chunk)
    done = _mapped(short, whole, ["_x"], "_y").select(*keys, "_at", "_raw", "_y").unionByName(_by_scan(_even(long, keys, chunk, 3 * len(a) + 1), keys, b, a).select(*keys, "_at", "_raw", "_y"))
    flat = done.select(*keys, F.explode(F.arrays_zip("_at", "_raw", "_y")).alias("s"))
    return flat.select(*keys, F.col("s._at").alias(order_by), F.col("s._raw").alias(column), F.nanvl("s._y", F.lit(None).cast("double")).alias(out))


def _even(long: DataFrame, keys: list[str], chunk: int, least: int) -> DataFrame:
    """Chunks whose last one, if it has fewer than `least` samples, is joined to the one before."""
    rest = F.col("_n") % chunk
    last = F.floor((F.col("_n") - 1) / chunk)
    merged = (rest > 0) & (rest < least)
    to = F.when(merged & (F.col("_c") == last), F.col("_c") - 1).otherwise(F.col("_c"))
    rows = long.withColumns({"_c2": to, "_piece": F.struct("_c", "_at", "_raw", "_x")}).groupBy(*keys, "_n", F.col("_c2").alias("_c")).agg(F.array_sort(F.collect_list("_piece")).alias("_l"))
    flat = lambda name: F.flatten(F.transform("_l", lambda p: p[name])).alias(name)
    return rows.select(*keys, "_n", "_c", flat("_at"), flat("_raw"), flat("_x"))
