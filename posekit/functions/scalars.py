"""Column expressions: geometry, time, names, labels."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PX_TO_MM = 32.0 / 832.0

# Greek letters by name, and marks.
GREEK = {
    "α": "alpha",
    "β": "beta",
    "γ": "gamma",
    "δ": "delta",
    "ε": "epsilon",
    "ζ": "zeta",
    "η": "eta",
    "θ": "theta",
    "ι": "iota",
    "κ": "kappa",
    "λ": "lambda",
    "μ": "mu",
    "ν": "nu",
    "ξ": "xi",
    "ο": "omicron",
    "π": "pi",
    "ρ": "rho",
    "σ": "sigma",
    "τ": "tau",
    "υ": "upsilon",
    "φ": "phi",
    "χ": "chi",
    "ψ": "psi",
    "ω": "omega",
    "′": "p",
    "’": "",
    "'": "p",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distance(x1, y1, x2, y2) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.pow(col(x2) - col(x1), 2) + F.pow(col(y2) - col(y1), 2))


def logistic(t, limit: float, k: float, t0: float) -> Column:
    """limit / (1 + exp(-k (t - t0))), the exponent held to +-700."""
    return F.lit(limit) / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -k * (col(t) - t0)))))


def heading_deg(hx, hy, tx, ty) -> Column:
    """Direction from (tx, ty) to (hx, hy) in image coordinates; null for a zero-length axis."""
    dx, dy = col(hx) - col(tx), col(hy) - col(ty)
    return F.when((dx != 0) | (dy != 0), F.degrees(F.atan2(dy, dx)))


def axis_unit(hx, hy, tx, ty) -> tuple[Column, Column]:
    """Unit vector of the body axis; null for a zero-length axis."""
    dx, dy = col(hx) - col(tx), col(hy) - col(ty)
    n = F.hypot(dx, dy)
    return F.try_divide(dx, n), F.try_divide(dy, n)


def forward(vx, vy, ux, uy) -> Column:
    return col(vx) * col(ux) + col(vy) * col(uy)


def lateral(vx, vy, ux, uy) -> Column:
    return -col(vx) * col(uy) + col(vy) * col(ux)


def backward_speed(fv) -> Column:
    """max(-forward, 0)."""
    return F.when(col(fv).isNotNull(), F.greatest(-col(fv), F.lit(0.0)))


def frames_to_seconds(frame, fps: float) -> Column:
    """Whole seconds, halves to even."""
    return F.bround(col(frame) / F.lit(float(fps))).cast("long")


def seconds_to_frames(seconds, fps: float) -> Column:
    return F.bround(col(seconds) * F.lit(float(fps))).cast("long")


def seconds_to_clock(seconds) -> Column:
    """struct(h, m, s) of whole seconds."""
    s = col(seconds).cast("long")
    return F.struct(F.floor(s / 3600).alias("h"), F.floor(s % 3600 / 60).alias("m"), (s % 60).alias("s"))


def clock_to_seconds(text) -> Column:
    """Seconds of H:M:S text."""
    p = F.split(col(text), ":")
    return p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")


def effect_size(p1, lo1, hi1, p2, lo2, hi2) -> Column:
    """struct(effect, min, max): difference of points, hi1 - lo2, lo1 - hi2 (ends as the reference pins them)."""
    return F.struct((col(p1) - col(p2)).alias("effect"), (col(hi1) - col(lo2)).alias("min"), (col(lo1) - col(hi2)).alias("max"))


def circle(ax, ay, bx, by, cx, cy) -> Column:
    """struct(cx, cy, r) of the circle through three points; null if they are collinear."""
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    ux = F.try_divide(a * (by - cy) + b * (cy - ay) + c * (ay - by), d)
    uy = F.try_divide(a * (cx - bx) + b * (ax - cx) + c * (bx - ax), d)
    return F.struct(ux.alias("cx"), uy.alias("cy"), F.hypot(ax - ux, ay - uy).alias("r"))


def undo_template(x, y, width: float, height: float, template_width=96, template_height=516, padding=20, crop_top=74, crop_bottom=0) -> tuple[Column, Column]:
    """Template coordinates back to the frame: padding off, scaled to the cropped frame, crop added."""
    sx = width / (template_width - 2 * padding)
    sy = (height - crop_top - crop_bottom) / template_height
    return (col(x) - padding) * sx, col(y) * sy + crop_top


def rotate_270(x, y, width: float) -> tuple[Column, Column]:
    """(x, y) of a frame of that width turned by 270 degrees."""
    return col(y), F.lit(float(width)) - col(x)


def side_of_node(node) -> Column:
    """right, left or other, by the first letter."""
    return F.when(col(node).startswith("R"), "right").when(col(node).startswith("L"), "left").otherwise("other")


def stars(p) -> Column:
    """Significance stars; empty for a null p."""
    return F.when(col(p).isNull(), "").when(col(p) < 0.001, "***").when(col(p) < 0.01, "**").when(col(p) < 0.05, "*").otherwise("ns")


def parent(path, k: int) -> Column:
    """The k-th folder above the file; the direct folder where the path is shorter."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) > k, F.get(parts, F.size(parts) - 1 - k)).otherwise(F.get(parts, F.size(parts) - 2))


def genotype_group(folder) -> Column:
    """PG<n>, B6XOGL7, B6VF, or the name as it is."""
    up = F.upper(col(folder))
    number = F.regexp_extract(up, r"^PG_?(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("PG"), number)).when(up.contains("XOGL7"), "B6XOGL7").when(up.startswith("B6VF"), "B6VF").otherwise(col(folder))


def is_control_group(group) -> Column:
    return col(group).isin("B6XOGL7", "B6VF")


def protocol_of(folder) -> Column:
    """short for PG, long for PG_<date>, else null."""
    return F.when(col(folder) == "PG", "short").when(col(folder).rlike(r"^PG_\d{8}$"), "long")


def fly_metadata(folder) -> Column:
    """struct(genotype, sex, age) of a folder name of two to four parts joined by `_`; three parts default to age 2."""
    p = F.split(col(folder), "_")
    n = F.size(p)
    sex = F.when(F.lower(F.get(p, F.lit(1))).contains("f"), "female").otherwise("male")
    age = F.regexp_extract(col(folder), r"(\d+)d", 1).try_cast("int")
    return F.when(n.between(2, 4), F.struct(p[0].alias("genotype"), sex.alias("sex"), F.when(n == 3, F.coalesce(age, F.lit(2))).otherwise(age).alias("age")))


def fly_place(name) -> Column:
    """struct(experiment, arena, corridor) of <experiment>_arena<n>_corridor<n>; null parts if it does not match."""
    pattern = r"^(.*)_arena(\d+)_corridor(\d+)"
    pick = lambda k: F.nullif(F.regexp_extract(col(name), pattern, k), F.lit(""))
    return F.struct(pick(1).alias("experiment"), pick(2).cast("int").alias("arena"), pick(3).cast("int").alias("corridor"))


def dated_folder(folder, start: int, end: int) -> Column:
    """Whether PG_<date>_Vglut_B6VF_1min lies in [start, end]."""
    day = F.regexp_extract(col(folder), r"^PG_(\d{8})_Vglut_?B6VF_1min$", 1)
    return F.coalesce(F.nullif(day, F.lit("")).cast("int").between(start, end), F.lit(False))


def plain_name(name) -> Column:
    """ASCII: Greek letters by name, primes as p, blanks as -, parentheses and all other non-ASCII dropped."""
    out = col(name)
    for a, b in GREEK.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(out, " ()", "-"), r"[^\x00-\x7F]", "")


def left_over(name) -> Column:
    """Characters that plain_name drops without a replacement."""
    return F.regexp_replace(F.translate(col(name), "".join(GREEK), ""), r"[\x00-\x7F]", "")


def name_issues(name) -> Column:
    """What is not plain in a name: kinds, the last one with its characters."""
    odd = F.array_sort(F.array_distinct(F.split(F.regexp_replace(col(name), r"[\x00-\x7F]", ""), "")))
    odd = F.array_join(F.array_remove(odd, ""), "")
    return F.concat_ws(", ", F.when(F.contains(col(name), F.lit(" ")), "space"), F.when(col(name).rlike("[()]"), "parentheses"), F.when(odd != "", F.concat(F.lit("non-ASCII: "), odd)))


def safe_file_name(name) -> Column:
    return F.regexp_replace(col(name), r'[<>:"/\\|?*]', "_")


def renamed(name, steps: list[tuple], pattern: str = "*") -> Column:
    """struct(name, changed): ("replace", a, b), ("regex", a, b), ("prefix", a), ("suffix", a) in order, on names that match a glob."""
    out = col(name)
    for kind, *args in steps:
        if kind == "replace":
            out = F.replace(out, F.lit(args[0]), F.lit(args[1]))
        elif kind == "regex":
            out = F.regexp_replace(out, args[0], args[1])
        elif kind == "prefix":
            out = F.concat(F.lit(args[0]), out)
        elif kind == "suffix":  # before the extension
            out = F.regexp_replace(out, r"^(.*?)(\.[^.]*)?$", "$1" + re.sub(r"[\\$]", r"\\\g<0>", args[0]) + "$2")
        else:
            raise ValueError(f"unknown rename step {kind!r}")
    glob = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
    out = F.when(col(name).rlike(glob), out).otherwise(col(name))
    return F.struct(out.alias("name"), (out != col(name)).alias("changed"))


def without_date(name) -> Column:
    return F.regexp_replace(col(name), r"^\d{6,8}_", "")


def flat_name(path) -> Column:
    """Destination in one folder: a root file keeps its name, a tiff takes its top folder's, others their own; no date in front."""
    parts = F.split(col(path), "/")
    own = F.element_at(parts, -1)
    tiff = own.rlike(r"(?i)\.tiff?$")
    return without_date(F.when((F.size(parts) > 1) & tiff, F.concat(parts[0], F.regexp_extract(own, r"\.[^.]*$", 0))).otherwise(own))


def sample_label(name, n) -> Column:
    return F.concat(col(name).cast("string"), F.lit(" (n="), col(n).cast("string"), F.lit(")"))


@F.pandas_udf(DoubleType())
def angle(y: pd.Series, x: pd.Series) -> pd.Series:
    """atan2 by the C library, as SQL engines have it; Java's differs in the last bit, which decides steps of just pi."""
    return pd.Series([math.atan2(b, a) if b == b and a == a else None for b, a in zip(y, x, strict=True)], dtype="float64")


def identifier(path) -> Column:
    """date, arena and corridor lines of a path; Unknown where a part is missing.

    A date is six to eight digits at the start or the end of a folder's name;
    digits inside a name are a number of something else.
    """
    pick = lambda p: F.coalesce(F.nullif(F.regexp_extract(col(path), p, 1), F.lit("")), F.lit("Unknown"))
    return F.concat_ws("\n", pick(r"((?<![^/])\d{6,8}(?!\d)(?=[^/]*/)|(?<!\d)\d{6,8}(?=/))"), pick(r"(arena\d+)"), pick(r"(corridor\d+)"))


def padded_window(start, end, duration, pad: float = 2.0) -> Column:
    """struct(start, end) widened by pad and held to the recording."""
    return F.struct(F.greatest(F.lit(0.0), col(start) - pad).alias("start"), F.least(col(duration), col(end) + pad).alias("end"))


def contains_all(name, keywords: list[str]) -> Column:
    """All keywords occur, case ignored."""
    out = F.lit(True)
    for k in keywords:
        out = out & F.contains(F.lower(col(name)), F.lit(k.lower()))
    return out


def contains_any(name, tokens: list[str]) -> Column:
    """Some token occurs, case ignored."""
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(F.lower(col(name)), F.lit(t.lower()))
    return out


def first_number(name) -> Column:
    """The first number of a name, 0 if none."""
    return F.coalesce(F.regexp_extract(col(name), r"\d+", 0).try_cast("int"), F.lit(0))
