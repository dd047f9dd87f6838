"""Scalar column expressions: time, text, statistics, bins and grades."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_UTC_OFFSET_H = 7
KN_MS = 0.514444


def night_of(ts: Column, offset_h: int = LOCAL_UTC_OFFSET_H) -> Column:
    """The local evening's date: hours before local noon belong to the evening before."""
    return F.to_date(ts + F.make_dt_interval(hours=F.lit(offset_h - 12)))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def week_fold(night: Column, first: Column, days: int = 7) -> Column:
    return F.floor(F.datediff(night, first) / days)


def in_utc_windows(ts: Column, windows: list[tuple[str, str]]) -> Column:
    """Time of day in any window; a window whose end is before its beginning wraps midnight."""
    t = F.date_format(ts, "HH:mm:ss")
    hit = F.lit(False)
    for a, b in windows:
        hit = hit | (t.between(a, b) if a <= b else (t >= a) | (t <= b))
    return hit


def normalise_doi(doi: Column) -> Column:
    """Lower case without one known prefix; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.when(bare != "", bare)


def normalise_title(title: Column) -> Column:
    """Lower case, tags away, anything but ASCII letters and digits to single spaces."""
    bare = F.regexp_replace(F.lower(title), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def normalise_text(text: Column) -> Column:
    """Unicode dashes to hyphens, white space to single spaces."""
    dashes = "‐‑‒–—−"
    return F.trim(F.regexp_replace(F.translate(text, dashes, "-" * len(dashes)), r"\s+", " "))


def issn_check_digit(seven: Column) -> Column:
    """Check character of the first seven digits: weights 8 to 2 modulo 11."""
    total = sum((F.substring(seven, i + 1, 1).cast("int") * (8 - i) for i in range(7)), F.lit(0))
    rest = (11 - total % 11) % 11
    return F.when(rest == 10, "X").otherwise(rest.cast("string"))


def title_year_key(title: Column, year: Column) -> Column:
    return F.concat_ws("|", normalise_title(title), year.cast("string"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; null without trials."""
    p, d = k / n, 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def sql_wilson(k: str, n: str, sign: str, z: float = 1.96) -> str:
    d = f"(1 + {z * z}::DOUBLE / {n})"
    return f"CASE WHEN {n} > 0 THEN (({k})::DOUBLE / {n} + {z * z}::DOUBLE / (2 * {n})) / {d} {sign} {z}::DOUBLE * sqrt(({k})::DOUBLE / {n} * (1 - ({k})::DOUBLE / {n}) / {n} + {z * z}::DOUBLE / (4 * {n} * {n})) / {d} END"


def log_factorial(n: Column) -> Column:
    """ln n! by the series in 1 / n, shifted so that it holds to rounding for every n."""
    x = n.cast("double") + 10  # ln (n + 9)! by the series, then the nine factors away
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    extra = sum((F.log(n.cast("double") + i) for i in range(1, 10)), F.lit(0.0))
    return series - extra


def poisson_cdf(k: Column, mean: Column, deviations: float = 40.0) -> Column:
    """P(X <= k): the sum of its terms. Terms more than so many standard deviations from the mean are below any rounding and left out, so the sum stays short for large counts."""
    far = deviations * F.sqrt(mean) + deviations
    first, last = F.greatest(F.lit(0), F.floor(mean - far)), F.least(k, F.ceil(mean + far))
    start = first * F.log(mean) - mean - log_factorial(first)
    total = F.aggregate(
        F.sequence(first, F.greatest(first, last)),
        F.struct(F.lit(0.0).alias("s"), start.alias("t")),
        lambda a, i: F.struct((a["s"] + F.exp(a["t"])).alias("s"), (a["t"] + F.log(mean / (i + 1))).alias("t")),
        lambda a: a["s"],
    )
    return F.when(mean <= 0, F.lit(1.0)).when(last < first, F.lit(0.0)).otherwise(F.least(total, F.lit(1.0)))


def poisson_deviance(count: Column, expected: Column) -> Column:
    return 2 * (F.when(count > 0, count * F.log(count / expected)).otherwise(0.0) - (count - expected))


def length_bin(x: Column, edges: list[float], closed: str = "left") -> Column:
    """Label ``a-b`` of the bin that holds x; ``closed`` names the side that counts; null outside."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:], strict=False):
        hit = (x >= a) & (x < b) if closed == "left" else (x > a) & (x <= b)
        out = F.when(hit, f"{a:g}-{b:g}").otherwise(out)
    return out


def sql_bin(x: str, edges: list[float], closed: str = "left") -> str:
    lo, hi = (">=", "<") if closed == "left" else (">", "<=")
    return "CASE " + " ".join(f"WHEN {x} {lo} {a} AND {x} {hi} {b} THEN '{a:g}-{b:g}'" for a, b in zip(edges, edges[1:], strict=False)) + " END"


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def match_grade(distance_m: Column, dt_s: Column, ratio: Column) -> Column:
    """Pair quality: high, medium or low; an unknown length ratio does not count against a pair."""
    fits = lambda a, b: ratio.isNull() | ratio.between(a, b)
    return F.when((distance_m <= 500) & (dt_s <= 300) & fits(0.4, 3.0), "high").when((distance_m <= 1000) & (dt_s <= 900) & fits(0.25, 4.0), "medium").otherwise("low")


def silence_grade(hours: Column) -> Column:
    return F.when(hours < 12, "silence").when(hours <= 72, "extended").when(hours.isNotNull(), "prolonged")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def mid_of(mmsi: Column) -> Column:
    """Maritime identification digits of a ship station, else null."""
    return F.when(mmsi.between(201000000, 775999999), F.floor(mmsi / 1000000))


def covariates(scr_vv: Column, scr_vh: Column, n_pixels: Column, length_m: Column, pol_class: Column, pixel_m: float = 10.0) -> dict[str, Column]:
    """The stronger channel's contrast, the width that the pixels fill at this length, and whether both channels saw it; null where an input is missing."""
    return {"scr_max": F.greatest(scr_vv, scr_vh), "fill_width": F.when(length_m > 0, n_pixels * pixel_m * pixel_m / length_m), "dual": F.when(pol_class.isNotNull(), (pol_class == "VV+VH").cast("int"))}


def presence(value: Column) -> Column:
    """Whether there is any; unknown stays unknown."""
    return F.when(value.isNotNull(), value > 0)


def clean_number(x: Column) -> Column:
    """NaN and the infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean_text(x: Column) -> Column:
    """Trimmed text; empty text and the words for nothing as null."""
    bare = F.trim(x)
    return F.when(~F.lower(bare).isin("", "none", "nan", "nat", "null", "<na>"), bare)


def clean_bool(x: Column) -> Column:
    """A truth value from text or numbers; null if it is neither."""
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low.isin("true", "1", "1.0", "yes"), True).when(low.isin("false", "0", "0.0", "no"), False)


def json_list(x: Column) -> Column:
    """A list of texts from JSON; empty if it is not one."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))
