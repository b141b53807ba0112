"""Column expressions over scores, times and short texts."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: An English prompt's yes/no template, and the default clip tag.
YES_NO_TEMPLATE = "Does this frame show: %s? Answer yes or no."
DEFAULT_TAG = "other"


def r6(c: Column) -> Column:
    """Rounded to six decimals, for comparison between engines."""
    return F.round(c, 6)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def binary_softmax(yes: Column, no: Column) -> tuple[Column, Column]:
    m = F.greatest(yes, no)
    y, n = F.exp(yes - m), F.exp(no - m)
    return y / (y + n), n / (y + n)


def contrast(p_yes: Column, p_no: Column, power: int = 2) -> Column:
    return F.pow(F.greatest(F.lit(0.0), p_yes - p_no), F.lit(power))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def amplify(d: Column, kind: str) -> Column:
    """The difference d of two logits, boosted where the answer is clear."""
    half = F.tanh(d / 2)
    return {
        "identity": d,
        "tanh": d + 2 * half,
        "abs_tanh": d * (1 + F.abs(half)),
        "tanh2": d * (1 + half * half),
        "rational2": d * (1 + d * d / (1 + d * d)),
        "rational4": d * (1 + F.pow(d, F.lit(4.0)) / (1 + F.pow(d, F.lit(4.0)))),
    }[kind]


def minmax(x: Column, over: WindowSpec, guard: str = "epsilon") -> Column:
    """x scaled by its group's range. guard: epsilon in the denominator, or what a zero range gives: keep (x) or zero."""
    lo, hi = F.min(x).over(over), F.max(x).over(over)
    if guard == "epsilon":
        return (x - lo) / (hi - lo + 1e-8)
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(x if guard == "keep" else F.lit(0.0))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def mmss(seconds: Column, wide: bool = True) -> Column:
    """MM:SS, or M:SS."""
    s = F.floor(seconds)
    minutes, rest = F.floor(s / 60).cast("string"), F.lpad((s % 60).cast("string"), 2, "0")
    return F.concat(F.when(F.length(minutes) < 2, F.concat(F.lit("0"), minutes)).otherwise(minutes) if wide else minutes, F.lit(":"), rest)


def parse_mmss(text: Column) -> Column:
    """Seconds of the first MM:SS in a text, 0 if there is none."""
    m, s = F.regexp_extract(text, r"(\d+):(\d{2})", 1), F.regexp_extract(text, r"(\d+):(\d{2})", 2)
    return F.coalesce(F.try_multiply(m.try_cast("int"), F.lit(60)) + s.try_cast("int"), F.lit(0))


def clip_window(hit: Column, before: float, after: float, least: float) -> tuple[Column, Column]:
    """Start and end of the clip around a hit: not below 0, at least `least` long."""
    start = F.greatest(hit - before, F.lit(0.0))
    return start, F.greatest(hit + after, start + least)


def clean_caption(text: Column, words: int = 8) -> Column:
    """First line without tags, symbols beyond U+2000 and quotes; the first few words."""
    line = F.element_at(F.split(text, "\n"), 1)
    line = F.regexp_replace(F.regexp_replace(line, r"#[^ \t]+", ""), "[\\x{2000}-\\x{10FFFF}]", "")
    line = F.regexp_replace(F.trim(F.regexp_replace(line, "[ \\t]+", " ")), "^[\"' ]+|[\"' ]+$", "")
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(line, "\"", "")), " "), 1, words), " ")


def asks_yes_no(text: Column) -> Column:
    low = F.lower(text)
    return F.rlike(low, F.lit(r"(?<![a-z])yes(?![a-z])")) & F.rlike(low, F.lit(r"(?<![a-z])no(?![a-z])"))


def first_tag(text: Column, tags: list[str], default: str = DEFAULT_TAG) -> Column:
    """The first tag of an ordered list that a text contains."""
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(t)), F.lit(t)) for t in tags], F.lit(default))


def slug(text: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(text, r"[^\w \-]", "")), r"[ \-]+", "_"), 1, most)


def error_columns(p: Column, gt: Column) -> dict[str, Column]:
    return {"bias": p - gt, "abs_bias": F.abs(p - gt), "sq_error": (p - gt) * (p - gt)}


def difficulty(x: Column, low: float = 0.3, high: float = 0.7, names: tuple[str, str, str] = ("hard", "border", "easy")) -> Column:
    return F.when(x >= high, names[2]).when(x >= low, names[1]).otherwise(names[0])
