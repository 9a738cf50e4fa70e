"""Column functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_div(x: Column, y: Column | int) -> Column:
    """The least whole number that is not below x / y, for whole numbers x >= 0 and y > 0."""
    y = F.lit(y) if isinstance(y, int) else y
    return F.floor((x + y - 1) / y).cast("long")


def frame_index(seconds: Column, width: float) -> Column:
    """Float floor-division of non-negative ``seconds`` by ``width``: the remainder is taken first, as dividing rounds up near borders."""
    w = F.lit(float(width))
    return F.round((seconds - seconds % w) / w).cast("int")


def frame_count(last_end: Column, rate: float) -> Column:
    """Frames of a grid that ends a second after ``last_end``; 0 without one."""
    return F.coalesce(((last_end + 1) * F.lit(float(rate))).cast("int"), F.lit(0))


def audio_frames(samples: Column, sample_rate: int, frame_rate: float) -> Column:
    """How many frames a codec makes of so many samples: a last partial frame counts."""
    return F.ceil(samples / F.lit(sample_rate / frame_rate)).cast("long")


def strip_any(word: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(word, r"(?U)^\s+|(?U)\s+$", "")


def checksum(values: Column, before: Column | int = 0) -> Column:
    """Sum of value times 1-based position, a fingerprint of an array's content and order. Pieces of an array, each with how many
    values come ``before`` it, sum to the array's."""
    weighted = F.transform(values, lambda v, i: v.cast("long") * (i + (before + 1)))
    return F.aggregate(weighted, F.lit(0).cast("long"), lambda a, x: a + x)


def natural_key(text: Column) -> Column:
    """A sort key in which runs of digits compare as numbers (of up to 38 digits; then by length)."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(short(p)).cast("string"), 6, "0"), short(p))).otherwise(p)), "\x00")


def log_sum_exp(logits: Column) -> Column:
    m = F.array_max(logits)
    return m + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def cross_entropy(logits: Column, label: Column, ignore: int) -> Column:
    """Negative log-likelihood of ``label`` (0-based); 0 where it is ``ignore``."""
    return F.when(label == ignore, F.lit(0.0)).otherwise(log_sum_exp(logits) - F.get(logits, label))


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def even_sizes(n: Column, parts: Column, part: Column) -> tuple[Column, Column]:
    """(offset, size) of 0-based ``part`` when n is cut in ``parts``: the first n mod parts get one more."""
    base, rest = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    return (part * base + F.least(part, rest)).cast("int"), (base + (part < rest).cast("int")).cast("int")
