"""Ranks over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows for each range, the most ranges (bounds and counts of all are on the driver), and sampled keys for each bound.
RANGE_ROWS, MOST_RANGES, SAMPLES = 250_000, 4096, 20


def _place(edges, key):
    """How many of the sorted ``edges`` are at most ``key``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_RANGES.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(edges)) & (F.get(edges, at + step - 1) <= key), at + step).otherwise(at))


def global_rank(rows: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """(``rows`` with ``out``, their 0-based rank by ``order``, how many rows there are).

    Ranges of keys are cut at bounds from a bounded sample of keys and named by the keys alone, so a task that runs again,
    or another branch of the plan, puts every row in the same range. Each range is ranked by itself and moved by the sum of
    the ranges before it, of which the driver gets one number each. ``order`` must tell rows apart; nulls come first.
    """
    key = F.struct(*[F.col(c) for c in order])
    n = rows.count()
    parts = int(min(MOST_RANGES, max(1, n // RANGE_ROWS)))
    bounds: list = []
    if parts > 1:
        some = rows.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(parts * SAMPLES).orderBy("k").collect()
        bounds = [some[i * SAMPLES]["k"] for i in range(1, parts) if i * SAMPLES < len(some)]
    part = F.lit(0)
    if bounds:
        kind = rows.select(key.alias("k")).schema["k"].dataType
        edges = F.array(*[F.struct(*[F.lit(b[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]) for b in bounds])
        part = _place(edges, key)
    dealt = rows.withColumn("__part", part)
    before, total = ({}, 0) if bounds else ({0: 0}, n)
    if bounds:
        for r in dealt.groupBy("__part").count().orderBy("__part").collect():
            before[r["__part"]], total = total, total + r["count"]
    by = ", ".join(f"`{c}` ASC NULLS FIRST" for c in order)
    starts = [before.get(i, 0) for i in range(max(before, default=0) + 1)]
    base = F.get(F.array(*[F.lit(int(x)).cast("long") for x in starts]), F.col("__part"))
    ranked = dealt.withColumn("__rn", F.expr(f"row_number() OVER (PARTITION BY __part ORDER BY {by})"))
    return ranked.withColumn(out, (base + F.col("__rn") - 1).cast("long")).drop("__part", "__rn"), total
