"""Connected components of a table of links, by rounds of star joins that never gather a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import shared_dir

MAX_ROUNDS = 60


#: Joins go by a number that stands for the node, not by the node that the minima are grouped by. So they have exchanges of their
#: own, whose large partitions, a hub's links, Spark can split; else they stand behind the sums and cannot be.
_MIX = 0x5DEECE66D1234567


def _stands_for(node: str):
    return F.col(node).bitwiseXOR(F.lit(_MIX))


def _with_minimum(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` (u, v) with ``m`` of ``least`` (u, m)."""
    return links.withColumn("at", _stands_for("u")).join(least.select(_stands_for("u").alias("at"), "m"), "at").select("u", "v", "m")


def _with_least(links: DataFrame) -> DataFrame:
    """Both directions of ``links`` with the least of each node and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def _large_star(links: DataFrame) -> DataFrame:
    return _with_least(links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself move to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_minimum(down, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: each node has one link down at most, to a node that has none."""
    if not links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return links.select("u").join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component) of every node that has a link: ``component`` is the least node it reaches.

    Alternating large-star and small-star rounds: each replaces links by links to the least neighbour, and joins links with
    one minimum per node; minima are pre-aggregated, and the join can split a hub's links. Rounds end when the links are
    stars, which often they are at once. Each round is written by checkpoint() to the shared folder. Self-links and nulls are
    ignored; an empty table has no rows.
    """
    shared_dir(links.sparkSession)
    now = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        now = _small_star(_large_star(now)).distinct().checkpoint()
    else:
        raise RuntimeError("the links did not settle")
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
