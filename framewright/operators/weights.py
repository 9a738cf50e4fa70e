"""Operators on tables of weights: moments, overrides, renames, groups, and merging shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Patterns of parameter names, what they end in and what takes its place; submodules of each trainable group.
RENAMES = [
    (r"^transformer\.layers\.[0-9]+\.gating\.linear_in_weight", "linear_in_weight", "linear_in.weight"),
    (r"^transformer\.layers\.[0-9]+\.gating\.linear_out_weight", "linear_out_weight", "linear_out.weight"),
    (r"^depformer\.layers\.[0-9]+\.gating\.[0-9]+\.linear_in_weight", "linear_in_weight", "linear_in.weight"),
    (r"^depformer\.layers\.[0-9]+\.gating\.[0-9]+\.linear_out_weight", "linear_out_weight", "linear_out.weight"),
    (r"^depformer\.layers\.[0-9]+\.self_attn\.out_proj_weight", "out_proj_weight", "out_proj.weight"),
]
GROUPS = {
    "tempformer": ["emb", "text_emb", "transformer", "out_norm", "text_linear"],
    "depformer": ["depformer_in", "depformer_emb", "depformer_text_emb", "depformer", "linears"],
    "text_embedding": ["text_emb", "depformer_text_emb"],
}


def embedding_mean(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(dim, mean) over the rows."""
    return vectors.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def embedding_covariance(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(i, j, cov): the population covariance of every pair of dimensions.

    Each task adds up one matrix of products around a common shift, so what is shuffled is one matrix for each task, where
    exploding pairs would make a row for each pair and vector. Rows that are null or of another length are left out.
    """
    first = vectors.where(F.col(vec).isNotNull()).select(vec).first()
    if first is None or not first[0]:
        return vectors.sparkSession.createDataFrame([], "i int, j int, cov double")
    shift, d = np.array(first[0], float), len(first[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float) - shift
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(d * d, n, np.int64)), pa.array(s[i]), pa.array(s[j]), pa.array(p.ravel())], names=["i", "j", "n", "si", "sj", "p"])

    parts = vectors.where(F.size(vec) == d).select(vec).mapInArrow(add, "i int, j int, n long, si double, sj double, p double")
    n = F.sum("n")
    return parts.groupBy("i", "j").agg((F.sum("p") / n - F.sum("si") / n * (F.sum("sj") / n)).alias("cov"))


def gaussian_rows(mean: DataFrame, covariance: DataFrame, rows: int, scale: float = 1e-5, seed: int = 0) -> DataFrame:
    """(row_id, embedding): draws from the normal distribution with this mean and ``scale`` times this covariance.

    The matrix has one row and column for each dimension; its root is made on the driver, the draws on the executors by row id.
    """
    spark = mean.sparkSession
    m = np.array([r["mean"] for r in mean.orderBy("dim").collect()])
    c = np.zeros((len(m), len(m)))
    for r in covariance.collect():
        c[r["i"], r["j"]] = r["cov"]
    value, vector = np.linalg.eigh(c * scale)
    root = vector * np.sqrt(np.maximum(value, 0))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([np.random.default_rng((seed, i)).standard_normal(len(m)) for i in batch.column(0).to_pylist()]).reshape(-1, len(m))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((m + z @ root.T).astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["row_id", "embedding"])

    return spark.range(rows).withColumnRenamed("id", "row_id").mapInArrow(draw, "row_id long, embedding array<float>")


def retain_override(fresh: DataFrame, original: DataFrame, keep_ids: list[int], key: str, value: str) -> DataFrame:
    """``fresh`` with the original value for ``keep_ids``; an id that ``fresh`` does not have is an error."""
    if keep_ids and fresh.where(F.col(key).isin(*keep_ids)).select(key).distinct().count() < len(set(keep_ids)):
        raise ValueError("an id to keep is not in the table")
    kept = original.where(F.col(key).isin(*keep_ids) if keep_ids else F.lit(False)).select(key, F.col(value).alias("__kept"))
    return fresh.join(F.broadcast(kept), key, "left").withColumn(value, F.coalesce("__kept", value)).drop("__kept")  # as many rows as ids


def renamed(names: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with new_name: the part that its pattern names gets a dot; others stay."""
    new = F.col(column)
    for pattern, old, put in reversed(RENAMES):
        new = F.when(F.col(column).rlike(pattern), F.replace(F.col(column), F.lit(old), F.lit(put))).otherwise(new)
    return names.withColumn("new_name", new)


def trainable(names: DataFrame, group: str, column: str = "name") -> DataFrame:
    """``names`` with trainable: whether the parameter's top submodule is in the group; ``all`` takes every one. A group that
    selects nothing is an error."""
    if group != "all" and group not in GROUPS:
        raise ValueError(f"unknown group {group}")
    chosen = F.lit(True) if group == "all" else F.split(column, r"\.")[0].isin(*GROUPS[group])
    out = names.withColumn("trainable", chosen)
    if out.where("trainable").isEmpty():
        raise ValueError("no parameter is left to train")
    return out


def shard_count(shards: DataFrame) -> DataFrame:
    """(ranks): how many ranks have shards."""
    return shards.agg(F.countDistinct("rank").alias("ranks"))


def check_shards(shards: DataFrame, world: int) -> None:
    """As many ranks as the run had, or an error."""
    found = shard_count(shards).first()["ranks"]
    if found != world:
        raise ValueError(f"{found} shards found, {world} expected")


def merge_flat_groups(shards: DataFrame, params: DataFrame, world: int) -> DataFrame:
    """(group, param, values): each group's shards (group, rank, values) in rank order are one run of values, cut by the running
    sizes of its params (group, param, position, numel). What is left over must be less than 2 x world values.

    A group without exactly ``world`` shards is left out whole; ``incomplete_groups`` has it.
    """
    flat = shards.groupBy("group").agg(F.count("*").alias("shards"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "values"))), lambda s: s["values"])).alias("flat"))
    cut = params.withColumn("at", F.expr("coalesce(sum(numel) OVER (PARTITION BY `group` ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).withColumn("whole", F.expr("sum(numel) OVER (PARTITION BY `group`)"))
    rows = cut.join(flat.where(F.col("shards") == world), "group")
    left = F.size("flat") - F.col("whole")
    ok = F.when((left < 0) | (left >= 2 * world), F.raise_error(F.concat(F.lit("sizes do not fit in group "), F.col("group").cast("string")))).otherwise(F.lit(True))
    return rows.where(ok).select("group", "param", F.slice("flat", (F.col("at") + 1).cast("int"), F.col("numel").cast("int")).alias("values"))


def incomplete_groups(shards: DataFrame, world: int) -> DataFrame:
    """(group, shards) of the groups that do not have ``world`` shards."""
    return shards.groupBy("group").agg(F.count("*").alias("shards")).where(F.col("shards") != world)


def merge_param_slices(shards: DataFrame, world: int, strict: bool = True) -> DataFrame:
    """(param, numel, values): every rank holds ceil(numel / world) values of each param, the last padded; joined in rank order and trimmed.

    A param without ``world`` slices, or with too few values, is an error; without ``strict`` it has the values that are there,
    and ``size(values) < numel`` or ``incomplete_groups`` tells it.
    """
    grouped = shards.groupBy("param").agg(F.max("numel").alias("numel"), F.count("*").alias("ranks"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "values"))), lambda s: s["values"])).alias("flat"))
    ok = F.when((F.col("ranks") != world) | (F.size("flat") < F.col("numel")), F.raise_error(F.concat(F.lit("slices are missing of "), F.col("param")))).otherwise(F.lit(True))
    return (grouped.where(ok) if strict else grouped).select("param", "numel", F.slice("flat", F.lit(1), F.col("numel").cast("int")).alias("values"))
