"""Parquet scans and sinks of merged dialogues and generated tokens, and the settings file of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import StreamConfig
from ..operators.ranking import global_rank
from ..operators.streams import undelay_streams


def read_splits(spark: SparkSession, splits: dict[str, list[str]], schema: str | T.StructType | None = None) -> dict[str, DataFrame]:
    """One table for each named split, of all files that its patterns match."""
    reader = spark.read.schema(schema) if schema else spark.read
    return {name: reader.parquet(*patterns) for name, patterns in splits.items()}


def with_chunk(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``df`` with the 0-based number of its file when each file has exactly ``rows`` rows in the order of ``key``.

    Ranks are made range by range, without one task seeing all rows.
    """
    ranked, _ = global_rank(df, [key], "__n")
    return ranked.withColumn("chunk", F.floor(F.col("__n") / rows).cast("int")).drop("__n")


def write_chunks(df: DataFrame, path: str, rows: int = 100_000, key: str = "dialogue_id", exact: bool = False) -> None:
    """Parquet files of at most ``rows`` rows; with ``exact``, folders chunk=i that hold exactly ``rows`` each but the last."""
    if exact:
        with_chunk(df, rows, key).repartition("chunk").sortWithinPartitions("chunk", key).write.partitionBy("chunk").parquet(path)
    else:
        df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.option("maxRecordsPerFile", rows).parquet(path)


def write_generated(rows: DataFrame, path: str, config: StreamConfig, key: str = "example_id", tokens: str = "tokens") -> None:
    """Generated tokens without their delays, by ``key``: Parquet sorted by it, so that a reader of some examples skips the rest.

    Rows too short for the delays, or with another number of streams, have null tokens there; none is dropped.
    """
    whole = rows.select(key, undelay_streams(F.col(tokens), config.delays).alias(tokens))
    whole.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(path)


def read_generated(spark: SparkSession, path: str, ids: list[int] | None = None, key: str = "example_id") -> DataFrame:
    """What ``write_generated`` wrote; ``ids`` prunes by the files' statistics."""
    rows = spark.read.parquet(path)
    return rows if ids is None else rows.where(F.col(key).isin(*ids) if ids else F.lit(False))


def write_metrics(rows: DataFrame, path: str) -> None:
    """Append long metric rows (step, split, metric, value) to a table in folders by split; names get their split as prefix."""
    named = rows.select("step", "split", F.concat_ws("_", "split", "metric").alias("metric"), F.col("value").cast("double").alias("value"))
    named.write.mode("append").partitionBy("split").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(step, split, metric, value) of all that was appended."""
    return spark.read.schema("step long, metric string, value double, split string").parquet(path).select("step", "split", "metric", "value")


def pack_npz(rows: DataFrame, key: str, arrays: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """(key, content): each row's arrays as the bytes of one compressed array file, for readers that want such files."""

    def pack(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = []
            for i in range(batch.num_rows):  # the numbers of one row at a time
                buffer, row = io.BytesIO(), batch.slice(i, 1).to_pylist()[0]
                np.savez_compressed(buffer, **{a: np.array(row[a], np.int32) for a in arrays})
                made.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[key, "content"])

    src = rows.select(key, *arrays)
    return src.mapInArrow(pack, T.StructType([src.schema[key], T.StructField("content", T.BinaryType())]))


def unpack_npz(files: DataFrame, key: str, arrays: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """(key, and each named array as array<array<int>>) of array files' bytes (key, content)."""

    def load(batches):
        import io

        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            for i in range(batch.num_rows):  # a file is small beside its arrays: each row is a batch
                with np.load(io.BytesIO(batch.column(1)[i].as_py())) as z:
                    found = [pa.array([np.atleast_2d(z[a]).astype(np.int32).tolist()], kind) for a in arrays]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *found], names=[key, *arrays])

    src = files.select(key, "content")
    return src.mapInArrow(load, T.StructType([src.schema[key], *[T.StructField(a, T.ArrayType(T.ArrayType(T.IntegerType()))) for a in arrays]]))


def read_npz(spark: SparkSession, path: str, arrays: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """Compressed array files of older runs: dialogue_id (the stem) and each named array as array<array<int>>."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return unpack_npz(files.select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("dialogue_id"), "content"), "dialogue_id", arrays)


def save_config(spark: SparkSession, config: StreamConfig, path: str) -> None:
    spark.createDataFrame([(config.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_config(spark: SparkSession, path: str) -> StreamConfig:
    return StreamConfig.from_json(spark.read.text(path, wholetext=True).first()["value"])
