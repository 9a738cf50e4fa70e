"""Token ids in ORC: ids are encoded by a tokenizer file and written in document order with stripes, row indexes and Bloom filters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import bound_batches, scratch_path
from ._text import WordBpe, once, pieces, text_slices, word_starts

#: The columns of the file format. ``part`` is the file's place in document order, ``before`` the number of ids before the row in its file.
FILE_SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"

#: Writer settings: run-length coded integer columns come with the format; the index stride is small as rows are long.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(64 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def encode_ids(df: DataFrame, tokenizer_path: str, end_id: int | None = 1) -> DataFrame:
    """FILE_SCHEMA rows of ``df`` (doc_id, text), in the row order of each partition; ``end_id`` closes each document."""
    tail = () if end_id is None else (end_id,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(("ids", tokenizer_path), lambda: WordBpe(tokenizer_path))
        before = 0
        for batch in batches:
            names = batch.schema.names
            ids_col, text_col, part_col = (batch.column(names.index(c)) for c in ("doc_id", "text", "part"))
            for first, end, raw, offsets in text_slices(text_col):
                starts = word_starts(raw, offsets)
                coded = pieces(raw, starts)
                known = [*bpe.of(coded.dictionary.to_pylist()), tail]
                size = np.fromiter(map(len, known), np.int64, len(known))
                flat = np.fromiter((i for k in known for i in k), np.int32, int(size.sum()))
                begin = np.cumsum(size) - size
                # The end id is one more piece behind each document.
                codes = np.insert(coded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets[1:]), len(known) - 1)
                lens = size[codes]
                total = np.cumsum(lens)
                take = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin[codes] - (total - lens), lens)
                ends = total[np.searchsorted(starts, offsets[1:]) + np.arange(end - first)] if len(total) else np.zeros(end - first, np.int64)
                bounds = np.concatenate(([0], ends))
                n = np.diff(bounds)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[take]))
                yield pa.RecordBatch.from_arrays(
                    [ids_col.slice(first, end - first), part_col.slice(first, end - first), pa.array(before + bounds[:-1]), pa.array(n), lists],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(bounds[-1])

    return df.mapInArrow(run, FILE_SCHEMA)


def write_token_orc(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = 1) -> str:
    """Write the ids of ``docs`` (doc_id, text) to ``path``: files in ascending doc_id order, null ids first, ties by text hash and text.

    Rows are dealt by ranges of (doc_id, hash of the text), so repeated ids do not meet in one file, and sorted in each;
    a null text is empty and has the end id only. Extra columns of ``docs`` are not stored. Beside the files (``ids``) stands a
    table (``starts``) of how many ids come before each file, so that a reader of some documents need not add them up.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")
    encode_ids(dealt.withColumn("part", F.spark_partition_id()), tokenizer_path, end_id).write.options(**ORC_OPTIONS).orc(f"{path}/ids")
    w = "SUM(ids_in_part) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sums = spark.read.schema(FILE_SCHEMA).orc(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("ids_in_part"))
    sums.select("part", F.expr(f"coalesce({w}, 0L)").alias("base")).write.orc(f"{path}/starts")  # a row for each file
    return path


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows with ``start``: how many ids all earlier documents have. ``doc_ids`` prunes files, stripes and runs of rows
    by the index and the Bloom filter; nothing else of the files is read."""
    rows = spark.read.schema(FILE_SCHEMA).orc(f"{path}/ids")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(*doc_ids) if doc_ids else F.lit(False))
    base = spark.read.schema("part int, base long").orc(f"{path}/starts")
    # One row for each file: the table of files is far smaller than the files' own metadata.
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def id_checksums(rows: DataFrame) -> DataFrame:
    """``rows`` with the ids replaced by their unsigned crc32 as little-endian unsigned 32-bit integers."""
    kept = rows.select("doc_id", "start", "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            data = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return kept.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_orc_report(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of ``docs``, written as token ORC in the shared folder and read from the
    files; odd rows as in ``write_token_orc``."""
    spark = docs.sparkSession
    path = write_token_orc(docs, tokenizer_path, scratch_path(spark, "token-orc"), end_id)
    return id_checksums(read_token_orc(spark, path))
