"""Token counts: in each batch the distinct pre-tokens are counted once, joined to the documents' pre-token frequencies, and summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import bound_batches, unused
from ._text import WordBpe, once, pieces, text_slices, word_starts


def _sentencepiece_counter(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def frequencies(codes: np.ndarray, cuts: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pre-token, times) of documents whose pre-tokens are ``codes`` between their ``cuts``; one row for each pair."""
    document = np.repeat(np.arange(len(cuts) - 1, dtype=np.int64), np.diff(cuts))
    pair, times = np.unique(document * distinct + codes, return_counts=True)
    return pair // distinct, pair % distinct, times


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "n_tokens", drop_text: bool = False) -> DataFrame:
    """``df`` with ``out`` (long): how many tokens the library gives for the whole text, without special tokens added.

    Texts are cut into pre-tokens whose ids do not depend on their neighbours. A slice of texts becomes rows (document,
    pre-token, times) and a table of its distinct pre-tokens; each of those is counted once while it stays in a bounded memo
    of the worker, which every batch of every task there shares; the rows are joined to the counts and the products summed by
    document. The library makes ids of a distinct pre-token, which are counted and dropped; none are made for documents. The
    same join over the whole table was built and measured, and moves several times the texts (README). A SentencePiece model
    has no such pre-tokens, as its pieces may cross words; there each whole text is one unit.
    Nulls are empty texts, which have 0 tokens. Every row gives one row, repeated rows repeated ones; an existing column
    named ``out`` is replaced; ``drop_text`` leaves the text column out. A very long text is one slice of its own; an empty
    table gives no rows; other columns may have any name.
    """
    bound_batches(df.sparkSession)
    keep = [c for c in df.columns if c.lower() != out.lower() and not (drop_text and c == text)]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(unused("text", *keep)))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path.endswith(".model"):
            sp = once(("sp", tokenizer_path), lambda: _sentencepiece_counter(tokenizer_path))
        else:
            bpe = once(("counts", tokenizer_path), lambda: WordBpe(tokenizer_path, counts=True))
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            n = np.zeros(batch.num_rows, np.int64)
            if tokenizer_path.endswith(".model"):
                n[:] = [len(sp.encode(t or "", num_threads=1)) for t in column.to_pylist()]
            else:
                for first, end, raw, offsets in text_slices(column):
                    starts = word_starts(raw, offsets)
                    if not len(starts):
                        continue
                    coded = pieces(raw, starts)
                    each = np.array(bpe.of(coded.dictionary.to_pylist()), np.int64)
                    document, piece, times = frequencies(coded.indices.to_numpy(), np.searchsorted(starts, offsets), len(each))
                    np.add.at(n, first + document, times * each[piece])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=schema.names)

    return src.mapInArrow(run, schema)


def token_report(df: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``df`` (doc_id, text); null is empty, repeated rows stay."""
    rows = df.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(rows, tokenizer_path, drop_text=True)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
