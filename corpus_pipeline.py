"""The corpus pipeline: documents pass toxicity, near-duplicate, benchmark and secret stages and leave as token ids.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, extra ones included, whatever their names.

What each stage does with odd rows: a null or blank text is not toxic, is a copy of other blank texts, holds no benchmark
words and no secrets, and has no ids. A row without a doc_id is judged like others but is never a copy, as nothing names it.
Of repeated rows the near-duplicate stage leaves one. Ties go to the least doc_id, then the least text hash. An empty table
gives empty tables. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import _session, byte_bpe, decontaminate, queries, secrets, simhash, toxicity


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier chain, fitted on a bounded sample of the labelled documents, calls toxic. Repeated rows are
    judged alike; without labels nothing is toxic."""
    labels, categories = toxicity.label_categories(_session.table(spark, sf_dir, "labels"))
    chain = toxicity.train(docs, labels, categories)
    # The scores' names are free while the documents are scored.
    own = {c: _session.unused(f"own_{c}", *docs.columns) for c in docs.columns if c.lower() in {"toxic", *(f"p_{x}" for x in categories)}}
    kept = toxicity.score(docs.withColumnsRenamed(own), chain).where("NOT toxic")
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies: five-word shingles, a similarity of 0.8. Rows without a
    doc_id stay, and so does one of all blank texts."""
    return simhash.drop_copies(docs, width=5, similarity=0.8)


def benchmark_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item. Null texts hold none."""
    return decontaminate.decontaminate(docs, _session.table(spark, sf_dir, "benchmark"), width=10, remove="documents")


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets, nested ones too, in the texts; no document goes. Null texts stay null; n_chars follows a changed text."""
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of each document that is left; a null or empty text has none."""
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), queries.vocabulary("byte_bpe_multi_50k.tiktoken"))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents_go),
    ("simhash_near_dedup", copies_go),
    ("benchmark_decontamination", benchmark_passages_go),
    ("secret_scans", secrets_are_masked),
    ("byte_bpe", token_ids),
]

#: The classifier and the recursive decoding cannot be said in SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage wrote for itself goes when its result is written."""
    docs, mark = _session.table(spark, sf_dir, "documents"), _session.scratch_mark()
    for name, stage in STAGES:
        docs = _session.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        _session.drop_scratch(spark, mark, keep_last=True)
    return docs
