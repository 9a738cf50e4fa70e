"""The queries of this subpackage and, where SQL can say them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, product_quantisation, url_filter
from ._session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op2_decontaminate": decontaminate.ORACLE, "op7_url_filter": url_filter.ORACLE, "op9_product_quantisation": product_quantisation.ORACLE}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents as ORC, read back. A null text is empty (the end id only); repeated rows stay; an empty table has no rows."""
    from .token_orc import token_orc_report

    return token_orc_report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded. A null text is empty (no ids); repeated rows stay; an empty table has no rows."""
    from .byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), ["doc_id"])


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. A null text is empty and has none; repeated rows stay; an empty table has no rows."""
    from .token_counts import token_report

    return token_report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents. A null or blank text has fingerprint zero; a null doc_id names no component."""
    from .simhash import report

    return report(table(spark, sf_dir, "documents"), width=3, distance=3)


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents. A null or blank text has no words; repeated rows stay; no items, no hits."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the chain. A null text or one without words is not toxic; without labels none is; repeated rows stay."""
    from .toxicity import label_categories, score, train

    docs = table(spark, sf_dir, "documents")
    labels, categories = label_categories(table(spark, sf_dir, "labels"))
    return score(docs, train(docs, labels, categories), keep=["doc_id"])


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents. A null text is empty; repeated rows stay; an empty table has no rows."""
    from . import secrets

    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page. A null url, or one without ``://``, has an empty host and path; repeated rows stay."""
    return url_filter.report(table(spark, sf_dir, "pages"))


@query
def op9_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors. Null, zero or non-finite ones link with nothing; repeated rows link with each other."""
    return product_quantisation.report(table(spark, sf_dir, "embeddings"), least=0.9)


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents. A null text is empty; repeated rows stay; an empty table has no rows."""
    from . import pii

    return pii.find(table(spark, sf_dir, "documents"))
