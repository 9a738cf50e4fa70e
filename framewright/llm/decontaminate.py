"""Benchmark decontamination with DataFrame functions only: item windows are a broadcast hash set, document windows probe it, and a hit is an equal window."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import unused, written

#: A word after A-Z are lower-cased, and before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Item windows are broadcast up to this many bytes of words and ids; beyond, windows are joined by a shuffle.
BROADCAST_BYTES = 128 << 20


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(len, gram, items): distinct windows of the items and the sorted ids of the items that have each.

    An item of fewer words is one window; one without words has none. A null item_id marks hits and is not listed.
    """
    split = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where("size(words) > 0")
    at = split.select("item", "words", F.explode(F.expr(f"sequence(0, greatest(size(words) - {width}, 0))")).alias("at"))
    gram = at.select("item", F.slice("words", F.col("at") + 1, width).alias("gram"))
    return gram.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.size("gram").alias("len"), "gram", "items")


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_key, n_words, n_hit, hits, items, n_items, contaminated.

    A word inside any occurrence of an item window is hit; ``hits`` has the occurrences (pos, len) in order, ``items`` the ids
    of the items with occurring windows as sorted strings. Words and windows are exploded and probed in one pass over the
    texts; only a document's first word and the verified hits go on, to be put together by document. Null texts have no
    words. Rows of equal doc_id are told apart by their text (``text_key``), and repeated rows give repeated results.
    """
    spark = docs.sparkSession
    grams = item_windows(benchmark, width)
    sizes = grams.groupBy("len").agg(F.sum(F.length(F.array_join("gram", " ")) + F.length(F.array_join("items", " ")) + 64).alias("bytes")).collect()
    small = sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    key = F.concat_ws(":", F.xxhash64("text"), F.octet_length("text"))
    rows = docs.select("doc_id", key.alias("text_key"), words(F.col("text").cast("string")).alias("words"))
    lens = sorted((r["len"] for r in sizes), reverse=True)
    # The windows are made where the words are: exploding the words beside them would copy a text once for each of its words.
    each = ", ".join(f"'w{n}', if(i + {n} <= size(words), array_join(slice(words, i + 1, {n}), ' '), NULL)" for n in lens or [width])
    rows = rows.select("doc_id", "text_key", F.size("words").alias("n_words"), F.expr(f"transform(words, (w, i) -> named_struct({each}))").alias("windows"))
    rows = rows.select("doc_id", "text_key", "n_words", F.posexplode_outer("windows").alias("pos", "window"))
    found = []
    for n in lens:
        side = grams.where(F.col("len") == n).select(F.array_join("gram", " ").alias("gram"), F.struct("len", "items").alias(f"found{n}"))
        rows = rows.join(F.broadcast(side) if small else side, F.col(f"window.w{n}") == F.col("gram"), "left").drop("gram")
        found.append(F.col(f"found{n}"))
    hit = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<len:int,items:array<string>>>")
    kept = rows.withColumn("found", hit).where("pos IS NULL OR pos = 0 OR size(found) > 0").select("doc_id", "text_key", "n_words", "pos", "found")
    spans = F.expr("transform(found, x -> named_struct('pos', pos, 'len', x.len))")
    each = kept.select("doc_id", "text_key", "n_words", "pos", spans.alias("spans"), F.expr("transform(found, x -> x.items)").alias("lists"))
    whole = each.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.expr("sort_array(array_distinct(flatten(collect_list(spans))))").alias("hits"),
        F.expr("sort_array(array_distinct(flatten(flatten(collect_set(lists)))))").alias("items"),
        F.count(F.expr("CASE WHEN coalesce(pos, 0) = 0 THEN 1 END")).alias("copies"),
    )
    covered = F.expr(
        "aggregate(hits, named_struct('n', 0L, 'upto', 0), (a, x) -> named_struct("
        "'n', a.n + greatest(0, x.pos + x.len - greatest(a.upto, x.pos)), 'upto', greatest(a.upto, x.pos + x.len)), a -> a.n)"
    )
    whole = whole.withColumn("n_hit", covered).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
    again = whole.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return again.select("doc_id", "text_key", "n_words", "n_hit", "hits", "items", "n_items", "contaminated")


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``; edge cases as in ``scan``."""
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return scan(docs, benchmark, width).select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents") -> DataFrame:
    """``docs`` without contamination: ``documents`` with a hit go, or only the hit words (``spans``), with all other text kept.

    All columns of ``docs`` come back, extra ones too; clean rows are unchanged, those with a null doc_id or text included.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    names = docs.columns
    named = {n: unused(n, *names) for n in ("bad_id", "bad_key", "bad_hits", "bad_words", "bad_gaps")}
    id_, key_, hits, raw, gaps = named.values()
    bad = scan(docs, benchmark, width).where("contaminated").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_), F.col("hits").alias(hits)).distinct()
    key = F.concat_ws(":", F.xxhash64("text"), F.octet_length("text"))
    match = F.col("doc_id").eqNullSafe(F.col(f"`{id_}`")) & (key == F.col(f"`{key_}`"))
    if remove == "documents":
        bad = written(bad.select(f"`{id_}`", f"`{key_}`"), "contaminated")
        size = bad.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(f"`{key_}`") + 64), F.lit(0))).first()[1]
        # A row for each bad text: broadcast where it is small, so that the texts are not shuffled.
        return docs.join(F.broadcast(bad) if size <= BROADCAST_BYTES // 4 else bad, match, "left_anti")
    rows = docs.join(bad, match, "left").withColumn(raw, F.regexp_extract_all("text", F.lit(RAW_WORD), F.lit(0))).withColumn(gaps, F.split("text", RAW_WORD, -1))
    left = F.expr(f"concat(`{gaps}`[0], array_join(transform(`{raw}`, (w, i) -> concat(if(exists(`{hits}`, x -> i >= x.pos AND i < x.pos + x.len), '', w), get(`{gaps}`, i + 1))), ''))")
    return rows.withColumn("text", F.when(F.col(f"`{hits}`").isNull(), F.col("text")).otherwise(left)).select(*[F.col(f"`{n}`") for n in names])


#: The same report in DuckDB.
ORACLE = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
    SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS gram, least(len(w), 10) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), x AS (
    SELECT r, i, array_to_string(w[i : i + n - 1], ' ') AS gram, n
    FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM g) WHERE i + n - 1 <= len(w)
), h AS (SELECT DISTINCT r, i, x.n, item_id FROM x JOIN g ON g.gram = x.gram AND g.n = x.n),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""
