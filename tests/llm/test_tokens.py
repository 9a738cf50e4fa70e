import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import byte_bpe, token_counts, token_orc
from framewright.llm._text import Recent, WordBpe, pattern_starts, pieces, text_slices, word_starts

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = list("ab's't'revemlld  \n\t1é٣漢 　!?'’—😀İΣ<|endoftext|>×ÉÑ") + ["'ll", "<|endoftext|>", "e\u0301", "≠", " \u0301", "<\u0338", "THE", "éa"]
ODD = "doc_id long, text string, n_tokens string, ids string, n_bytes string, part string"


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(n)] + [None, "", " ", "\n\n"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return Tokenizer.from_file(WORD), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_rows(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(texts(4000, 9)[:-4])
    rows = [(1, "Tie here"), (2, "Tie here"), (3, None), (4, ""), (5, " \n "), (6, long), (6, long), (None, "no id"), (None, None), (7, "x" * 30000)]
    return spark.createDataFrame([(*r, "a", "b", None, "d") for r in rows], ODD), rows


def test_splits_equal_the_libraries(library):
    pattern, docs = regex.compile(P.PATTERN), texts(4000, 1)
    bpe = WordBpe(WORD, limit=50)
    for a, b, raw, offsets in text_slices(pa.array(docs), 2000):
        starts = pattern_starts(raw, offsets)
        cuts = np.append(starts, len(raw))
        assert [raw[x:y].tobytes().decode() for x, y in zip(cuts[:-1], cuts[1:])] == [m for d in docs[a:b] for m in pattern.findall(d or "")]
        starts = word_starts(raw, offsets)
        coded = pieces(raw, starts)
        ids, codes, at = bpe.of(coded.dictionary.to_pylist()), coded.indices.to_pylist(), np.searchsorted(starts, offsets)
        for i in range(b - a):
            assert [t for c in codes[at[i] : at[i + 1]] for t in ids[c]] == library[0].encode(docs[a + i] or "", add_special_tokens=False).ids


def test_recent_forgets_but_does_not_change():
    asked, memo = [], Recent(3)
    for keys in ([1, 2, 3, 4], [4, 5], [1, 4]):
        assert memo.fill(keys, lambda k: asked.extend(k) or [x * 10 for x in k]) == [k * 10 for k in keys]
    assert asked[:4] == [1, 2, 3, 4]


def test_counts(spark, library):
    df, rows = odd_rows(spark)
    got = token_counts.token_report(df, WORD).collect()
    want = sorted(((i, len((t or "").encode()), n := len(library[0].encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert token_counts.token_report(df.where("false"), WORD).count() == 0
    assert token_counts.count_tokens(df, WORD).columns == ["doc_id", "text", "ids", "n_bytes", "part", "n_tokens"]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    short = df.where("length(text) < 100 OR text IS NULL")
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(short, P.path("piece_bpe_32k.model")).collect()) == sorted(len(sp.encode(t or "")) for _, t in rows if not t or len(t) < 100)


def test_orc_files(spark, library, tmp_path):
    df, rows = odd_rows(spark)
    path = token_orc.write_token_orc(df, WORD, str(tmp_path / "orc"), 1)
    back = token_orc.read_token_orc(spark, path).orderBy("start").collect()
    start, ids = 0, [r["doc_id"] for r in back]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    whole = {}
    for r in back:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        whole.setdefault(r["doc_id"], []).append(r["ids"][:-1])
        start += r["n_tokens"]
    for i in {i for i, _ in rows}:
        assert sorted(whole[i]) == sorted(library[0].encode(t or "", add_special_tokens=False).ids for j, t in rows if j == i)
    crc = {r["start"]: r["ids_crc32"] for r in token_orc.id_checksums(token_orc.read_token_orc(spark, path)).collect()}
    assert all(crc[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in back)
    one = token_orc.read_token_orc(spark, path, [2]).collect()
    assert [(r["doc_id"], r["start"]) for r in one] == [(2, next(b["start"] for b in back if b["doc_id"] == 2))]
    empty = token_orc.write_token_orc(df.where("false"), WORD, str(tmp_path / "none"))
    assert token_orc.read_token_orc(spark, empty).count() == 0


def test_reading_some_documents_skips_the_rest(spark, tmp_path):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    path = token_orc.write_token_orc(df, WORD, str(tmp_path / "orc"))
    some = token_orc.read_token_orc(spark, path, [7, 30_500])
    assert sorted((r["doc_id"], r["start"]) for r in some.collect()) == [(7, 21), (30_500, 91_500)]
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [In(doc_id, [" in plan
    leaves = some._jdf.queryExecution().executedPlan()
    scanned = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "Stage" in name and node.children().isEmpty() and hasattr(node, "plan"):
            return walk(node.plan())
        if name.startswith("Scan orc"):
            scanned.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(leaves)
    assert max(scanned) <= 4000  # two runs of 1,000 rows, not 60,000


def test_byte_bpe(spark, library):
    df, rows = odd_rows(spark)
    got = sorted(map(tuple, byte_bpe.round_trip(df, RANKS, ["doc_id"]).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library[1].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    whole = byte_bpe.decode(byte_bpe.encode(df.select("doc_id", "text", "part"), RANKS), RANKS).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in whole)
    assert byte_bpe.round_trip(df.where("false"), RANKS, ["doc_id"]).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), RANKS).first()["decoded"] is None


def test_recursive_query_and_heap_agree(library):
    bpe, rng = byte_bpe.ByteBpe(RANKS), random.Random(3)
    words = list({"".join(rng.choices("abtheingé", k=rng.randint(2, 40))).encode() for _ in range(300)})
    queried = bpe._query(words)
    assert queried == [bpe._heap(w) for w in words]
    assert all(i == library[1]._encode_single_piece(w) for w, i in zip(words, queried) if w not in bpe.ranks)
