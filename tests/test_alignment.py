import random

import pytest
from pyspark.sql import functions as F

from framewright.config import StreamConfig
from framewright.functions.columns import audio_frames, ceil_div, frame_index, natural_key, strip_any
from framewright.functions.tokenizers import ascii_pieces, character_tokens, sentencepiece_encoder
from framewright.operators import alignment
from framewright.schemas import WORDS

CONFIG = StreamConfig()


def placed_plainly(frames, tokens, size, pad, end):
    grid = [pad] * size
    for f, t in zip(frames, tokens):
        while f < size and grid[f] != pad:
            f += 1
        if f >= size:
            break
        grid[f] = t
        if f > 0 and grid[f - 1] == pad:
            grid[f - 1] = end
    return grid


def test_place_in_turn_equals_plain_loop():
    rng = random.Random(1)
    for _ in range(2000):
        size, n = rng.randint(0, 12), rng.randint(0, 10)
        frames, tokens = [rng.randint(0, 14) for _ in range(n)], [rng.choice([3, 5, 6, 7]) for _ in range(n)]
        cells = dict(alignment.place_in_turn(frames, tokens, size, 3, 0))
        assert [cells.get(i, 3) for i in range(size)] == placed_plainly(frames, tokens, size, 3, 0)


def test_frame_placement_both_ways(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(60):
        n, size = rng.randint(1, 15), rng.randint(1, 20)
        frames = [rng.randint(0, 18) for _ in range(n)]
        frames = sorted(frames) if g % 2 else frames
        tokens = [rng.choice([3, 9, 8]) if g % 5 == 0 else rng.randint(4, 9) for _ in range(n)]
        rows += [(str(g), "A", i, t, f, size) for i, (f, t) in enumerate(zip(frames, tokens))]
        want[str(g)] = placed_plainly(frames, tokens, size, 3, 0)
    df = spark.createDataFrame(rows, "dialogue_id string, speaker string, token_idx int, token_id int, frame int, num_frames int")
    got = {k: {} for k in want}
    for r in alignment.frame_placement(df, CONFIG).collect():
        got[r["dialogue_id"]][r["slot"]] = r["id"]
    assert {k: [got[k].get(i, 3) for i in range(len(v))] for k, v in want.items()} == want


def test_frame_index_is_float_floor_division(spark):
    values = [i * 0.01 for i in range(3000)] + [i * 0.08 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", frame_index(F.col("x"), 1 / 12.5).alias("f"))
    assert all(r["f"] == int(r["x"] // (1 / 12.5)) for r in df.collect())


def _stream_plainly(words):
    """Characters one after another, as (start, end, character)."""
    out = []
    for i, (w, s, e) in enumerate(words):
        text = w.strip() if i == 0 else " " + w.strip()
        d = (e - s) / len(text)
        out += [(s + k * d, s + (k + 1) * d, c) for k, c in enumerate(text)]
    return out


def test_token_alignment_over_word_borders(spark):
    rng, rows, tokens, want = random.Random(3), [], [], {}
    for g in range(12):
        words, t = [], 0.0
        for i in range(rng.randint(1, 8)):
            t += rng.random()
            words.append(("".join(rng.choices("aé漢😀b", k=rng.randint(1, 5))), t, t + 0.1 + rng.random()))
        rows += [(f"d{g}", i, "A", w, s, e) for i, (w, s, e) in enumerate(words)]
        chars, at, idx = _stream_plainly(words), 0, 0
        while at < len(chars):
            n = min(rng.randint(1, 4), len(chars) - at)
            tokens.append((f"d{g}", "A", idx, "".join(c[2] for c in chars[at : at + n]), 7, at, at + n))
            want[f"d{g}", idx] = (chars[at][0], chars[at + n - 1][1])
            at, idx = at + n, idx + 1
    spaced = alignment.spaced_words(spark.createDataFrame(rows, WORDS))
    tk = spark.createDataFrame(tokens, "dialogue_id string, speaker string, token_idx int, token string, token_id int, b0 long, b1 long")
    got = {(r["dialogue_id"], r["token_idx"]): (r["start"], r["end"]) for r in alignment.token_alignment(spaced, tk).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert alignment.length_mismatch(spaced, tk).count() == 0
    assert alignment.length_mismatch(spaced, tk.where("token_idx > 0")).count() > 0


def test_ties_keep_file_order_and_first_word_has_no_space(spark):
    df = spark.createDataFrame([("d", 1, "A", "two", 1.0, 2.0), ("d", 0, "A", " one ", 1.0, 2.0), ("d", 2, "A", "zero", 0.5, 0.9)], WORDS)
    assert [r["text"] for r in alignment.spaced_words(df).orderBy("n").collect()] == ["zero", " one", " two"]
    assert sorted(r["text"] for r in alignment.spaced_words(df, spaces=False).collect()) == [" one ", "two", "zero"]


def test_quarantine(spark):
    rows = [("ok", 0, "A", "a", 0.0, 1.0), ("ok", 1, "B", "b", 0.0, 1.0), ("one", 0, "A", "a", 0.0, 1.0), ("null", 0, "A", None, 0.0, 1.0), ("null", 1, "B", "b", 0.0, 1.0), ("neg", 0, "A", "a", -1.0, 1.0), ("neg", 1, "B", "b", 0.0, 1.0)]
    good, bad = alignment.quarantine(spark.createDataFrame(rows, WORDS))
    assert {r["dialogue_id"] for r in good.collect()} == {"ok"}
    assert {r["dialogue_id"] for r in bad.collect()} == {"one", "null", "neg"}


def test_whole_chain_from_words_to_grid(spark):
    rows = [("d", 0, "A", "hello", 0.0, 0.5), ("d", 1, "B", "x", 0.2, 0.3), ("d", 2, "A", "you", 2.0, 2.3)]
    got = {r["speaker"]: r["text"] for r in alignment.text_streams(spark.createDataFrame(rows, WORDS)).collect()}
    assert len(got["A"]) == int((2.3 + 1) * 12.5) and got["A"][0] not in (0, 3) and got["A"][int(2.0 // 0.08) - 1] == 0 and got["A"][int(2.0 // 0.08)] not in (0, 3)
    assert len(got["B"]) == int((0.3 + 1) * 12.5)
    assert alignment.text_streams(spark.createDataFrame([], WORDS)).count() == 0


def test_pieces_of_one_character_are_one_token():
    ids = {"▁a": 5, "b": 6}
    covered = [("▁", ""), ("▁a", "a"), ("<0xCE>", ""), ("<0xB1>", "α"), ("b", "b")]
    assert character_tokens(covered, "aαb", lambda t: ids.get(t, 0)) == [("▁a", 5, 0, 1), ("α", 0, 1, 2), ("b", 6, 2, 3)]
    assert character_tokens([], "", len) == []
    for broken in (covered[:-1], covered[2:]):
        with pytest.raises(ValueError):
            character_tokens(broken, "aαb", len)


def test_model_over_whole_streams(spark):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    said = {"A": ["hello", "there", "Größe", "漢字", "😀!"], "B": ["α", "été"]}
    rows = [("d", i, s, w, float(i), i + 0.5) for s, words in said.items() for i, w in enumerate(words)] + [("e", 0, "A", " ", 0.0, 1.0), ("e", 1, "B", "x", 0.0, 1.0)]
    aligned, aside = alignment.align_or_set_aside(spark.createDataFrame(rows, WORDS), encode=sentencepiece_encoder(model))
    got = {s: sorted((r["token_idx"], r["token"], r["token_id"], r["start"], r["end"]) for r in aligned.collect() if r["speaker"] == s) for s in "AB"}
    assert [tuple(r) for r in aside.collect()] == [("e", "a word is empty")]
    for s, words in said.items():
        text = " ".join(words)
        times = _stream_plainly([(w, float(i), i + 0.5) for i, w in enumerate(words)])
        assert "".join(t[1] for t in got[s]).replace("▁", " ").lstrip(" ") == text
        at = 0
        for _, token, token_id, start, end in got[s]:
            n = len(token) - (at == 0 and token.startswith("▁"))
            assert (start, end) == (pytest.approx(times[at][0]), pytest.approx(times[at + n - 1][1])) and token_id == sp.piece_to_id(token)
            at += n
        assert at == len(text)


def test_failures_set_whole_dialogues_aside(spark):
    rows = [("ok", 0, "A", "a", 0.0, 1.0), ("ok", 1, "B", "b", 0.0, 1.0), ("bad", 0, "A", "é", 0.0, 1.0), ("bad", 1, "B", "b", 0.0, 1.0), ("blank", 0, "A", "\u3000", 0.0, 1.0), ("blank", 1, "A", "x", 2.0, 3.0), ("blank", 2, "B", "b", 0.0, 1.0), ("late", 0, "A", "x", 0.0, 1.0), ("late", 1, "A", " ", 2.0, 3.0), ("late", 2, "B", "b", 0.0, 1.0)]
    df = spark.createDataFrame(rows, WORDS)
    aligned, aside = alignment.align_or_set_aside(df, pieces=ascii_pieces)
    assert {r["dialogue_id"] for r in aligned.collect()} == {"ok", "late"}
    assert {tuple(r) for r in aside.collect()} == {("bad", "tokens and words differ in length"), ("blank", "a word is empty")}
    assert {r["dialogue_id"] for r in alignment.quarantine(df, spaces=False)[1].collect()} == set()


def test_small_columns(spark):
    df = spark.createDataFrame([("a10b2",), ("a9b10",), ("a10b1",), ("b",), ("a009",)], "s string")
    assert [r["s"] for r in df.orderBy(natural_key(F.col("s"))).collect()] == ["a009", "a9b10", "a10b1", "a10b2", "b"]
    assert [r[0] for r in spark.range(3840, 3843).select(audio_frames(F.col("id"), 24000, 12.5)).collect()] == [2, 3, 3]
    assert spark.range(1).select(ceil_div(F.lit(7), 7), ceil_div(F.lit(8), 7), ceil_div(F.lit(0), 7)).first() == (1, 2, 0)
    assert spark.range(1).select(strip_any(F.lit("　 a b\t "))).first()[0] == "a b"
