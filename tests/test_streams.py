import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.config import StreamConfig
from framewright.operators import ranking, streams
from framewright.schemas import MERGED

SMALL = StreamConfig(delays=(0, 0, 1, 2), text_initial_id=90, audio_initial_id=50, max_length=5, min_length=None, codebooks=3)


def test_delay_split_label_undelay(spark):
    x = [[(i * 7 + t * 3) % 49 for t in range(18)] for i in range(4)]
    df = spark.createDataFrame([("d", x)], "dialogue_id string, streams array<array<int>>").withColumn("streams", streams.delay_streams(F.col("streams"), SMALL))
    late = df.first()["streams"]
    ini, pad = [90, 50, 50, 50], [3, 50, 50, 50]
    assert late == [[ini[i]] * (d + 1) + x[i] + [pad[i]] * (2 - d) for i, d in enumerate(SMALL.delays)]
    cut = sorted(streams.split_streams(df, SMALL).collect(), key=lambda r: r["chunk"])
    assert [r["num_frames"] for r in cut] == [5, 4, 4, 4, 4]
    assert all((np.array(r["streams"]) == p).all() for r, p in zip(cut, np.array_split(np.array(late), 5, axis=1)))
    assert [r["num_frames"] for r in streams.split_streams(df, replace(SMALL, min_length=5)).collect()] == [5]
    assert streams.split_streams(df, replace(SMALL, max_length=None)).count() == 1
    labels = df.select(streams.stream_labels(F.col("streams"), SMALL)).first()[0]
    assert labels == [[v if v < ini[i] else -1 for v in s] for i, s in enumerate(late)]
    back = df.select(streams.undelay_streams(F.col("streams"), SMALL.delays)).first()[0]
    assert back == [[ini[i]] + x[i] for i in range(4)]
    short = spark.createDataFrame([([[1, 2]] * 4,), ([[1, 2, 3]] * 4,), ([[1, 2, 3]] * 3,)], "streams array<array<int>>")
    assert [r[0] for r in short.select(streams.undelay_streams(F.col("streams"), SMALL.delays)).collect()] == [None, [[1], [1], [2], [3]], None]


def test_even_split_sizes(spark):
    for n in (1, 5, 6, 17, 39):
        df = spark.createDataFrame([("d", [list(range(n))])], "dialogue_id string, streams array<array<int>>")
        got = [r["streams"][0] for r in sorted(streams.split_streams(df, SMALL).collect(), key=lambda r: r["chunk"])]
        assert got == [p.tolist() for p in np.array_split(np.arange(n), -(-n // 5))]


def test_align_merge_view(spark):
    text = spark.createDataFrame([("d", "A", [1, 2, 3, 4]), ("d", "B", [5]), ("x", "A", [1])], "dialogue_id string, speaker string, text array<int>")
    audio = spark.createDataFrame([("d", "A", [[7, 8, 9]]), ("d", "B", [[6, 6, 6]]), ("x", "A", [[1]])], "dialogue_id string, speaker string, audio array<array<int>>")
    rows = streams.merge_streams(text, audio, prefix="p").collect()
    assert [(r["dialogue_id"], r["A"], r["B"]) for r in rows] == [("p/d", [[1, 2, 3], [7, 8, 9]], [[5, 3, 3], [6, 6, 6]])]
    merged = spark.createDataFrame(rows, MERGED)
    views = {r["speaker"]: r["streams"] for r in streams.main_speaker_streams(merged).collect()}
    assert views == {"A": [[1, 2, 3], [7, 8, 9], [6, 6, 6]], "B": [[5, 3, 3], [6, 6, 6], [7, 8, 9]]}
    uneven = spark.createDataFrame([("d", [[1, 2]], [[1]])], MERGED)
    assert streams.main_speaker_streams(uneven).count() == 0 and streams.size_mismatch(uneven).count() == 1


def test_collate(spark):
    rows = [(0, 2, [[1, 2]], [[1, 2]]), (1, 3, [[1, 2, 3]], [[1, 2, 3]]), (2, 1, [[9]], [[9]])]
    df = streams.batches(spark.createDataFrame(rows, "example_id long, num_frames int, streams array<array<int>>, labels array<array<int>>"), 2)
    got = {r["example_id"]: r for r in streams.collate(df, replace(SMALL, zero_id=-7)).collect()}
    assert got[0]["input_ids"] == [[1, 2, -7]] and got[0]["text_attention_mask"] == [1, 1, -7] and got[1]["labels"] == [[1, 2, 3]]
    assert got[2]["input_ids"] == [[9]] and got[2]["batch_id"] == 1


def test_global_rank_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 40)
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i) for i in range(500)] + [(None, -1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, i long").repartition(7)
    ranked, n = ranking.global_rank(df, ["s", "i"], "rank")
    got = {(r["s"], r["i"]): r["rank"] for r in ranked.collect()}
    assert n == 501 and got == {k: i for i, k in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))}
    assert ranking.global_rank(df.where("i > 1000"), ["s"], "rank")[0].count() == 0


def test_shards_resume_reconcile(spark):
    ids = spark.range(10).withColumnRenamed("id", "k")
    got = [r["worker"] for r in streams.shard_assignment(ids, 4, "k").orderBy("k").collect()]
    assert got == [w for w, p in enumerate(np.array_split(np.arange(10), 4)) for _ in p]
    assert [r["worker"] for r in streams.shard_assignment(ids.where("k < 2"), 4, "k").orderBy("k").collect()] == [0, 1]
    assert {r["k"] for r in streams.resume_pending(ids, ids.where("k > 2"), "k").collect()} == {0, 1, 2}
    missing = streams.reconcile_missing(ids.where("k < 3"), ids.where("k > 1"), "k").where("k < 5").collect()
    assert {(r["k"], r["missing_in"]) for r in missing} == {(0, "audio"), (1, "audio"), (3, "text"), (4, "text")}
    streams.reconcile(ids, ids, "k")
    with pytest.raises(ValueError, match="2 without audio; 7 without text, such as 0, 1, 3"):
        streams.reconcile(ids.where("k < 3"), ids.where("k > 1"), "k")


def test_audio_shapes(spark):
    rows = [("good", "A", [[1, 2], [1, 2], [1, 2]], 3840), ("more", "A", [[1, 2], [1, 2], [1, 2]], 3841), ("uneven", "B", [[1, 2], [1], [1, 2]], 3840), ("few", "A", [[1, 2]], 3840), ("null", "A", None, 3840)]
    df = spark.createDataFrame(rows, "dialogue_id string, speaker string, audio array<array<int>>, samples long")
    assert {r["dialogue_id"] for r in streams.audio_shape_errors(df, 24000, SMALL).collect()} == {"more", "uneven", "few", "null"}


def test_sampling_and_plans(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0, 2.0, 3.0])], "k int, logits array<double>")
    got = [(r["id"], r["probability"]) for r in streams.sampling_candidates(df, "k", top_k=2).orderBy("id").collect()]
    assert [g[0] for g in got] == [1, 3] and abs(got[0][1] - 0.5) < 1e-9
    assert streams.sampling_candidates(df, "k", top_p=0.1).count() == 1
    assert streams.epoch_plan(spark.range(25), 2, 3, 2).first() == (25, 12, 3)


def test_pieces_without_arrays_and_at_once(spark):
    config = StreamConfig(max_length=4, min_length=3)
    rows = spark.createDataFrame([(k, n, [list(range(n)), list(range(10, 10 + n))]) for k, n in enumerate((0, 1, 3, 4, 5, 7, 9, 30))], "k int, num_frames int, streams array<array<int>>")
    whole = streams.split_streams(rows, config)
    want = []
    for k, n, s in rows.collect():
        parts = max(-(-n // 4), 1)
        at = 0
        for c in range(parts):
            size = n // parts + (c < n % parts)
            if size >= 3:
                want.append((k, c, size, [x[at : at + size] for x in s]))
            at += size
    assert sorted(tuple(r) for r in whole.select("k", "chunk", "num_frames", "streams").collect()) == want
    sizes = streams.split_streams(rows.drop("streams"), config)
    assert sorted(tuple(r) for r in sizes.select("k", "chunk", "num_frames").collect()) == [w[:3] for w in want]


def test_audio_by_ramp_is_the_formula(spark):
    from framewright.plans.dialogue import with_audio

    rows = spark.createDataFrame([(d, s, [3] * n) for d, n in (("0", 1), ("7", 40), ("65", 5000), ("-3", 20)) for s in "AB"], "dialogue_id string, speaker string, text array<int>")
    for n in (2048, 14):  # 14 has no ramp
        for r in with_audio(rows, StreamConfig(audio_initial_id=n)).collect():
            x = int(r["dialogue_id"]) * 31 + 5 * (r["speaker"] == "B")
            assert len(r["audio"]) == 8 and all(v == math.fmod(x + k * 17 + t * 7, n) for k, s in enumerate(r["audio"]) for t, v in enumerate(s))
            assert {len(s) for s in r["audio"]} == {r["frames"]}


@pytest.mark.parametrize("late, bound, least", [((0, 0, 1, 2), 5, None), ((0, 3, 1, 0), 4, 3), ((0, 0, 0, 0), 7, None), ((2, 0, 5, 1), 1, None)])
def test_pieces_of_windows_are_those_of_whole_streams(spark, late, bound, least):
    config, size = replace(SMALL, delays=late, max_length=bound, min_length=least), 8
    rng = random.Random(5)
    lengths = [1, 2, 3, 7, 8, 9, 15, 16, 17, 23, 40, 64, 65, 101]
    rows = [(str(n), [[rng.randrange(49) for _ in range(n)] for _ in late]) for n in lengths]
    before = streams.frames_before(config)
    parts = [(d, "A", p, len(x[0]), [s[max(p * size - before, 0) : (p + 1) * size] for s in x]) for d, x in rows for p in range(-(-len(x[0]) // size))]
    got = streams.split_windows(spark.createDataFrame(parts, "dialogue_id string, speaker string, part int, frames int, streams array<array<int>>"), size, config)
    whole = spark.createDataFrame([(d, "A", x) for d, x in rows], "dialogue_id string, speaker string, streams array<array<int>>")
    want = streams.split_streams(whole.withColumn("streams", streams.delay_streams(F.col("streams"), config)), config)
    order = ["dialogue_id", "speaker", "chunk", "num_frames", "streams"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))


def test_text_in_windows_is_the_text(spark):
    from framewright.operators import alignment

    rng, cells = random.Random(6), []
    for d, n in enumerate([1, 2, 8, 9, 16, 50, 77]):
        some = sorted(rng.sample(range(n), max(1, n // 6)))
        cells += [(str(d), s, n, t, 1000 + t) for s, slots in (("A", some), ("B", some[:1])) for t in slots]
    df = spark.createDataFrame(cells, "dialogue_id string, speaker string, num_frames int, slot int, id int")
    whole = {(r.dialogue_id, r.speaker): r.text for r in alignment.text_stream_grid(df).collect()}
    got = {(r.dialogue_id, r.speaker, r.part): r.text for r in alignment.text_windows(df, 8, 3).collect()}
    assert got == {(*k, p): t[max(p * 8 - 3, 0) : (p + 1) * 8] for k, t in whole.items() for p in range(-(-len(t) // 8))}


def test_long_dialogue_in_windows(spark, tmp_path):
    """Rows of the stages that examples are made of do not grow with a dialogue, and give what whole rows give."""
    from framewright.config import DEFAULT
    from framewright.plans import dialogue

    turns = [(c, i, ("user", "assistant")[i % 2], " ".join(f"w{c}{i}{j}" for j in range(n))) for c, (k, n) in enumerate([(40, 60), (3, 5), (90, 40), (1, 9)]) for i in range(k)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = dialogue.merged_windows(spark, str(tmp_path))
    assert rows.select(F.max(F.size(F.get("A", F.lit(0))))).first()[0] <= dialogue.WINDOW + streams.frames_before(DEFAULT) < 3000 < dialogue.merged(spark, str(tmp_path)).select(F.max(F.size(F.get("A", F.lit(0))))).first()[0]
    kept = ["dialogue_id", "speaker", "chunk", "num_streams", "num_frames", "streams", "labels"]
    want = streams.training_examples(dialogue.merged(spark, str(tmp_path)))
    assert sorted(map(tuple, dialogue.examples(spark, str(tmp_path)).select(kept).collect())) == sorted(map(tuple, want.select(kept).collect()))
    own = {(r.dialogue_id, r.speaker, k): [] for r in dialogue.sides(rows).collect() for k in range(9)}
    for r in sorted(dialogue.sides(rows).collect(), key=lambda r: r.part):
        for k in range(9):
            own[r.dialogue_id, r.speaker, k] += r.streams[k]
    assert own == {(r.dialogue_id, s, k): r[s][k] for r in dialogue.merged(spark, str(tmp_path)).collect() for s in "AB" for k in range(9)}


def test_prefix_is_cut_before_examples_are_dealt(spark):
    from framewright.plans import dialogue

    sf = "/root/testdata/sf0.001"
    prefix = lambda rows: {(r.example_id, tuple(map(tuple, r.p))) for r in rows.select("example_id", streams.prompt_prefix(F.col("input_ids"), 20).alias("p")).collect()}
    cut = dialogue.batched(spark, sf, most=20)
    assert cut.select(F.max(F.size(F.get("input_ids", F.lit(0))))).first()[0] == 20
    assert prefix(cut) == prefix(dialogue.batched(spark, sf))


def test_stages_shuffle_in_parts_of_bounded_size(spark, monkeypatch, tmp_path):
    from framewright.config import DEFAULT
    from framewright.plans import dialogue

    rows = [(c, i, ("user", "assistant")[i % 2], "ab cd ef " * 5) for c in range(9) for i in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(dialogue, "PARTITION_CHARS", 150)
    seen = []
    real, was = type(spark.conf).set, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(type(spark.conf), "set", lambda self, k, v: (seen.append((k, v)), real(self, k, v))[1])
    assert dialogue.framed(spark, str(tmp_path), DEFAULT).count() > 0
    assert [v for k, v in seen if k == "spark.sql.shuffle.partitions"] == ["11", was]
    assert spark.conf.get("spark.sql.shuffle.partitions") == was
