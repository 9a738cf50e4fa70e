"""Streams of one dialogue that end at different places around a window's border."""

import random

import duckdb
import pytest

from framewright import catalog
from framewright.operators import alignment, streams
from framewright.plans import dialogue


@pytest.fixture(scope="module")
def uneven(spark, tmp_path_factory):
    """Conversations in which one speaker stops some frames before, at or behind frame 1,024 or 2,048, and the other goes on."""
    sf, turns = tmp_path_factory.mktemp("uneven"), []
    for c, (words, more) in enumerate([(690, 60), (705, 40), (717, 50), (733, 60), (735, 30), (738, 90), (760, 9), (1450, 60), (1476, 40)]):
        roles = ("user", "assistant") if c % 2 else ("assistant", "user")
        parts = [(roles[1], 5), (roles[0], words - 5), (roles[1], more)]
        turns += [(c, i, role, " ".join(f"w{c}{i}{j}" for j in range(n))) for i, (role, n) in enumerate(parts)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    return str(sf)


def same_as_sql(spark, sf: str, name: str) -> None:
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet/*.parquet'")
    df, res = catalog.QUERIES[name](spark, sf), duck.execute(catalog.ORACLES[name])
    cols, names = sorted(df.columns), [d[0] for d in res.description]
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())
    assert want and sorted(tuple(r[c] for c in cols) for r in df.collect()) == want


def test_text_windows_past_the_end(spark):
    rng, cells = random.Random(7), []
    for d, n in enumerate([1, 8, 9, 14, 16, 17, 77]):
        cells += [(str(d), "A", n, t, 1000 + t) for t in sorted(rng.sample(range(n), max(1, n // 3)))]
    df = spark.createDataFrame(cells, "dialogue_id string, speaker string, num_frames int, slot int, id int")
    whole = {r.dialogue_id: r.text for r in alignment.text_stream_grid(df).collect()}
    got = {(r.dialogue_id, r.part): r.text for r in alignment.text_windows(df, 8, 19, past_end=True).collect()}
    assert got == {(d, p): t[max(p * 8 - 19, 0) : (p + 1) * 8] for d, t in whole.items() for p in range((len(t) - 1 + 19) // 8 + 1)}


def test_examples_of_uneven_streams(spark, uneven):
    kept = ["dialogue_id", "speaker", "chunk", "num_streams", "num_frames", "streams", "labels"]
    want = streams.training_examples(dialogue.merged(spark, uneven)).select(kept).collect()
    assert sorted(map(tuple, dialogue.examples(spark, uneven).select(kept).collect())) == sorted(map(tuple, want))


def test_split_streams_is_its_sql(spark, uneven):
    same_as_sql(spark, uneven, "split_streams")


def test_prompt_prefix_is_its_sql(spark, uneven):
    same_as_sql(spark, uneven, "prompt_prefix")


def test_collate_pad_is_its_sql(spark, uneven):
    same_as_sql(spark, uneven, "collate_pad")


def test_stream_labels_is_its_sql(spark, uneven):
    same_as_sql(spark, uneven, "stream_labels")


def test_merge_streams_by_windows(spark, uneven, monkeypatch):
    """No row is as long as a dialogue, and windows give what whole streams give."""
    longest, real = [], streams.merge_streams

    def seen(text, audio, *args, **kwargs):
        both = real(text, audio, *args, **kwargs)
        longest.extend(max(len(s) for x in (r.A, r.B) for s in x) for r in both.collect())
        return both

    monkeypatch.setattr(streams, "merge_streams", seen)
    same_as_sql(spark, uneven, "merge_streams")
    assert longest and max(longest) <= dialogue.WINDOW


def test_merge_streams_needs_both_speakers_on_both_sides(spark):
    text = [("d", s, p, [1, 2][p:]) for s in "AB" for p in (0, 1)] + [("x", "A", 0, [1]), ("y", "A", 0, [1]), ("y", "B", 0, [1])]
    audio = [("d", s, p, [[7, 8], [9, 9]]) for s in "AB" for p in (0, 1)] + [("x", "A", 0, [[1]]), ("x", "B", 0, [[1]]), ("y", "B", 0, [[1]])]
    text, audio = spark.createDataFrame(text, "dialogue_id string, speaker string, part int, text array<int>"), spark.createDataFrame(audio, "dialogue_id string, speaker string, part int, audio array<array<int>>")
    got = sorted(map(tuple, streams.merge_streams(text, audio, window="part").collect()))
    assert got == [("d", p, [t, [7, 8], [9, 9]], [t, [7, 8], [9, 9]]) for p, t in ((0, [1, 2]), (1, [2, 3]))]
