import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.config import StreamConfig
from framewright.operators import metrics, weights
from framewright.schemas import WORDS
from framewright.sources import files, stages
from framewright.sources.transcripts import conversation_words, read_transcript_folders, read_transcripts, write_transcripts
from framewright.streaming.metrics import streaming_means

CONFIG = StreamConfig()


def _rows(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i // 6, i % 6, i % 17, rng.normal(size=5).tolist(), int(rng.integers(-1, 5))) for i in range(n)], "example_id int, frame int, codebook int, logits array<double>, label int")


def test_cross_entropy_and_accuracy(spark):
    for r in metrics.scored(_rows(spark)).collect():
        x = np.array(r["logits"])
        want = 0.0 if r["label"] == -1 else np.log(np.exp(x).sum()) - x[r["label"]]
        assert abs(r["loss"] - want) < 1e-9 and r["correct"] == float(x.argmax() == r["label"])
    ties = spark.createDataFrame([([1.0, 2.0, 2.0], 1)], "logits array<double>, label int")
    assert metrics.scored(ties).first()["correct"] == 1.0


def test_losses(spark):
    rows = _rows(spark)
    all_ = metrics.scored(rows).collect()
    mean = lambda v: sum(v) / len(v)
    t = metrics.text_loss_split(rows).first()
    other, pad = [r["loss"] for r in all_ if r["label"] not in (3, -1)], [r["loss"] for r in all_ if r["label"] == 3]
    assert abs(t["text_loss"] - (mean(other) + 0.5 * mean(pad))) < 1e-9
    none = metrics.text_loss_split(rows.where("label = 3")).first()
    assert math.isnan(none["text_loss_non_pad"]) and not math.isnan(none["text_loss"])
    split = metrics.audio_loss_split(rows)
    w = lambda c: 100.0 if c in (0, 8) else 1.0
    kept = [r for r in all_ if r["label"] != -1]
    want = sum(w(r["codebook"]) * r["loss"] for r in kept) / sum(w(r["codebook"]) for r in kept)
    assert abs(metrics.weighted_audio_loss(split).first()[0] - want) < 1e-9
    assert {r["class"] for r in metrics.audio_loss_split(rows, user_stream=False).collect()} == {"semantic", "acoustic"}
    assert metrics.weighted_audio_loss(split.where("false")).first()[0] == 0.0


def test_next_token_and_nanmean(spark):
    rows = _rows(spark, 12)
    assert metrics.next_token_pairs(rows).count() == 10
    m = spark.createDataFrame([(1, "t", "a", 1.0), (2, "t", "a", float("nan")), (11, "t", "a", 5.0), (1, "t", "b", float("nan"))], "step long, split string, metric string, value double")
    got = {r["metric"]: r["value"] for r in metrics.nanmean_metrics(m, ["metric"]).collect()}
    assert got["a"] == 3.0 and math.isnan(got["b"])
    w = {(r["metric"], r["window"]): r["value"] for r in metrics.logging_window(m).collect()}
    assert w["t_a", 0] == 1.0 and w["t_a", 1] == 5.0


def test_moments_and_draws(spark):
    x = np.random.default_rng(1).normal(size=(200, 4)) * [1, 2, 3, 4] + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<float>").repartition(3)
    cov = np.zeros((4, 4))
    for r in weights.embedding_covariance(df).collect():
        cov[r["i"], r["j"]] = r["cov"]
    assert np.allclose(cov, np.cov(x.T, bias=True), atol=1e-4)
    mean = [r["mean"] for r in weights.embedding_mean(df).orderBy("dim").collect()]
    assert np.allclose(mean, x.mean(0), atol=1e-5)
    drawn = np.array([r["embedding"] for r in weights.gaussian_rows(weights.embedding_mean(df), weights.embedding_covariance(df), 3000, scale=1.0).collect()])
    assert np.allclose(np.cov(drawn.T, bias=True), cov, atol=1.6) and np.allclose(drawn.mean(0), mean, atol=0.4)
    assert weights.embedding_covariance(df.where("false")).count() == 0


def test_weight_tables(spark):
    t = spark.createDataFrame([(0, 1.0), (1, 2.0)], "id int, v double")
    assert {r["id"]: r["v"] for r in weights.retain_override(t.withColumn("v", F.lit(9.0)), t, [1], "id", "v").collect()} == {0: 9.0, 1: 2.0}
    with pytest.raises(ValueError):
        weights.retain_override(t, t, [7], "id", "v")
    names = spark.createDataFrame([("transformer.layers.3.gating.linear_in_weight",), ("depformer.layers.0.self_attn.out_proj_weight",), ("x.transformer.layers.3.gating.linear_in_weight",)], "name string")
    assert [r["new_name"] for r in weights.renamed(names).collect()] == ["transformer.layers.3.gating.linear_in.weight", "depformer.layers.0.self_attn.out_proj.weight", "x.transformer.layers.3.gating.linear_in_weight"]
    assert [r["trainable"] for r in weights.trainable(names, "depformer").collect()] == [False, True, False]
    with pytest.raises(ValueError):
        weights.trainable(names, "text_embedding")


def test_shards(spark):
    shards = spark.createDataFrame([(0, 1, [3.0, 4.0, 0.0]), (0, 0, [0.0, 1.0, 2.0])], "group int, rank int, values array<float>")
    params = spark.createDataFrame([(0, "b", 1, 3), (0, "a", 0, 2)], "group int, param string, position int, numel int")
    assert {r["param"]: r["values"] for r in weights.merge_flat_groups(shards, params, 2).collect()} == {"a": [0.0, 1.0], "b": [2.0, 3.0, 4.0]}
    assert weights.merge_flat_groups(shards, params, 3).count() == 0 and [tuple(r) for r in weights.incomplete_groups(shards, 3).collect()] == [(0, 2)]
    s3 = spark.createDataFrame([(1, "p", 5, [3.0, 4.0, 0.0]), (0, "p", 5, [0.0, 1.0, 2.0])], "rank int, param string, numel long, values array<float>")
    assert weights.merge_param_slices(s3, 2).first()["values"] == [0.0, 1.0, 2.0, 3.0, 4.0]
    weights.check_shards(s3, 2)
    with pytest.raises(ValueError):
        weights.check_shards(s3, 3)
    with pytest.raises(Exception, match="missing"):
        weights.merge_param_slices(s3, 3).collect()


def test_last_param_with_fewer_slices(spark, tmp_path):
    from framewright.catalog import ORACLES, QUERIES

    duckdb = pytest.importorskip("duckdb")
    rows = [(i, [float(i + j) for j in range(64)]) for i in range(10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = duckdb.sql(ORACLES["merge_param_slices"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in QUERIES["merge_param_slices"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 3


def test_array_files_come_back_row_by_row(spark):
    rows = spark.createDataFrame([(str(k), [[k, 1, 2]] * 2, [[k]]) for k in range(40)], "dialogue_id string, A array<array<int>>, B array<array<int>>").coalesce(1)
    again = files.unpack_npz(files.pack_npz(rows, "dialogue_id"), "dialogue_id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_stages_of_long_arrays_hold_few_rows(spark):
    import glob

    import pyarrow.parquet as pq

    def make():
        return spark.range(300, numPartitions=1).select("id", F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.hash(i * 31 + F.col("id"))).alias("s"))

    rows = stages.compute_once(spark, "long-arrays", [1], make)
    scan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Batched: false" in scan or "ColumnarToRow" not in scan
    (path,) = glob.glob(f"{rows.inputFiles()[0].removeprefix('file://')}")
    assert pq.ParquetFile(path).metadata.num_row_groups > 1 and rows.where(F.size("s") == 40_000).count() == 300


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    words = [{"speaker": "B", "word": "hi", "start": 0.1, "end": 0.2}, {"speaker": "A", "word": "α", "start": 0.0, "end": 0.2}]
    (tmp_path / "t/D1.json").write_text(json.dumps(words))
    (tmp_path / "t/bad.json").write_text("{oops")
    got = read_transcripts(spark, str(tmp_path / "t")).orderBy("dialogue_id", "pos").collect()
    assert [(r["dialogue_id"], r["pos"], r["word"]) for r in got] == [("D1", 0, "hi"), ("D1", 1, "α"), ("bad", None, None)]
    np.savez_compressed(tmp_path / "x.npz", A=np.arange(6).reshape(2, 3), B=np.zeros((1, 2), int))
    assert files.read_npz(spark, str(tmp_path)).first()["A"] == [[0, 1, 2], [3, 4, 5]]
    df = spark.range(23).select(F.format_string("d%02d", "id").alias("dialogue_id"))
    files.write_chunks(df, str(tmp_path / "exact"), rows=5, exact=True)
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "exact")).groupBy("chunk").count().collect()) == [3, 5, 5, 5, 5]
    files.write_chunks(df, str(tmp_path / "most"), rows=5)
    assert files.read_splits(spark, {"train": [str(tmp_path / "most/*.parquet")]})["train"].count() == 23
    made = spark.createDataFrame([(i, [[i, i, i, 7], [i, 1, 2, 3]]) for i in range(9)] + [(9, [[1], [1]])], "example_id long, tokens array<array<int>>")
    small = StreamConfig(delays=(0, 1))
    files.write_generated(made, str(tmp_path / "g"), small)
    back = {r["example_id"]: r["tokens"] for r in files.read_generated(spark, str(tmp_path / "g")).collect()}
    assert back[4] == [[4, 4, 4], [1, 2, 3]] and back[9] is None and len(back) == 10
    assert [r["example_id"] for r in files.read_generated(spark, str(tmp_path / "g"), [3]).collect()] == [3] and files.read_generated(spark, str(tmp_path / "g"), []).count() == 0
    m = spark.createDataFrame([(1, "training", "loss", 2.0), (2, "evaluation", "loss", float("nan"))], "step long, split string, metric string, value double")
    for _ in range(2):
        files.write_metrics(m, str(tmp_path / "m"))
    assert sorted(r["metric"] for r in files.read_metrics(spark, str(tmp_path / "m")).collect()) == ["evaluation_loss"] * 2 + ["training_loss"] * 2
    files.save_config(spark, CONFIG, str(tmp_path / "c"))
    assert files.load_config(spark, str(tmp_path / "c")) == CONFIG
    assert CONFIG.differs_from(StreamConfig(batch_size=9, max_length=3), ignore=("max_length",)) == ["batch_size"]


def test_stages_are_computed_once(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    assert stages.compute_once(spark, "numbers", ["x", 1], make).count() == 5 == stages.compute_once(spark, "numbers", ["x", 1], make).count()
    assert len(made) == 1 and stages.compute_once(spark, "numbers", ["x", 2], make).count() == 5 and len(made) == 2


def test_transcripts_written_and_read(spark, tmp_path):
    rows = [("d 1", 0, "A", "a", 0.5, 1.0), ("d 1", 1, "B", "é", 0.0, 1.0), ("x/2", 0, "A", "z", 0.0, 1.0)]
    df = spark.createDataFrame(rows, WORDS)
    write_transcripts(df, str(tmp_path / "w"))
    assert sorted(map(tuple, read_transcript_folders(spark, str(tmp_path / "w")).collect())) == rows


def test_conversation_words_and_stream(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "system", "x"), (1, 2, "assistant", " c\n"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert [(r["pos"], r["speaker"], r["word"]) for r in conversation_words(c).orderBy("pos").collect()] == [(0, "B", "a"), (1, "B", "b"), (2, "A", "c")]
    e = spark.createDataFrame([("x", "2024-01-01 00:10:00", 1.0), ("x", "2024-01-01 00:20:00", 3.0), ("y", "2024-01-01 05:00:00", float("nan"))], "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "e"))
    s = streaming_means(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = s.writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["event_type"], str(r["window_start"]), r["n"], r["value"])
    assert sorted(map(key, spark.table("means").collect()), key=str) == sorted(map(key, streaming_means(e).collect()), key=str)
