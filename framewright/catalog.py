"""Every query of the token-stream operators by name, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions.columns import argmax, audio_frames, ceil_div, checksum, cross_entropy, natural_key
from .functions.tokenizers import ascii_pieces
from .operators import alignment, metrics, streams, weights
from .plans import dialogue
from .plans.oracles import MERGED, STREAMS, TOKENS, WORDS, check, over
from .sources import files, transcripts
from .sources.stages import scratch
from .streaming.metrics import streaming_means

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_stream(rows: DataFrame, keys: list[str], streams_column: str = "streams") -> DataFrame:
    """One row for each stream: its number, length and checksum."""
    out = rows.select(*keys, F.posexplode(streams_column).alias("k", "s"))
    return out.select(*keys, "k", F.size("s").alias("n"), checksum(F.col("s")).alias("checksum"))


# Text


@query(over(WORDS, 'SELECT dialogue_id, pos, speaker, word, round(start, 9) AS start, round("end", 9) AS "end" FROM words'))
def transcript_words(spark, sf_dir):
    return dialogue.words(spark, sf_dir).select("dialogue_id", "pos", "speaker", "word", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))


@query(over(WORDS, "SELECT dialogue_id, 'a speaker has no words' AS error FROM judged WHERE NOT good"))
def quarantined_dialogues(spark, sf_dir):
    return alignment.quarantine(dialogue.words(spark, sf_dir))[1]


@query(over(WORDS, "SELECT dialogue_id, speaker, n::BIGINT AS n, text, c1 - len(text) AS c0, c1 FROM spaced"))
def word_char_spans(spark, sf_dir):
    return dialogue.spaced(spark, sf_dir).select("dialogue_id", "speaker", F.col("n").cast("long").alias("n"), "text", "c0", "c1")


@query(over(TOKENS, 'SELECT dialogue_id, speaker, token_idx, token_id, round(t0, 9) AS start, round(t1, 9) AS "end" FROM aligned'))
def token_alignment(spark, sf_dir):
    s = dialogue.spaced(spark, sf_dir)
    rows = alignment.token_alignment(s, alignment.word_tokens(s))
    return rows.select("dialogue_id", "speaker", "token_idx", "token_id", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))


# An encoder that drops what is not printable ASCII comes out short on some streams.
_SHORT = "short AS (SELECT dialogue_id, speaker FROM spaced GROUP BY ALL HAVING sum(len(text)) <> sum(len(regexp_replace(text, '[^ -~]', '', 'g'))))"


@query(over(f"{WORDS}, {_SHORT}", "SELECT dialogue_id, speaker, 'tokens and words differ in length' AS error FROM short"))
def length_mismatch(spark, sf_dir):
    s = dialogue.spaced(spark, sf_dir)
    return alignment.length_mismatch(s, alignment.word_tokens(s, ascii_pieces))


@query(over(f"{WORDS}, {_SHORT}", "SELECT dialogue_id, 'a speaker has no words' AS error FROM judged WHERE NOT good UNION ALL SELECT DISTINCT dialogue_id, 'tokens and words differ in length' FROM short"))
def set_aside(spark, sf_dir):
    return alignment.align_or_set_aside(dialogue.words(spark, sf_dir), pieces=ascii_pieces)[1]


@query(over(f"{TOKENS}, {_SHORT}", 'SELECT dialogue_id, speaker, token_idx, token_id, round(t0, 9) AS start, round(t1, 9) AS "end" FROM aligned ANTI JOIN short USING (dialogue_id)'))
def aligned_after_set_aside(spark, sf_dir):
    rows = alignment.align_or_set_aside(dialogue.words(spark, sf_dir), pieces=ascii_pieces)[0]
    return rows.select("dialogue_id", "speaker", "token_idx", "token_id", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))


@query(over(WORDS, 'SELECT dialogue_id, pos, speaker, word, round(start, 9) AS start, round("end", 9) AS "end" FROM words'))
def transcript_scan(spark, sf_dir):
    path = scratch(spark, "transcripts")
    transcripts.write_transcripts(dialogue.words(spark, sf_dir), path)
    rows = transcripts.read_transcript_folders(spark, path)
    return rows.select("dialogue_id", "pos", "speaker", "word", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))


@query(over(TOKENS, "SELECT dialogue_id, speaker, token_idx, frame, num_frames FROM framed"))
def frame_index(spark, sf_dir):
    return dialogue.framed(spark, sf_dir).select("dialogue_id", "speaker", "token_idx", "frame", "num_frames")


@query(over(TOKENS, "SELECT dialogue_id, speaker, slot::INTEGER AS slot, id FROM cells WHERE id <> 0"))
def frame_placement(spark, sf_dir):
    return alignment.frame_placement(dialogue.framed(spark, sf_dir)).where("id <> 0").select("dialogue_id", "speaker", "slot", "id")


@query(over(TOKENS, "SELECT dialogue_id, speaker, slot::INTEGER AS slot FROM cells WHERE id = 0"))
def eot_markers(spark, sf_dir):
    return alignment.frame_placement(dialogue.framed(spark, sf_dir)).where("id = 0").select("dialogue_id", "speaker", "slot")


@query(over(STREAMS, f"SELECT dialogue_id, speaker, len(text)::INTEGER AS n, {check('text')} AS checksum FROM grid"))
def text_stream_grid(spark, sf_dir):
    return dialogue.text(spark, sf_dir).select("dialogue_id", "speaker", F.size("text").alias("n"), checksum(F.col("text")).alias("checksum"))


# Assembly


@query(over(MERGED, f"SELECT dialogue_id, speaker, len(s)::INTEGER AS n, {check('s')} AS checksum FROM merged WHERE k = 0"))
def align_text_to_audio(spark, sf_dir):
    rows = dialogue.frames_of(dialogue.text(spark, sf_dir))
    aligned = streams.align_text(F.col("text"), F.col("frames"), DEFAULT.text_padding_id)
    return rows.select("dialogue_id", "speaker", aligned.alias("s")).select("dialogue_id", "speaker", F.size("s").alias("n"), checksum(F.col("s")).alias("checksum"))


@query(over(MERGED, f"SELECT 'train/' || dialogue_id AS dialogue_id, speaker, k, len(s)::INTEGER AS n, {check('s')} AS checksum FROM merged"))
def merge_streams(spark, sf_dir):
    text, audio = dialogue.text_and_audio(spark, sf_dir)
    both = streams.merge_streams(text, audio, prefix="train", window="part")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("speaker"), F.col(s).alias("streams")) for s in "AB"]))
    rows = both.select("dialogue_id", "part", sides.alias("x")).select("dialogue_id", "part", "x.speaker", F.posexplode("x.streams").alias("k", "s"))
    value = checksum(F.col("s"), F.col("part").cast("long") * dialogue.WINDOW)
    return rows.groupBy("dialogue_id", "speaker", "k").agg(F.sum(F.size("s")).cast("int").alias("n"), F.sum(value).alias("checksum"))


@query(over(MERGED, f"SELECT dialogue_id, speaker, CASE WHEN k <= 4 THEN 0 ELSE 1 END AS half, (k - 1) % 4 AS k, {check('s')} AS checksum FROM merged WHERE k > 0"))
def split_channels(spark, sf_dir):
    rows = dialogue.sides(dialogue.merged_windows(spark, sf_dir)).select("dialogue_id", "speaker", "part", F.slice("streams", 2, 8).alias("s"))
    halves = streams.split_channels(F.col("s"), 4)
    out = rows.select("dialogue_id", "speaker", "part", F.posexplode(F.array(*halves)).alias("half", "streams")).select("dialogue_id", "speaker", "part", "half", F.posexplode("streams").alias("k", "s"))
    # A window's checksum counts from its own first frame; its values weigh as many more as frames are before it.
    value = checksum(F.col("s")) + F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x) * F.col("part") * dialogue.WINDOW
    return out.groupBy("dialogue_id", "speaker", "half", "k").agg(F.sum(value).alias("checksum"))


_AUDIO_SIZES = MERGED + """, sized AS (
    SELECT dialogue_id, speaker, len(s)::BIGINT AS frames, len(s)::BIGINT * 1920 - (dialogue_id::BIGINT % 3) * 10 + CASE WHEN dialogue_id::BIGINT % 5 = 0 THEN 1920 ELSE 0 END AS samples FROM merged WHERE k = 1
)"""


def _audio_sizes(spark, sf_dir) -> DataFrame:
    """Audio of each speaker with a number of samples at 24 kHz that ends within its last frame; every fifth dialogue has a frame more."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("speaker"), F.slice(s, 2, 8).alias("audio")) for s in "AB"])).alias("x")
    rows = dialogue.merged(spark, sf_dir).select("dialogue_id", sides).select("dialogue_id", "x.speaker", "x.audio")
    return rows.withColumn("samples", _samples(F.size(F.get("audio", F.lit(0)))))


def _samples(frames):
    d = F.col("dialogue_id").cast("long")
    return frames.cast("long") * 1920 - d % 3 * 10 + F.when(d % 5 == 0, 1920).otherwise(0)


@query(over(_AUDIO_SIZES, "SELECT dialogue_id, speaker, ceil(samples / 1920.0)::BIGINT AS frames FROM sized"))
def audio_frame_count(spark, sf_dir):
    own = dialogue.sides(dialogue.merged_windows(spark, sf_dir)).groupBy("dialogue_id", "speaker")
    rows = own.agg(F.sum(F.size(F.get("streams", F.lit(1)))).alias("n"))
    return rows.select("dialogue_id", "speaker", audio_frames(_samples(F.col("n")), 24000, 12.5).alias("frames"))


@query(over(_AUDIO_SIZES, "SELECT dialogue_id, 'audio and samples differ in frames' AS error FROM sized WHERE ceil(samples / 1920.0) <> frames GROUP BY 1"))
def audio_shape_errors(spark, sf_dir):
    return streams.audio_shape_errors(_audio_sizes(spark, sf_dir), 24000)


_CUSTOMERS = "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) AS n, count(*) OVER () AS t FROM customer"


@query(f"SELECT c_custkey, (CASE WHEN n < (t % 7) * (t // 7 + 1) THEN n // (t // 7 + 1) ELSE t % 7 + (n - (t % 7) * (t // 7 + 1)) // (t // 7) END)::INTEGER AS worker FROM ({_CUSTOMERS})")
def shard_assignment(spark, sf_dir):
    return streams.shard_assignment(table(spark, sf_dir, "customer").select("c_custkey"), 7, "c_custkey")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def resume_pending(spark, sf_dir):
    return streams.resume_pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, CASE WHEN d IS NULL THEN 'text' ELSE 'audio' END AS missing_in FROM (SELECT DISTINCT doc_id, 1 AS d FROM documents) FULL JOIN (SELECT DISTINCT doc_id, 1 AS l FROM labels WHERE quality = 1) USING (doc_id) WHERE d IS NULL OR l IS NULL")
def reconcile_missing(spark, sf_dir):
    return streams.reconcile_missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("SELECT chunk, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 300)::INTEGER AS chunk FROM documents) GROUP BY 1")
def write_chunks(spark, sf_dir):
    path = scratch(spark, "chunks")
    files.write_chunks(table(spark, sf_dir, "documents").select("doc_id"), path, rows=300, key="doc_id", exact=True)
    rows = files.read_splits(spark, {"train": [f"{path}/chunk=*/*.parquet"]}, "doc_id long")["train"].select("doc_id", F.regexp_extract("_metadata.file_path", r"chunk=([0-9]+)/", 1).cast("int").alias("chunk"))
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("SELECT lang AS split, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def named_splits(spark, sf_dir):
    path = scratch(spark, "splits")
    table(spark, sf_dir, "documents").select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    found = files.read_splits(spark, {s: [f"{path}/lang={s}/*.parquet"] for s in ("en", "fr")}, "doc_id long")
    rows = [df.agg(F.lit(s).alias("split"), F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")) for s, df in found.items()]
    return rows[0].unionByName(rows[1])


@query("SELECT source, row_number() OVER (ORDER BY regexp_replace(source, '[0-9]+', ''), regexp_extract(source, '[0-9]+')::BIGINT) AS rank FROM (SELECT DISTINCT source FROM documents)")
def natural_sort(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("source").distinct().withColumn("key", natural_key(F.col("source")))
    return names.select("source", F.expr("cast(row_number() OVER (ORDER BY key, source) AS long)").alias("rank"))  # a name for each source


@query(over(MERGED, f"SELECT dialogue_id, speaker, k, len(s)::INTEGER AS n, {check('s')} AS checksum FROM merged"))
def npz_round_trip(spark, sf_dir):
    packed = files.pack_npz(dialogue.merged(spark, sf_dir), "dialogue_id")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("speaker"), F.col(s).alias("streams")) for s in "AB"]))
    rows = files.unpack_npz(packed, "dialogue_id").select("dialogue_id", sides.alias("x"))
    return by_stream(rows.select("dialogue_id", "x.speaker", "x.streams"), ["dialogue_id", "speaker"])


# Examples


@query(over(MERGED, f"SELECT dialogue_id, speaker, k, len(s)::INTEGER AS n, {check('s')} AS checksum FROM viewed"))
def main_speaker_streams(spark, sf_dir):
    return by_stream(streams.main_speaker_streams(dialogue.merged(spark, sf_dir)), ["dialogue_id", "speaker"])


@query(over(MERGED, f"SELECT dialogue_id, speaker, k, len(s)::INTEGER AS n, {check('s')} AS checksum FROM delayed"))
def delay_streams(spark, sf_dir):
    return by_stream(dialogue.delayed(spark, sf_dir), ["dialogue_id", "speaker"])


@query(over(MERGED, f"SELECT dialogue_id, speaker, k, (len(s) - 1)::INTEGER AS n, {check('list_slice(s, late + 1, late + len(s) - 1)')} AS checksum FROM delayed"))
def undelay_streams(spark, sf_dir):
    rows = dialogue.delayed(spark, sf_dir)
    return by_stream(rows.withColumn("streams", streams.undelay_streams(F.col("streams"), DEFAULT.delays, F.col("num_frames"))), ["dialogue_id", "speaker"])


@query(over(MERGED, f"SELECT (dense_rank() OVER (ORDER BY dialogue_id, speaker) - 1)::BIGINT AS example_id, k, (len(s) - 1)::INTEGER AS n, {check('list_slice(s, late + 1, late + len(s) - 1)')} AS checksum FROM delayed"))
def generated_tokens(spark, sf_dir):
    rows = dialogue.delayed(spark, sf_dir)
    ids = streams.example_ids(rows.select("dialogue_id", "speaker"), ["dialogue_id", "speaker"])
    path = scratch(spark, "generated")
    files.write_generated(rows.join(ids, ["dialogue_id", "speaker"]).select("example_id", F.col("streams").alias("tokens")), path, DEFAULT)
    return by_stream(files.read_generated(spark, path), ["example_id"], "tokens")


@query(over(MERGED, f"SELECT dialogue_id, speaker, chunk, k, len(s)::INTEGER AS n, {check('s')} AS checksum FROM chunks"))
def split_streams(spark, sf_dir):
    from dataclasses import replace

    return by_stream(streams.split_windows(dialogue.view_windows(spark, sf_dir), dialogue.WINDOW, replace(DEFAULT, min_length=None)), ["dialogue_id", "speaker", "chunk"])


@query(over(MERGED, "SELECT dialogue_id, speaker, chunk, num_frames FROM chunks WHERE k = 0 AND num_frames >= 50"))
def filter_short(spark, sf_dir):
    from dataclasses import replace

    return streams.split_streams(dialogue.delayed(spark, sf_dir).drop("streams"), replace(DEFAULT, min_length=50)).select("dialogue_id", "speaker", "chunk", "num_frames")


@query(over(MERGED, f"SELECT dialogue_id, speaker, chunk, k, len(s)::INTEGER AS n, {check('labels')} AS checksum FROM examples"))
def stream_labels(spark, sf_dir):
    return by_stream(dialogue.examples(spark, sf_dir), ["dialogue_id", "speaker", "chunk"], "labels")


@query(over(MERGED, "SELECT dialogue_id, speaker, chunk, count(*)::INTEGER AS num_streams, any_value(num_frames) AS num_frames FROM examples GROUP BY 1, 2, 3"))
def training_chunks(spark, sf_dir):
    return dialogue.examples(spark, sf_dir).select("dialogue_id", "speaker", "chunk", "num_streams", "num_frames")


# Batches


def _numbered(spark, sf_dir):
    return dialogue.numbered(spark, sf_dir).drop("batch_id")


@query(over(MERGED, "SELECT DISTINCT dialogue_id, speaker, chunk, example_id FROM examples"))
def example_ids(spark, sf_dir):
    return _numbered(spark, sf_dir).select("dialogue_id", "speaker", "chunk", "example_id")


@query(over(MERGED, "SELECT DISTINCT dialogue_id, speaker, chunk, example_id FROM examples WHERE example_id < 25"))
def limit_examples(spark, sf_dir):
    return streams.limit_examples(_numbered(spark, sf_dir), 25).select("dialogue_id", "speaker", "chunk", "example_id")


@query(over(MERGED, "SELECT batch_id, count(*) AS examples, min(example_id) AS first_id, max(num_frames) AS longest FROM padded WHERE k = 0 GROUP BY 1"))
def batches(spark, sf_dir):
    rows = streams.batches(_numbered(spark, sf_dir), DEFAULT.batch_size)
    return rows.groupBy("batch_id").agg(F.count("*").alias("examples"), F.min("example_id").alias("first_id"), F.max("num_frames").alias("longest"))


@query(over(MERGED, f"SELECT example_id, batch_id, k, len(input_ids)::INTEGER AS n, {check('input_ids')} AS ids_checksum, {check('out_labels')} AS labels_checksum FROM padded"))
def collate_pad(spark, sf_dir):
    rows = dialogue.batched(spark, sf_dir).select("example_id", "batch_id", F.posexplode(F.arrays_zip("input_ids", "labels")).alias("k", "x"))
    return rows.select("example_id", "batch_id", "k", F.size("x.input_ids").alias("n"), checksum(F.col("x.input_ids")).alias("ids_checksum"), checksum(F.col("x.labels")).alias("labels_checksum"))


@query(over(MERGED, "SELECT example_id, num_frames AS ones, (most - num_frames)::INTEGER AS fills FROM padded WHERE k = 0"))
def attention_mask(spark, sf_dir):
    rows = dialogue.batched(spark, sf_dir)
    count = lambda v: F.size(F.filter("text_attention_mask", lambda x: x == v))
    return rows.select("example_id", count(1).alias("ones"), count(DEFAULT.zero_id).alias("fills"))


@query(over(MERGED, f"SELECT example_id, k, {check('list_slice(input_ids, 1, 10)')} AS checksum FROM padded"))
def prompt_prefix(spark, sf_dir):
    rows = dialogue.batched(spark, sf_dir, most=10).select("example_id", F.posexplode(streams.prompt_prefix(F.col("input_ids"), 10)).alias("k", "s"))
    return rows.select("example_id", "k", checksum(F.col("s")).alias("checksum"))


@query(over(MERGED, "SELECT count(*) AS examples, 24::BIGINT AS global_batch, ceil(count(*) / 24.0)::BIGINT AS steps_per_epoch FROM examples WHERE k = 0"))
def epoch_plan(spark, sf_dir):
    return streams.epoch_plan(dialogue.examples(spark, sf_dir), 4, 3, 2)


@query(over(MERGED, "SELECT DISTINCT batch_id FROM padded WHERE batch_id >= (3 * 2) % 5"))
def skip_on_resume(spark, sf_dir):
    rows = streams.batches(_numbered(spark, sf_dir), DEFAULT.batch_size)
    return streams.skip_on_resume(rows, 3, 2, 5).select("batch_id").distinct()


@query("SELECT conv_id, row_number() OVER (ORDER BY md5('7:' || conv_id), conv_id) - 1 AS position FROM (SELECT DISTINCT conv_id FROM conversations)")
def shuffle(spark, sf_dir):
    return streams.shuffled(table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id", 7)


@query("SELECT o_orderkey, (ceil(o_orderkey / 7.0))::BIGINT AS parts FROM orders")
def ceil_division(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ceil_div(F.col("o_orderkey"), 7).alias("parts"))


# Metrics


def _logits(spark, sf_dir) -> DataFrame:
    """Vectors as logits of 64 classes: ten frames an example, 17 codebooks in turn, label 9 as the zero id."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("example_id"), (F.col("vec_id") % 10).cast("int").alias("frame"), (F.col("vec_id") % 17).cast("int").alias("codebook"),
        F.col("vec_id"), F.col("embedding").cast("array<double>").alias("logits"), F.when(F.col("label") == 9, DEFAULT.zero_id).otherwise(F.col("label")).alias("label"),
    )


_LOGITS = """logits AS (
    SELECT vec_id, vec_id // 10 AS example_id, vec_id % 10 AS frame, vec_id % 17 AS codebook, embedding::DOUBLE[] AS x, CASE WHEN label = 9 THEN -1 ELSE label END AS label FROM embeddings
), scored AS (
    SELECT *, CASE WHEN label = -1 THEN 0 ELSE list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) - x[label + 1] END AS loss,
        CASE WHEN list_position(x, list_max(x)) - 1 = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct
    FROM logits
)"""


@query(over(_LOGITS, "SELECT vec_id, next_label FROM (SELECT vec_id, lead(label) OVER (PARTITION BY example_id ORDER BY frame) AS next_label FROM logits) WHERE next_label IS NOT NULL"))
def next_token_pairs(spark, sf_dir):
    return metrics.next_token_pairs(_logits(spark, sf_dir)).select("vec_id", "next_label")


@query(over(_LOGITS, "SELECT vec_id, round(loss, 6) AS loss FROM scored"))
def cross_entropy_loss(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(cross_entropy(F.col("logits"), F.col("label"), DEFAULT.zero_id), 6).alias("loss"))


@query(over(_LOGITS, "SELECT vec_id, (list_position(x, list_max(x)) - 1)::INTEGER AS best, correct FROM scored"))
def argmax_accuracy(spark, sf_dir):
    return metrics.scored(_logits(spark, sf_dir)).select("vec_id", argmax(F.col("logits")).alias("best"), "correct")


_TEXT = """text AS (
    SELECT coalesce(avg(loss) FILTER (label NOT IN (3, -1)), 'nan'::DOUBLE) AS text_loss_non_pad, coalesce(avg(loss) FILTER (label = 3), 'nan'::DOUBLE) AS text_loss_pad,
        coalesce(avg(correct) FILTER (label NOT IN (3, -1)), 'nan'::DOUBLE) AS text_acc_non_pad, coalesce(avg(correct) FILTER (label = 3), 'nan'::DOUBLE) AS text_acc_pad,
        coalesce(avg(loss) FILTER (label NOT IN (3, -1)), 0) + 0.5 * coalesce(avg(loss) FILTER (label = 3), 0) AS text_loss
    FROM scored
), audio AS (
    SELECT CASE WHEN codebook = 0 THEN 'semantic' WHEN codebook < 8 THEN 'acoustic' WHEN codebook = 8 THEN 'user_semantic' ELSE 'user_acoustic' END AS class,
        count(*) AS tokens, sum(loss) AS loss_sum, avg(loss) AS loss, avg(correct) AS accuracy
    FROM scored WHERE label <> -1 GROUP BY 1
), weighted AS (
    SELECT coalesce(sum((CASE WHEN class LIKE '%semantic' THEN 100.0::DOUBLE ELSE 1 END) * loss_sum) / sum((CASE WHEN class LIKE '%semantic' THEN 100.0::DOUBLE ELSE 1 END) * tokens), 0) AS audio_loss FROM audio
)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(over(f"{_LOGITS}, {_TEXT}", "SELECT round(text_loss_non_pad, 6) AS text_loss_non_pad, round(text_loss_pad, 6) AS text_loss_pad, round(text_acc_non_pad, 6) AS text_acc_non_pad, round(text_acc_pad, 6) AS text_acc_pad, round(text_loss, 6) AS text_loss FROM text"))
def text_loss_split(spark, sf_dir):
    return _rounded(metrics.text_loss_split(_logits(spark, sf_dir)))


@query(over(f"{_LOGITS}, {_TEXT}", "SELECT class, tokens, round(loss_sum, 6) AS loss_sum, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM audio"))
def audio_loss_split(spark, sf_dir):
    return _rounded(metrics.audio_loss_split(_logits(spark, sf_dir)))


@query(over(f"{_LOGITS}, {_TEXT}", "SELECT round(audio_loss, 6) AS audio_loss FROM weighted"))
def weighted_audio_loss(spark, sf_dir):
    return _rounded(metrics.weighted_audio_loss(metrics.audio_loss_split(_logits(spark, sf_dir))))


@query(over(f"{_LOGITS}, {_TEXT}", "SELECT round(text_loss, 6) AS text_loss, round(audio_loss, 6) AS audio_loss, round(text_loss + audio_loss, 6) AS total_loss FROM text, weighted"))
def total_loss(spark, sf_dir):
    rows = _logits(spark, sf_dir)
    return _rounded(metrics.total_loss(metrics.text_loss_split(rows), metrics.weighted_audio_loss(metrics.audio_loss_split(rows))))


def _events(spark, sf_dir) -> DataFrame:
    """Events as metric rows; those of every seventh event are NaN."""
    value = F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 50) + 1).cast("long").alias("step"), F.when(F.col("event_id") % 5 == 0, "evaluation").otherwise("training").alias("split"), F.col("event_type").alias("metric"), value.alias("value"), F.lit(0).alias("rank"))


_EVENTS = "m AS (SELECT event_id // 50 + 1 AS step, CASE WHEN event_id % 5 = 0 THEN 'evaluation' ELSE 'training' END AS split, event_type AS metric, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"


@query(over(_EVENTS, "SELECT split, metric, step, round(coalesce(avg(value), 'nan'::DOUBLE), 6) AS value FROM m GROUP BY 1, 2, 3"))
def nanmean_metrics(spark, sf_dir):
    return _rounded(metrics.nanmean_metrics(_events(spark, sf_dir), ["split", "metric", "step"]))


@query(over(_EVENTS, 'SELECT split, split || \'_\' || metric AS metric, (step - 1) // 10 AS "window", max(step) AS last_step, round(coalesce(avg(value), \'nan\'::DOUBLE), 6) AS value FROM m GROUP BY 1, 2, 3'))
def logging_window(spark, sf_dir):
    return _rounded(metrics.logging_window(_events(spark, sf_dir)))


@query(over(_EVENTS, "SELECT step, split, split || '_' || metric AS metric, count(*) AS n, round(coalesce(avg(value), 'nan'::DOUBLE), 6) AS value FROM m GROUP BY 1, 2, 3"))
def metric_table(spark, sf_dir):
    path, rows = scratch(spark, "metrics"), _events(spark, sf_dir)
    for even in (0, 1):  # two runs append to one table
        files.write_metrics(rows.where(F.col("step") % 2 == even), path)
    found = files.read_metrics(spark, path)
    return _rounded(found.groupBy("step", "split", "metric").agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(~F.isnan("value"), F.col("value"))), F.lit(float("nan"))).alias("value")))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def streaming_event_means(spark, sf_dir):
    return _rounded(streaming_means(table(spark, sf_dir, "events")))


@query(
    "WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT vec_id, i - 1 AS id, e[i] AS v, row_number() OVER (PARTITION BY vec_id ORDER BY e[i] DESC, i) AS rank FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM x)), "
    "k AS (SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM r WHERE rank <= 20), c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k) "
    "SELECT vec_id, id::INTEGER AS id, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS probability FROM c WHERE before < 0.8"
)
def sampling_candidates(spark, sf_dir):
    rows = _logits(spark, sf_dir).select("vec_id", "logits")
    return _rounded(streams.sampling_candidates(rows, "vec_id", 1.0, top_k=20, top_p=0.8))


# Weights


@query("SELECT (i - 1)::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1")
def embedding_mean(spark, sf_dir):
    return _rounded(weights.embedding_mean(table(spark, sf_dir, "embeddings")))


@query("SELECT (i - 1)::INTEGER AS i, (j - 1)::INTEGER AS j, round(covar_pop(embedding[i]::DOUBLE, embedding[j]::DOUBLE), 6) AS cov FROM embeddings, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY 1, 2")
def embedding_covariance(spark, sf_dir):
    return _rounded(weights.embedding_covariance(table(spark, sf_dir, "embeddings")))


@query()
def gaussian_init(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return weights.gaussian_rows(weights.embedding_mean(rows), weights.embedding_covariance(rows), 100)


@query("SELECT vec_id, CASE WHEN vec_id IN (0, 3, 17) THEN label ELSE -5 END AS value FROM embeddings")
def retain_override(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("value"))
    return weights.retain_override(rows.select("vec_id", F.lit(-5).alias("value")), rows, [0, 3, 17], "vec_id", "value")


def _names(spark, sf_dir) -> DataFrame:
    """Parameter names made of supplier keys."""
    kinds = ["transformer.layers.{}.gating.linear_in_weight", "transformer.layers.{}.gating.linear_out_weight", "depformer.layers.{}.gating.1.linear_in_weight", "depformer.layers.{}.gating.2.linear_out_weight", "depformer.layers.{}.self_attn.out_proj_weight", "emb.{}.weight", "text_emb.weight_{}"]
    key = F.col("s_suppkey")
    name = F.lit("text_emb.weight_0")
    for i, k in enumerate(kinds):
        a, b = k.split("{}")
        name = F.when(key % len(kinds) == i, F.concat(F.lit(a), key.cast("string"), F.lit(b))).otherwise(name)
    return table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))


_NAMES = (
    "n AS (SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'transformer.layers.' || s_suppkey || '.gating.linear_in_weight' WHEN 1 THEN 'transformer.layers.' || s_suppkey || '.gating.linear_out_weight' "
    "WHEN 2 THEN 'depformer.layers.' || s_suppkey || '.gating.1.linear_in_weight' WHEN 3 THEN 'depformer.layers.' || s_suppkey || '.gating.2.linear_out_weight' "
    "WHEN 4 THEN 'depformer.layers.' || s_suppkey || '.self_attn.out_proj_weight' WHEN 5 THEN 'emb.' || s_suppkey || '.weight' ELSE 'text_emb.weight_' || s_suppkey END AS name FROM supplier)"
)


@query(over(_NAMES, "SELECT name, regexp_replace(name, '(linear_in|linear_out|out_proj)_weight$', '\\1.weight') AS new_name FROM n"))
def key_rename(spark, sf_dir):
    return weights.renamed(_names(spark, sf_dir)).select("name", "new_name")


@query(over(_NAMES, "SELECT name, split_part(name, '.', 1) IN ('emb', 'text_emb', 'transformer', 'out_norm', 'text_linear') AS trainable FROM n"))
def parameter_groups(spark, sf_dir):
    return weights.trainable(_names(spark, sf_dir), "tempformer").select("name", "trainable")


@query(
    "WITH s AS (SELECT vec_id // 8 AS g, list(embedding ORDER BY vec_id % 8) AS l FROM embeddings GROUP BY 1), f AS (SELECT g, flatten(l) AS x FROM s WHERE len(l) = 8), "
    "p AS (SELECT * FROM (VALUES ('a', 0, 100), ('b', 100, 250), ('c', 350, 160)) AS t(param, off, numel)) "
    "SELECT g AS \"group\", param, numel::INTEGER AS n, round(list_sum(list_transform(x[off + 1 : off + numel], lambda v, i: v::DOUBLE * i)), 4) AS checksum FROM f, p"
)
def merge_flat_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("long").alias("group"), (F.col("vec_id") % 8).cast("int").alias("rank"), F.col("embedding").alias("values"))
    params = rows.select("group").distinct().select("group", F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.lit(i).alias("position"), F.lit(n).alias("numel")) for i, (p, n) in enumerate([("a", 100), ("b", 250), ("c", 160)])])).alias("p")).select("group", "p.*")
    merged = weights.merge_flat_groups(rows, params, 8)
    return merged.select("group", "param", F.size("values").alias("n"), _weighted("values"))


def _weighted(values: str):
    return F.round(F.aggregate(F.transform(values, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("checksum")


@query(
    "WITH s AS (SELECT vec_id // 4 AS p, list(embedding ORDER BY vec_id % 4) AS l FROM embeddings GROUP BY 1) "
    "SELECT 'v' || p AS param, 250::BIGINT AS numel, round(list_sum(list_transform(list_slice(flatten(l), 1, 250), lambda v, i: v::DOUBLE * i)), 4) AS checksum FROM s"
)
def merge_param_slices(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).cast("int").alias("rank"), F.concat(F.lit("v"), F.floor(F.col("vec_id") / 4).cast("string")).alias("param"), F.lit(250).cast("long").alias("numel"), F.col("embedding").alias("values"))
    # Where the number of vectors is no multiple of four, the last param has fewer slices; it is a row like the others.
    return weights.merge_param_slices(rows, 4, strict=False).select("param", "numel", _weighted("values"))


@query("SELECT vec_id // 8 AS \"group\", count(*) AS shards FROM embeddings GROUP BY 1 HAVING count(*) <> 8")
def incomplete_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("long").alias("group"))
    return weights.incomplete_groups(rows, 8)


@query("SELECT count(DISTINCT vec_id % 7) AS ranks FROM embeddings")
def shard_count(spark, sf_dir):
    return weights.shard_count(table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("rank")))
