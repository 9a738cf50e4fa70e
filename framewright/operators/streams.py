"""Dataset assembly, training examples and batches on arrays of arrays; all of it array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, StreamConfig
from ..functions.columns import audio_frames, even_sizes
from .ranking import global_rank


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


# Assembly


def shard_assignment(ids: DataFrame, workers: int, key: str) -> DataFrame:
    """``ids`` with the 0-based worker of each row: even shares in key order, the first ones get one more.

    Rows are ranked by ranges, so that no task sorts all of them.
    """
    ranked, total = global_rank(ids, [key], "__n")
    base, rest = divmod(total, workers)
    at, long = F.col("__n"), rest * (base + 1)
    worker = F.when(at < long, F.floor(at / (base + 1))).otherwise(rest + F.floor((at - long) / max(base, 1)))
    return ranked.withColumn("worker", worker.cast("int")).drop("__n")


def resume_pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that have no output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("text", "audio"), named: int = 10) -> None:
    """Stop before anything is written if an id is on one side only: ValueError with how many there are and some of them."""
    missing = reconcile_missing(left, right, key, names)
    found = {r["missing_in"]: (r["n"], r["some"]) for r in missing.groupBy("missing_in").agg(F.count("*").alias("n"), F.min(key).alias("some")).collect()}
    if found:
        some = [str(r[key]) for r in missing.select(key).orderBy(key).limit(named).collect()]
        raise ValueError("; ".join(f"{n} without {side}" for side, (n, _) in sorted(found.items())) + f", such as {', '.join(some)}")


def reconcile_missing(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("text", "audio")) -> DataFrame:
    """(key, missing_in) for each id that only one side has; each side's ids count once."""
    a = left.select(key).distinct().withColumn("__a", F.lit(True))
    b = right.select(key).distinct().withColumn("__b", F.lit(True))
    missing = F.when(F.col("__a").isNull(), names[0]).when(F.col("__b").isNull(), names[1])
    return a.join(b, key, "full_outer").select(key, missing.alias("missing_in")).where("missing_in IS NOT NULL")


def align_text(text: Column, frames: Column, pad: int) -> Column:
    """The text stream cut or padded on the right to ``frames``; audio sets the length."""
    more = F.greatest(frames - F.size(text), F.lit(0))
    return F.slice(F.concat(text, F.array_repeat(F.lit(pad), more)), F.lit(1), frames)


def merge_streams(text: DataFrame, audio: DataFrame, config: StreamConfig = DEFAULT, prefix: str | None = None, window: str | None = None) -> DataFrame:
    """MERGED rows: for each dialogue and speaker the aligned text above its audio streams. Inputs: (dialogue_id, speaker, text) and
    (dialogue_id, speaker, audio array<array<int>>), one row for each speaker; a dialogue needs both speakers on both sides.

    With ``window``, a column of both inputs, their rows are windows of the streams and meet window by window.
    """
    keys = ["dialogue_id", window] if window else ["dialogue_id"]
    sides = lambda rows, c: rows.groupBy(*keys).agg(*[F.max(F.when(F.col("speaker") == s, F.col(c))).alias(f"{c}_{s}") for s in "AB"])
    both = sides(text, "text").join(sides(audio, "audio"), keys)

    def merged(s: str) -> Column:
        aligned = align_text(F.col(f"text_{s}"), F.size(F.get(f"audio_{s}", F.lit(0))), config.text_padding_id)
        return F.concat(F.array(aligned), f"audio_{s}").alias(s)

    name = F.concat_ws("/", F.lit(prefix), "dialogue_id") if prefix else F.col("dialogue_id")
    held = both.where(" AND ".join(f"{c}_{s} IS NOT NULL" for c in ("text", "audio") for s in "AB"))
    return held.select(name.alias("dialogue_id"), *keys[1:], merged("A"), merged("B"))


def size_mismatch(merged: DataFrame) -> DataFrame:
    """(dialogue_id, error) of merged rows whose streams are not all of one length."""
    lengths = F.array_distinct(F.transform(F.concat("A", "B"), lambda s: F.size(s)))
    return merged.where(F.size(lengths) != 1).select("dialogue_id", F.lit("streams differ in length").alias("error"))


def audio_shape_errors(audio: DataFrame, sample_rate: int, config: StreamConfig = DEFAULT) -> DataFrame:
    """(dialogue_id, error) of dialogues whose audio (dialogue_id, speaker, audio, samples) has not the codebooks of the settings,
    all of as many frames as the samples make."""
    frames = audio_frames(F.col("samples"), sample_rate, config.frame_rate)
    fits = (F.size("audio") == config.codebooks) & F.forall("audio", lambda s: F.size(s) == frames)
    wrong = audio.where(~F.coalesce(fits, F.lit(False))).select("dialogue_id").distinct()
    return wrong.select("dialogue_id", F.lit("audio and samples differ in frames").alias("error"))


def split_channels(streams: Column, channels: int = 8) -> tuple[Column, Column]:
    return F.slice(streams, 1, channels), F.slice(streams, channels + 1, channels)


# Examples


def main_speaker_streams(merged: DataFrame, speakers: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """(dialogue_id, speaker, streams): a view for each requested main speaker, its streams above the other's audio. Columns besides
    A and B stay."""
    other = {"A": "B", "B": "A"}
    views = F.array(*[F.struct(F.lit(s).alias("speaker"), F.concat(F.col(s), F.slice(F.col(other[s]), F.lit(2), F.greatest(F.size(other[s]) - 1, F.lit(0)))).alias("streams")) for s in speakers])
    equal = F.size(F.array_distinct(F.transform(F.concat("A", "B"), lambda s: F.size(s)))) == 1
    more = [c for c in merged.columns if c not in ("dialogue_id", "A", "B")]
    return merged.where(equal).select("dialogue_id", *more, F.explode(views).alias("v")).select("dialogue_id", "v.speaker", *more, "v.streams")


def delay_streams(streams: Column, config: StreamConfig = DEFAULT) -> Column:
    """One leading column of initial ids, then each stream behind as many more as its delay and padded to the longest one."""
    initial, pad, late = _ints(config.initial_ids), _ints(config.padding_ids), _ints(config.delays)
    most = max(config.delays)
    return F.transform(streams, lambda s, i: F.concat(F.array_repeat(F.get(initial, i), F.get(late, i) + 1), s, F.array_repeat(F.get(pad, i), F.lit(most) - F.get(late, i))))


def undelay_streams(streams: Column, delays, frames: Column | None = None) -> Column:
    """Each stream from its delay on, all of one length; null if there are not more frames than the longest delay, or not as many
    streams as delays. ``frames`` is how many the streams have, where a column says so; else the first stream is measured."""
    late, most = _ints(delays), max(delays)
    frames = F.size(F.get(streams, F.lit(0))) if frames is None else frames
    cut = F.transform(streams, lambda s, i: F.slice(s, F.get(late, i) + 1, F.greatest(frames - most, F.lit(0))))
    return F.when((frames >= most + 1) & (F.size(streams) == len(delays)), cut)


def split_streams(rows: DataFrame, config: StreamConfig = DEFAULT) -> DataFrame:
    """``rows`` with (chunk, num_frames, streams): even pieces of at most max_length frames; pieces under min_length go.

    Piece sizes are whole-number arithmetic on the length, which a column num_frames may give; without a column streams only
    they are worked out. All pieces of a row are sliced at once, so a long row is not copied for each of its pieces.
    """
    n = F.col("num_frames") if "num_frames" in rows.columns else F.size(F.get("streams", F.lit(0)))
    most, held = config.max_length, "streams" in rows.columns
    parts = F.greatest(F.ceil(n / most), F.lit(1)).cast("int") if most else F.lit(1)
    rows = rows.withColumn("__n", n).withColumn("__k", parts)

    def piece(c: Column) -> Column:
        off, size = even_sizes(F.col("__n"), F.col("__k"), c)
        more = [F.transform("streams", lambda s: F.slice(s, off + 1, size)).alias("streams")] if held else []
        return F.struct(c.alias("chunk"), size.alias("num_frames"), *more)

    chunks = F.sequence(F.lit(0), F.col("__k") - 1)
    if config.min_length:
        chunks = F.filter(chunks, lambda c: even_sizes(F.col("__n"), F.col("__k"), c)[1] >= config.min_length)
    made = ["chunk", "num_frames", "streams"]
    cut = rows.select(*[c for c in rows.columns if c not in made and c not in ("__n", "__k")], F.explode(F.transform(chunks, piece)).alias("__p"))
    order = [c for c in rows.columns if c not in ("__n", "__k")]
    order += [c for c in made if c not in order and (held or c != "streams")]
    return cut.select(*[F.col(f"__p.{c}").alias(c) if c in made else c for c in order])


def frames_before(config: StreamConfig = DEFAULT) -> int:
    """How many frames a window must hold before its own, so that ``split_windows`` finds each piece in one window."""
    return config.max_length + max(config.delays) + 1


def split_windows(windows: DataFrame, size: int, config: StreamConfig = DEFAULT) -> DataFrame:
    """(dialogue_id, speaker, chunk, num_frames, streams): the pieces that ``split_streams`` makes of ``delay_streams``, from windows.

    ``windows`` (dialogue_id, speaker, part, frames, streams) hold the frames from part * size - frames_before (or 0) to
    (part + 1) * size of streams of ``frames`` frames, before any delay. A piece is cut from the window of its last frame. No row
    is as long as a stream, so a long dialogue takes no more memory than a short one.
    """
    most, bound = max(config.delays), config.max_length
    initial, pad, late = _ints(config.initial_ids), _ints(config.padding_ids), _ints(config.delays)
    frames, at = F.col("frames"), F.col("part") * size
    n = frames + (1 + most)
    k = F.ceil(n / bound).cast("int")
    rows = windows.withColumn("__n", n.cast("int")).withColumn("__k", k).withColumn("__from", F.greatest(at - frames_before(config), F.lit(0)).cast("int"))
    sizes = lambda c: even_sizes(F.col("__n"), F.col("__k"), c)
    base = F.floor(F.col("__n") / F.col("__k")).cast("int")

    def here(c: Column) -> Column:
        off, many = sizes(c)
        end = F.greatest(F.least(off + many - 2, frames - 1), F.lit(0))
        found = (end >= at) & (end < at + size)
        return found & (many >= config.min_length) if config.min_length else found

    # Pieces are base or base + 1 long, so those that end in a window are not far from these two.
    low = F.greatest(F.floor(at / (base + 1)).cast("int") - 2, F.lit(0))
    high = F.when(at + size >= frames, F.col("__k") - 1).otherwise(F.least(F.ceil((at + size + 2) / base).cast("int"), F.col("__k") - 1))

    def piece(c: Column) -> Column:
        off, many = sizes(c)

        def cut(s: Column, i: Column) -> Column:
            begin = F.get(late, i) + 1
            ahead = F.least(F.greatest(begin - off, F.lit(0)), many)
            behind = F.least(F.greatest(off + many - begin - frames, F.lit(0)), many)
            first = F.greatest(off - begin, F.lit(0)) - F.col("__from") + 1
            return F.concat(F.array_repeat(F.get(initial, i), ahead), F.slice(s, first, many - ahead - behind), F.array_repeat(F.get(pad, i), behind))

        return F.struct(c.alias("chunk"), many.alias("num_frames"), F.transform("streams", cut).alias("streams"))

    chunks = F.filter(F.sequence(low, F.greatest(high, low)), lambda c: (c <= high) & here(c))
    return rows.select("dialogue_id", "speaker", F.explode(F.transform(chunks, piece)).alias("__p")).select("dialogue_id", "speaker", "__p.chunk", "__p.num_frames", "__p.streams")


def stream_labels(streams: Column, config: StreamConfig = DEFAULT) -> Column:
    """Values below their stream's initial id; zero id elsewhere."""
    initial = _ints(config.initial_ids)
    return F.transform(streams, lambda s, i: F.transform(s, lambda v: F.when(v < F.get(initial, i), v).otherwise(config.zero_id)))


def training_examples(merged: DataFrame, config: StreamConfig = DEFAULT, speakers: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """(dialogue_id, speaker, chunk, num_streams, num_frames, streams, labels): views, delays, pieces, labels, in this order."""
    return examples_of_delayed(main_speaker_streams(merged, speakers).withColumn("streams", delay_streams(F.col("streams"), config)), config)


def examples_of_delayed(rows: DataFrame, config: StreamConfig = DEFAULT) -> DataFrame:
    """The training examples of delayed views (dialogue_id, speaker, streams)."""
    return labelled(split_streams(rows, config), config)


def labelled(cut: DataFrame, config: StreamConfig = DEFAULT) -> DataFrame:
    """The training examples of pieces (dialogue_id, speaker, chunk, num_frames, streams)."""
    return cut.select("dialogue_id", "speaker", "chunk", F.size("streams").alias("num_streams"), "num_frames", "streams", stream_labels(F.col("streams"), config).alias("labels"))


# Batches


def example_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with example_id, their 0-based rank in ``order`` over the whole table, made range by range."""
    return global_rank(rows, order, "example_id")[0]


def limit_examples(rows: DataFrame, most: int | None) -> DataFrame:
    return rows if most is None else rows.where(F.col("example_id") < most)


def batches(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with batch_id: consecutive examples; the last batch may be smaller."""
    return rows.withColumn("batch_id", F.floor(F.col("example_id") / size).cast("long"))


def collate(rows: DataFrame, config: StreamConfig = DEFAULT) -> DataFrame:
    """``rows`` with input_ids, labels and text_attention_mask padded to the longest example of their batch by the zero id.

    A column ``longest`` says how long that is, where it is known; so the arrays need not be dealt by batch. The mask is 1 on real frames and the zero id elsewhere.
    """
    longest = F.col("longest") if "longest" in rows.columns else F.expr("max(num_frames) OVER (PARTITION BY batch_id)")
    rows = rows.withColumn("__more", (longest - F.col("num_frames")).cast("int"))
    fill = lambda s: F.concat(s, F.array_repeat(F.lit(config.zero_id), F.col("__more")))
    mask = F.concat(F.array_repeat(F.lit(1), F.col("num_frames")), F.array_repeat(F.lit(config.zero_id), F.col("__more")))
    long = "array<array<bigint>>"
    return rows.select(*[c for c in rows.columns if c not in ("streams", "labels", "longest", "__more")], F.transform("streams", fill).cast(long).alias("input_ids"), F.transform("labels", fill).cast(long).alias("labels"), mask.cast("array<bigint>").alias("text_attention_mask"))


def prompt_prefix(streams: Column, frames: int) -> Column:
    return F.transform(streams, lambda s: F.slice(s, 1, frames))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with ``position``, their 0-based place in a repeatable shuffle: by the digest of the seed and the key."""
    named = rows.withColumn("__mixed", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    return global_rank(named, ["__mixed", key], "position")[0].drop("__mixed")


def epoch_plan(examples: DataFrame, per_device: int, processes: int, accumulation: int) -> DataFrame:
    """(examples, global_batch, steps_per_epoch)."""
    whole = per_device * processes * accumulation
    return examples.agg(F.count("*").alias("examples")).select("examples", F.lit(whole).cast("long").alias("global_batch"), F.ceil(F.col("examples") / whole).cast("long").alias("steps_per_epoch"))


def skip_on_resume(rows: DataFrame, steps: int, accumulation: int, batches_per_epoch: int) -> DataFrame:
    """Batches that a resumed epoch still has to see; both numbers count batches, also when several make one step."""
    return rows.where(F.col("batch_id") >= (steps * accumulation) % max(batches_per_epoch, 1))


def sampling_candidates(logits: DataFrame, key: str, temperature: float = 1.0, top_k: int = 0, top_p: float = 0.0) -> DataFrame:
    """(key, id, probability) of the ids that a sampler may draw: the ``top_k`` best, of which the best whose probabilities before
    them sum to less than ``top_p``; 0 turns either off. Ties go to the lower id; probabilities sum to 1 over what is left."""
    scaled = F.transform("logits", lambda x: x / temperature)
    ranked = F.expr("array_sort(transform(scaled, (x, i) -> struct(-x AS neg, i AS id)))")
    kept = F.slice("ranked", 1, top_k) if top_k else F.col("ranked")
    rows = logits.select(key, scaled.alias("scaled")).select(key, ranked.alias("ranked")).select(key, kept.alias("kept"))
    rows = rows.withColumn("total", F.expr("aggregate(kept, 0D, (a, x) -> a + exp(kept[0].neg - x.neg))"))
    rows = rows.select(key, F.posexplode(F.expr("transform(kept, x -> struct(x.id AS id, exp(kept[0].neg - x.neg) / total AS p))")).alias("rank", "c"))
    before = F.expr(f"coalesce(sum(c.p) OVER (PARTITION BY `{key}` ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)")
    rows = rows.withColumn("before", before)
    rows = rows.where(F.col("before") < top_p) if top_p else rows
    return rows.select(key, F.col("c.id").cast("int").alias("id"), (F.col("c.p") / F.expr(f"sum(c.p) OVER (PARTITION BY `{key}`)")).alias("probability"))
