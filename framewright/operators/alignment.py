"""Words to tokens to frames: time alignment of subword tokens and their placement on the frame grid of each speaker."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, StreamConfig
from ..functions.columns import frame_count, frame_index, strip_any
from ..functions.tokenizers import stand_in_id, stand_in_pieces

KEY = ["dialogue_id", "speaker"]


def quarantine(words: DataFrame, spaces: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good words, (dialogue_id, error)): a dialogue goes aside as a whole, and no row ends the job.

    It needs both speakers A and B with words, and complete rows that do not start before zero. A word without characters has
    no time to share: none may be empty, and with ``spaces`` the first one of a speaker, which gets no space, not blank either.
    """
    bad_row = F.col("word").isNull() | F.col("start").isNull() | F.col("end").isNull() | F.isnan("start") | F.isnan("end") | (F.col("start") < 0)
    first = F.min(F.when(~bad_row, F.struct("start", "pos", "word"))).alias("first")
    streams = words.groupBy("dialogue_id", "speaker").agg(first, F.max(bad_row).alias("bad"), F.max(F.length(F.coalesce("word", F.lit(""))) == 0).alias("empty"))
    blank = F.col("speaker").isin("A", "B") & (F.length(strip_any(F.col("first.word"))) == 0) & F.lit(spaces)
    stats = streams.groupBy("dialogue_id").agg(F.max(F.col("speaker") == "A").alias("a"), F.max(F.col("speaker") == "B").alias("b"), F.max("bad").alias("bad"), F.max(F.coalesce(blank, F.lit(False)) | (F.col("empty") & F.lit(not spaces))).alias("blank"))
    error = (
        F.when(~F.coalesce("a", F.lit(False)) | ~F.coalesce("b", F.lit(False)), "a speaker has no words").when(F.coalesce("bad", F.lit(True)), "a word is incomplete or starts before zero").when(F.col("blank"), "a word is empty")
    )
    judged = stats.select("dialogue_id", error.alias("error"))
    return words.where("speaker IN ('A', 'B')").join(judged.where("error IS NULL").select("dialogue_id"), "dialogue_id", "left_semi"), judged.where("error IS NOT NULL")


def spaced_words(words: DataFrame, spaces: bool = True) -> DataFrame:
    """Words in start order (ties in file order) with ``n``, the text they add to the stream, and its characters [c0, c1).

    With ``spaces``, words are stripped and all but a stream's first begin with a space; otherwise they stay as they are.
    """
    order = "PARTITION BY dialogue_id, speaker ORDER BY start, pos"
    rows = words.withColumn("n", F.expr(f"row_number() OVER ({order}) - 1"))
    bare = strip_any(F.col("word"))
    text = F.when(F.col("n") > 0, F.concat(F.lit(" "), bare)).otherwise(bare) if spaces else F.col("word")
    rows = rows.withColumn("text", text)
    return rows.withColumn("c1", F.expr(f"sum(length(text)) OVER ({order})")).withColumn("c0", F.col("c1") - F.length("text"))


def word_tokens(spaced: DataFrame, pieces: Callable[[Column], Column] = stand_in_pieces, ids: Callable[[Column], Column] = stand_in_id) -> DataFrame:
    """(dialogue_id, speaker, token_idx, token, token_id, b0, b1): tokens of an encoder that works word by word, in stream order."""
    rows = spaced.select(*KEY, "n", F.posexplode(pieces(F.col("text"))).alias("j", "token"))
    order = "PARTITION BY dialogue_id, speaker ORDER BY n, j"
    rows = rows.withColumn("token_idx", F.expr(f"row_number() OVER ({order}) - 1")).withColumn("b1", F.expr(f"sum(length(token)) OVER ({order})"))
    return rows.select(*KEY, "token_idx", "token", ids(F.col("token")).alias("token_id"), (F.col("b1") - F.length("token")).alias("b0"), "b1")


def stream_tokens(spaced: DataFrame, encode: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(tokens as ``word_tokens`` gives them, (dialogue_id, speaker, error)) of an encoder that reads a speaker's whole text.

    ``encode`` gives struct TOKEN_LIST. Tokens may cross words; those that stand for no character are not among them.
    """
    whole = spaced.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda w: w["text"]), "").alias("text"))
    coded = whole.select(*KEY, encode(F.col("text")).alias("x"))
    rows = coded.where("x.error IS NULL").select(*KEY, F.posexplode("x.tokens").alias("token_idx", "t"))
    return rows.select(*KEY, "token_idx", "t.token", "t.token_id", "t.b0", "t.b1"), coded.where("x.error IS NOT NULL").select(*KEY, "x.error")


def token_alignment(spaced: DataFrame, tokens: DataFrame) -> DataFrame:
    """``tokens`` with the start of their first character and the end of their last one.

    A word's time is shared evenly by its characters. Which word holds a character is an as-of lookup: words and token ends
    are put in one order by character, and each end takes the last word before it. That is one pass over a sorted stream,
    where a join on ranges would compare every token with every word of its stream. Streams whose tokens and words differ
    in length come out wrong; ``align_or_set_aside`` takes their dialogues out.
    """
    span = F.struct("start", "end", "c0", "c1")
    nothing = F.lit(None).cast("struct<start:double,end:double,c0:bigint,c1:bigint>")
    blank = F.lit(None).cast("struct<token_idx:int,token:string,token_id:int,b0:bigint,b1:bigint>")
    marks = spaced.where("c1 > c0").select(*KEY, F.col("c0").alias("at"), F.lit(0).alias("side"), span.alias("word"), blank.alias("t"))
    token = F.struct(F.col("token_idx").cast("int").alias("token_idx"), "token", F.col("token_id").cast("int").alias("token_id"), F.col("b0").cast("long").alias("b0"), F.col("b1").cast("long").alias("b1"))
    ends = tokens.where("b1 > b0").select(*KEY, F.explode(F.array(F.struct(F.col("b0").alias("at"), F.lit(1).alias("side")), F.struct((F.col("b1") - 1).alias("at"), F.lit(2).alias("side")))).alias("e"), token.alias("t"))
    ends = ends.select(*KEY, F.col("e.at").alias("at"), F.col("e.side").alias("side"), nothing.alias("word"), "t")
    held = F.expr("last(word, true) OVER (PARTITION BY dialogue_id, speaker ORDER BY at, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    found = marks.unionByName(ends).withColumn("w", held).where("side > 0")
    # Tokens do not overlap, so a token's end comes right behind its start.
    nxt = "OVER (PARTITION BY dialogue_id, speaker ORDER BY at, side)"
    both = found.select("*", F.expr(f"lead(w) {nxt}").alias("w2"), F.expr(f"lead(at) {nxt}").alias("at2")).where("side = 1")
    share = lambda w: (F.col(f"{w}.end") - F.col(f"{w}.start")) / (F.col(f"{w}.c1") - F.col(f"{w}.c0"))
    start = F.col("w.start") + (F.col("at") - F.col("w.c0")) * share("w")
    end = F.col("w2.start") + (F.col("at2") - F.col("w2.c0") + 1) * share("w2")
    return both.select(*KEY, "t.token_idx", "t.token", "t.token_id", start.alias("start"), end.alias("end"))


def length_mismatch(spaced: DataFrame, tokens: DataFrame) -> DataFrame:
    """(dialogue_id, speaker, error) of streams whose tokens do not have as many characters as their words."""
    w = spaced.groupBy(*KEY).agg(F.max("c1").alias("word_chars"))
    t = tokens.groupBy(*KEY).agg(F.max("b1").alias("token_chars"))
    differ = w.join(t, KEY, "left").where("NOT word_chars <=> token_chars")
    return differ.select(*KEY, F.lit("tokens and words differ in length").alias("error"))


def with_frames(aligned: DataFrame, config: StreamConfig = DEFAULT) -> DataFrame:
    """``aligned`` with ``frame`` and its stream's ``num_frames``, counted from the token that is last in the sequence."""
    last = F.expr("last_value(end) OVER (PARTITION BY dialogue_id, speaker ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    return aligned.withColumn("frame", frame_index(F.col("start"), config.frame_seconds)).withColumn("num_frames", frame_count(last, config.frame_rate))


def place_in_turn(frames: list[int], tokens: list[int], size: int, pad: int, end: int) -> list[tuple[int, int]]:
    """(slot, id) of the cells that are not padding: each token takes the first free cell from its frame on; past the grid it and
    all later ones are dropped; the free cell before a token is marked. A token equal to ``pad`` leaves its cell free."""
    cells: dict[int, int] = {}
    free = list(range(size + 1))  # the next free cell, with short-cuts

    def first_free(i: int) -> int:
        root = i
        while root < size and free[root] != root:
            root = free[root]
        while i < root:
            free[i], i = root, free[i]
        return root

    for frame, token in zip(frames, tokens, strict=True):
        slot = first_free(min(frame, size))
        if slot >= size:
            break
        if token != pad:
            cells[slot], free[slot] = token, slot + 1
        if slot > 0 and slot - 1 not in cells and end != pad:
            cells[slot - 1], free[slot - 1] = end, slot
    return sorted(cells.items())


def frame_placement(framed: DataFrame, config: StreamConfig = DEFAULT) -> DataFrame:
    """(dialogue_id, speaker, num_frames, slot, id): the cells of each stream that are not padding.

    Where frames do not go back along a stream, the slot of a token is its rank plus the largest lead of a frame over its
    rank so far, a window expression. Streams that go back, or hold the padding id as a token, are placed in turn, in Python;
    the two kinds are told apart first, and without the second no Python runs.
    """
    pad, end = config.text_padding_id, config.end_of_text_padding_id
    by = "PARTITION BY dialogue_id, speaker"
    step = framed.withColumn("back", F.expr(f"frame < lag(frame) OVER ({by} ORDER BY token_idx)"))
    odd = F.expr(f"max(coalesce(back, false) OR token_id = {pad}) OVER ({by})")
    rows = step.withColumn("odd", odd).withColumn("rn", F.expr(f"row_number() OVER ({by} ORDER BY token_idx) - 1"))
    slots = rows.where("NOT odd").withColumn("slot", F.expr(f"cast(rn + max(frame - rn) OVER ({by} ORDER BY rn) AS int)")).where("slot < num_frames")
    marked = slots.withColumn("before", F.expr(f"lag(slot) OVER ({by} ORDER BY slot)"))
    cell = F.struct("slot", F.col("token_id").alias("id"))
    mark = F.struct((F.col("slot") - 1).alias("slot"), F.lit(end).alias("id"))
    has_mark = (F.col("slot") > 0) & (F.col("before").isNull() | (F.col("before") != F.col("slot") - 1)) & F.lit(end != pad)
    plain = marked.select(*KEY, "num_frames", F.explode(F.when(has_mark, F.array(cell, mark)).otherwise(F.array(cell))).alias("c")).select(*KEY, "num_frames", "c.slot", "c.id")

    def slow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token_idx")
        size = int(pdf["num_frames"].iloc[0])
        cells = place_in_turn(pdf["frame"].tolist(), pdf["token_id"].tolist(), size, pad, end)
        return pd.DataFrame({"dialogue_id": pdf["dialogue_id"].iloc[0], "speaker": pdf["speaker"].iloc[0], "num_frames": size, "slot": [c[0] for c in cells], "id": [c[1] for c in cells]})

    schema = "dialogue_id string, speaker string, num_frames int, slot int, id int"
    return plain.unionByName(rows.where("odd").select(*KEY, "num_frames", "token_idx", "frame", "token_id").groupBy(*KEY).applyInPandas(slow, schema))


def text_stream_grid(cells: DataFrame, config: StreamConfig = DEFAULT) -> DataFrame:
    """(dialogue_id, speaker, text array<int>): one id for each frame, padding where there is no cell."""
    grouped = cells.groupBy(*KEY).agg(F.max("num_frames").alias("n"), F.map_from_entries(F.collect_list(F.struct("slot", "id"))).alias("m"))
    grid = F.expr(f"transform(if(n > 0, sequence(0, n - 1), array()), f -> coalesce(try_element_at(m, f), {config.text_padding_id}))")
    return grouped.select(*KEY, grid.alias("text"))


def text_windows(cells: DataFrame, size: int, before: int, config: StreamConfig = DEFAULT, past_end: bool = False) -> DataFrame:
    """(dialogue_id, speaker, part, num_frames, text): the streams of ``text_stream_grid`` in windows, so that no row is as long as a stream.

    Window ``part`` holds the frames from part * size - before (or 0) to (part + 1) * size, or to the end. Each cell brings the
    padding since the cell before it, and the last one that to the end, to every window that they lie in. With ``past_end`` there
    are also the windows that begin at or behind a stream's end and hold frames from before it: another stream of the dialogue
    may go on.
    """
    pad, order = F.lit(config.text_padding_id), "PARTITION BY dialogue_id, speaker ORDER BY slot"
    rows = cells.withColumn("lo", F.expr(f"coalesce(lag(slot) OVER ({order}) + 1, 0)"))
    rows = rows.withColumn("hi", F.expr(f"if(lead(slot) OVER ({order}) IS NULL, num_frames - 1, slot)"))
    last = f"(hi + {before}) div {size}" if past_end else f"least((hi + {before}) div {size}, (num_frames - 1) div {size})"
    windows = F.expr(f"sequence(cast(lo div {size} AS int), cast({last} AS int))")
    rows = rows.select(*KEY, "num_frames", "lo", "hi", "slot", "id", F.explode(windows).alias("part"))
    first, last = F.greatest("lo", F.col("part") * size - before), F.least("hi", F.col("part") * size + (size - 1))
    runs = rows.select(*KEY, "part", "num_frames", F.struct(first.alias("lo"), last.alias("hi"), "slot", "id").alias("r"))
    grouped = runs.groupBy(*KEY, "part").agg(F.max("num_frames").alias("num_frames"), F.sort_array(F.collect_list("r")).alias("rs"))
    filled = lambda r: F.concat(F.array_repeat(pad, r.slot - r.lo), F.array(r.id), F.array_repeat(pad, r.hi - r.slot))
    text = F.flatten(F.transform("rs", lambda r: F.when((r.slot >= r.lo) & (r.slot <= r.hi), filled(r)).otherwise(F.array_repeat(pad, r.hi - r.lo + 1))))
    return grouped.select(*KEY, "part", "num_frames", text.alias("text"))


def align_or_set_aside(words: DataFrame, pieces=stand_in_pieces, ids=stand_in_id, encode: Callable[[Column], Column] | None = None, spaces: bool = True) -> tuple[DataFrame, DataFrame]:
    """(aligned tokens, (dialogue_id, error)): every failure sets its whole dialogue aside, with the first error by name.

    Failures are those of ``quarantine``, texts that ``encode`` (a whole-text encoder, in place of ``pieces`` and ``ids``)
    cannot take, and streams whose tokens do not cover their words' characters.
    """
    good, bad = quarantine(words, spaces)
    spaced = spaced_words(good, spaces)
    tokens, failed = (word_tokens(spaced, pieces, ids), None) if encode is None else stream_tokens(spaced, encode)
    errors = bad.unionByName(length_mismatch(spaced, tokens).select("dialogue_id", "error"))
    if failed is not None:
        coded = failed.select("dialogue_id", F.lit("the encoder cannot take the text").alias("error"))
        errors = errors.unionByName(coded)
    errors = errors.groupBy("dialogue_id").agg(F.min("error").alias("error"))
    aside = errors.select("dialogue_id")
    return token_alignment(spaced.join(aside, "dialogue_id", "left_anti"), tokens.join(aside, "dialogue_id", "left_anti")), errors


def framed_tokens(words: DataFrame, config: StreamConfig = DEFAULT, pieces=stand_in_pieces, ids=stand_in_id) -> DataFrame:
    """Aligned tokens with frames, by a word-by-word encoder that covers every character, as the stand-in does."""
    good, _ = quarantine(words)
    spaced = spaced_words(good)
    return with_frames(token_alignment(spaced, word_tokens(spaced, pieces, ids)), config)


def text_streams(words: DataFrame, config: StreamConfig = DEFAULT) -> DataFrame:
    """From words to the text stream of each speaker."""
    return text_stream_grid(frame_placement(framed_tokens(words, config), config), config)


