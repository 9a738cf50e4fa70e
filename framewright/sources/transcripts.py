"""Word transcripts as tables: JSON files, and the conversations table as a stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import WORDS_JSON

#: Seconds between the starts of made-up words, and how long each lasts.
WORD_STEP, WORD_LENGTH = 0.11, 0.09


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """WORDS rows of a folder of JSON files, one array of words each; the file's stem is the dialogue. ``pos`` is the place in the
    file. A file that does not parse gives one row of nulls, for the quarantine."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("name"))
    stem = F.regexp_replace(F.regexp_replace("name", r"\.json$", ""), "%20", " ")
    words = files.select(stem.alias("dialogue_id"), F.posexplode_outer(F.from_json("value", WORDS_JSON)).alias("pos", "w"))
    return words.select("dialogue_id", "pos", "w.speaker", "w.word", "w.start", "w.end")


def write_transcripts(words: DataFrame, path: str) -> None:
    """A folder dialogue_id=... for each dialogue, with one array of its words as JSON, in their order."""
    word = F.struct("pos", F.struct("speaker", "word", "start", "end").alias("w"))
    whole = words.groupBy("dialogue_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"])).alias("value"))
    whole.write.partitionBy("dialogue_id").text(path)


def read_transcript_folders(spark: SparkSession, path: str) -> DataFrame:
    """WORDS rows of what ``write_transcripts`` wrote."""
    files = spark.read.schema("value string, dialogue_id string").text(path, wholetext=True)  # else a number loses its zeros
    words = files.select("dialogue_id", F.posexplode_outer(F.from_json("value", WORDS_JSON)).alias("pos", "w"))
    return words.select("dialogue_id", "pos", "w.speaker", "w.word", "w.start", "w.end")


def conversation_words(conversations: DataFrame) -> DataFrame:
    """WORDS rows of conversations: assistant is A, user is B, system turns go; the n-th word of a conversation starts at n steps."""
    speaker = F.when(F.col("role") == "assistant", "A").when(F.col("role") == "user", "B")
    turns = conversations.select(F.col("conv_id").cast("string").alias("dialogue_id"), "turn", speaker.alias("speaker"), F.filter(F.split("text", "[ \\n\\t\\r]+"), lambda w: w != "").alias("words"))
    turns = turns.where("speaker IS NOT NULL AND size(words) > 0")
    # One running sum over the turns of a conversation, not over its words.
    before = F.expr("coalesce(sum(size(words)) OVER (PARTITION BY dialogue_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    rows = turns.withColumn("before", before).select("dialogue_id", "speaker", "before", F.posexplode("words").alias("i", "word"))
    rows = rows.withColumn("pos", (F.col("before") + F.col("i")).cast("int"))
    start = F.col("pos") * F.lit(WORD_STEP)
    return rows.select("dialogue_id", "pos", "speaker", "word", start.alias("start"), (start + F.lit(WORD_LENGTH)).alias("end"))
