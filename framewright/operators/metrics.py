"""Masked losses and accuracies over rows of logits and labels, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, StreamConfig
from ..functions.columns import argmax, cross_entropy

NAN = float("nan")


def next_token_pairs(rows: DataFrame, example: str = "example_id", frame: str = "frame") -> DataFrame:
    """``rows`` with next_label: each frame's logits meet the label of the next frame; an example's last frame goes."""
    return rows.withColumn("next_label", F.expr(f"lead(label) OVER (PARTITION BY `{example}` ORDER BY `{frame}`)")).where("next_label IS NOT NULL")


def scored(rows: DataFrame, config: StreamConfig = DEFAULT, label: str = "label") -> DataFrame:
    """``rows`` with ``loss`` (0 where the label is the zero id) and ``correct`` (1.0 or 0.0)."""
    y = F.col(label)
    return rows.withColumn("loss", cross_entropy(F.col("logits"), y, config.zero_id)).withColumn("correct", (argmax(F.col("logits")) == y).cast("double"))


def _mean(value: Column, when: Column) -> Column:
    """Mean over the rows of a class; NaN if it has none."""
    return F.coalesce(F.avg(F.when(when, value)), F.lit(NAN))


def text_loss_split(rows: DataFrame, config: StreamConfig = DEFAULT, label: str = "label") -> DataFrame:
    """One row of text metrics: loss and accuracy of padding and of other tokens, and the weighted text loss."""
    y = F.col(label)
    pad, other = y == config.text_padding_id, (y != config.text_padding_id) & (y != config.zero_id)
    zero = lambda c: F.coalesce(F.avg(F.when(c, F.col("loss"))), F.lit(0.0))
    return scored(rows, config, label).agg(
        _mean(F.col("loss"), other).alias("text_loss_non_pad"), _mean(F.col("loss"), pad).alias("text_loss_pad"), _mean(F.col("correct"), other).alias("text_acc_non_pad"), _mean(F.col("correct"), pad).alias("text_acc_pad"),
        (zero(other) + config.text_padding_weight * zero(pad)).alias("text_loss"),
    )


def codebook_class(codebook: Column, codebooks: int = 8) -> Column:
    """Semantic and acoustic codebooks of the main speaker, then of the user."""
    return F.when(codebook == 0, "semantic").when(codebook < codebooks, "acoustic").when(codebook == codebooks, "user_semantic").otherwise("user_acoustic")


def audio_loss_split(rows: DataFrame, config: StreamConfig = DEFAULT, user_stream: bool = True, label: str = "label") -> DataFrame:
    """(class, tokens, loss_sum, loss, accuracy) for each class of codebooks, labels equal to the zero id left out."""
    kept = rows if user_stream else rows.where(F.col("codebook") < config.codebooks)
    kept = scored(kept, config, label).where(F.col(label) != config.zero_id)
    return kept.groupBy(codebook_class(F.col("codebook"), config.codebooks).alias("class")).agg(F.count("*").alias("tokens"), F.sum("loss").alias("loss_sum"), F.avg("loss").alias("loss"), F.avg("correct").alias("accuracy"))


def weighted_audio_loss(split: DataFrame, config: StreamConfig = DEFAULT) -> DataFrame:
    """(audio_loss): weighted sums of losses over weighted counts; 0 without tokens."""
    w = F.when(F.col("class").endswith("semantic"), config.semantic_weight).otherwise(config.acoustic_weight)
    return split.agg(F.coalesce(F.try_divide(F.sum(w * F.col("loss_sum")), F.sum(w * F.col("tokens"))), F.lit(0.0)).alias("audio_loss"))


def total_loss(text: DataFrame, audio: DataFrame) -> DataFrame:
    """(text_loss, audio_loss, total_loss) of two one-row tables."""
    none = F.lit(None).cast("double")
    both = text.select("text_loss", none.alias("audio_loss")).unionByName(audio.select(none.alias("text_loss"), "audio_loss"))
    return both.agg(F.max("text_loss").alias("text_loss"), F.max("audio_loss").alias("audio_loss")).withColumn("total_loss", F.col("text_loss") + F.col("audio_loss"))


def nanmean_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and value: the mean of the values that are not NaN (and not null); NaN if there is none."""
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.when(~F.isnan("value"), F.col("value"))), F.lit(NAN)).alias("value"))


def logging_window(rows: DataFrame, config: StreamConfig = DEFAULT) -> DataFrame:
    """(split, metric, window, last_step, value): NaN-ignoring means over each run of logging_steps steps; keys begin with the split."""
    named = rows.withColumn("window", F.floor((F.col("step") - 1) / config.logging_steps).cast("long")).withColumn("metric", F.concat_ws("_", "split", "metric"))
    means = named.groupBy("split", "metric", "window").agg(F.max("step").alias("last_step"), F.coalesce(F.avg(F.when(~F.isnan("value"), F.col("value"))), F.lit(NAN)).alias("value"))
    return means
