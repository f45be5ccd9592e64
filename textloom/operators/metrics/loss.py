"""Mean token loss of a language model from its logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = -100


def _log_sum_exp(scores: Column) -> Column:
    top = F.array_max(scores)
    return top + F.log(F.aggregate(scores, F.lit(0.0).cast("double"), lambda a, x: a + F.exp(x - top)))


def token_losses(logits: Column, labels: Column) -> Column:
    """Loss of each kept target: the logits of a step are scored on the next step's label.

    A target without a score fails the job.
    """
    wide = F.transform(logits, lambda row: row.cast("array<double>"))
    steps = F.greatest(F.size(logits) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(wide, F.lit(1), steps), F.slice(labels, F.lit(2), steps),
        lambda row, target: F.struct(row.alias("row"), target.alias("target")),
    )
    kept = F.filter(pairs, lambda p: p["target"] != IGNORE)

    def score(p: Column) -> Column:
        shown = F.coalesce(p["target"].cast("string"), F.lit("NULL"))
        bad = F.raise_error(F.concat(F.lit("no score for target "), shown)).cast("double")
        return F.coalesce(F.get(p["row"], p["target"].cast("int")), bad)

    return F.transform(kept, lambda p: _log_sum_exp(p["row"]) - score(p))


def masked_loss(df: DataFrame, logits: str = "logits", labels: str | None = "labels", inputs: str = "input_ids") -> DataFrame:
    """One row ``loss``: mean over all unmasked next tokens; without labels the inputs are used."""
    losses = df.select(token_losses(F.col(logits), F.col(labels or inputs)).alias("l"))
    per_row = losses.select(
        F.aggregate("l", F.lit(0.0).cast("double"), lambda a, x: a + x).alias("s"), F.size("l").alias("n")
    )
    return per_row.agg((F.sum("s") / F.sum("n")).alias("loss"))
