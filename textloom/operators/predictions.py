"""Model outputs -> predictions, pairing with references, run logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax, drop, take
from ..functions.labels import index_to_label, indices_to_tags
from . import ordering

IGNORE = -100
START_METRIC = -100.0


def sequence_class(logits: Column, labels: Sequence[str]) -> Column:
    """Label of the largest score; the lowest index wins a tie."""
    return index_to_label(argmax(logits), labels)


def token_classes(logits: Column, gold: Column) -> Column:
    """Best index per token, up to the first ignored gold label."""
    best = F.transform(logits, argmax)
    stop = F.array_position(gold, F.lit(IGNORE).cast("bigint"))
    return F.when(stop > 0, take(best, stop - 1)).otherwise(take(best, F.size(gold)))


def token_labels(logits: Column, gold: Column, labels: Sequence[str]) -> Column:
    return indices_to_tags(token_classes(logits, gold), labels)


def aspect_classes(logits: Column) -> Column:
    """Best index per aspect."""
    return F.transform(logits, argmax)


def generated_ids(logits: Column, gold: Column) -> Column:
    """Best id per step, without every step whose gold label is ignored."""
    best = F.transform(logits, argmax)
    return F.filter(best, lambda h, i: F.get(gold, i) != IGNORE)


def visible_ids(gold: Column) -> Column:
    """Gold ids without the ignored ones."""
    return F.filter(gold, lambda g: g != IGNORE)


def remove_prompt(ids: Column, width: Column | int) -> Column:
    """Generated ids without the padded prompt in front."""
    return drop(ids, width)


def pair_with_references(
    hypotheses: DataFrame, references: DataFrame, id_col: str = "id", hyp: str = "hyp", label: str = "label"
) -> DataFrame:
    """``(id, hyp, label)`` by id. Every reference stays, repeated ones too; one without a hypothesis gets null.

    Two hypotheses for one id have no order by which they could be told apart: that is an error. Counting them costs no further
    shuffle, since the join is on the same key.
    """
    one = hypotheses.groupBy(id_col).agg(F.any_value(hyp).alias("_hyp"), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.concat(F.lit("more than one hypothesis for id "), F.col(id_col).cast("string")))
    found = F.when(F.col("_n") > 1, twice.cast(hypotheses.schema[hyp].dataType)).otherwise(F.col("_hyp"))
    return references.select(id_col, label).join(one, id_col, "left").select(id_col, found.alias(hyp), label)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def preview(df: DataFrame, id_col: str = "id", rows: int = 5) -> DataFrame:
    """First rows in id order."""
    return df.orderBy(id_col).limit(rows)


def epoch_losses(batches: DataFrame, by: Sequence[str], loss: str = "loss", test: bool = False) -> DataFrame:
    """Mean and sum of the batch losses per epoch; both 0 in test mode."""
    if test:
        return batches.groupBy(*by).agg(F.lit(0.0).alias("mean_loss"), F.lit(0.0).alias("sum_loss"))
    return batches.groupBy(*by).agg(F.avg(loss).alias("mean_loss"), F.sum(loss).alias("sum_loss"))


def levels(
    runs: DataFrame, exp: str = "exp", epoch: str = "epoch", metric: str = "metric", evaluate_every: int = 1,
) -> DataFrame:
    """Stretches of evaluations under one best metric: ``(exp, best, first, last)``.

    ``epoch`` counts densely from 1 and ``first`` and ``last`` count evaluations from 0. A
    stretch starts at an improvement (strictly above the best before); one before any
    improvement has the start value as its best.
    """
    seen = runs.where(F.col(epoch) % evaluate_every == 0).select(
        F.col(exp).alias("exp"), (F.floor(F.col(epoch) / evaluate_every) - 1).alias("step"),
        F.greatest(F.col(metric).cast("double"), F.lit(START_METRIC)).alias("metric"),
    )
    best = ordering.group_running_max(seen, ["exp"], "step", "metric", "best", include_current=True)
    return best.groupBy("exp", "best").agg(F.min("step").alias("first"), F.max("step").alias("last"))


def _stop_step(limit: int) -> Column:
    """Evaluation of a stretch at which ``limit`` of them have not improved, or null."""
    improved = F.col("best") > START_METRIC
    at = F.col("first") + F.when(improved, limit).otherwise(limit - 1)
    return F.when(at <= F.col("last"), at)


def early_stop(runs: DataFrame, limit: int = 3, evaluate_every: int = 1, **columns) -> DataFrame:
    """``(exp, stop_epoch)``: first evaluation with ``limit`` evaluations without improvement.

    ``stop_epoch`` is null for a run that never stops early.
    """
    found = levels(runs, evaluate_every=evaluate_every, **columns).groupBy("exp")
    return found.agg(((F.min(_stop_step(limit)) + 1) * evaluate_every).alias("stop_epoch"))


def best_epoch(runs: DataFrame, limit: int | None = 3, evaluate_every: int = 1, **columns) -> DataFrame:
    """``(exp, best_epoch, best_metric)``; epochs after an early stop do not count.

    The first of equal metrics wins. Null when no metric ever beats the start value.
    """
    here = F.struct(F.col("first"), F.col("best"))
    stopped = F.min(F.when(_stop_step(limit).isNotNull(), here)) if limit is not None else F.lit(None)
    chosen = levels(runs, evaluate_every=evaluate_every, **columns).groupBy("exp").agg(
        F.coalesce(stopped, F.max(here)).alias("level")
    )
    improved = F.col("level.best") > START_METRIC
    return chosen.select(
        "exp", F.when(improved, (F.col("level.first") + 1) * evaluate_every).alias("best_epoch"),
        F.when(improved, F.col("level.best")).alias("best_metric"),
    )


def describe(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column: ``(metric, statistic, value)``."""
    frames = []
    for name in columns:
        basic = metrics.agg(
            F.count(name).cast("double").alias("count"), F.avg(name).alias("mean"),
            F.stddev_samp(name).alias("std"), F.min(name).cast("double").alias("min"),
            F.max(name).cast("double").alias("max"),
        )
        frames.append(
            basic.unpivot([], ["count", "mean", "std", "min", "max"], "statistic", "value")
            .select(F.lit(name).alias("metric"), "statistic", "value")
        )
        quartile = ordering.quantiles(metrics.select(F.col(name).alias("v")), "v", [0.25, 0.5, 0.75])
        frames.append(
            quartile.select(
                F.lit(name).alias("metric"),
                F.format_string("%d%%", (F.col("p") * 100).cast("int")).alias("statistic"),
                F.col("quantile").alias("value"),
            )
        )
    return stack(frames)


def format_metrics(metrics: DataFrame, order: str = "position") -> DataFrame:
    """``(position, metric, value)`` -> one line ``name:0.00 name:0.00``."""
    entry = F.struct(F.col(order), F.format_string("%s:%.2f", F.col("metric"), F.col("value")).alias("text"))
    return metrics.agg(F.sort_array(F.collect_list(entry)).alias("all")).select(
        F.array_join(F.transform("all", lambda e: e["text"]), " ").alias("line")
    )
