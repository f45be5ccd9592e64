"""Accuracy and macro precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 when the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def from_counts(correct: Column, guessed: Column, gold: Column) -> dict[str, Column]:
    """tp, fp, fn, precision, recall and F1 from counts."""
    p, r = ratio(correct, guessed), ratio(correct, gold)
    return {
        "tp": correct, "fp": guessed - correct, "fn": gold - correct,
        "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r),
    }


def class_counts(df: DataFrame, hyp: str = "hyp", label: str = "label") -> DataFrame:
    """``(cls, correct, guessed, gold)`` over all classes seen on either side.

    A null is no class: a missing prediction is wrong for its gold class and guesses nothing.

    Pairs are counted first, so what is shuffled does not grow with the rows.
    """
    pairs = df.groupBy(F.col(label).alias("label"), F.col(hyp).alias("hyp")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("bigint")
    same = F.when(F.col("label") == F.col("hyp"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("cls"), same.alias("correct"), zero.alias("guessed"), F.col("n").alias("gold")),
        F.struct(F.col("hyp").alias("cls"), zero.alias("correct"), F.col("n").alias("guessed"), zero.alias("gold")),
    )
    return (
        pairs.select(F.inline(sides)).where(F.col("cls").isNotNull())
        .groupBy("cls")
        .agg(*[F.sum(c).alias(c) for c in ("correct", "guessed", "gold")])
    )


def per_class(df: DataFrame, hyp: str = "hyp", label: str = "label") -> DataFrame:
    counts = class_counts(df, hyp, label)
    scores = from_counts(F.col("correct"), F.col("guessed"), F.col("gold"))
    return counts.select("cls", *[c.alias(n) for n, c in scores.items()], "gold")


def accuracy(df: DataFrame, hyp: str = "hyp", label: str = "label") -> DataFrame:
    """A missing prediction counts as wrong."""
    right = F.coalesce(F.col(hyp) == F.col(label), F.lit(False))
    return df.agg(F.avg(right.cast("double")).alias("ACC"))


def macro_scores(df: DataFrame, hyp: str = "hyp", label: str = "label") -> DataFrame:
    """One row ``ACC, F1, REC, PRE``; macro F1 is the mean of the class F1s."""
    return per_class(df, hyp, label).agg(
        ratio(F.sum("tp"), F.sum("gold")).alias("ACC"), F.avg("f1").alias("F1"),
        F.avg("recall").alias("REC"), F.avg("precision").alias("PRE"),
    )


def macro_scores_multi(df: DataFrame, hyp: str = "hyp", label: str = "label") -> DataFrame:
    """The same over array columns, all outputs pooled; a missing array is a missing prediction for each output."""
    nothing = F.transform(F.col(label), lambda x: F.lit(None).cast("string"))
    kind = df.schema[hyp].dataType.simpleString()
    given = F.coalesce(F.col(hyp), nothing.cast(kind))
    flat = df.select(F.inline(F.arrays_zip(F.col(label).alias("label"), given.alias("hyp"))))
    return macro_scores(flat)
