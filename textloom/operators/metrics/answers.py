"""Exact match and token F1 of short answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.text import normalise_answer
from .classification import ratio
from .overlap import Scheme, ngram_overlap


def answer_rows(
    df: DataFrame, *, id_col: str = "id", hyp: str = "hyp", label: str = "label", method: str = "row"
) -> DataFrame:
    """``(id, em, f1)`` per row, 0 to 1.

    Two empty answers match; one empty answer scores 0.
    """
    same = (normalise_answer(F.col("_hyp")) == normalise_answer(F.col("_label"))).cast("bigint")
    counts = ngram_overlap(
        df, {"a": Scheme(normalise_answer, (1,))}, id_col=id_col, hyp=hyp, label=label, extra={"em": same},
        method=method,
    )
    h, r, m = F.col("a_hyp"), F.col("a_ref"), F.col("a_m1")
    p, rec = ratio(m, h), ratio(m, r)
    f1 = F.when((h == 0) | (r == 0), (h == r).cast("double")).otherwise(ratio(2 * p * rec, p + rec))
    return counts.select("id", F.col("em").cast("double").alias("em"), f1.alias("f1"))


def answer_scores(df: DataFrame, **columns) -> DataFrame:
    """One row ``EM, F1`` in percent."""
    return answer_rows(df, **columns).agg((F.avg("em") * 100).alias("EM"), (F.avg("f1") * 100).alias("F1"))


def exact_match(df: DataFrame, hyp: str = "hyp", label: str = "label") -> DataFrame:
    """EM alone, in built-in expressions; a null text counts as empty."""
    text = lambda c: normalise_answer(F.coalesce(F.col(c), F.lit("")))
    same = text(hyp) == text(label)
    return df.agg((F.avg(same.cast("double")) * 100).alias("EM"))
