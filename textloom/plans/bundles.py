"""Metric bundles: every metric of a task family in as few passes as its tokens allow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rouge_text, treebank_text, v13a_text
from ..operators.metrics import answers, bleu, chunks, classification, rouge
from ..operators.metrics.overlap import Scheme, ngram_overlap, total_columns

ROUGE_KINDS = ("ROUGE1", "ROUGE2", "ROUGEL", "ROUGELsum")


def generation_scores(
    df: DataFrame, *, id_col: str = "id", hyp: str = "hyp", label: str = "label", method: str = "row"
) -> DataFrame:
    """``BLEU, SacreBLEU, ROUGE1, ROUGE2, ROUGEL, ROUGELsum`` in one row, in one pass over the texts."""
    orders = bleu.ORDERS
    schemes = {
        "b": Scheme(treebank_text, orders), "s": Scheme(v13a_text, orders), "r": Scheme(rouge_text, (1, 2)),
    }
    counts = ngram_overlap(
        df, schemes, id_col=id_col, hyp=hyp, label=label, extra=rouge.lcs_columns(ROUGE_KINDS), method=method
    )
    sums = [c for s in ("b", "s") for c in total_columns(s, orders, f"{s}_")]
    fields = rouge.scores_of("r")
    sums += [(F.avg(fields[k]) * 100).alias(k) for k in ROUGE_KINDS]
    whole = counts.agg(*sums)
    return whole.select(
        bleu.bleu_column("b_").alias("BLEU"), bleu.sacrebleu_column("s_").alias("SacreBLEU"), *ROUGE_KINDS
    )


METRICS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "classes": (lambda df, **c: classification.macro_scores(df, **_sides(c)), ("ACC", "F1", "REC", "PRE")),
    "multi_classes": (lambda df, **c: classification.macro_scores_multi(df, **_sides(c)), ("ACC", "F1", "REC", "PRE")),
    "chunks": (lambda df, **c: chunks.chunk_scores(df, **_sides(c)), ("ACC", "F1", "REC", "PRE")),
    "generation": (generation_scores, ("BLEU", "SacreBLEU", *ROUGE_KINDS)),
    "answers": (answers.answer_scores, ("EM", "F1")),
}


def _sides(columns: dict) -> dict:
    return {k: v for k, v in columns.items() if k != "id_col"}


def register_metric(name: str, fn: Callable[..., DataFrame], columns: tuple[str, ...]) -> None:
    """``fn(df, **columns)`` gives one row with ``columns``."""
    METRICS[name] = (fn, columns)


def score(bundle: str, df: DataFrame, **columns) -> DataFrame:
    """Long form ``(position, metric, value)``."""
    if bundle not in METRICS:
        raise ValueError(f"unknown metric bundle {bundle!r}")
    fn, names = METRICS[bundle]
    row = fn(df, **columns)
    entries = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return row.select(F.posexplode(F.array(*entries)).alias("position", "m")).select("position", "m.*")
