"""Corpus BLEU in its two forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import treebank_text, v13a_text
from .overlap import Scheme, ngram_overlap, totals

ORDERS = (1, 2, 3, 4)
LOG_OF_ZERO = -9999999999.0


def _brevity(hyp_len: Column, ref_len: Column, equal_is_one: bool) -> Column:
    penalty = F.exp(1 - ref_len / hyp_len)
    long_enough = hyp_len >= ref_len if equal_is_one else hyp_len > ref_len
    return F.when(hyp_len == 0, 0.0).when(long_enough, 1.0).otherwise(penalty)


def bleu_column(prefix: str = "") -> Column:
    """Unsmoothed BLEU times 100 from corpus totals; 0 when any order has no match."""
    col = lambda name: F.col(prefix + name)
    logs = sum((F.log(col(f"m{n}") / col(f"t{n}")) for n in ORDERS), F.lit(0.0)) / 4
    # No match of one order makes the geometric mean 0.
    some = F.least(*[col(f"m{n}") for n in ORDERS]) > 0
    score = F.when(some, F.exp(logs)).otherwise(0.0)
    return _brevity(col("hyp_len"), col("ref_len"), False) * score * 100


def sacrebleu_column(prefix: str = "") -> Column:
    """Exponentially smoothed BLEU, 0 to 100.

    Orders without possible n-grams end the loop with precision 0. Each order without a match
    doubles the smoothing divisor.
    """
    col = lambda name: F.col(prefix + name)
    logs, divisor, alive = F.lit(0.0), F.lit(1.0), F.lit(True)
    for n in ORDERS:
        m, possible = col(f"m{n}"), col(f"t{n}")
        alive = alive & (possible > 0)
        divisor = F.when(alive & (m == 0), divisor * 2).otherwise(divisor)
        p = F.when(m == 0, 100.0 / (divisor * possible)).otherwise(100.0 * m / possible)
        logs = logs + F.when(alive, F.log(p)).otherwise(LOG_OF_ZERO)
    return _brevity(col("hyp_len"), col("ref_len"), True) * F.exp(logs / 4)


def bleu(
    df: DataFrame, *, id_col: str = "id", hyp: str = "hyp", label: str = "label",
    text: Callable[[Column], Column] = treebank_text, method: str = "row",
) -> DataFrame:
    """One row ``BLEU``: order 4, one reference per row, Treebank tokens by default.

    ``text`` gives the tokens separated by white space.
    """
    counts = ngram_overlap(df, {"b": Scheme(text, ORDERS)}, id_col=id_col, hyp=hyp, label=label, method=method)
    return totals(counts, "b", ORDERS).select(bleu_column().alias("BLEU"))


def sacrebleu(
    df: DataFrame, *, id_col: str = "id", hyp: str = "hyp", label: str = "label",
    text: Callable[[Column], Column] = v13a_text, method: str = "row",
) -> DataFrame:
    """One row ``SacreBLEU``: case-sensitive v13a tokens, exponential smoothing."""
    counts = ngram_overlap(df, {"s": Scheme(text, ORDERS)}, id_col=id_col, hyp=hyp, label=label, method=method)
    return totals(counts, "s", ORDERS).select(sacrebleu_column().alias("SacreBLEU"))
