"""Array helpers shared by the layouts, the decoders and the metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def in_steps(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """Every step of the one before; what a step gives is worked out once, however often the next one names it."""
    held = F.array(value)
    for step in steps:
        held = F.transform(held, step)
    return F.get(held, F.lit(0))


def repeat(value, count: Column | int, kind: str = "bigint") -> Column:
    count = F.lit(count) if isinstance(count, int) else count
    return F.array_repeat(F.lit(value).cast(kind), F.greatest(count, F.lit(0)).cast("int"))


def take(array: Column, count: Column | int) -> Column:
    """First ``count`` elements; a negative count gives none."""
    count = F.lit(count) if isinstance(count, int) else count
    return F.slice(array, F.lit(1), F.greatest(count, F.lit(0)).cast("int"))


def drop(array: Column, count: Column | int) -> Column:
    """All but the first ``count`` elements."""
    count = F.lit(count) if isinstance(count, int) else count
    count = F.least(F.greatest(count, F.lit(0)), F.size(array)).cast("int")
    return F.slice(array, count + 1, F.size(array))


def pad(array: Column, width: Column | int, value, kind: str = "bigint") -> Column:
    """Cut to ``width`` and fill on the right with ``value``."""
    width = F.lit(width) if isinstance(width, int) else width
    cut = take(array, width)
    return F.concat(cut, repeat(value, width - F.size(cut), kind))


def mask(length: Column, width: Column) -> Column:
    """``length`` ones, then zeros up to ``width``, as floats."""
    return pad(repeat(1, length, "float"), width, 0, "float")


def argmax(scores: Column) -> Column:
    """Position of the largest score from 0; the lowest position wins a tie."""
    return F.array_position(scores, F.array_max(scores)) - 1


def ngrams(tokens: Column, n: int, separator: str = " ") -> Column:
    """All n-grams in order. ``separator`` must not occur inside a token."""
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    grams = F.transform(
        starts,
        lambda i: F.concat_ws(separator, *[F.element_at(tokens, i + k) for k in range(n)]),
    )
    return F.when(F.size(tokens) >= n, grams).otherwise(empty("string"))
