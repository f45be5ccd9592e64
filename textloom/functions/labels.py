"""Label <-> index conversions. Every function is Column -> Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literals(labels: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def _lookup(value: Column, labels: Sequence[str]) -> Column:
    at = F.array_position(_literals(labels), value)
    return F.when(at > 0, at - 1)


def label_to_index(
    value: Column, labels: Sequence[str], on_unknown: str = "error", unknown_id: int = -1
) -> Column:
    """Position of ``value`` in ``labels`` (from 0).

    ``on_unknown``: ``error`` fails the job, ``null`` keeps the row with a null index, ``unk``
    gives ``unknown_id``.
    """
    index = _lookup(value, labels)
    if on_unknown == "null":
        return index
    if on_unknown == "unk":
        return F.coalesce(index, F.lit(unknown_id).cast("bigint"))
    if on_unknown != "error":
        raise ValueError(f"on_unknown must be error, null or unk, not {on_unknown!r}")
    shown = F.coalesce(value, F.lit("NULL"))
    return F.coalesce(index, F.raise_error(F.concat(F.lit("unknown label: "), shown)).cast("bigint"))


def tags_to_indices(tags: Column, labels: Sequence[str], on_unknown: str = "error") -> Column:
    return F.transform(tags, lambda t: label_to_index(t, labels, on_unknown))


def index_to_label(index: Column, labels: Sequence[str]) -> Column:
    return F.get(_literals(labels), index.cast("int"))


def indices_to_tags(indices: Column, labels: Sequence[str]) -> Column:
    return F.transform(indices, lambda i: index_to_label(i, labels))


def multi_label_to_indices(
    cell: Column, labels: Sequence[str], on_unknown: str = "error", separator: str = ","
) -> Column:
    """``"a,b"`` -> ``[index(a), index(b)]``."""
    return tags_to_indices(F.split(cell, separator), labels, on_unknown)


def multi_hot(indices: Column, width: int) -> Column:
    """0/1 vector of length ``width`` with ones at ``indices``."""
    if width < 1:
        raise ValueError("width must be positive")
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))
    return F.transform(slots, lambda k: F.array_contains(indices, k).cast("bigint"))


def aspects_to_array(aspects: Sequence[str], labels: Sequence[str], on_unknown: str = "error") -> Column:
    """Named aspect columns -> one ordered array of label indices."""
    return F.array(*[label_to_index(F.col(a), labels, on_unknown) for a in aspects])


def unknown_label(value: Column, labels: Sequence[str]) -> Column:
    """The value itself when it is in no known class, else null: a reject column to count."""
    return F.when(_lookup(value, labels).isNull(), value)
