"""Special tokens around id sequences: wrapping, masks, segment ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import repeat


def _one(token_id: int | Column) -> Column:
    value = token_id if isinstance(token_id, Column) else F.lit(token_id)
    return F.array(value.cast("bigint"))


def join_with_separator(left: Column, separator_id: int, right: Column) -> Column:
    """left ++ [separator] ++ right, the question-answering input."""
    return F.concat(left, _one(separator_id), right)


def wrap_sentence(ids: Column, pair: Column | None = None, *, start_id: int = 0, end_id: int = 2) -> Column:
    """``<s> X </s>``; a pair becomes ``<s> A </s></s> B </s>``."""
    out = [_one(start_id), ids, _one(end_id)]
    if pair is not None:
        out += [_one(end_id), pair, _one(end_id)]
    return F.concat(*out)


def wrap_sentence_mask(ids: Column, pair: Column | None = None) -> Column:
    """1 on the special tokens of :func:`wrap_sentence`, 0 on content."""
    out = [_one(1), repeat(0, F.size(ids)), _one(1)]
    if pair is not None:
        out += [_one(1), repeat(0, F.size(pair)), _one(1)]
    return F.concat(*out)


def wrap_language(ids: Column, pair: Column | None = None, *, language_id: int | Column, end_id: int = 2) -> Column:
    """``[lang] X </s>``; a pair is joined with no separator."""
    content = [ids] if pair is None else [ids, pair]
    return F.concat(_one(language_id), *content, _one(end_id))


def wrap_language_mask(ids: Column, pair: Column | None = None) -> Column:
    content = [ids] if pair is None else [ids, pair]
    return F.concat(_one(1), *[repeat(0, F.size(c)) for c in content], _one(1))


def seq2seq_inputs(
    source: Column, target: Column, *, source_language: int | Column, target_language: int | Column, end_id: int = 2
) -> dict[str, Column]:
    """``input_ids`` under the source language and ``labels`` under the target language."""
    return {
        "input_ids": wrap_language(source, language_id=source_language, end_id=end_id),
        "labels": wrap_language(target, language_id=target_language, end_id=end_id),
    }


def special_mask(ids: Column, start_id: int = 0, end_id: int = 2) -> Column:
    """Mask of ids that already carry special tokens."""
    return F.transform(ids, lambda i: i.isin(start_id, end_id).cast("bigint"))


def zero_segments(wrapped: Column) -> Column:
    return repeat(0, F.size(wrapped))


def remove_ids(ids: Column, special_ids: list[int]) -> Column:
    """Ids without the special ones, order kept."""
    return F.filter(ids, lambda i: ~i.isin(*special_ids))


def encode_segments(
    ids: Column, pair: Column | None = None, *, cls_id: int | Column | None = None,
    sep_id: int | Column | None = None,
) -> tuple[Column, Column]:
    """Ids and segment ids of one text or a pair.

    With ``cls_id`` and ``sep_id``: ``<cls> A <sep> [B <sep>]``, else plain ``A ++ B``. Segment 0
    covers the first text with its special tokens, segment 1 the second one. Without a pair
    all segments are 0.
    """
    special = cls_id is not None
    first = F.concat(_one(cls_id), ids, _one(sep_id)) if special else ids
    if pair is None:
        return first, repeat(0, F.size(first))
    second = F.concat(pair, _one(sep_id)) if special else pair
    return (
        F.concat(first, second),
        F.concat(repeat(0, F.size(first)), repeat(1, F.size(second))),
    )
