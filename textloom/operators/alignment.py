"""Word to sub-word alignment for labelling tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import repeat


def _spread(pieces: Column, value) -> Column:
    """One ``value(i)`` per sub-word of word ``i``."""
    return F.flatten(F.transform(pieces, lambda p, i: F.array_repeat(value(i).cast("bigint"), F.size(p))))


def align_words(pieces: Column, cls_id: int | Column, sep_id: int | Column) -> tuple[Column, Column]:
    """``pieces``: sub-word ids per word. Gives ids ``[cls] .. [sep]`` and word indices.

    Special tokens have word index -1.
    """
    cls, sep = _id(cls_id), _id(sep_id)
    ids = F.concat(cls, F.flatten(pieces), sep)
    index = F.concat(_id(-1), _spread(pieces, lambda i: i), _id(-1))
    return ids, index


def align_question_passage(
    question: Column, passage: Column, cls_id: int | Column, sep_id: int | Column
) -> tuple[Column, Column, Column]:
    """``[cls] question [sep] passage [sep]``: ids, word indices, segment ids.

    Question sub-words have index -1 and segment 0 up to and with their ``[sep]``; passage
    sub-words have their word's index and segment 1 up to and with the last ``[sep]``.
    """
    cls, sep = _id(cls_id), _id(sep_id)
    asked, read = F.flatten(question), F.flatten(passage)
    ids = F.concat(cls, asked, sep, read, sep)
    index = F.concat(repeat(-1, F.size(asked) + 2), _spread(passage, lambda i: i), _id(-1))
    segments = F.concat(repeat(0, F.size(asked) + 2), repeat(1, F.size(read) + 1))
    return ids, index, segments


def _id(value: int | Column) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.array(value.cast("bigint"))
