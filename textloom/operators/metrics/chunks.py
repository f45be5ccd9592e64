"""Chunk-level evaluation of tag sequences (one sentence per row, tags as arrays).

Tags are ``PREFIX-TYPE`` with prefixes B, I, E, S, O and ``.``; no hyphen means the empty type.
The sentence stands alone: before it and after it the tag is ``O``. Chunk borders depend on
neighbouring tags only, so all work is in the row and only counts are shuffled. The tags of a batch of rows are
compared as arrays of small numbers, in a short Arrow function.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ...functions.arrays import take
from ...session import bound_batches
from .classification import from_counts, ratio

# The functions travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Prefixes as bits, so that a border is a few integer tests.
B, I, E, S, O, DOT = 1, 2, 4, 8, 16, 32
PREFIXES = {"B": B, "I": I, "E": E, "S": S, "O": O, ".": DOT}
NO_TYPE = -1  # of a null tag; it differs from no other


def _lists(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of all rows and their number in each row."""
    return values.flatten(), pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts_and_ends(prefix: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a chunk starts at each tag, and whether one ended just before; sentences end with an outside tag."""
    last, last_kind = np.concatenate([[O], prefix[:-1]]), np.concatenate([[0], kind[:-1]])
    is_in = lambda bits, some: (bits & some) != 0
    changed = (last_kind != kind) & (last_kind != NO_TYPE) & (kind != NO_TYPE)
    starts = is_in(prefix, B | S) | (is_in(last, E | S | O) & is_in(prefix, E | I)) | (changed & ~is_in(prefix, O | DOT))
    ends = is_in(last, E | S) | (is_in(last, B | I) & is_in(prefix, B | S | O)) | (changed & ~is_in(last, O | DOT))
    quiet = is_in(last, O) & is_in(prefix, O)
    return starts & ~quiet, ends & ~quiet


def _spans(tags: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all sentences as strings ``start:end:type``, and their number in each. A sentence's next start and next end belong together."""
    coded = tags.dictionary_encode()
    parts = [t.partition("-") for t in coded.dictionary.to_pylist()]
    kinds = sorted({""} | {k for _, _, k in parts})  # the empty type is the first
    at = {k: i for i, k in enumerate(kinds)}
    known = [*((PREFIXES.get(p, 0), at[k]) for p, _, k in parts), (0, NO_TYPE), (O, 0)]  # a null tag, and the end of a sentence
    code = coded.indices.fill_null(len(parts)).to_numpy(zero_copy_only=False)
    stops = np.cumsum(sizes)
    prefix, kind = np.array(known, np.int64)[np.insert(code, stops, len(parts) + 1)].T
    sentence = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(len(prefix)) - (stops - sizes + np.arange(len(sizes)))[sentence]
    borders = [np.flatnonzero(found) for found in _starts_and_ends(prefix, kind)]
    number = [np.bincount(sentence[found], minlength=len(sizes)) for found in borders]
    spans = np.maximum(*number)
    columns = []
    for found, n in zip(borders, number):
        rank = np.arange(len(found)) - (np.cumsum(n) - n)[sentence[found]]
        to = (np.cumsum(spans) - spans)[sentence[found]] + rank
        column = np.full(int(spans.sum()), -1)
        column[to] = found
        columns.append(column)
    start, end = (pa.array(np.where(c < 0, 0, place[c]), mask=c < 0).cast(pa.string()) for c in columns)
    types = pa.array(kinds, pa.string()).take(pa.array(np.where(columns[0] < 0, 0, kind[columns[0]]), mask=columns[0] < 0))
    return pc.binary_join_element_wise(start, end, types, ":", null_handling="skip"), spans


def _rows(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def batch_chunks(hyps: pa.Array, golds: pa.Array) -> list[pa.Array]:
    """``gold, guessed, correct, tokens, equal_tags`` of sentences whose sides are equally long."""
    (hyp, sizes), (gold, _) = _lists(hyps), _lists(golds)
    (gold_spans, gold_n), (hyp_spans, hyp_n) = (_spans(side, sizes) for side in (gold, hyp))
    code = pa.concat_arrays([gold_spans, hyp_spans]).dictionary_encode()
    sentence = np.concatenate([np.repeat(np.arange(len(sizes)), n) for n in (gold_n, hyp_n)])
    key = sentence * max(1, len(code.dictionary)) + code.indices.to_numpy(zero_copy_only=False)
    in_gold, in_hyp = pa.array(key[: len(gold_spans)]), pa.array(key[len(gold_spans) :])
    shared = np.flatnonzero(pc.is_in(in_gold, value_set=in_hyp).to_numpy(zero_copy_only=False))
    if pc.count_distinct(in_gold).as_py() < len(in_gold):  # odd tags only: no two chunks start at one tag
        shared = np.intersect1d(shared, np.unique(key[: len(gold_spans)], return_index=True)[1])
    same = pc.fill_null(pc.equal(gold, hyp), False).to_numpy(zero_copy_only=False)
    within = np.repeat(np.arange(len(sizes)), sizes)
    return [
        _rows(gold_spans, gold_n), _rows(hyp_spans, hyp_n),
        _rows(gold_spans.take(pa.array(shared)), np.bincount(sentence[shared], minlength=len(sizes))),
        pa.array(sizes, pa.int32()), pa.array(np.bincount(within[same], minlength=len(sizes)), pa.int32()),
    ]


def sentence_chunks(df: DataFrame, hyp: str = "hyp", label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per sentence: chunk arrays of both sides, tokens and equal tags.

    The longer side is cut. A missing prediction counts as all ``O``; a null label as empty.
    """
    gold = F.coalesce(F.col(label), F.array().cast("array<string>"))
    sides = [F.coalesce(F.col(hyp), F.array_repeat(F.lit("O"), F.size(gold))), gold]
    both = df.select(*keep, sides[0].alias("_hyp"), sides[1].alias("_gold"))
    shared = F.least(F.size("_hyp"), F.size("_gold"))
    cut = both.select(*keep, take(F.col("_hyp"), shared).alias("_hyp"), take(F.col("_gold"), shared).alias("_gold"))
    names = ["gold", "guessed", "correct", "tokens", "equal_tags"]
    kinds = [ArrayType(StringType())] * 3 + [IntegerType()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            *kept, hyps, golds = b.columns
            yield pa.RecordBatch.from_arrays([*kept, *batch_chunks(hyps, golds)], names=[*keep, *names])

    bound_batches(df.sparkSession)
    fields = [StructField(n, k) for n, k in zip(names, kinds)]
    return cut.mapInArrow(run, StructType([*cut.schema.fields[: len(keep)], *fields]))


def chunk_counts(df: DataFrame, hyp: str = "hyp", label: str = "label") -> DataFrame:
    """One row: ``correct, guessed, gold, tokens, equal_tags, sentences``."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return sentence_chunks(df, hyp, label).agg(
        total(F.size("correct")).alias("correct"), total(F.size("guessed")).alias("guessed"),
        total(F.size("gold")).alias("gold"), total("tokens").alias("tokens"),
        total("equal_tags").alias("equal_tags"), F.count(F.lit(1)).alias("sentences"),
    )


def chunk_scores(df: DataFrame, hyp: str = "hyp", label: str = "label", acc: str = "boundaries") -> DataFrame:
    """One row ``ACC, PRE, REC, F1`` (fractions).

    ``acc="boundaries"`` counts one matching step per sentence end; ``acc="tokens"`` does not.
    """
    counts = chunk_counts(df, hyp, label)
    extra = {"boundaries": F.col("sentences"), "tokens": F.lit(0)}[acc]
    scores = from_counts(F.col("correct"), F.col("guessed"), F.col("gold"))
    return counts.select(
        ratio(F.col("equal_tags") + extra, F.col("tokens") + extra).alias("ACC"),
        scores["precision"].alias("PRE"), scores["recall"].alias("REC"), scores["f1"].alias("F1"),
    )


def _typed(kind: str) -> Column:
    return F.transform(
        F.col(kind),
        lambda s: F.struct(
            F.lit(kind).alias("kind"), F.substring_index(s, ":", 1).cast("int").alias("at"),
            F.regexp_extract(s, r"(?s)^\d+:\d+:(.*)$", 1).alias("type"),
        ),
    )


def chunk_scores_by_type(df: DataFrame, id_col: str = "id", hyp: str = "hyp", label: str = "label") -> DataFrame:
    """Counts and scores per chunk type, in order of first appearance (gold types first)."""
    kinds = ("gold", "guessed", "correct")
    tagged = [_typed(k) for k in kinds]
    spans = sentence_chunks(df, hyp, label, keep=(id_col,)).select(
        id_col, F.inline(F.concat(*tagged))
    )
    count = lambda k: F.sum((F.col("kind") == k).cast("bigint"))
    first = F.min(F.struct((F.col("kind") != "gold").alias("side"), F.col(id_col), "at"))
    by_type = spans.groupBy("type").agg(*[count(k).alias(k) for k in kinds], first.alias("first"))
    scores = from_counts(F.col("correct"), F.col("guessed"), F.col("gold"))
    return by_type.orderBy("first").select("type", "gold", "guessed", *[c.alias(n) for n, c in scores.items()])
