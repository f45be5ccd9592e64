"""Clipped n-gram overlap of hypothesis and reference, the base of BLEU, ROUGE-n and token F1.

Two ways give the same counts. ``row`` counts inside the row with a short Arrow function: no
shuffle, no state beyond one row. ``group`` counts all rows of an id together: the texts are
shuffled and grouped by id, and the n-grams of a group are counted as integers. Only an id with
very much text has its n-grams exploded and grouped by built-in operators, whose hash tables may
spill. ``row`` is the default and needs no exchange at any size.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ...functions.arrays import ngrams
from ...functions.text import split_words, words
from ...session import bound_batches, shuffle_partitions

# Ship the helpers below with the job, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Scheme:
    """A text form whose tokens are separated by white space, and the n-gram orders to count."""

    text: Callable[[Column], Column]
    orders: tuple[int, ...]


def clipped_matches(hyp: list[str], ref: list[str], n: int) -> int:
    """Sum over n-grams of the smaller of both counts."""
    grams = lambda t: Counter(zip(*(t[i:] for i in range(n))))
    few, many = sorted((grams(hyp), grams(ref)), key=len)
    return sum(min(count, many[gram]) for gram, count in few.items() if gram in many)


PART_BYTES = 256 << 10  # of both sides' texts, counted at once; the tables of so many tokens stay in the cache
GROUP_BYTES = 16 << 20  # of both sides' texts of one id, held at once


def _encoded(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers get equal small ones, and how many there are."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts as ``str.split`` gives them, and the row of each."""
    parts = split_words(texts)
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    words_ = parts.flatten()
    full = pc.not_equal(words_, "")
    return words_.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def batch_matches(hyps: pa.Array, refs: pa.Array, orders: tuple[int, ...], texts: np.ndarray | None = None) -> list[np.ndarray]:
    """Per row: tokens of both sides, and :func:`clipped_matches` of each order, for a whole batch by integer ids.

    A row has one text on each side, or as many as ``texts`` says; no n-gram crosses texts.
    """
    rows_n = len(hyps if texts is None else texts)
    owners = np.arange(rows_n) if texts is None else np.repeat(np.arange(rows_n), texts)
    (hyp, hyp_texts), (ref, ref_texts) = _tokens(hyps), _tokens(refs)
    sizes = [np.bincount(owners[t], minlength=rows_n) for t in (hyp_texts, ref_texts)]
    code = pa.concat_arrays([hyp, ref]).dictionary_encode()
    row = owners[np.concatenate([hyp_texts, ref_texts])]
    text = np.concatenate([hyp_texts, ref_texts + len(owners)])  # the text a token is in
    first, kinds = _encoded(row * max(1, len(code.dictionary)) + code.indices.to_numpy())
    at, gram, matches = np.arange(len(row)), first, {}
    for n in range(1, max(orders, default=0) + 1):
        if n > 1:
            fits = at + (n - 1) < len(row)
            fits[fits] = text[at[fits] + (n - 1)] == text[at[fits]]
            at, gram = at[fits], gram[fits]
            gram, kinds_n = _encoded(gram * max(1, kinds) + first[at + (n - 1)])
        else:
            kinds_n = kinds
        if n in orders:
            in_hyp = text[at] < len(owners)
            both = np.minimum(np.bincount(gram[in_hyp], minlength=kinds_n), np.bincount(gram[~in_hyp], minlength=kinds_n))
            owner = np.zeros(kinds_n, np.int64)
            owner[gram] = row[at]
            matches[n] = np.bincount(owner, weights=both, minlength=rows_n).astype(np.int64)
    return [*sizes, *(matches[n] for n in orders)]


def _counted(hyps: pa.Array, refs: pa.Array, sizes: np.ndarray, orders: tuple[int, ...]) -> pa.StructArray:
    """:func:`batch_matches` of rows with ``sizes`` texts a side each, in parts of bounded size."""
    names = ["hyp", "ref", *[f"m{n}" for n in orders]]
    if not len(sizes):
        return pa.StructArray.from_arrays([pa.array([], pa.int64())] * len(names), names)
    hyps, refs = (t.cast(pa.large_string()) for t in (hyps, refs))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    held = np.concatenate([[0], np.cumsum(sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False) for t in (hyps, refs)))])
    cuts = [0, *(np.flatnonzero(np.diff(held[upto[1:]] // PART_BYTES)) + 1).tolist(), len(sizes)]  # after these rows
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        some = slice(int(upto[a]), int(upto[b]))
        parts.append(batch_matches(hyps[some], refs[some], orders, sizes[a:b]))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)], names)


def _counts_type(orders: tuple[int, ...]) -> StructType:
    return StructType([StructField(n, LongType()) for n in ("hyp", "ref", *[f"m{n}" for n in orders])])


def _row_counter(orders: tuple[int, ...]):
    def count(hyps: pa.Array, refs: pa.Array) -> pa.Array:
        return _counted(hyps, refs, np.ones(len(hyps), np.int64), orders)

    return F.arrow_udf(count, _counts_type(orders))


def _group_counter(orders: tuple[int, ...]):
    def count(groups: pa.Array) -> pa.Array:
        texts = groups.flatten()
        return _counted(texts.field("h"), texts.field("r"), pc.fill_null(pc.list_value_length(groups), 0).to_numpy(zero_copy_only=False), orders)

    return F.arrow_udf(count, _counts_type(orders))


def ngram_overlap(
    df: DataFrame, schemes: dict[str, Scheme], *, id_col: str = "id", hyp: str = "hyp", label: str = "label",
    extra: dict[str, Column] | None = None, method: str = "row",
) -> DataFrame:
    """One row per id with ``<scheme>_m<n>`` (clipped matches), ``<scheme>_hyp``, ``<scheme>_ref``.

    ``<scheme>_hyp`` and ``<scheme>_ref`` are the token counts. ``extra`` gives further bigint
    values of the row, written over the columns ``_hyp`` and ``_label``. Null texts count as
    empty. The ``group`` method counts rows that repeat an id as one.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text(hyp).alias("_hyp"), text(label).alias("_label"))
    if method == "row":
        bound_batches(df.sparkSession)
        return _by_row(rows, schemes, extra or {})
    if method == "group":
        return _by_group(rows, schemes, extra or {})
    raise ValueError(f"unknown method {method!r}")


def _by_row(rows: DataFrame, schemes: dict[str, Scheme], extra: dict[str, Column]) -> DataFrame:
    counts = [
        _row_counter(s.orders)(s.text(F.col("_hyp")), s.text(F.col("_label"))).alias(name) for name, s in schemes.items()
    ]
    fields = [
        F.col(f"{name}.{f}").alias(f"{name}_{f}")
        for name, s in schemes.items() for f in ("hyp", "ref", *[f"m{n}" for n in s.orders])
    ]
    return rows.select("id", *counts, *[c.cast("bigint").alias(n) for n, c in extra.items()]).select("id", *fields, *extra)


def _by_group(rows: DataFrame, schemes: dict[str, Scheme], extra: dict[str, Column]) -> DataFrame:
    """The n-grams of a group are counted where its rows meet: one exchange, of the texts.

    The texts of a group are collected and counted at once. If they are too many to be held, their n-grams are exploded and grouped.
    """
    bound_batches(rows.sparkSession)
    texts = [F.struct(s.text(F.col("_hyp")).alias("h"), s.text(F.col("_label")).alias("r")).alias(name) for name, s in schemes.items()]
    rows = rows.select("id", *texts, *[c.cast("bigint").alias(n) for n, c in extra.items()])
    # A number of its own: adaptive execution would join small partitions to ones whose n-grams spill.
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "id")
    size = sum((F.octet_length(f"{name}.{side}") for name in schemes for side in "hr"), F.lit(0).cast("bigint"))
    rows = rows.withColumn("_held", F.sum(size).over(Window.partitionBy("id")))

    # A group is (kind, weight, grams): per scheme and order one group of each side, where
    # hypothesis grams weigh 1 and reference grams 0. Numbers of the row itself travel as the
    # weight of one empty gram, and texts to be held beside one.
    groups, sums, kind = [], [], 1
    numbers: dict[str, Column] = {}
    for name, scheme in schemes.items():
        h, r = words(F.col(f"{name}.h")), words(F.col(f"{name}.r"))
        numbers[f"{name}_hyp"], numbers[f"{name}_ref"] = F.size(h), F.size(r)
        for n in scheme.orders:
            groups += [_group(kind, F.lit(1), ngrams(h, n)), _group(kind, F.lit(0), ngrams(r, n))]
            clipped = F.least(F.col("hyp_n"), F.col("both_n") - F.col("hyp_n"))
            sums.append(F.sum(F.when(F.col("kind") == kind, clipped).otherwise(0)).alias(f"{name}_m{n}"))
            kind += 1
    held = [_group(0, F.lit(0), F.array(F.lit("")))]
    for name, value in [*numbers.items(), *((n, F.col(n)) for n in extra)]:
        number = _group(kind, value, F.array(F.lit("")))
        groups.append(number)
        held += [number] if name in extra else []
        sums.append(F.max(F.when(F.col("kind") == kind, F.col("hyp_n"))).alias(name))
        kind += 1
    chosen = F.when(F.col("_held") <= GROUP_BYTES, F.array(*held)).otherwise(F.array(*groups))
    nested = rows.select("id", *schemes, F.inline(chosen))
    beside = F.when(F.col("kind") == 0, F.struct(*schemes)).alias("texts")
    grams = nested.select("id", "kind", "weight", beside, F.explode("grams").alias("gram"))
    counted = grams.groupBy("id", "kind", "gram").agg(
        F.sum("weight").alias("hyp_n"), F.count(F.lit(1)).alias("both_n"), F.collect_list("texts").alias("texts")
    )
    texts = F.any_value(F.when(F.col("kind") == 0, F.col("texts")), F.lit(True))
    whole = counted.groupBy("id").agg(*sums, texts.alias("texts"))
    counts = [_group_counter(s.orders)(F.col(f"texts.{name}")).alias(f"_{name}") for name, s in schemes.items()]
    fields = [
        F.when(F.col("texts").isNull(), F.col(f"{name}_{f}")).otherwise(F.col(f"_{name}.{f}")).alias(f"{name}_{f}")
        for name, s in schemes.items() for f in ("hyp", "ref", *[f"m{n}" for n in s.orders])
    ]
    return whole.select("*", *counts).select("id", *fields, *extra)


def _group(kind: int, weight: Column, grams: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), weight.cast("bigint").alias("weight"), grams.alias("grams"))


def totals(overlap: DataFrame, scheme: str, orders: tuple[int, ...]) -> DataFrame:
    """Corpus sums: ``m<n>``, possible n-grams ``t<n>``, ``hyp_len``, ``ref_len``."""
    whole = overlap.agg(*total_columns(scheme, orders))
    return whole.select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in whole.columns])


def total_columns(scheme: str, orders: tuple[int, ...], prefix: str = "") -> list[Column]:
    hyp, ref = F.col(f"{scheme}_hyp"), F.col(f"{scheme}_ref")
    sums = [F.sum(hyp).alias(f"{prefix}hyp_len"), F.sum(ref).alias(f"{prefix}ref_len")]
    for n in orders:
        sums.append(F.sum(f"{scheme}_m{n}").alias(f"{prefix}m{n}"))
        sums.append(F.sum(F.greatest(hyp - (n - 1), F.lit(0))).alias(f"{prefix}t{n}"))
    return sums
