"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest
``doc_id`` stays (null is smallest). Rows that repeat a ``doc_id`` with the same text are one group: one
of them stays. Extra columns are carried along and never looked at.

Texts are not shuffled to be compared. A first pass counts (length, prefix hash) pairs; the pairs that
occur twice or more are put on a bit map of fixed size. The second pass reads the full content of the rows
on the map only. A false positive of the map costs one hash and changes no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_set, bit_words, or_empty, saved

PREFIX = 64  # characters that the second level hashes
MAP_BITS = 1 << 22  # fixed, so what every task receives does not grow with the data


def _levels(text: Column) -> tuple[Column, Column]:
    return F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("_head")


def _slot(map_bits: int) -> Column:
    return F.pmod(F.xxhash64("_len", "_head"), F.lit(map_bits))


def surviving_map(docs: DataFrame, text: str = "text", map_bits: int = MAP_BITS) -> DataFrame:
    """One row ``(words)``: bits of the (length, prefix) pairs that more than one row has.

    Both levels are counted with partial sums, so a pair shared by a third of all rows is one row per task.
    """
    pairs = docs.select(*_levels(or_empty(text))).groupBy("_len", "_head").agg(F.count(F.lit(1)).alias("n"))
    # A pair that two rows have is a length that two rows have, so this settles both levels and gathers no list of prefixes.
    twice = pairs.where("n > 1")
    return bit_words(twice.select(_slot(map_bits).alias("slot")), map_bits)


def flagged(docs: DataFrame, text: str = "text", map_bits: int = MAP_BITS) -> DataFrame:
    """``docs`` with ``_full``: the full hash of rows whose length and prefix survive, else null."""
    words = saved(surviving_map(docs, text, map_bits), "lengths").scalar()
    rows = docs.withColumns(dict(zip(("_len", "_head"), _levels(or_empty(text)))))
    on = bit_set(words, _slot(map_bits))
    return rows.withColumn("_full", F.when(on, F.sha2(or_empty(text), 256))).drop("_len", "_head")


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", map_bits: int = MAP_BITS) -> DataFrame:
    """One narrow row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``text_sha256`` of rows settled by length or prefix is taken as they are read, as a digest only.
    """
    rows = flagged(docs, text, map_bits).select(
        F.col(doc_id).alias("doc_id"), "_full", F.coalesce("_full", F.sha2(or_empty(text), 256)).alias("text_sha256")
    )
    single = rows.where(F.col("_full").isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    # Repeated rows are counted first and written out again last, so no key gathers them.
    same = rows.where(F.col("_full").isNotNull()).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    same = saved(same, "survivors")
    groups = same.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    grouped = (
        same.join(groups, "text_sha256")
        .withColumn("place", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"), "text_sha256",
        )
    )
    return single.unionByName(grouped)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", map_bits: int = MAP_BITS) -> DataFrame:
    """The rows that stay, with all their columns.

    Each task first reduces its rows of a group to the one that may stay, so copies are not shuffled.
    """
    columns = docs.columns
    rows = flagged(docs, text, map_bits)
    order = [doc_id, *[c for c in columns if c != doc_id]]
    best = (
        rows.where(F.col("_full").isNotNull())
        .groupBy("_full").agg(F.max(F.struct(*[F.col(c) for c in order])).alias("row"))
        .select(*[F.col(f"row.{c}").alias(c) for c in columns])
    )
    return reduce(DataFrame.unionByName, [rows.where(F.col("_full").isNull()).select(*columns), best])
