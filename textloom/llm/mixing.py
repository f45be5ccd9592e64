"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of all words to the power ``a``, normalised. ``a`` is bisected on a grid: the largest
value whose entropy reaches the target (a share of the entropy of equal weights), or, if larger, the smallest one at which no
source is repeated more often than the limit. A source then has ``ratio = weight * budget / words``: how often its words
are used. Each source is cut into blocks of about ``block_words`` words by a hash of the id; each block is permuted by that
hash and realises the ratio itself: all of it ``floor(ratio)`` times, and from the start of the permutation as many documents again
as the rest of its budget holds (a document that the budget cuts is in if its middle is). So no task sees more than a block,
and a source with a third of all rows is many blocks. ``assign`` gives this, as the query and its SQL have it: each block rounds on
its own, so documents about as long as a block miss the ratio. ``mix`` counts through all blocks of a source instead (``counted``).

A null source counts as the empty name, a null text as no words, a null id as the empty id. Rows that repeat an id stand
side by side in their block. Sources without words have weight 0. Extra columns are kept by ``mix``. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, or_empty, saved

ENTROPY_SHARE = 0.95
MAX_REPEATS = 4.0
BLOCK_WORDS = 32_768
GRID = 1024


def word_count(text: str) -> Column:
    return F.regexp_count(or_empty(text), F.lit(WORD)).cast("bigint")


def _largest(holds, low: int, high: int) -> int:
    """Largest number in [low, high] that ``holds``, which is true at ``low`` and changes once."""
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if holds(middle) else (low, middle - 1)
    return low


def exponent(sources: DataFrame, budget: int, entropy_share: float, max_repeats: float) -> int:
    """The exponent in steps of 1/GRID for ``sources(source, words)``. Each step is one sum over the sources."""
    known = sources.where("words > 0")
    total, count = known.agg(F.sum("words"), F.count(F.lit(1))).first()
    if not count:
        return GRID

    def measure(step: int) -> tuple[float, float]:
        share = F.col("words") / F.lit(float(total))
        powered = known.select("words", F.pow(share, F.lit(step / GRID)).alias("p"))
        z, plogp, most = powered.agg(F.sum("p"), F.sum(F.col("p") * F.log("p")), F.max(F.col("p") / F.col("words"))).first()
        return math.log(z) - plogp / z, most / z * budget

    target = entropy_share * math.log(count)
    by_entropy = _largest(lambda s: measure(s)[0] >= target, 0, GRID)
    # Repeats fall as the exponent grows: the smallest step within the limit, or GRID if none is.
    if measure(by_entropy)[1] <= max_repeats:
        return by_entropy
    over = _largest(lambda s: s <= by_entropy or measure(s)[1] > max_repeats, by_entropy, GRID)
    return min(GRID, over + 1)


def weights(
    docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS,
    block_words: int = BLOCK_WORDS, source: str = "source", text: str = "text",
) -> DataFrame:
    """One row per source: ``source, words, weight, ratio, blocks``. ``budget`` counts words; all words if not given."""
    sources = saved(
        docs.select(F.coalesce(F.col(source), F.lit("")).alias("source"), word_count(text).alias("words"))
        .groupBy("source").agg(F.sum("words").alias("words")),
        "sources",
    )
    total = sources.agg(F.sum("words")).first()[0] or 0
    budget = total if budget is None else budget
    step = exponent(sources, budget, entropy_share, max_repeats)
    powered = sources.withColumn(
        "p", F.when(F.col("words") > 0, F.pow(F.col("words") / F.lit(float(total or 1)), F.lit(step / GRID))).otherwise(0.0)
    )
    z = powered.agg(F.sum("p")).first()[0] or 1.0
    weight = F.col("p") / F.lit(z)
    ratio = F.when(F.col("words") > 0, F.round(weight * F.lit(float(budget)) / F.col("words"), 9)).otherwise(0.0)
    return saved(
        powered.select("source", "words", weight.alias("weight"), ratio.alias("ratio"), F.expr(f"words div {block_words} + 1").alias("blocks")),
        "weights",
    )


def assign(
    docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", drop_text: bool = False
) -> DataFrame:
    """``docs``, without their texts if they are not wanted, with ``_words, _block, _place`` (from 0) and ``_copies``: how often the row is used.

    Spark broadcasts ``plan`` while its files are below the session's threshold, and otherwise joins it by shuffle, where
    adaptive execution splits a source with many rows.
    """
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    own = plan.select(F.col("source").alias("_source"), F.col("ratio").alias("_ratio"), F.col("blocks").alias("_blocks"))
    rows = docs.withColumns({
        "_source": F.coalesce(F.col(source), F.lit("")), "_words": word_count(text), "_digest": digest,
    })
    rows = (rows.drop(text) if drop_text else rows).join(own, "_source")
    high = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("_block", F.shiftright(high * F.col("_blocks"), 32))
    block = Window.partitionBy("_source", "_block")
    order = block.orderBy("_digest", "_words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "_place": F.count(F.lit(1)).over(order) - 1, "_upto": F.sum("_words").over(order), "_all": F.sum("_words").over(block),
    })
    part = F.col("_ratio") - F.floor("_ratio")
    more = (F.col("_upto") - F.col("_words") / 2 <= part * F.col("_all")) & (part > 0)
    copies = F.floor("_ratio").cast("int") + more.cast("int")
    return rows.withColumn("_copies", copies).drop("_source", "_digest", "_ratio", "_blocks", "_upto", "_all")


def counted(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with ``_copies``, rounded once over the whole source and not in each block.

    A source's rows stand in order of length class (powers of two), block and hash. The row at place k of its source is used
    ``floor(ratio * (k + 1) + 1/2) - floor(ratio * k + 1/2)`` times, so every run of rows realises the ratio up to one row, long
    and short documents alike, however long they are beside a block. Places are counted within blocks; a narrow table of the
    blocks' counts, summed in two steps, has where each one starts.
    """
    own = plan.select(F.col("source").alias("_source"), F.col("ratio").alias("_ratio"), F.col("blocks").alias("_blocks"))
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = docs.withColumns({"_source": F.coalesce(F.col(source), F.lit("")), "_words": word_count(text), "_digest": digest}).join(own, "_source")
    high = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumns({"_class": F.length(F.bin("_words")), "_block": F.shiftright(high * F.col("_blocks"), 32)})
    block = ["_source", "_class", "_block"]
    sizes = saved(rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).withColumn("_super", F.shiftright("_block", 8)), "blocks")
    supers = sizes.groupBy("_source", "_class", "_super").agg(F.sum("_n").alias("_all"))
    earlier = Window.partitionBy("_source").orderBy("_class", "_super").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("_source", "_class", "_super").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = supers.select("_source", "_class", "_super", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    offsets = sizes.withColumn("_within", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(starts, ["_source", "_class", "_super"])
    offsets = saved(offsets.select(*block, (F.col("_before") + F.col("_within")).alias("_start")), "offsets")
    place = F.row_number().over(Window.partitionBy(*block).orderBy("_digest", "_words"))
    rows = rows.withColumn("_place", place).join(offsets, block).withColumn("_upto", F.col("_start") + F.col("_place"))
    copies = F.floor(F.col("_ratio") * F.col("_upto") + 0.5) - F.floor(F.col("_ratio") * (F.col("_upto") - 1) + 0.5)
    return rows.withColumn("_copies", copies.cast("int")).select(*docs.columns, "_copies")


def mix(docs: DataFrame, plan: DataFrame | None = None, **columns: str) -> DataFrame:
    """The rows of ``docs`` as often as the weights say, with the columns of ``docs``."""
    plan = weights(docs, **{k: v for k, v in columns.items() if k != "doc_id"}) if plan is None else plan
    rows = counted(docs, plan, **columns).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
