"""Dialogue turns, histories under a token budget, speaker markers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lower_words
from . import ordering

TURNS_PER_BLOCK = 4096


def flatten_dialogues(df: DataFrame, conv_id: str = "conv_id", dialogue: str = "dialogue") -> DataFrame:
    """``ARRAY<[user, reply]>`` -> one row per turn ``(conv_id, k, id, user_text, reply)``."""
    turns = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(dialogue).alias("k", "pair"))
    return turns.select(
        "conv_id", F.col("k").cast("bigint").alias("k"), turn_id().alias("id"),
        F.get("pair", F.lit(0)).alias("user_text"), F.get("pair", F.lit(1)).alias("reply"),
    )


def turn_id() -> Column:
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("k").cast("string"))


def with_running_id(turns: DataFrame) -> DataFrame:
    """Integer id running over the whole corpus in (conversation, turn) order."""
    return ordering.running_sum(turns.drop("id"), ["conv_id", "k"], out="id")


def pair_turns(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", skip_roles: tuple[str, ...] = ("system",),
) -> DataFrame:
    """Message table -> complete (user, reply) pairs, numbered from 0 in each conversation.

    Messages of ``skip_roles`` are left out first; a last message with no reply is dropped.
    """
    kept = messages.where(~F.col(role).isin(*skip_roles)).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(text).alias("text")
    )
    numbered = ordering.group_row_number(
        kept, ["conv_id"], ["turn"], F.floor(F.col("turn") / TURNS_PER_BLOCK)
    )
    even = F.col("rn") % 2 == 0
    return (
        numbered.groupBy("conv_id", F.floor(F.col("rn") / 2).alias("k"))
        .agg(
            F.max(F.when(even, F.col("text"))).alias("user_text"),
            F.max(F.when(~even, F.col("text"))).alias("reply"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("n = 2")
        .select("conv_id", "k", turn_id().alias("id"), "user_text", "reply")
    )


def complete_history(turns: DataFrame, turns_per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """All texts a turn can see, however many: ``(conv_id, k, n, history, reply)``.

    The result itself grows with the square of a conversation's length, and the row of a late turn holds nearly all of it. What
    meets in a task is one block of turns with the texts before the block, gathered once for all its turns, so a long
    conversation is many tasks. For histories under a token budget use :func:`running_history`. Turns are numbered from 0.
    """
    block = F.floor(F.col("k") / turns_per_block)
    held = turns.select("conv_id", block.alias("_block"), F.struct("k", "user_text", "reply").alias("turn"))
    texts = F.flatten(F.transform("turns", lambda t: F.array(t["user_text"], t["reply"])))
    blocks = held.groupBy("conv_id", "_block").agg(F.sort_array(F.collect_list("turn")).alias("turns")).withColumn("texts", texts)
    ends = turns.groupBy("conv_id").agg(F.max(block).alias("_last")).where("_last > 0")
    sent = blocks.join(ends, "conv_id").where("_block < _last").select(
        "conv_id", F.struct("_block", "texts").alias("part"), F.explode(F.sequence(F.col("_block") + 1, F.col("_last"))).alias("_block")
    )
    before = sent.groupBy("conv_id", "_block").agg(F.sort_array(F.collect_list("part")).alias("parts")).select(
        "conv_id", "_block", F.flatten(F.transform("parts", lambda p: p["texts"])).alias("before")
    )
    each = blocks.join(before, ["conv_id", "_block"], "left").select("conv_id", "before", "texts", F.posexplode("turns").alias("i", "t"))
    own = F.slice("texts", F.lit(1), 2 * F.col("i") + 1)
    history = F.when(F.col("before").isNull(), own).otherwise(F.concat("before", own))
    return each.select("conv_id", "t.k", (2 * F.col("t.k") + 1).alias("n"), history.alias("history"), "t.reply")


def running_history(
    turns: DataFrame, max_tokens: int = 512, tokenize: Callable[[Column], Column] = lower_words,
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """Texts a turn can see under a budget: earlier user and reply texts in order, then its own user text.

    ``history`` is an array of ``(text, tokens)``; ``n`` is the number of all entries up to the turn. Entries are ordered by the
    running sum of what they cost (their tokens and two more places), so those that can fit are a range of that sum: no entry is
    carried that starts before the budget. The sums run inside blocks of turns, each with the tail of the block before it that
    the budget can reach, so one very long conversation is spread over many tasks. Turns must be numbered densely from 0.
    """
    budget = max(max_tokens - 2, 0)
    reach = max(1, (budget // 2 + 1) // 2 + 1)
    size = max(turns_per_block, reach)
    own = F.floor(F.col("k") / size)
    blocks = F.when(F.col("k") % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    entry = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("text"), tokenize(F.col(c)).alias("tokens"))
    entries = (
        turns.select("conv_id", "k", "id", F.explode(F.array(entry(0, "user_text"), entry(1, "reply"))).alias("e"))
        .select("conv_id", "k", "id", "e.*", F.explode(blocks).alias("_block"))
    )
    in_order = Window.partitionBy("conv_id", "_block").orderBy("k", "side")
    cost = F.sum(F.greatest(F.size("tokens"), F.lit(0)) + 2).over(in_order)
    affordable = Window.partitionBy("conv_id", "_block").orderBy("_cost").rangeBetween(-budget, 0)
    return (
        entries.withColumns({"_cost": cost, "reply": F.lead("text").over(in_order), "reply_tokens": F.lead("tokens").over(in_order)})
        .withColumn("history", F.collect_list(F.struct("text", "tokens")).over(affordable))
        .where((F.col("side") == 0) & (F.col("_block") == own))
        .select("conv_id", "k", "id", "reply", "reply_tokens", (2 * F.col("k") + 1).alias("n"), "history")
    )


def truncate_history(df: DataFrame, max_tokens: int = 512, policy: str = "triangular") -> DataFrame:
    """Drop the oldest entries until ``tokens <= max - 2 - 2 * entries``.

    ``triangular``: step r drops r + 1 more entries, so 0, 1, 3, 6, 10, ... are dropped in all.
    ``minimal``: one entry at a time. Nothing is kept when even the last entry does not fit.
    Adds ``kept`` and ``dropped``.
    """
    n, held = F.col("n"), F.size("history")
    # A kept count above ``held`` never fits (see running_history), so the search starts there.
    first = n - held
    if policy == "triangular":
        root = F.ceil((F.sqrt(8 * first.cast("double") + 1) - 1) / 2).cast("bigint")
        options = F.transform(
            F.sequence(root, root + held), lambda r: F.greatest(n - r * (r + 1) / 2, F.lit(0)).cast("int")
        )
    elif policy == "minimal":
        options = F.sequence(held, F.lit(0), F.lit(-1))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    sizes = F.transform("history", lambda e: F.size(e["tokens"]))
    fits = lambda keep: F.aggregate(
        F.slice("_sizes", F.col("_held") - keep + 1, keep), F.lit(0), lambda a, x: a + x + 2
    ) <= max_tokens - 2
    return (
        df.withColumn("_sizes", sizes).withColumn("_held", held).withColumn("_options", options)
        .withColumn(
            "kept",
            F.coalesce(F.get(F.filter("_options", lambda s: (s <= F.col("_held")) & fits(s)), F.lit(0)), F.lit(0)),
        )
        .withColumn("dropped", F.col("n") - F.col("kept"))
        .withColumn("history", F.slice("history", F.col("_held") - F.col("kept") + 1, F.col("kept")))
        .drop("_sizes", "_held", "_options")
    )


def mark_speakers(
    df: DataFrame, speaker_1: int | str, speaker_2: int | str, anchor: str = "position",
    field: str = "tokens", kind: str | None = None, out: str = "marked",
) -> DataFrame:
    """Put a speaker marker before every history entry and flatten.

    ``anchor="position"`` alternates from the first kept entry; ``anchor="role"`` keeps the real
    speakers after an odd number of dropped entries.
    """
    kind = kind or ("string" if isinstance(speaker_1, str) else "bigint")
    if anchor not in ("position", "role"):
        raise ValueError(f"unknown anchor {anchor!r}")
    shift = F.lit(0) if anchor == "position" else F.col("dropped")

    def marked(entry: Column, i: Column) -> Column:
        speaker = F.when((i + shift) % 2 == 0, F.lit(speaker_1)).otherwise(F.lit(speaker_2))
        content = entry[field] if field == "tokens" else F.array(entry[field])
        return F.concat(F.array(speaker.cast(kind)), content.cast(f"array<{kind}>"))

    return df.withColumn(out, F.flatten(F.transform("history", marked)))


def longest_history(df: DataFrame, column: str = "marked") -> DataFrame:
    return df.agg(F.max(F.size(column)).cast("bigint").alias("max_len"))
