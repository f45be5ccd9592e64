"""Cheapest repair of conversation structure by iterative-deepening A*.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn. Rows are kept (0),
rerolled to user or assistant (2) or deleted (3; blank rows and repeats must be), empty turns are inserted (2), and a truncated row
that stays costs 1. The search goes depth first through the edits in ASCII order (Delete, Insert, Keep, Rerole) under a cost bound that
rises until a path is accepted; a table of failed states, with the budget they failed with, cuts repeated work. The first path
accepted is the cheapest one, and among those the least as text.

What a search costs does not grow with the conversation: rows are cut into blocks of ``BLOCK``, each searched once for every pair of
roles it can be entered and left with. Insertions stand before a row, so a block's edits end with a row's own edit, no
block's text is the start of another's with the same rows, and joining the blocks' cheapest edits gives the cheapest of the whole.
Rows are spread by ranges of (conversation, turn, ...), without their texts, so a conversation of any length is many tasks; each partition
sends at most two unfinished conversations on. Then texts meet the edits in one ordered stream per conversation, which is never held.
The audit of a conversation is one string and its digest one pass over its texts, as their definitions say.

Order in a conversation: by turn (nulls first), then role, then MD5 of the text; equal rows are counted, not listed. A null role or
text is one space, a null conversation id is a conversation. A role that starts with none of s, u, a (or is empty) cannot be kept.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, partitions, saved

BLOCK = 48
LONGEST_RUN = 1 << 20
CACHE = 200_000
BLANKS = " \t\n\x0b\x0c\r"

# States: nothing yet, after system, after user, after assistant.
_INSERTED = (2, 2, 3, 2)
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_EXITS = ((0, 1, 2, 3), (1, 2, 3), (2, 3), (2, 3))
_ACCEPT = -1
_ROLES = {2: "user", 3: "assistant"}
_LEGAL = {"su", "ua", "au"}

STATS = ("n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_turn", "last_turn")
# Column names with Spark's types; ``_schema`` has Arrow's.
FRAGMENT = {
    "part": "int", "whole": "boolean", **dict.fromkeys(STATS, "bigint"), "first_role": "string", "last_role": "string",
    "ways": "array<struct<enter:int,leave:int,cost:bigint,audit:string>>",
}
VERDICT = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint") | {"audit": "string"}
_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(),
    FRAGMENT["ways"]: pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
}


def search(rows: str, enter: int, goal: int) -> tuple[int, str] | None:
    """Cost and edits that lead from state ``enter`` through ``rows`` to state ``goal`` (``_ACCEPT``: a finished conversation).

    A row is two characters: its role's initial, and ``x`` (must go), ``t`` (truncated) or ``.``. Without a finish,
    the edits end with the last row's.
    """
    initials, faults = rows[::2], rows[1::2]
    n, least = len(faults), [0]
    for f in reversed(faults):
        least.append(least[-1] + {"x": 3, "t": 1, ".": 0}[f])
    least.reverse()
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def walk(i: int, state: int, budget: int) -> int:
        """The cost of the first path found within the budget, or -1."""
        if i == n and (state == goal or goal == _ACCEPT and state in (0, 3)):
            return 0
        if budget < least[i] or failed.get((i, state), -1) >= budget:
            return -1
        steps = [("D", 3, i + 1, state)] if i < n else []
        if i < n or goal == _ACCEPT:
            steps.append(("I", 2, i, _INSERTED[state]))
        if i < n and faults[i] != "x":
            extra = faults[i] == "t"
            if initials[i] in _KEPT[state]:
                steps.append(("K", extra, i + 1, _KEPT[state][initials[i]]))
            steps.append(("R", 2 + extra, i + 1, _INSERTED[state]))
        for edit, cost, j, after in steps:
            if cost + least[j] <= budget:
                path.append(edit)
                rest = walk(j, after, budget - cost)
                if rest >= 0:
                    return cost + rest
                path.pop()
        failed[i, state] = budget
        return -1

    for bound in range(least[0], 3 * n + 5):  # deleting all and inserting two turns costs no more
        cost = walk(0, enter, bound)
        if cost >= 0:
            return cost, "".join(path)
    return None


class Searches(dict):
    """Results by rows, entry and goal, remembered up to a bound; many conversations have the same form."""

    def __missing__(self, key: tuple[str, int, int]) -> tuple[int, str] | None:
        if len(self) >= CACHE:
            self.clear()
        value = self[key] = search(*key)
        return value


_FOUND = Searches()


def block_ways(rows: str) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest edits for every way through a block."""
    ways = {}
    for enter, exits in enumerate(_EXITS):
        for leave in exits:
            if (enter, leave) != (0, 1) or "s." in rows or "st" in rows:
                way = _FOUND[rows, enter, leave]
                if way is not None:
                    ways[enter, leave] = way
    return ways


def run_ways(n: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Ways through ``n`` rows that all must go: an insertion may as well come after them, which is less as text."""
    return {(s, s): (3 * n, "D" * n) for s in range(4)}


def joined_ways(one: dict, two: dict) -> dict[tuple[int, int], tuple[int, str]]:
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for (enter, middle), (cost, audit) in one.items():
        for (start, leave), (more, rest) in two.items():
            if start == middle:
                way = cost + more, audit + rest
                if (enter, leave) not in out or way < out[enter, leave]:
                    out[enter, leave] = way
    return out


def finished(ways: dict[tuple[int, int], tuple[int, str]]) -> tuple[int, str]:
    """The cheapest whole repair from the ways through all rows."""
    ends = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    return min((cost + ends[leave][0], audit + ends[leave][1]) for (enter, leave), (cost, audit) in ways.items() if enter == 0)


class Segment:
    """The rows of one conversation in one partition, in order."""

    def __init__(self, conv):
        self.conv, self.rows, self.chain = conv, [], []
        self.stats = dict.fromkeys(STATS, 0) | {"low": None, "high": None, "first_turn": None, "last_turn": None}
        self.first_role = self.last_role = None

    def _push(self, ways: dict, size: int) -> None:
        """Joins blocks like a binary counter, so texts are copied a logarithmic number of times."""
        self.chain.append((size, ways))
        while len(self.chain) > 1 and self.chain[-2][0] <= self.chain[-1][0]:
            (a, one), (b, two) = self.chain[-2:]
            self.chain[-2:] = [(a + b, joined_ways(one, two))]

    def add(self, turn, role: str, initial: str, count: int, blank: bool, earlier: bool, cut: bool) -> None:
        s = self.stats
        if count == 0:
            return
        fault = "blank" if blank else "duplicate" if earlier else "truncated" if cut else None
        if fault:
            s[fault] += 1
        s["blank" if blank else "duplicate"] += count - 1
        s["illegal"] += (count - 1) + (s["n"] > 0 and self.last_role + initial not in _LEGAL)
        if s["n"] == 0:
            self.first_role, s["first_turn"] = initial, turn
        if turn is not None:
            s["turns"] += turn != s["last_turn"]
            s["low"] = turn if s["low"] is None else s["low"]
            s["high"] = turn
        self.last_role, s["last_turn"] = initial, turn
        s["n"] += count
        self.rows.append((initial or " ") + {None: ".", "truncated": "t"}.get(fault, "x"))
        more = count - 1
        if more <= BLOCK:
            self.rows += [" x"] * more
        else:
            self.flush()
            for at in range(0, more, LONGEST_RUN):
                n = min(LONGEST_RUN, more - at)
                self._push(run_ways(n), -(-n // BLOCK))
        while len(self.rows) > BLOCK:
            self._push(block_ways("".join(self.rows[:BLOCK])), 1)
            del self.rows[:BLOCK]

    def flush(self) -> None:
        if self.rows:
            self._push(block_ways("".join(self.rows)), 1)
            self.rows = []

    def ways(self) -> dict:
        self.flush()
        total = {(s, s): (0, "") for s in range(4)}
        for _, ways in self.chain:
            total = joined_ways(total, ways)
        return total

    def row(self, part: int, whole: bool) -> dict:
        """A whole conversation carries its one cheapest repair, a part of one all its ways."""
        if whole and not self.chain:
            ways = {(0, 0): _FOUND["".join(self.rows), 0, _ACCEPT]}
        else:
            ways = self.ways()
            if whole:
                ways = {(0, 0): finished(ways)}
        listed = [{"enter": a, "leave": b, "cost": c, "audit": t} for (a, b), (c, t) in ways.items()]
        return {"conv_id": self.conv, "part": part, "whole": whole, **self.stats, "first_role": self.first_role, "last_role": self.last_role, "ways": listed}


def _schema(columns: dict[str, str], like: pa.Schema) -> pa.Schema:
    return pa.schema([("conv_id", like.field("conv_id").type), *((n, _ARROW[t]) for n, t in columns.items())])


def _ddl(columns: dict[str, str], rows: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in {"conv_id": rows.schema["conv_id"].dataType.simpleString(), **columns}.items())


def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted narrow rows of one partition to one row per conversation; the first and the last may go on in other partitions."""
    from pyspark import TaskContext

    part, now, first, out, schema = TaskContext.get().partitionId(), None, True, [], None
    for b in batches:
        schema = schema or _schema(FRAGMENT, b.schema)
        for conv, *row in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "initial", "count", "blank", "earlier", "cut"))):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row(part, not first))
                    first = False
                now = Segment(conv)
            now.add(*row)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if now is not None:
        out.append(now.row(part, False))
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _verdict(row: dict, cost: int, audit: str) -> dict:
    gaps = 0 if row["low"] is None else row["high"] - row["low"] + 1 - row["turns"]
    return {"gaps": gaps, **{k: row[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order of conversation and partition to one verdict per conversation."""
    now, ways, schema = None, {}, None

    def close() -> pa.RecordBatch:
        cost, audit = finished(ways)
        return pa.RecordBatch.from_pylist([_verdict(now, cost, audit)], schema=schema)

    for b in batches:
        schema = schema or _schema(VERDICT, b.schema)
        for row in b.to_pylist():
            mine = {(w["enter"], w["leave"]): (w["cost"], w["audit"]) for w in row.pop("ways")}
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    yield close()
                now, ways = row, mine
                continue
            ways = joined_ways(ways, mine)
            if row["n"] == 0:
                continue
            if now["n"]:
                now["illegal"] += now["last_role"] + row["first_role"] not in _LEGAL
                now["turns"] -= row["first_turn"] is not None and row["first_turn"] == now["last_turn"]
            now["low"] = row["low"] if now["low"] is None else now["low"]
            now["high"] = row["high"] if row["high"] is not None else now["high"]
            for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns"):
                now[k] += row[k]
            now["last_role"], now["last_turn"] = row["last_role"], row["last_turn"]
    if now is not None:
        yield close()


def _plain(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, count: Column | None) -> DataFrame:
    held = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        held.alias("text"), F.unhex(F.md5(held)).alias("digest"), (F.lit(1) if count is None else count).cast("bigint").alias("count"),
    )


def _verdicts(plain: DataFrame) -> DataFrame:
    """One row per conversation: its faults, and the cost and edits of its cheapest repair."""
    spark = plain.sparkSession
    end = F.rtrim("text", F.lit(BLANKS))
    cut = ~F.substring(end, -1, 1).isin(".", "!", "?")
    narrow = plain.select("conv_id", "turn", "role", "digest", "count", (end == "").alias("blank"), cut.alias("cut"))
    kinds = narrow.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("count").alias("count"), F.any_value("blank").alias("blank"), F.any_value("cut").alias("cut")
    )
    first = kinds.where("count > 0").groupBy(*(F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "digest"))).agg(
        F.min("turn").alias("f_turn"), F.max(F.col("turn").isNull()).alias("f_null")
    )
    same = F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    earlier = F.when(F.col("turn").isNull(), False).otherwise(F.col("f_null") | (F.col("turn") > F.col("f_turn")))
    known = kinds.join(first, same, "left").select(
        *kinds.columns, F.substring("role", 1, 1).alias("initial"), F.coalesce(earlier, F.lit(False)).alias("earlier")
    )
    order = ["conv_id", "turn", "role", "digest"]
    ranged = saved(known, "turns").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    parts = saved(ranged.mapInArrow(fragments, _ddl(FRAGMENT, plain)), "repairs")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    done = parts.where("whole").select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit")
    )
    rest = parts.where("not whole").repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part")
    return done.unionByName(rest.mapInArrow(combined, _ddl(VERDICT, plain)))


def _ordered(plain: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each conversation's verdict and then its rows, in order, in one partition."""
    spark = plain.sparkSession
    head = F.struct(*(c for c in verdicts.columns if c != "conv_id"))
    heads = verdicts.select("conv_id", head.alias("head"), F.lit(0).alias("kind"))
    rows = plain.where("count > 0").withColumn("kind", F.lit(1))
    order = ["conv_id", "kind", "turn", "role", "digest"]
    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.repartition(partitions(spark), "conv_id").sortWithinPartitions(*order).select("conv_id", "head", "turn", "role", "text", "count")


def repaired_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, head, None)`` at the start of each conversation, then ``(conv_id, edit, (turn, role, text))`` for every edit."""
    audit, at, state, conv = "", 0, 0, None
    for b in batches:
        for conv_now, head, turn, role, text, count in zip(*(c.to_pylist() for c in b.columns)):
            if head is not None:
                for _ in audit[at:]:  # what is left are insertions
                    state = _INSERTED[state]
                    yield conv, "I", (None, _ROLES[state], "")
                audit, at, state, conv = head["audit"], 0, 0, conv_now
                yield conv, head, None
                continue
            for _ in range(count):
                while audit[at] == "I":
                    state, at = _INSERTED[state], at + 1
                    yield conv, "I", (None, _ROLES[state], "")
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = _KEPT[state][role[:1]]
                elif edit == "R":
                    state = _INSERTED[state]
                yield conv, edit, (turn, _ROLES[state] if edit == "R" else role, text)
    for _ in audit[at:]:
        state = _INSERTED[state]
        yield conv, "I", (None, _ROLES[state], "")


def repair(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", count: Column | None = None,
) -> DataFrame:
    """The repaired turns: ``conv_id, place`` (from 0), ``turn`` (null if inserted), ``role, text, edit``. ``count`` repeats a row."""
    bound_batches(conversations.sparkSession)
    plain = _plain(conversations, conv_id, turn, role, text, count)
    columns = {"place": "bigint", "turn": "bigint", "role": "string", "text": "string", "edit": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, size, place = None, [], 0, 0

        def typed(source):
            nonlocal schema
            for b in source:
                schema = schema or _schema(columns, b.schema)
                yield b

        for conv, edit, row in repaired_rows(typed(batches)):
            if row is None:
                place = 0
            elif edit != "D":
                out.append((conv, place, *row, edit))
                place, size = place + 1, size + len(row[2])
                if len(out) >= 1000 or size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ordered = _ordered(plain, _verdicts(plain))
    return ordered.mapInArrow(run, _ddl(columns, plain))


def report(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", count: Column | None = None,
) -> DataFrame:
    """One row per conversation: faults, cost, edits, and the SHA-256 of its repaired ``role:text`` lines."""
    bound_batches(conversations.sparkSession)
    plain = _plain(conversations, conv_id, turn, role, text, count)
    columns = VERDICT | {"repaired_sha256": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, now, digest, lines = None, [], None, None, 0

        def typed(source):
            nonlocal schema
            for b in source:
                schema = schema or _schema(columns, b.schema)
                yield b

        for conv, edit, row in repaired_rows(typed(batches)):
            if row is None:
                if now is not None:
                    out.append({**now, "repaired_sha256": digest.hexdigest()})
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                now, digest, lines = {"conv_id": conv, **edit}, hashlib.sha256(), 0
            elif edit != "D":
                digest.update((("\n" if lines else "") + row[1] + ":" + row[2]).encode("utf-8", "surrogatepass"))
                lines += 1
        if now is not None:
            out.append({**now, "repaired_sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _ordered(plain, _verdicts(plain)).mapInArrow(run, _ddl(columns, plain))


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, count``: rows harmed by the CRC-32 of ``conv_id:turn``; a dropped row has count 0, a repeated one 2."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(filled(conv_id), F.lit(":"), filled(turn))) % 20
    held = filled(text)
    return conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.when(harm == 4, "user").otherwise(filled(role)).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(held, "[.!?]", "")).otherwise(held).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("count"),
    )
