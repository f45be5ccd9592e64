"""Conversation repair beside brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import conversation_repair as repair

ACCEPTED = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """``(cost, audit, repaired)`` over ``(role, text, fault)`` rows, by growing all edit strings in order of cost, then text."""
    heap = [(0, "", 0, ())]
    seen = set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in out)
        if i == len(rows) and ACCEPTED.fullmatch(initials):
            return cost, audit, out
        if (i, state := (initials[:1] == "s", initials[-2:], len(out) > 0)) in seen or not re.fullmatch("s?(ua)*u?", initials):
            continue
        seen.add((i, state))
        steps = [("I", 2, i, out + ((r, ""),)) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append(("D", 3, i + 1, out))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                steps += [("K", extra, i + 1, out + ((role, text),))] if role else []
                steps += [("R", 2 + extra, i + 1, out + ((r, text),)) for r in ("user", "assistant")]
        for edit, more, j, after in steps:
            heapq.heappush(heap, (cost + more, audit + edit, j, after))


def plain(rows):
    """Results per conversation of ``(conv_id, turn, role, text, count)`` rows."""
    by = {}
    for conv, turn, role, text, count in rows:
        by.setdefault(conv, []).extend([(turn, role if role is not None else " ", text if text is not None else " ")] * count)
    out = Counter()
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        faults, before = [], set()
        for _, role, text in own:
            body = text.strip(repair.BLANKS)
            faults.append("blank" if not body else "duplicate" if (role, text) in before else "truncated" if body[-1] not in ".!?" else "")
            before.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest] += 1
    return out


def made(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice([f"text {turn}.", f"text {turn}", "same.", " \n", "", None, f"what {turn}? \t", "é!"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn // 2, None, turn + 3]), role, text, rng.choice([0, 1, 1, 1, 1, 1, 2, 3])))
    return rows


SCHEMA = "conv_id bigint, turn int, role string, text string, count int"


@pytest.mark.parametrize("block", [48, 2])
def test_report_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = made(block, 60, 9)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"cost": F.lit("x"), "kind": F.lit(1), "part": F.lit(2)}).repartition(4)
    got = Counter(tuple(r) for r in repair.report(table, count=F.col("count")).collect())
    assert got == plain(rows)


def test_conversation_over_many_partitions(spark):
    rows = [("c", t, "user" if (t * 7) % 5 else "assistant", f"t{t % 150}" + "." * (t % 3 > 0), 1) for t in range(400)] + [("d", 0, "user", "a.", 1)]
    rows += [("e", 1, "user", "hi.", 5000), ("e", 2, "assistant", "yes.", 1)]
    table = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string, count int").repartition(5)
    assert Counter(tuple(r) for r in repair.report(table, count=F.col("count")).collect()) == plain(rows)
    lines = [r for r in repair.repair(table, count=F.col("count")).where("conv_id = 'e'").orderBy("place").collect()]
    assert [(r.place, r.turn, r.role, r.text, r.edit) for r in lines] == [(0, 1, "user", "hi.", "K"), (1, 2, "assistant", "yes.", "K")]


def test_search_gives_the_first_of_the_cheapest():
    for n in range(5):
        for rows in itertools.product(["u.", "a.", "s.", "ut", "at", " x", "t."], repeat=n):
            text = "".join(rows)
            names = {"u": "user", "a": "assistant", "s": "system", "t": "tool", " ": " "}
            want = cheapest([(names[r[0]], "", {"x": "blank", "t": "truncated", ".": ""}[r[1]]) for r in rows])
            assert repair.search(text, 0, repair._ACCEPT) == want[:2]


def test_damage_and_empty_table(spark):
    rows = [(c, t, "assistant", f"Is it {t}? Yes. No!") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): (r.role, r.text, r["count"]) for r in repair.damaged(table).collect()}
    for conv, turn, role, text in rows:
        text, role = text or " ", role or " "
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        want = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        assert got[conv, turn] == ("user" if k == 4 else role, want, {0: 0, 3: 2}.get(k, 1))
    assert repair.report(table.limit(0)).count() == repair.repair(table.limit(0)).count() == 0


def test_blocks_join_to_the_whole_search(monkeypatch):
    rng = random.Random(9)
    for block in (1, 2, 5):
        monkeypatch.setattr(repair, "BLOCK", block)
        for _ in range(150):
            segment, text = repair.Segment("c"), ""
            for turn in range(rng.randint(0, 12)):
                role = rng.choice("uuaast")
                blank, earlier, cut, count = rng.random() < 0.1, rng.random() < 0.1, rng.random() < 0.2, rng.choice([1, 1, 1, 9])
                segment.add(turn, role, role, count, blank, earlier, cut)
                text += role + ("x" if blank or earlier else "t" if cut else ".") + " x" * (count - 1)
            assert repair.finished(segment.ways()) == repair.search(text, 0, repair._ACCEPT)
