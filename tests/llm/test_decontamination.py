"""Benchmark decontamination beside brute force."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LINE = " ".join(f"w{i}" for i in range(30))
ITEMS = [
    (1, "Alpha beta, GAMMA-delta epsilon zeta eta theta iota kappa lambda mu"), (1, "short one"), (2, "short one"), (3, None), (4, " ?! "),
    (None, "nameless item here"), (5, LINE + " tail"), (6, LINE), (7, "é9ü"), (10, LINE), (8, "a a a a a a a a a a a a"),
]
DOCS = [
    (1, "x alpha BETA gamma delta\nepsilon zeta eta theta iota kappa lambda. tail"), (2, None), (2, ""), (2, "..."), (3, "A SHORT, one! short two"),
    (4, "alpha beta gamma delta epsilon zeta eta theta iota"), (5, "the nameless item-here again"), (None, "é9ü and é9 ü"), (6, "z " * 20000 + LINE + " y" * 20000),
    (7, LINE.replace("w12", "q") + " " + LINE), (7, "a " * 9), (7, "a " * 25), (8, "w" * 5000), (6, "alpha"), (6, "alpha"),
]


def plain(docs, items, window=10):
    lower = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for name, text in items:
        w = lower(text)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[at : at + window]), set()).add(name)
    out = Counter()
    for doc, text in docs:
        w, hit, found = lower(text), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if (key := tuple(w[at : at + n])) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[key]
        names = sorted(str(x) for x in found if x is not None)
        out[doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", k, None) for k, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, found string, items int, spans string").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string").repartition(2)


@pytest.mark.parametrize("options", [{}, {"window": 3}, {"block_bytes": 150}])
def test_report_is_brute_force(docs, items, options):
    got = Counter(tuple(r) for r in decontamination.report(docs, items, **options).collect())
    assert got == plain(DOCS, ITEMS, options.get("window", 10))


def test_long_items_are_cut_with_overlap(spark, docs, items, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 4)
    got = Counter(tuple(r) for r in decontamination.report(docs, items, block_bytes=300).collect())
    assert got == plain(DOCS, ITEMS)


def test_empty_tables_and_clashing_names(docs, items):
    assert decontamination.report(docs.limit(0), items).count() == 0
    none = decontamination.report(docs, items.limit(0)).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated or r.n_hit or r.n_items for r in none)
    found = decontamination.find(docs, items)
    assert found.columns == ["doc_id", "text", "items", "spans", "found"] and found.where("found.n_words is null").count() == 0


def test_clean_removes_spans_or_documents(docs, items):
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(DOCS)
    by_place = {r.items: r.text for r in kept.collect()}
    assert by_place[0] == "x . tail" and by_place[1] is None and by_place[2] == ""
    assert by_place[4] == "A ! short two"
    assert by_place[8] == "z " * 19999 + "z " + ("y " * 20000).strip() and by_place[5] == DOCS[5][1]
    assert not any(r.contaminated for r in decontamination.report(kept.where("items not in (9, 11)"), items).collect())
    whole = decontamination.clean(docs, items, drop_documents=True)
    flags = [k for k, d in enumerate(DOCS) if not list(plain([d], ITEMS))[0][-1]]
    assert whole.columns == docs.columns and sorted(r.items for r in whole.collect()) == flags
    assert whole.where(F.col("text") == "alpha").count() == 2
