"""Fingerprints of next texts over many partitions, beside brute force."""

import hashlib

import numpy as np
import pytest

from textloom.llm import imatch


@pytest.fixture
def partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", old)


def corpus(spark, n):
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(300)]
    rows = [(int(i), " ".join(rng.choice(words, 30)) if i % 11 else None) for i in rng.permutation(n) * 3]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


@pytest.mark.parametrize("parts", [1, 2, 3, 10, 40])
def test_fingerprints_are_brute_force(spark, partitions, parts):
    rows, docs = corpus(spark, 60)
    words = imatch.lexicon(docs)
    partitions(parts)
    order = sorted(rows, reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        other = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        mine, changed, after = (imatch.fingerprint(x, words) for x in (t, other, following))
        digest = hashlib.sha256(other.encode()).hexdigest()
        want[i] = (i, len(t), digest, imatch.as_text(mine), imatch.as_text(changed), imatch.likeness(mine, changed), imatch.likeness(mine, after))
    assert {r.doc_id: tuple(r) for r in imatch.fingerprints(docs).collect()} == want


def test_plan_at_thousands_of_partitions(spark, partitions):
    _, docs = corpus(spark, 9000)
    partitions(4000)
    plan = imatch.with_next(docs)
    assert "4000" in plan._jdf.queryExecution().toString() and plan.limit(1).count() == 1
