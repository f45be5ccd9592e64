"""I-Match fingerprints with randomised lexicons.

The lexicon keeps terms whose inverse document frequency, ``ln(documents / df)``, lies in a band. Document frequencies are
counted for each term (by 64-bit hash) over all documents; the band bounds the number of terms in the lexicon. A text's distinct lexicon terms are sorted and hashed for several random subsets of the lexicon: ``CHAINS`` chains of
nested subsets, each half of the one before. Small subsets survive edits, large ones tell texts apart. Two fingerprints are as
alike as the share of chains that agree on the smallest subset in which either text has a term.

A text without lexicon terms uses all its terms; a null text, or one without words, has the all-zero fingerprint. Equal texts
have equal fingerprints. Repeated rows get equal rows. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bound_batches, mix, partitions, words_of

HELD_TERMS = 1 << 20
LOW_IDF, HIGH_IDF = 3.0, 9.0
CHAINS, LEVELS = 12, 12
_HASHES: list[WordHashes] = []
_SEEDS = mix(np.arange(1, 2 * CHAINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, CHAINS, 1)


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct term hashes of a text; A-Z are lower-cased."""
    if not _HASHES:
        _HASHES.append(WordHashes(seed=17))
    return np.unique(_HASHES[0].of([w.lower() for w in words_of(text)]))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW_IDF, high: float = HIGH_IDF) -> np.ndarray:
    """Sorted hashes of the terms in the band, by exact frequencies.

    A term in the band stands in at least ``exp(-high)`` of the documents, so the lexicon holds at most ``exp(high)`` times the mean
    number of distinct terms of a document, however large the corpus: a sorted list that fits the driver and every task.
    """
    total = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                found = terms(t)
                held.append(found)
                size += len(found)
                if size >= HELD_TERMS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary())], names=["terms"])

    df = docs.select(text).mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(F.lit(float(total)) / F.col("df"))
    inside = df.where((idf >= low) & (idf <= high)).select("term").mapInArrow(packed, "terms binary")
    parts = [np.frombuffer(bytes(r.terms), np.uint64) for r in inside.collect()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def fingerprint(text: str | None, words: np.ndarray) -> np.ndarray:
    """``CHAINS x LEVELS`` 16-bit hashes; 0 stands for a subset in which the text has no term."""
    h = terms(text)
    slots = np.zeros((CHAINS, LEVELS), np.uint16)
    if len(h) == 0:
        return slots
    known = h[words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h] if len(words) else h[:0]
    h = known if len(known) else h
    with np.errstate(over="ignore"):
        z = mix(h ^ _SEEDS[0])
        level = np.minimum(np.log2((z & (~z + np.uint64(1))).astype(np.float64)), LEVELS - 1).astype(np.int64)
        level[z == 0] = LEVELS - 1
        value = mix(h ^ _SEEDS[1])
        sums, counts = np.zeros(CHAINS * LEVELS, np.uint64), np.zeros(CHAINS * LEVELS, np.int64)
        at = (level + LEVELS * np.arange(CHAINS)[:, None]).reshape(-1)
        np.add.at(sums, at, value.reshape(-1))
        np.add.at(counts, at, 1)
        # A subset holds the terms of its level and all smaller subsets' terms.
        sums = np.cumsum(sums.reshape(CHAINS, LEVELS)[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        counts = np.cumsum(counts.reshape(CHAINS, LEVELS)[:, ::-1], axis=1)[:, ::-1]
        return np.where(counts > 0, np.maximum(mix(sums) >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal fingerprints."""
    some = (a != 0) | (b != 0)
    used = some.any(axis=1)
    if not used.any():
        return 1.0
    top = LEVELS - 1 - some[:, ::-1].argmax(axis=1)
    rows = np.arange(CHAINS)
    return float((a[rows, top] == b[rows, top])[used].mean())


def as_text(slots: np.ndarray) -> str:
    return slots.astype(">u2").tobytes().hex()


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id, text, guest`` in range partitions, in descending order of the id within each.

    The first row of a partition also goes, as a guest at the end, to the partition before it (that of the first partition to the last
    one), so each row's next row stands behind it. One shuffle of the texts. Ties are ordered by text; null ids come last.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    cuts = docs.where(F.col(doc_id).isNotNull()).approxQuantile(doc_id, [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted({int(c) for c in cuts}, reverse=True)
    # Partition 0 has the largest ids. Bounds are looked up in two steps: the group, then the place in it.
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[at : at + step] for at in range(0, len(bounds), step)]
    count = lambda array: F.size(F.filter(array, lambda b: b > F.col("doc_id")))
    if bounds:
        whole = count(F.array(*[F.lit(g[-1]) for g in groups]))  # groups that lie above the id
        inside = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), whole)
        above = whole * step + F.when(inside.isNull(), 0).otherwise(count(inside)) - F.when(whole == len(groups), len(groups) * step - len(bounds)).otherwise(0)
    else:
        above = F.lit(0)
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(above).cast("int")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("part", part)
    first = sorted((r.part, r["first"]) for r in named.groupBy("part").agg(F.max("doc_id").alias("first")).collect())  # one row per partition
    kind = named.schema["doc_id"].dataType.simpleString()
    hosts = spark.createDataFrame([(p, i, first[k - 1][0]) for k, (p, i) in enumerate(first)], f"_part int, _first {kind}, guest int")
    at_home = (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    # One row per partition.
    guest = named.join(F.broadcast(hosts), at_home, "left").withColumn("homes", F.when(F.col("guest").isNull(), F.array("part")).otherwise(F.array("part", "guest")))
    rows = guest.select("doc_id", "text", F.posexplode("homes").alias("place", "part")).withColumn("guest", F.col("place") == 1)
    placed = rows.repartitionById(max(parts, len(bounds) + 1), F.col("part"))
    return placed.sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text")).select("doc_id", "text", "guest")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first code points, as many or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    bound_batches(docs.sparkSession)
    words = lexicon(docs, text)
    rows = with_next(docs, doc_id, text)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False  # a partition ends at its first guest
        for b in batches:
            ids, out = [], []
            for i, t, guest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if done:
                    break
                t = t or ""
                mine = fingerprint(t, words)
                if held is not None:
                    other = edited(held[1], t)
                    changed = fingerprint(other, words)
                    digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                    ids.append(held[0])
                    out.append((len(held[1]), digest, as_text(held[2]), as_text(changed), likeness(held[2], changed), likeness(held[2], mine)))
                held, done = (i, t, mine), guest
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=names
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
