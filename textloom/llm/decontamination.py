"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII. Each benchmark item gives its windows of ``WINDOW``
words; an item of fewer words is one window. The windows' hashes are broadcast; a task numbers the words of a whole batch of
documents, hashes all their windows at once, looks them up and compares every hit word by word, so a hash never decides alone.

What is broadcast is bounded: a benchmark above ``BLOCK_BYTES`` is cut into blocks of at most that size (long items into
overlapping pieces; the sizes are counted first), and the documents, with the hits found so far, pass the blocks one after another. Nothing is
left out at any size, and documents are never shuffled.

A null text has no words. Rows that repeat an item id are one item; a null item id still marks words but names no item. Repeated
document rows each get their result, extra columns are kept, and an empty table on either side gives no hits.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, mix, saved

WINDOW = 10
BLOCK_BYTES = 32 << 20
PIECE_WORDS = 4096
FOUND = "n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>"

# Every byte outside 0-9, a-z and the bytes of characters beyond ASCII becomes a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BETWEEN = b"A"  # no word holds a capital


def normal(text: str | None) -> bytes:
    """The text's bytes with a space for each byte that belongs to no word; offsets stay."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)


def _marked(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of true values."""
    edges = np.diff(np.concatenate([[0], keep.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


class Windows:
    """The windows of a block of the benchmark: ``(item, words, whole)`` rows, ``whole`` for items shorter than a window."""

    def __init__(self, items: list[str | None], texts: list[bytes], window: int):
        self.window, self.vocabulary = window, {_BETWEEN: -1}
        number = self.vocabulary.setdefault
        ids, owner = [0], [-1]
        for i, text in enumerate(texts):
            ids += [number(w, len(self.vocabulary)) for w in text.split()]
            owner += [i] * (len(ids) - len(owner))
            ids.append(0)
            owner.append(-1)
        self.ids, owner = np.array(ids, np.int64), np.array(owner)
        names = sorted({x for x in items if x is not None})
        place = {x: k for k, x in enumerate(names)}
        self.names = np.array(names, object)
        named = np.array([place.get(x, -1) for x in items] + [-1])
        sizes = np.bincount(owner[owner >= 0], minlength=len(texts)) if texts else np.zeros(0, np.int64)
        self.tables = {}
        for length in sorted({min(int(n), window) for n in sizes if n}):
            starts = self.runs(self.ids, length)
            mine = sizes[owner[starts]]
            starts = starts[mine >= window] if length == window else starts[mine == length]
            seed = 1
            while True:  # until no two different windows share a hash
                hashes = self.hashes(self.ids, starts, length, seed)
                order = np.argsort(hashes, kind="stable")
                known, first, which = np.unique(hashes[order], return_index=True, return_inverse=True)
                at = starts[order]
                if all((self.ids[at + k] == self.ids[at[first][which] + k]).all() for k in range(length)):
                    break
                seed += 1
            pairs = np.unique(np.stack([which, named[owner[at]]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
            pairs = pairs[:, pairs[1] >= 0]
            offsets = np.searchsorted(pairs[0], np.arange(len(known) + 1))
            bits = max(10, int(np.ceil(np.log2(16 * max(1, len(known))))))
            seen = np.zeros(1 << bits, bool)
            seen[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables[length] = seed, known, at[first], pairs[1], offsets, seen, np.uint64(64 - bits)

    @staticmethod
    def runs(ids: np.ndarray, length: int) -> np.ndarray:
        """Starts of all windows of known words."""
        if len(ids) < length:
            return np.zeros(0, np.int64)
        bad = np.concatenate([[0], np.cumsum(ids <= 0)])
        return np.flatnonzero(bad[length:] == bad[:-length])

    @staticmethod
    def hashes(ids: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
        words = mix(ids.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        total = np.zeros(len(starts), np.uint64)
        for k in range(length):
            total = total * np.uint64(0xD1342543DE82EF95) + words[starts + k]
        return mix(total)

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For normalised texts: word counts, the first word's place of each, hit words, and ``(text, name)`` pairs."""
        words = (b" " + _BETWEEN + b" ").join([b"", *texts]).split()
        ids = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.int64, len(words))
        begins = np.flatnonzero(ids == -1) + 1
        counts = np.diff(np.append(begins, len(ids) + 1)) - 1
        change = np.zeros(len(ids) + 1, np.int64)
        named = [np.zeros((2, 0), np.int64)]
        for length, (seed, known, example, names, offsets, seen, shift) in self.tables.items():
            starts = self.runs(ids, length)
            hashes = self.hashes(ids, starts, length, seed)
            maybe = seen[(hashes >> shift).astype(np.int64)]
            starts, hashes = starts[maybe], hashes[maybe]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            same = known[at] == hashes
            starts, at = starts[same], at[same]
            same = np.ones(len(starts), bool)
            for k in range(length):
                same &= ids[starts + k] == self.ids[example[at] + k]
            starts, at = starts[same], at[same]
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)
            text = np.searchsorted(begins, starts, side="right") - 1
            text, at = np.unique(np.stack([text, at]), axis=1) if len(at) else (text, at)
            many = offsets[at + 1] - offsets[at]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            named.append(np.stack([np.repeat(text, many), names[np.repeat(offsets[at], many) + within]]))
        return counts, begins, np.cumsum(change[:-1]) > 0, np.unique(np.concatenate(named, axis=1), axis=1)


_BUILT: dict[str, Windows] = {}


def _windows(shared, window: int) -> Windows:
    """The windows of a broadcast block, built once per Python worker; one block is held at a time."""
    if shared.value[2] not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.value[2]] = Windows(shared.value[0], shared.value[1], window)
    return _BUILT[shared.value[2]]


def _pieces(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct ``(item, words)``: normalised items; those beyond ``PIECE_WORDS`` words in pieces that share ``window - 1`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, cut = [], []
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = normal(t).split()
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = words[at : at + PIECE_WORDS + window - 1]
                    if piece:
                        names.append(name)
                        cut.append(b" ".join(piece))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cut, pa.binary())], names=["item", "words"])

    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text))
    return rows.mapInArrow(run, "item string, words binary").distinct()


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("item", "words"), F.lit(blocks))


def _scanned(rows: DataFrame, shared, text: str, window: int) -> DataFrame:
    """``rows`` with what one block finds added to ``_found``."""
    names = rows.columns
    text_at, found_at = names.index(text), names.index("_found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _windows(shared, window)
        for b in batches:
            counts, begins, hit, named = index.scan([normal(t) for t in b.column(text_at).to_pylist()])
            before = b.column(found_at).to_pylist()
            items: list[set] = [set(x["items"]) for x in before]
            for row, name in zip(named[0].tolist(), index.names[named[1]].tolist()):
                items[row].add(name)
            found = []
            for row, (n, at) in enumerate(zip(counts.tolist(), begins.tolist())):
                mine = hit[at : at + n]
                if before[row]["spans"]:
                    mine = mine.copy()
                    for s in before[row]["spans"]:
                        mine[s["start"] : s["stop"]] = True
                starts, stops = _marked(mine) if mine.any() else ((), ())
                spans = [{"start": int(s), "stop": int(e)} for s, e in zip(starts, stops)]
                found.append({"n_words": n, "spans": spans, "items": sorted(items[row])})
            columns = list(b.columns)
            columns[found_at] = pa.array(found, b.schema.field(found_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return rows.mapInArrow(run, rows.schema)


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES, into: str = "found",
) -> DataFrame:
    """``docs`` with the struct ``into`` added: ``n_words``, the hit ``spans`` of words (start, stop), and the ``items`` that occur.

    A column of that name is replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    pieces = saved(_pieces(benchmark, item_id, item_text, window), "benchmark")
    blocks = 1
    while True:  # until no block is larger than allowed, or holds one piece only
        sizes = pieces.groupBy(_block(blocks).alias("k")).agg(F.sum(F.length("words") + 64).alias("bytes"), F.count(F.lit(1)).alias("n"))
        if sizes.where((F.col("bytes") > block_bytes) & (F.col("n") > 1)).isEmpty():
            break
        blocks *= 2
    rows = docs.drop(into).withColumn("_found", F.from_json(F.lit('{"n_words": 0, "spans": [], "items": []}'), FOUND))
    for k in range(blocks):
        here = pieces.where(_block(blocks) == k).collect()
        shared = spark.sparkContext.broadcast(([r.item for r in here], [bytes(r.words) for r in here], uuid.uuid4().hex))
        rows = _scanned(rows, shared, text, window)
        if k + 1 < blocks:
            rows = saved(rows, "scanned")
    return rows.withColumnRenamed("_found", into)


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which each word starts and stops."""
    return _marked(np.frombuffer(normal(text), np.uint8) != 32)


def without_spans(text: str, spans: list[dict]) -> str:
    """The text without the hit words and what lies between them; a space stays where text is left on both sides."""
    starts, stops = word_offsets(text)
    raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
    for s in spans:
        kept.append(raw[at : starts[s["start"]]].rstrip())
        at = int(stops[s["stop"] - 1])
    kept.append(raw[at:].lstrip() if spans else raw[at:])
    return b" ".join(k for k in kept if k).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_documents: bool = False, **options) -> DataFrame:
    """``docs`` without what the benchmark holds: the hit spans are cut out of the texts, or whole hit documents go."""
    found = find(docs, benchmark, text, into="_hits", **options)
    if drop_documents:
        return found.where(F.size("_hits.spans") == 0).drop("_hits")
    text_at, hits_at, columns = found.columns.index(text), found.columns.index("_hits"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [
                without_spans(t, h["spans"]) if h["spans"] else t
                for t, h in zip(b.column(text_at).to_pylist(), b.column(hits_at).to_pylist())
            ]
            held = list(b.columns)
            held[text_at] = pa.array(new, b.schema.field(text_at).type)
            del held[hits_at]
            yield pa.RecordBatch.from_arrays(held, names=[n for n in b.schema.names if n != "_hits"])

    return found.mapInArrow(run, found.drop("_hits").schema).select(*columns)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: its words, the hit ones, the items that occur, and their digest."""
    found = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, "text", **options)
    n_hit = F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.size("found.spans") > 0).alias("contaminated"),
    )
