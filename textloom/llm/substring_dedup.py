"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``block`` words. Every rolling window of ``block``
words of every document is probed against these blocks; a hit is a window whose block also stands at
another place. With ``block = (window + 1) // 2`` each repeated run of ``window`` words holds a whole reference block
of its twin, so it holds a hit. Hits are then extended: all ``window``-word runs around them are compared exactly
(a rolling hash and a digest of the characters, 128 bits in all), and the union of those that occur again is the set of maximal exact repeats.

Plan: rows are grouped into units by a hash of the row, a few per shuffle partition. A unit sends, per bucket of the
hash space, each of its distinct window hashes once, so a window that the whole corpus shares is one small entry
per unit and never a list of places or of pairs. Texts are shuffled once; the shuffle is used by all three steps.

A null text has no words. Rows are judged on their own: repeated rows or ids are repeats of each other.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, mix, partitions, words_of

WINDOW = 35
UNITS_PER_PARTITION = 2
_BASE = 0x9E3779B97F4A7C15 | 1


_POWERS: list[np.ndarray] = []
_SPAN = 1 << 21
_BYTE_BASE = 0xD6E8FEB86659FD93


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _SPAN)
        _POWERS[:] = []
        for base in (_BYTE_BASE, pow(_BYTE_BASE, -1, 1 << 64)):
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))), dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the words at bytes [first, last) of ``data``, all at once."""
    out, at = np.empty(len(first), np.uint64), 0
    raw = np.frombuffer(data, np.uint8)
    while at < len(first):  # a span of bytes at a time, longer only for one long word
        base = int(first[at])
        to = max(at + 1, int(np.searchsorted(last, base + _SPAN, side="right")))
        n = int(last[to - 1]) - base
        power, inverse = _powers(n)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw[base : base + n].astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))
            a, b = first[at:to] - base, last[at:to] - base
            out[at:to] = (total[b] - total[a]) * inverse[a]
        at = to
    return mix(out)


class Words:
    """The words of several texts one after another, single spaces between, and where each text starts and ends."""

    def __init__(self, texts: list[str | None]):
        self.texts = [b" ".join(words_of(t)) for t in texts]
        self.data = b" ".join([t for t in self.texts if t])
        sizes = np.array([t.count(b" ") + 1 if t else 0 for t in self.texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        spaces = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 32)
        some = len(self.data) > 0
        self.first = np.concatenate(([0], spaces + 1)) if some else np.zeros(0, np.int64)
        self.last = np.concatenate((spaces, [len(self.data)])) if some else np.zeros(0, np.int64)
        self.hashes = word_hashes(self.data, self.first, self.last)

    def rolling(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (in all words) of the runs of ``width`` words inside one text, and the runs' 64-bit hashes."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            have, size, out, done, base = self.hashes, 1, None, 0, np.uint64(_BASE)
            # Runs of 1, 2, 4 ... words; those that make up ``width`` are put side by side.
            while True:
                if width & size:
                    out = have[:n].copy() if out is None else out * base + have[done : done + n]
                    done += size
                size *= 2
                if size > width:
                    break
                have = have[: len(have) - size // 2] * base + have[size // 2 :]
                base = base * base
            out = mix(out)
        last = np.repeat(self.ends, self.ends - self.starts)[:n]
        places = np.flatnonzero(np.arange(n) + width <= last)
        return places, out[places]

    def digests(self, places: np.ndarray, window: int) -> np.ndarray:
        """64-bit digests of the characters of the ``window``-word runs at ``places``."""
        import xxhash

        one, data = xxhash.xxh3_64_intdigest, self.data
        spans = zip(self.first[places].tolist(), self.last[places + window - 1].tolist())
        return np.fromiter((one(data[a:b]) for a, b in spans), np.uint64, len(places))


def _send(unit: int, keys: np.ndarray, rest: np.ndarray, flag: np.ndarray, buckets: int) -> pa.Table:
    """Rows ``(unit, bucket, data)``: per bucket the distinct entries, each with its flag and whether it is repeated here.

    ``keys`` choose the bucket; ``rest`` (one row of bytes per entry) is what is compared there.
    """
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    if rest.dtype.names:
        order = np.lexsort((rest["b"], rest["a"], bucket))
    else:
        order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | rest)
    bucket, rest, flag = bucket[order], rest[order], flag[order]
    new = np.ones(len(order), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (rest[1:] != rest[:-1])
    at = np.flatnonzero(new)
    if len(at) == 0:
        return _sent([], [], [])
    count = np.diff(np.append(at, len(order)))
    flag = np.maximum.reduceat(flag.astype(np.uint8), at) | ((count > 1).astype(np.uint8) << 1)
    bucket, rest = bucket[at], rest[at]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(cut[1:], len(bucket))
    data = [
        rest[a:b].tobytes() + np.packbits(flag[a:b] & 1).tobytes() + np.packbits(flag[a:b] >> 1).tobytes()
        for a, b in zip(cut, ends)
    ]
    sizes = (ends - cut).tolist()
    return _sent([unit] * len(cut), bucket[cut].tolist(), [n.to_bytes(4, "little") + d for n, d in zip(sizes, data)])


SENT = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
SENT_DDL = "unit bigint, bucket bigint, data binary"


def _sent(units, buckets, data) -> pa.Table:
    return pa.table({"unit": pa.array(units, pa.int64()), "bucket": pa.array(buckets, pa.int64()), "data": pa.array(data, pa.binary())})


def _received(data: bytes, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    packed = -(-n // 8)
    rest = np.frombuffer(data, kind, n, 4)
    bits = np.frombuffer(data, np.uint8, 2 * packed, 4 + n * width)
    return rest, np.unpackbits(bits[:packed], count=n), np.unpackbits(bits[packed:], count=n)


_HASH = "<u4"
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])


def _match(kind):
    """Per bucket: entries that are flagged somewhere and occur at two places; sent back to the units that hold them."""

    def run(table: pa.Table) -> pa.Table:
        units = table.column("unit").to_pylist()
        got = [_received(d, kind) for d in table.column("data").to_pylist()]
        rest = np.concatenate([g[0] for g in got])
        if len(rest) == 0:
            return _sent([], [], [])
        order = _order(rest)
        ordered = rest[order]
        rank = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        inverse = np.empty(len(rest), np.int64)
        inverse[order] = rank
        n = int(rank[-1]) + 1
        anchored = np.bincount(inverse, np.concatenate([g[1] for g in got]), n) > 0
        places = np.bincount(inverse, 1 + np.concatenate([g[2] for g in got]), n)
        hit = (anchored & (places > 1))[inverse]
        out, at = [], 0
        for unit, (r, _, _) in zip(units, got):
            mine = r[hit[at : at + len(r)]]
            at += len(r)
            if len(mine):
                out.append((unit, mine.tobytes()))
        bucket = table.column("bucket")[0].as_py()
        return _sent([u for u, _ in out], [bucket] * len(out), [d for _, d in out])

    return run


def _order(rest: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Sorting order by the entries, then by the arrays in ``more``."""
    if rest.dtype.names or more:
        return np.lexsort((*more, rest["b"], rest["a"]) if rest.dtype.names else (*more, rest))
    return np.argsort(rest)


class Hits:
    """The entries of a unit that are hits, with the buckets they came from; looked up by binary search."""

    def __init__(self, table: pa.Table, kind):
        got = [np.frombuffer(d, kind) for d in table.column("data").to_pylist()]
        rest = np.concatenate(got) if got else np.zeros(0, kind)
        bucket = np.repeat(np.array(table.column("bucket").to_pylist(), np.uint64), [len(g) for g in got])
        order = _order(rest, bucket)
        self.rest, self.bucket = rest[order], bucket[order]
        self.first = np.ascontiguousarray(self.rest["a"] if rest.dtype.names else self.rest)
        starts = np.flatnonzero(np.append(True, self.first[1:] != self.first[:-1])) if len(rest) else np.zeros(0, np.int64)
        self.most = int(np.diff(np.append(starts, len(rest))).max()) if len(rest) else 0

    def __len__(self) -> int:
        return len(self.rest)

    def may_have(self, first: np.ndarray) -> np.ndarray:
        """Whether some hit starts with this number."""
        if not len(self.first):
            return np.zeros(len(first), bool)
        return self.first[np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)] == first

    def has(self, bucket: np.ndarray, rest: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, rest["a"] if rest.dtype.names else rest)
        out = np.zeros(len(rest), bool)
        for k in range(self.most):  # entries of different buckets may agree; hardly ever more than two
            i = np.minimum(at + k, len(self.rest) - 1)
            same = self.first[i] == (rest["a"] if rest.dtype.names else rest)
            if rest.dtype.names:
                same &= self.rest["b"][i] == rest["b"]
            out |= same & (self.bucket[i] == bucket)
        return out


def _low(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(_HASH)


def _entries(rolled: np.ndarray, digest: np.ndarray) -> np.ndarray:
    out = np.empty(len(rolled), _DIGEST)
    out["a"], out["b"] = rolled, digest
    return out


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, spans, kept_sha256``.

    ``spans`` lists the repeated word ranges as [first, end); the words outside are kept.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = partitions(spark)
    units, buckets = UNITS_PER_PARTITION * parts, parts
    block = (window + 1) // 2
    ident = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.pmod(F.xxhash64(F.col(doc_id), F.octet_length(F.col(text))), F.lit(units)).alias("unit"),
    ).repartition(parts, "unit")

    def probe(table: pa.Table) -> pa.Table:
        """All rolling windows of a unit; the flag says that the window is a reference block."""
        unit = table.column("unit")[0].as_py()
        words = Words(table.column("text").to_pylist())
        places, h = words.rolling(block)
        start = np.repeat(words.starts, words.ends - words.starts)[places]
        return _send(unit, h & np.uint64(0xFFFFFFFF), _low(h), (places - start) % block == 0, buckets)

    def extend(table: pa.Table, found: pa.Table) -> pa.Table:
        """The runs of ``window`` words around a unit's hits."""
        if table.num_rows == 0 or found.num_rows == 0:
            return _sent([], [], [])
        hits, unit = Hits(found, _HASH), table.column("unit")[0].as_py()
        words = Words(table.column("text").to_pylist())
        places, h = words.rolling(block)
        on = np.zeros(len(words.hashes) + 1, np.int64)
        on[places + 1] = hits.has((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets), _low(h))
        before = np.cumsum(on)
        runs, rolled = words.rolling(window)
        near = before[runs + window - block + 1] > before[runs]
        runs, rolled = runs[near], rolled[near]
        entries = _entries(rolled, words.digests(runs, window))
        return _send(unit, rolled & np.uint64(0xFFFFFFFF), entries, np.ones(len(entries), np.uint8), buckets)

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        """Word ranges of a unit's documents that are covered by repeated runs."""
        repeats = Hits(found, _DIGEST)
        words = Words(table.column("text").to_pylist())
        edge = np.zeros(len(words.hashes) + 1, np.int64)
        if len(repeats):
            runs, rolled = words.rolling(window)
            maybe = repeats.may_have(rolled)
            runs, rolled = runs[maybe], rolled[maybe]
            runs = runs[repeats.has((rolled & np.uint64(0xFFFFFFFF)) % np.uint64(buckets), _entries(rolled, words.digests(runs, window)))]
            np.add.at(edge, runs, 1)
            np.add.at(edge, runs + window, -1)
        every = np.cumsum(edge) > 0
        out = []
        for i, own, a, b in zip(table.column("doc_id").to_pylist(), words.texts, words.starts.tolist(), words.ends.tolist()):
            covered = every[a:b]
            change = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
            kept = b" ".join([w for w, c in zip(own.split(), covered.tolist()) if not c]) if len(change) else own
            out.append((i, b - a, int(covered.sum()), change.reshape(-1, 2).tolist(), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) or [[]] * 5
        return pa.table({
            "doc_id": pa.array(columns[0], table.schema.field("doc_id").type), "n_words": pa.array(columns[1], pa.int64()),
            "n_removed": pa.array(columns[2], pa.int64()), "spans": pa.array(columns[3], pa.list_(pa.list_(pa.int64()))),
            "kept_sha256": pa.array(columns[4], pa.string()),
        })

    def back(sent: DataFrame, kind) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(_match(kind), SENT_DDL)

    by_unit = rows.groupBy("unit")
    hits = back(by_unit.applyInArrow(probe, SENT_DDL), _HASH)
    runs = back(by_unit.cogroup(hits.groupBy("unit")).applyInArrow(extend, SENT_DDL), _DIGEST)
    return by_unit.cogroup(runs.groupBy("unit")).applyInArrow(
        cut, f"doc_id {ident}, n_words bigint, n_removed bigint, spans array<array<bigint>>, kept_sha256 string"
    )
