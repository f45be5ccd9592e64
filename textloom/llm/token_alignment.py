"""Alignment of two tokenizers' tokens by pointer jumping.

``A`` is a byte-level file of the tokenizers library, ``B`` a sentencepiece model that puts a space before a text; both encode a text
with that space. Every token points to the farthest-right token that overlaps it; a token that ends where one of the other
side ends is the last of its group. Doubling the pointers, ``p = p[p]`` over whole arrays, takes every token to the last one of
its component in a logarithmic number of steps, and that one labels the group.

A text is cut before each space that follows no white space. No token of either kind reaches across such a place, so both
end there and groups never do: tokens, groups and links of a text are those of its parts, and a part seen before is not
encoded or aligned again. The memory of parts is bounded, long parts are not remembered.

A link is a pair of tokens, one of each side, that end together. One of them is then a suffix of the other, so two vocabularies have
a fixed number of possible pairs (``possible_pairs``: 324,297 for the public files), whatever the corpus. Counts of pairs are
summed per task, then by shuffle; they go to the tasks in blocks of at most ``PAIRS`` pairs.

A null or empty text, and one that either side does not give back byte for byte, has no tokens: zeros and an empty
digest. Repeated rows and ids, and null ids, each get their own row. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, saved

PAIRS = 2_000_000
REMEMBERED = 200_000  # parts, in each of two generations
LONG_PART = 64
SPACE = "▁"
_CUT = re.compile(r"(?<!\s)(?= )")
_SPACE_RUN = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level files write bytes: printable ones are themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens; an empty entry stands for a token that no text gives."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, special = byte_letters(), self.a.get_added_tokens_decoder()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [b"" if i in special or not all(c in letters for c in t) else bytes(letters[c] for c in t) for i, t in enumerate(names)]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            odd = self.b.is_control(i) or self.b.is_unknown(i)
            self.b_bytes.append(b"" if odd else bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.alone = self.b.piece_to_id(SPACE)
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of parts that start with a space, on both sides."""
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in parts], num_threads=1)
        return a, [[self.alone] if p == " " else ids for p, ids in zip(parts, b)]

    def gives_back(self, part: str, a: list[int], b: list[int]) -> bool:
        raw = part.encode()
        return b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])


def last_of_group(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For tokens of A, then of B, given by increasing ends: the number of their group's last token of B.

    Both sides must end together.
    """
    n = len(a_ends)
    itself = np.arange(n, n + len(b_ends))
    over_a = np.searchsorted(a_ends, b_ends)  # the token that holds the last byte reaches farthest
    to = np.concatenate([n + np.searchsorted(b_ends, a_ends), np.where(a_ends[over_a] == b_ends, itself, over_a) if n else itself])
    while True:
        twice = to[to]
        if np.array_equal(twice, to):
            return to - n
        to = twice


class Aligner:
    """``align(texts)``: tokens, groups and links of texts."""

    def __init__(self, a_path: str, b_path: str):
        self.tokenizers = Tokenizers(a_path, b_path)
        self.radix = len(self.tokenizers.b_bytes)
        self.code = np.int32 if len(self.tokenizers.a_bytes) * self.radix < 1 << 31 else np.int64
        self.now: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def learn(self, parts: list[str]) -> dict[str, tuple]:
        """``(tokens of A, tokens of B, groups, links, groups as text)`` of each part, ``None`` for parts that are not given back."""
        t = self.tokenizers
        a, b = t.encode(parts)
        good = [k for k, p in enumerate(parts) if t.gives_back(p, a[k], b[k])]
        out: dict[str, tuple | None] = dict.fromkeys(parts)
        if not good:
            return out
        a_ids, b_ids = (np.concatenate([np.array(x[k], np.int64) for k in good]) for x in (a, b))
        a_ends, b_ends = np.cumsum(t.a_size[a_ids]), np.cumsum(t.b_size[b_ids])
        last = last_of_group(a_ends, b_ends)
        a_stops = np.flatnonzero(np.diff(last[: len(a_ids)], append=-1)) + 1
        b_stops = np.flatnonzero(np.diff(last[len(a_ids) :], append=-1)) + 1
        codes = (a_ids[a_stops - 1] * self.radix + b_ids[b_stops - 1]).astype(self.code)
        part_ends = np.cumsum([len(parts[k].encode()) for k in good])
        groups_to = np.searchsorted(b_ends[b_stops - 1], part_ends, side="right").tolist()
        a_text, b_text = [*map(str, a_ids.tolist())], [*map(str, b_ids.tolist())]
        texts, a_from, b_from = [], 0, 0
        for a_to, b_to in zip(a_stops.tolist(), b_stops.tolist()):
            texts.append(",".join(a_text[a_from:a_to]) + "|" + ",".join(b_text[b_from:b_to]))
            a_from, b_from = a_to, b_to
        at = 0
        for k, to in zip(good, groups_to):
            out[parts[k]] = len(a[k]), len(b[k]), to - at, codes[at:to].tobytes(), ";".join(texts[at:to])
            at = to
        return out

    @staticmethod
    def parts(text: str) -> list[str]:
        text = " " + text
        if _SPACE_RUN.search(text):
            return [p for p in _CUT.split(text) if p]
        return [" " + p for p in text[1:].split(" ")]

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, bytes, str]]:
        """For each text; without tokens ``(0, 0, 0, b"", "")``."""
        cut = [self.parts(t) if t else [] for t in texts]
        new = {p for parts in cut for p in parts if p not in self.now}
        again = {p: self.old[p] for p in new if p in self.old}
        if len(self.now) > REMEMBERED:
            again |= {p: self.now[p] for parts in cut for p in parts if p in self.now}
            self.old, self.now = self.now, {}
        self.now.update(again)
        new = [p for p in new if p not in again]
        long = {}
        for at in range(0, len(new), 4096):
            found = self.learn(new[at : at + 4096])
            self.now.update((p, v) for p, v in found.items() if len(p) <= LONG_PART)
            long |= {p: v for p, v in found.items() if len(p) > LONG_PART}
        for parts in cut:
            try:
                found = [self.now[p] for p in parts]
            except KeyError:
                found = [self.now[p] if p in self.now else long[p] for p in parts]
            if not found or None in found:
                yield 0, 0, 0, b"", ""
                continue
            a, b, groups, codes, as_text = zip(*found)
            yield sum(a), sum(b), sum(groups), b"".join(codes), ";".join(as_text)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker and pair of files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def possible_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> int:
    """How many pairs of tokens can end together: one is a suffix of the other."""
    total = 0
    for short, long, equal in ((a_bytes, b_bytes, True), (b_bytes, a_bytes, False)):
        have: dict[bytes, int] = {}
        for t in short:
            have[t] = have.get(t, 0) + 1
        total += sum(have.get(t[k:], 0) for t in long for k in range(0 if equal else 1, len(t)))
    return total


def align(
    docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", groups: bool = True,
) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups``, its ``links`` (``a * size of B + b``), ``groups_sha256`` and, if asked for,
    the ``groups`` themselves: ``a1,a2|b1;a3|b2,b3``.
    """
    bound_batches(docs.sparkSession)
    code = "int" if aligner(a_path, b_path).code is np.int32 else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        kind = pa.from_numpy_dtype(own.code)
        for b in batches:
            texts = b.column(1).to_pylist()
            counts, codes, digests, shown = [], [], [], []
            for n_a, n_b, n_groups, links, as_text in own.align(texts):
                counts.append((n_a, n_b, n_groups))
                codes.append(links)
                digests.append(hashlib.sha256(as_text.encode()).hexdigest() if as_text else "")
                if groups:
                    shown.append(as_text)
            flat = np.frombuffer(b"".join(codes), own.code)
            offsets = np.concatenate([[0], np.cumsum([len(c) // flat.itemsize for c in codes])])
            numbers = np.array(counts, np.int64).reshape(-1, 3).T
            links = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
            columns = [b.column(0), *map(pa.array, numbers), links, pa.array(digests, pa.string())] + [pa.array(shown, pa.string())] * groups
            names = ["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"] + ["groups"] * groups
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ident = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {ident}, n_a bigint, n_b bigint, n_groups bigint, links array<{code}>, groups_sha256 string" + ", groups string" * groups
    return rows.mapInArrow(run, ddl)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(link, n)``: how often each pair of ids is linked in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # at most all possible pairs
        held, size = [], 0

        def merge() -> None:
            nonlocal known, n, held, size
            here, many = np.unique(np.concatenate([known[:0], *held]), return_counts=True)
            both, at = np.unique(np.concatenate([known, here]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([n, many]))
            known, n, held, size = both, total, [], 0

        for b in batches:
            held.append(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            size += len(held[-1])
            if size > 1 << 20:
                merge()
        merge()
        for at in range(0, len(known), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(known[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], names=["link", "n"])

    return aligned.select("links").mapInArrow(run, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("n"))


def scored(aligned: DataFrame, counts: DataFrame, radix: int) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` and ``count_sum`` from the counts of all pairs; ``radix`` is the size of B."""
    spark = aligned.sparkSession
    b = F.col("link") % radix
    best = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    known = saved(counts.withColumn("b", b).join(best, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    blocks = -(-known.count() // PAIRS) or 1
    rows = aligned.withColumns({"n_best": F.lit(0).cast("bigint"), "count_sum": F.lit(0).cast("bigint")})
    for k in range(blocks):
        here = known.where(F.pmod(F.xxhash64("link"), F.lit(blocks)) == k).orderBy("link").toArrow()
        shared = spark.sparkContext.broadcast([c.to_numpy() for c in here.columns])
        rows = _with_block(rows, shared)
        if k + 1 < blocks:
            rows = saved(rows, "scored")
    return rows.withColumn("n_links", F.size("links").cast("bigint"))


def _with_block(rows: DataFrame, shared) -> DataFrame:
    links_at, best_at, sum_at = (rows.columns.index(c) for c in ("links", "n_best", "count_sum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for b in batches:
            links = b.column(links_at)
            flat = links.flatten().to_numpy(zero_copy_only=False)
            stops = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))])
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            columns = list(b.columns)
            for place, values in ((best_at, best), (sum_at, n)):
                each = np.where(hit, values[at], 0) if len(known) else np.zeros(len(flat), np.int64)
                total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
                columns[place] = pa.array(b.column(place).to_numpy() + np.diff(total[stops]))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def report(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its tokens, groups and links, and how common its links are in the corpus."""
    aligned = saved(align(docs, a_path, b_path, doc_id, text, groups=False), "aligned")
    counts = saved(pair_counts(aligned), "pair-counts")
    found = scored(aligned, counts, aligner(a_path, b_path).radix)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
