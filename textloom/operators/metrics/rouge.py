"""ROUGE-1, ROUGE-2, ROUGE-L, ROUGE-Lsum and their bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
import sys
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ...functions.text import rouge_text
from .classification import ratio
from .overlap import Scheme, ngram_overlap

LINE_SPLIT = "\n"

# Ship the helpers below with the job, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def f_measure(hits: Column, hyp: Column, ref: Column) -> Column:
    """F1 of hits over the hypothesis and the reference size; 0 when either is empty."""
    p, r = ratio(hits, hyp), ratio(hits, ref)
    return ratio(2 * p * r, p + r)


def _columns_of(tokens: Sequence[str]) -> dict[str, int]:
    """Bit set of the positions of every token."""
    where: dict[str, int] = {}
    for i, token in enumerate(tokens):
        where[token] = where.get(token, 0) | (1 << i)
    return where


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence by bit-parallel rows (zero bits mark increments)."""
    if len(a) > len(b):
        a, b = b, a
    full = (1 << len(a)) - 1
    where = _columns_of(a)
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _matched_positions(ref: Sequence[str], where: dict[str, int], width: int) -> list[int]:
    """Reference positions of one LCS with a line of ``width`` tokens, walking back from the end.

    ``where`` has the bit set of every token of that line. On unequal tokens the walk goes left
    only if the left value is larger than the upper one; the value at (i, j) is the number of
    zero bits among the first j of row i. A reference token the line does not hold repeats the
    row above it, so the walk always passes it upwards and it can be left out.
    """
    kept = [(i, where[token]) for i, token in enumerate(ref) if token in where]
    if len(kept) < 2:
        return [i for i, _ in kept]
    row = full = (1 << width) - 1
    rows = [row]
    for _, bits in kept:
        hit = row & bits
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, upto, found = len(kept), full, []
    while i and upto:
        at, bits = kept[i - 1]
        shorter = upto >> 1
        if bits & (upto ^ shorter):
            found.append(at)
            i, upto = i - 1, shorter
        elif (~rows[i] & shorter).bit_count() > (~rows[i - 1] & upto).bit_count():
            upto = shorter
        else:
            i -= 1
    return found


def _matched_by_line(line: Sequence[str], where: dict[str, int], width: int) -> list[int]:
    """:func:`_matched_positions` of a reference line, from the bit sets of its ``width`` tokens: one step for each token of the other ``line``.

    At a token the walk goes up to the last position before it that holds the token, or where the row counts one more; there it
    takes the position, or goes left.
    """
    row = full = (1 << width) - 1
    rows = []
    for token in line:
        bits = where.get(token, 0)
        hit = row & bits
        if hit:
            row = ((row + hit) | (row - hit)) & full
        rows.append((bits, bits | (row ^ full)))
    upto, found = full, []
    for bits, stops in reversed(rows):
        at = (stops & upto).bit_length()
        if not at:
            break
        upto = (1 << at) - 1
        if bits >> (at - 1) & 1:
            found.append(at - 1)
            upto >>= 1
    return found


def union_hits(ref_lines: list[list[str]], hyp_lines: list[list[str]]) -> int:
    """Summary-level hits: per reference line the union of its LCS with every hypothesis line.

    A position can only be matched by a line that holds its token. So the lines are looked up
    by token, rare tokens first, and a position already matched asks for no further line. A
    token counts at most as often as the hypothesis has it.
    """
    if len(ref_lines) == 1 and len(hyp_lines) == 1:
        return lcs_length(ref_lines[0], hyp_lines[0])
    available = Counter(token for line in hyp_lines for token in line)
    places = [_columns_of(line) for line in hyp_lines]
    holders: dict[str, list[int]] = {}
    for n, where in enumerate(places):
        for token in where:
            holders.setdefault(token, []).append(n)
    matched: Counter = Counter()
    for line in ref_lines:
        union: set[int] = set()
        seen: set[int] = set()
        held, own = [holders.get(token, ()) for token in line], _columns_of(line)
        for i in sorted(range(len(line)), key=[len(h) for h in held].__getitem__):
            for n in held[i]:
                if i in union:
                    break
                if n not in seen:
                    seen.add(n)
                    if len(hyp_lines[n]) < len(line):  # the same positions, in fewer steps
                        union.update(_matched_by_line(hyp_lines[n], own, len(line)))
                    else:
                        union.update(_matched_positions(line, places[n], len(hyp_lines[n])))
        matched.update(line[i] for i in union)
    return sum(min(n, available[token]) for token, n in matched.items())


@F.arrow_udf(LongType())
def lcs_of_texts(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """LCS length of two texts already normalised to space-separated tokens."""
    return pa.array([lcs_length(h.split(), r.split()) for h, r in zip(hyp.to_pylist(), ref.to_pylist())], pa.int64())


@F.arrow_udf(LongType())
def union_hits_of_lines(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """Summary-level hits of two arrays of normalised lines."""
    split = lambda lines: [line.split() for line in lines]
    return pa.array([union_hits(split(r), split(h)) for h, r in zip(hyp.to_pylist(), ref.to_pylist())], pa.int64())


def lines(text: Column) -> Column:
    """Non-empty lines, each normalised."""
    kept = F.filter(F.split(text, LINE_SPLIT), lambda s: s != "")
    return F.transform(kept, rouge_text)


def rouge_rows(
    df: DataFrame, *, id_col: str = "id", hyp: str = "hyp", label: str = "label",
    kinds: Sequence[str] = ("ROUGE1", "ROUGE2", "ROUGEL", "ROUGELsum"), method: str = "row",
) -> DataFrame:
    """F measures per row (fractions)."""
    schemes = {"r": Scheme(rouge_text, tuple(n for n in (1, 2) if f"ROUGE{n}" in kinds))}
    counts = ngram_overlap(
        df, schemes, id_col=id_col, hyp=hyp, label=label, extra=lcs_columns(kinds), method=method
    )
    fields = scores_of("r")
    return counts.select("id", *[fields[k].alias(k) for k in kinds])


def lcs_columns(kinds: Sequence[str], hyp: str = "_hyp", label: str = "_label") -> dict[str, Column]:
    out = {}
    if "ROUGEL" in kinds:
        out["lcs"] = lcs_of_texts(rouge_text(F.col(hyp)), rouge_text(F.col(label)))
    if "ROUGELsum" in kinds:
        out["union_lcs"] = union_hits_of_lines(lines(F.col(hyp)), lines(F.col(label)))
    return out


def scores_of(scheme: str) -> dict[str, Column]:
    """F measure columns over the counts of ``scheme``."""
    hyp, ref = F.col(f"{scheme}_hyp"), F.col(f"{scheme}_ref")
    grams = lambda size, n: F.greatest(size - (n - 1), F.lit(0))
    hits = {
        "ROUGE1": (f"{scheme}_m1", 1), "ROUGE2": (f"{scheme}_m2", 2),
        "ROUGEL": ("lcs", 1), "ROUGELsum": ("union_lcs", 1),
    }
    return {k: f_measure(F.col(h), grams(hyp, n), grams(ref, n)) for k, (h, n) in hits.items()}


def rouge(df: DataFrame, *, kinds: Sequence[str] = ("ROUGE1", "ROUGE2", "ROUGEL", "ROUGELsum"), **columns) -> DataFrame:
    """One row: mean F times 100 per kind."""
    rows = rouge_rows(df, kinds=kinds, **columns)
    return rows.agg(*[(F.avg(k) * 100).alias(k) for k in kinds])


PRIME = (1 << 31) - 1


def poisson_steps(terms: int = 16) -> list[int]:
    """Where the Poisson(1) count of a number below ``PRIME`` goes up by one, by its distribution function."""
    total, steps = 0.0, []
    for k in range(terms):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(int(total * PRIME))
    return steps


def replicate_numbers(replicate: int, seed: int) -> tuple[int, int, int]:
    """Factor, summand and second factor of a replicate, from an MD5 digest."""
    digest = hashlib.md5(f"{seed}:{replicate}".encode()).hexdigest()
    first, second, third = (int(digest[at : at + 8], 16) >> 1 for at in (0, 8, 16))
    return first % (PRIME - 1) + 1, second % PRIME, third % (PRIME - 1) + 1


def row_key(id_col: str) -> Column:
    """31 bits of the id's MD5 digest."""
    digest = F.substring(F.md5(F.col(id_col).cast("string")), 1, 8)
    return F.shiftright(F.conv(digest, 16, 10).cast("bigint"), 1) % PRIME


def weights(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(1) counts, rows by replicates: a universal hash of the row's key under the replicate's numbers, mixed once more."""
    x = (keys[:, None] * replicates[0] + replicates[1]) % PRIME
    x = ((x ^ (x >> 15)) * replicates[2]) % PRIME
    return np.searchsorted(np.array(poisson_steps()), x, side="right")


def bootstrap(
    rows: DataFrame, kinds: Sequence[str], *, id_col: str = "id", replicates: int = 1000, seed: int = 0,
) -> DataFrame:
    """Low, mid and high (2.5, 50, 97.5 %) of the resampled means: ``(metric, low, mid, high)``.

    A row enters a replicate with a Poisson(1) weight that depends on its id, the replicate and the seed only. No row is
    copied: a batch of rows makes a matrix of weights, whose product with the values is added up per task. What is
    shuffled is one sum per task and replicate.
    """
    numbers = np.array([replicate_numbers(r, seed) for r in range(1, replicates + 1)], np.int64).T.reshape(3, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros((len(kinds), replicates)), np.zeros(replicates, np.int64)
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.array([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(kinds))], float).reshape(len(kinds), -1)
            for at in range(0, len(keys), 500):
                w = weights(keys[at : at + 500], numbers)
                sums += np.nan_to_num(values[:, at : at + 500]) @ w
                total += w.sum(axis=0)
        columns = [pa.array(np.arange(1, replicates + 1, dtype=np.int64)), pa.array(total), *map(pa.array, sums)]
        yield pa.RecordBatch.from_arrays(columns, names=["rep", "w", *kinds])

    keyed = rows.select(row_key(id_col).alias("key"), *[F.col(k).cast("double").alias(k) for k in kinds])
    parts = keyed.mapInArrow(run, "rep bigint, w bigint, " + ", ".join(f"`{k}` double" for k in kinds))
    means = parts.groupBy("rep").agg(*[(F.try_divide(F.sum(k), F.sum("w")) * 100).alias(k) for k in kinds])
    long = means.unpivot([], list(kinds), "metric", "mean")
    # percentile() holds at most one value per replicate here.
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return long.groupBy("metric").agg(q.alias("q")).select(
        "metric", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high")
    )
