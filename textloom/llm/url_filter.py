"""URL verdicts from path rules and a Bloom filter cascade.

The cascade holds a list of keys exactly for every key of the corpus. Level 1 is a Bloom filter of the listed keys; level 2
holds the unlisted keys of the corpus that pass level 1; level 3 the listed keys that pass level 2; and so on, until no key
passes by mistake. A key is looked up level by level: the first level that does not hold it decides. The levels are
bit maps in one small array each, so urls are judged where they are read, without a join or a shuffle.

Rules come first: a rule ``host/path`` fits its host and all subdomains if the url's path starts with its path; the longest
rule wins (the longer host among rules of equal length). A null url, or one without ``://``, has an empty host and path: no rule
fits, and the empty key is looked up like any other. Repeated rows are judged alike. Extra columns are kept by ``judge``.
DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_set, bit_words, saved

# Bound of all levels together: they go to every task. About 50 million listed keys; more are refused with an error.
MAX_BYTES = 64 << 20
MAX_LEVELS = 128


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    at = F.locate("://", F.col(url))
    after = F.substring(F.col(url), at + 3, F.length(url))
    raw = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(raw) + 1, F.length(url)), "^[^?#]*", 0)
    known = F.coalesce(at > 0, F.lit(False))
    host = F.translate(raw, ascii_uppercase, ascii_lowercase)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


@dataclass
class Cascade:
    """Levels from first to last: the number of hashes, the bits and the one-row table of the bit map."""

    levels: list[tuple[int, int, DataFrame]] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        """Exact membership of a key of the universe."""
        result = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            hashes, bits, words = self.levels[i - 1]
            passes = _in_level(key, i, hashes, bits, words)
            result = F.when(passes, result).otherwise(F.lit(i % 2 == 0))
        return result


def _slot(key: Column, level: int, number: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(number)), F.lit(bits))


def _in_level(key: Column, level: int, hashes: int, bits: int, words: DataFrame) -> Column:
    tests = [bit_set(words.scalar(), _slot(key, level, j, bits)) for j in range(hashes)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Number of hashes and bits (a multiple of 64) for ``n`` keys at a false positive rate."""
    bits = 64 * max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
    return max(1, min(16, round(math.log2(1 / rate)))), bits


def build(keys: DataFrame) -> Cascade:
    """Cascade of ``keys(key, listed)``: the complete universe of keys, each with whether it is listed.

    Its size follows the list and only the logarithm of the universe: the first level lets through about as many
    unlisted keys as are listed, each later one half.
    """
    universe = saved(keys.groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    held, others = universe.where("listed").select("key"), universe.where(~F.col("listed")).select("key")
    n, rest = held.count(), others.count()
    rate = min(0.5, max(1e-6, math.sqrt(0.5) * n / max(1, rest)))
    cascade, total = Cascade(), 0
    while n:
        level = len(cascade.levels) + 1
        if level > MAX_LEVELS:
            raise RuntimeError(f"the cascade did not close in {MAX_LEVELS} levels")
        hashes, bits = _shape(n, rate)
        total += bits // 8
        if total > MAX_BYTES:
            raise ValueError(f"the cascade takes over {MAX_BYTES} bytes; split the list")
        slots = held.select(F.explode(F.array(*[_slot(F.col("key"), level, j, bits) for j in range(hashes)])).alias("slot"))
        words = saved(bit_words(slots, bits), "level")
        cascade.levels.append((hashes, bits, words))
        wrong = saved(others.where(_in_level(F.col("key"), level, hashes, bits, words)), "passed")
        held, others = wrong, held
        n, rate = held.count(), 0.5
    return cascade


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that fits, like ``org/`` (else null), and its verdict. ``rules`` are ``(rule, verdict)``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    split = lambda r: (r[: r.index("/")], r[r.index("/") :])
    for text, says in sorted(rules, key=lambda r: (len(r[0]), len(split(r[0])[0]))):
        own, start = split(text)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, cascade: Cascade, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``."""
    host, path = host_and_path(url)
    parts = pages.withColumns({"host": host, "path": path})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    listed = F.when(cascade.holds(F.col("host")), "block").otherwise("allow")
    return parts.withColumns({"rule": rule, "verdict": F.coalesce(says, listed)})


def listed_hosts(pages: DataFrame, labels: Sequence[str], url: str = "url") -> DataFrame:
    """The corpus's key universe ``(key, listed)``: every host, listed if one of its labels is on the list."""
    host, _ = host_and_path(url)
    hosts = pages.select(host.alias("key")).distinct()
    return hosts.select("key", F.arrays_overlap(F.split("key", "[.]"), F.array(*[F.lit(x) for x in labels])).alias("listed"))
