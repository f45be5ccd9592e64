"""Helpers that several corpus operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, BATCH_ROWS, bound_batches, scratch_path  # noqa: F401 - used by the operators

WORD = "[^\\x20\\x09-\\x0D]+"

def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets the optimizer know the table's size,
    so that Spark broadcasts it only where its files are below the broadcast threshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions, which the session sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_words(slots: DataFrame, bits: int) -> DataFrame:
    """One row ``(words)``: the bit map of ``slots(slot)`` as an array of ``bits / 64`` numbers."""
    set_words = slots.groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("word_bits")
    )
    zeros = slots.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("word_bits"))
    dense = set_words.unionByName(zeros).groupBy("word").agg(F.bit_or("word_bits").alias("word_bits"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("word", "word_bits"))).getField("word_bits").alias("words"))


def bit_set(words: Column, slot: Column) -> Column:
    """Whether bit ``slot`` of a bit map is set."""
    word = F.get(words, F.floor(slot / 64).cast("int"))
    return F.getbit(word, F.pmod(slot, F.lit(64))) == 1


def or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` cuts at exactly these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def joined(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by one space, with the byte offsets at which each starts and ends."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit numbers (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    LIMIT = 500_000

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
