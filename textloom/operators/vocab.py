"""Vocabulary tables: build, encode, decode, embedding coverage."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.arrays import empty
from ..session import bound_batches, shuffle_partitions, written
from . import ordering

# The functions travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Special tokens appended after the last vocabulary id, in this order (fixed values).
SPECIAL_TOKENS = ["<bos>", "<|endoftext|>", "<speaker1>", "<speaker2>", "<pad>", "<cls>", "<sep>"]

BROADCAST_BYTES = 32 << 20
HOT_WORDS = 1000
HOT_BYTES = 256
TRACKED = 20_000
ASIDE = 4096


def build_vocab(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """Distinct tokens with dense ids from 0 in token order."""
    distinct = tokens.select(F.col(token_col).alias("token")).distinct()
    return ordering.running_sum(distinct, ["token"], out="token_id")


def add_special_tokens(vocab: DataFrame, specials: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """Append the special tokens with ids n, n+1, ...; n is the vocabulary size."""
    size = vocab.agg(F.count(F.lit(1)).alias("n"))
    rows = size.select(
        F.posexplode(F.array(*[F.lit(s) for s in specials])).alias("pos", "token"), "n"
    ).select("token", (F.col("n") + F.col("pos")).alias("token_id"))
    return vocab.select("token", "token_id").unionByName(rows)


def duplicate_entries(vocab: DataFrame) -> DataFrame:
    """Tokens or ids that break the one-to-one rule; empty for a valid vocabulary."""
    by_token = vocab.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("token").alias("kind"), F.col("token").alias("entry"), "n"
    )
    by_id = vocab.groupBy("token_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("token_id").alias("kind"), F.col("token_id").cast("string").alias("entry"), "n"
    )
    return by_token.unionByName(by_id)


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def table_bytes(vocab: DataFrame, *columns: str) -> int:
    """Size of a table's text and numbers, counted before it is broadcast."""
    width = sum((F.octet_length(F.col(c).cast("string")) + 16 for c in columns), F.lit(0))
    return vocab.agg(F.sum(width.cast("bigint")).alias("n")).first()["n"] or 0


def frequent_entries(elements: DataFrame, key: str, most: int = HOT_WORDS) -> DataFrame:
    """``(key)``: the most frequent entries by a mergeable summary, in one pass and with bounded memory.

    An entry whose share of all elements is above ``3.5 / TRACKED`` is never missed by the summary; which of the rarer ones are
    named is open. Long entries are left out, so the result has at most ``most * HOT_BYTES`` bytes.
    """
    short = elements.where(F.octet_length(F.col(key).cast("string")) <= HOT_BYTES)
    top = short.agg(F.expr(f"approx_top_k({key}, {most}, {TRACKED})").alias("top"))
    return top.select(F.explode("top.item").alias(key))


def _lookup(rows: DataFrame, vocab: DataFrame, key: str, value: str, spread: Column) -> DataFrame:
    """Left join of every element with a vocabulary too large to broadcast.

    A few words make up most of any text, so the frequent ones are looked up in a broadcast of bounded size first. Their
    rows, and null elements, take a spread key through the shuffle. The summary only decides which way a row goes, never its value.
    """
    vocab = vocab.select(F.col(key), F.col(value))
    hot = frequent_entries(rows, key).join(vocab, key).select(key, F.col(value).alias("_hot"))
    aside = F.concat(F.lit("\0"), F.pmod(F.hash(spread), F.lit(ASIDE)).cast("string"))
    route = F.coalesce(F.when(F.col("_hot").isNull(), F.col(key).cast("string")), aside)
    return (
        rows.join(F.broadcast(hot), key, "left").withColumn("_key", route)
        .join(vocab.select(F.col(key).cast("string").alias("_key"), F.col(value).alias("_cold")), "_key", "left")
        .withColumn(value, F.coalesce("_hot", "_cold"))
        .drop("_key", "_hot", "_cold")
    )


def _found_in_batch(
    arrays: list[pa.Array], keys: pa.Array, values: pa.Array, unknown=None, texts: pa.Array | None = None,
) -> tuple[list[pa.Array], pa.Array]:
    """Arrays with every element replaced, and for each row the last element that has no value, by its text in ``texts`` if given.

    Where one array is null all are empty.
    """
    size = len(arrays[0])
    full = np.logical_and.reduce([a.is_valid().to_numpy(zero_copy_only=False) for a in arrays])
    out, missing = [], np.full(size, None, object)
    for a in arrays:
        a = a if full.all() else a.take(pa.array(np.arange(size), mask=~full))
        sizes = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
        code = a.flatten().dictionary_encode()
        at = pc.index_in(code.dictionary, value_set=keys)
        found = values.take(at)
        mapped = found.take(code.indices)
        if found.null_count:
            lost = np.flatnonzero(pc.fill_null(found.is_null().take(code.indices), False).to_numpy(zero_copy_only=False))
            names = code.dictionary.cast(pa.string()) if texts is None else texts.take(at)
            missing[np.repeat(np.arange(size), sizes)[lost]] = names.take(code.indices.take(pa.array(lost))).to_pylist()
        if unknown is not None:
            mapped = mapped.fill_null(unknown)
        out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), mapped))
    return out, pa.array(missing, pa.string())


def _by_broadcast(
    df: DataFrame, id_col: str, arrays: dict[str, Column], table: pa.Table, kind: str, on_unknown: str, unknown, keep: Sequence[str],
) -> DataFrame:
    """:func:`map_arrays` with a vocabulary of bounded size: rows stay whole, a batch of them is looked up at once."""
    spark, n = df.sparkSession, len(arrays)
    rows = df.select(
        F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
        *[a.alias(f"_array{i}") for i, a in enumerate(arrays.values())], F.monotonically_increasing_id().alias("_row"),
    ).repartition(shuffle_partitions(spark), "_row").drop("_row")
    shared = spark.sparkContext.broadcast([c.combine_chunks() for c in table.columns])
    fill = {"bigint": int, "string": str}[kind](unknown) if on_unknown == "unk" and unknown is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for b in batches:
            if b.num_rows:
                mapped, missing = _found_in_batch(b.columns[-n:], keys, values, fill)
                yield pa.RecordBatch.from_arrays([*b.columns[:-n], *mapped, missing], names=[*b.schema.names, "_missing"])

    bound_batches(spark)
    return _checked(rows.mapInArrow(run, _mapped_schema(rows, n, kind)), id_col, arrays, kind, on_unknown, keep)


def _mapped_schema(rows: DataFrame, n: int, kind: str, behind: int = 0) -> StructType:
    """The columns of ``rows`` before their ``n`` arrays (and ``behind`` columns at the end), arrays of ``kind`` and the missing entry."""
    wanted = ArrayType({"bigint": LongType(), "string": StringType()}[kind])
    held = rows.schema.fields[: len(rows.columns) - n - behind]
    return StructType([*held, *[StructField(f"_array{i}", wanted) for i in range(n)], StructField("_missing", StringType())])


def _checked(found: DataFrame, id_col: str, arrays: dict[str, Column], kind: str, on_unknown: str, keep: Sequence[str]) -> DataFrame:
    checked = F.col
    if on_unknown == "error":
        failed = F.raise_error(F.concat(F.lit("unknown entry: "), F.col("_missing"))).cast(f"array<{kind}>")
        checked = lambda c: F.when(F.col("_missing").isNotNull(), failed).otherwise(F.col(c))
    return found.select(
        F.col("_id").alias(id_col), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        *[checked(f"_array{i}").alias(name) for i, name in enumerate(arrays)],
    )


def _blocks(rows: DataFrame, n: int, entry: DataType) -> DataFrame:
    """``rows``, written once, the rows of one Arrow batch being a ``_block``: their last ``n`` columns, arrays, hold numbers of
    the distinct entries of the block, and its first row has these in ``_entries``.
    """
    bits = ordering.PLACE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << bits
        for i, b in enumerate(batches):
            if not (size := b.num_rows):
                continue
            arrays, coded, at = b.columns[-n:], [], 0
            code = pa.concat_arrays([a.flatten() for a in arrays]).dictionary_encode()
            for a in arrays:
                upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False))])
                coded.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), code.indices.slice(at, upto[-1]), mask=a.is_null()))
                at += int(upto[-1])
            only_first = pa.array(np.arange(size) > 0)
            entries = pa.ListArray.from_arrays(pa.array([0] + size * [len(code.dictionary)], pa.int32()), code.dictionary, mask=only_first)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-n], *coded, pa.array(np.full(size, first + i)), entries], names=[*b.schema.names, "_block", "_entries"]
            )

    bound_batches(rows.sparkSession)
    fields = [*rows.schema.fields[:-n], *[StructField(c, ArrayType(IntegerType())) for c in rows.columns[-n:]]]
    schema = StructType([*fields, StructField("_block", LongType()), StructField("_entries", ArrayType(entry))])
    return written(rows.mapInArrow(run, schema), "elements")


def _by_blocks(
    df: DataFrame, id_col: str, arrays: dict[str, Column], vocab: DataFrame, key: str, value: str, kind: str, on_unknown: str, unknown, keep: Sequence[str],
) -> DataFrame:
    """:func:`map_arrays` with a vocabulary of any size: the distinct entries of each block of rows meet the vocabulary, and their values the rows."""
    n = len(arrays)
    blocks = _blocks(df.select(
        F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
        *[a.alias(f"_array{i}") for i, a in enumerate(arrays.values())],
    ), n, vocab.schema[key].dataType)
    rows, each = blocks.drop("_entries"), blocks.select("_block", F.posexplode("_entries").alias("_code", key))
    values = vocab.select(F.col(key), F.col(value).cast(kind).alias(value))
    lost = F.when(F.col(value).isNull(), F.col(key).cast("string"))
    found = _lookup(each, values, key, value, F.col("_block")).select(F.col("_block").alias("_of"), "_code", F.col(value).alias("v"), lost.alias("lost"))
    fill = {"bigint": int, "string": str}[kind](unknown) if on_unknown == "unk" and unknown is not None else None
    held = rows.columns[: -n - 1]

    def put(block: pa.Table, entries: pa.Table) -> pa.Table:
        block, entries = block.combine_chunks(), entries.combine_chunks()
        whole = lambda c: c.chunk(0) if c.num_chunks else pa.array([], c.type)
        mapped, missing = _found_in_batch(
            [whole(block.column(f"_array{i}")) for i in range(n)], *(whole(entries.column(c)) for c in ("_code", "v")), fill, whole(entries.column("lost")),
        )
        return pa.table([*[block.column(c) for c in held], *mapped, missing], names=[*held, *[f"_array{i}" for i in range(n)], "_missing"])

    together = rows.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(put, _mapped_schema(rows, n, kind, 1))
    return _checked(together, id_col, arrays, kind, on_unknown, keep)


def _repeats_a_key(vocab: DataFrame, key: str) -> bool:
    return not vocab.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _same_types(df: DataFrame, arrays: dict[str, Column], vocab: DataFrame, key: str) -> bool:
    """Whether the elements have the type of the vocabulary's keys."""
    fields = df.select(*arrays.values()).schema.fields
    return all(isinstance(f.dataType, ArrayType) and f.dataType.elementType == vocab.schema[key].dataType for f in fields)


def _slotted(array: Column, slot: int, key: str) -> Column:
    """Array elements with the number of their array and their position."""
    return F.transform(
        array, lambda x, i: F.struct(F.lit(slot).alias("slot"), i.alias("pos"), x.alias(key))
    )


def map_arrays(
    df: DataFrame, id_col: str, arrays: dict[str, Column], vocab: DataFrame, *,
    key: str = "token", value: str = "token_id", broadcast_bytes: int = BROADCAST_BYTES,
    on_unknown: str = "error", unknown=None, keep: Sequence[str] = (),
) -> DataFrame:
    """Replace every array element by its vocabulary value: ``(id, <keep> ..., <name> ...)``, one row per row of ``df``, repeated ids too.

    The columns of ``keep`` travel with a row's first element.

    A vocabulary of at most ``broadcast_bytes`` is broadcast, and rows stay whole: they are dealt out once and looked up a batch at a
    time. If it repeats a key, rows are partitioned by a key of their own before they are exploded, so their values come back
    together with no second shuffle. For a larger one the arrays are written once in blocks of rows. The distinct entries of each
    block are looked up, the frequent ones by a summary and the others by shuffle, and meet their block again.
    ``on_unknown``: ``error``, ``null`` (element kept as null) or ``unk`` (``unknown`` is used).
    """
    kind = "bigint" if value == "token_id" else "string"
    if on_unknown not in ("error", "null", "unk"):
        raise ValueError(f"on_unknown must be error, null or unk, not {on_unknown!r}")
    small = table_bytes(vocab, key, value) <= broadcast_bytes
    if not isinstance(unknown, Column) and _same_types(df, arrays, vocab, key):
        if small:
            table = vocab.select(F.col(key).alias("k"), F.col(value).cast(kind).alias("v")).toArrow()
            keys = table.column("k")
            if keys.null_count == 0 and pc.count_distinct(keys).as_py() == len(keys):
                return _by_broadcast(df, id_col, arrays, table, kind, on_unknown, unknown, keep)
        elif not _repeats_a_key(vocab, key):
            return _by_blocks(df, id_col, arrays, vocab, key, value, kind, on_unknown, unknown, keep)
    tagged = F.concat(*[_slotted(col, slot, key) for slot, col in enumerate(arrays.values())])
    held = [F.struct(*keep).alias("_keep")] if keep else []
    rows = df.select(F.col(id_col), tagged.alias("_elements"), *held).withColumn("_row", F.monotonically_increasing_id())
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    with_first = [F.when(first, F.col("_keep")).alias("_keep")]

    def elements(held: DataFrame) -> DataFrame:
        if not keep:
            return held.select(id_col, "_row", F.explode_outer("_elements").alias("e")).select(id_col, "_row", "e.*")
        each = held.select(id_col, "_row", "_keep", F.posexplode_outer("_elements").alias("_at", "e"))
        return each.select(id_col, "_row", *with_first, "e.*")

    if small:
        joined = elements(rows.repartition(shuffle_partitions(df.sparkSession), "_row")).join(F.broadcast(vocab.select(key, value)), key, "left")
    else:
        joined = _lookup(elements(written(rows, "elements")), vocab, key, value, F.struct("_row", "pos"))
    found = F.col(value)
    if on_unknown == "unk":
        found = F.coalesce(found, F.lit(unknown).cast(kind))
    elif on_unknown == "error":
        missing = found.isNull() & F.col(key).isNotNull()
        found = F.when(
            missing, F.raise_error(F.concat(F.lit("unknown entry: "), F.col(key).cast("string"))).cast(kind)
        ).otherwise(found)
    columns = ["_keep"] if keep else []
    cells = joined.select(id_col, "_row", F.struct("slot", "pos", found.alias("v")).alias("cell"), *columns)
    carried = [F.first("_keep", ignorenulls=True).alias("_keep")] if keep else []
    grouped = cells.groupBy("_row", id_col).agg(F.sort_array(F.collect_list("cell")).alias("cells"), *carried)

    def slot_values(slot: int) -> Column:
        mine = F.filter("cells", lambda c: c["slot"] == slot)
        return F.coalesce(F.transform(mine, lambda c: c["v"]), empty(kind))

    kept = [F.col("_keep").getField(c).alias(c) for c in keep]
    return grouped.select(id_col, *kept, *[slot_values(s).alias(n) for s, n in enumerate(arrays)])


def encode(df: DataFrame, id_col: str, tokens: dict[str, Column], vocab: DataFrame, **options) -> DataFrame:
    """Token arrays -> id arrays."""
    return map_arrays(df, id_col, tokens, vocab, **options)


def decode(df: DataFrame, id_col: str, ids: Column, vocab: DataFrame, out: str = "text", **options) -> DataFrame:
    """Id arrays -> words joined by one space."""
    found = map_arrays(
        df, id_col, {out: ids}, vocab, key="token_id", value="token", **options
    )
    return found.select(id_col, F.array_join(out, " ").alias(out))


def uniform_vector(token_id: Column, dim: int, seed: int) -> Column:
    """Reproducible numbers in [0, 1), a function of the token id, the position and the seed."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(dim)),
        lambda i: F.shiftrightunsigned(F.xxhash64(token_id, i, F.lit(seed)), 11) / F.lit(2.0**53),
    )


def embed_vocab(vocab: DataFrame, vectors: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """One vector per token: from ``vectors(token, line, vector)`` if known, else random.

    A token given twice takes its last line. Output ``(token, token_id, vector, known)``.
    """
    last = vectors.groupBy("token").agg(F.max_by("vector", "line").alias("found"))
    joined = vocab.join(last, "token", "left")
    return joined.select(
        "token", "token_id",
        F.coalesce(F.col("found").cast("array<double>"), uniform_vector(F.col("token_id"), dim, seed)).alias("vector"),
        F.col("found").isNotNull().alias("known"),
    )


def embedding_coverage(embedded: DataFrame) -> DataFrame:
    """Number and percentage of tokens with a given vector."""
    known, total = F.sum(F.col("known").cast("bigint")), F.count(F.lit(1))
    return embedded.agg(
        known.alias("known"), total.alias("total"), F.when(total > 0, known * 100.0 / total).otherwise(0.0).alias("percent")
    )
