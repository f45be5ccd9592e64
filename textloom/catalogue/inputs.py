"""Inputs derived from the given tables, in Spark and as SQL fragments.

All rows and whole texts are used. ``pairs`` turns every document into a reference and a
damaged, rotated hypothesis; ``tagged`` into two tag sequences; and so on.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import split_words, words
from ..operators.dialogue import pair_turns
from ..session import bound_batches

# The functions travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANGUAGES = ["de", "en", "es", "fr"]
TAGS = ["B-X", "I-X", "B-Y", "I-Y", "O"]


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that comes in fewer splits than there are cores.

    A small file may be one split, which would leave all row-wise work to one core. A table
    with enough splits is left as it is, so large inputs get no extra shuffle. Use it on a
    table as read, before any shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").withColumnRenamed("doc_id", "id")


def repeated(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, text)``: two documents share an id, and one in three has a text that others have too."""
    text = F.when(F.col("id") % 6 < 2, "same").otherwise(F.col("text"))
    return documents(spark, folder).select((F.floor(F.col("id") / 2) * 2).alias("id"), text.alias("text"))


def joined(array: Column, separator: str = " ") -> Column:
    """Array -> text, so that a value does not depend on an engine's list type."""
    return F.array_join(array.cast("array<string>"), separator)


def _damaged(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """Words of each text without one in seven and with "zz" for one in five, by place and id; the first five moved to the end, eleven a line."""
    size = len(texts)
    parts = split_words(texts.cast(pa.large_string()))
    row = np.repeat(np.arange(size), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    flat, row = flat.filter(pa.array(full)), row[full]
    place = lambda rows: np.arange(len(rows)) - np.searchsorted(rows, rows)
    known = ids.is_valid().to_numpy(zero_copy_only=False)[row]
    number = place(row) + ids.fill_null(0).to_numpy(zero_copy_only=False)[row]
    kept = ~known | (number % 7 != 0)
    swapped = pa.array((known & (np.fmod(number, 5) == 1))[kept])
    flat, row = pc.if_else(swapped, pa.scalar("zz", flat.type), flat.filter(pa.array(kept))), row[kept]
    count = np.bincount(row, minlength=size)
    at, first, n = place(row), (np.cumsum(count) - count)[row], count[row]
    # Of five words or fewer all are moved, so they stay as they are.
    moved = flat.take(pa.array(first + np.where(n > 5, (at + 5) % np.maximum(n, 1), at)))
    ends = pc.if_else(pa.array(at % 11 == 10), pa.scalar("\n", flat.type), pa.scalar(" ", flat.type))
    lined = pc.binary_join_element_wise(moved, ends, pa.scalar("", flat.type))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)])), lined), pa.scalar("", flat.type))
    return pc.if_else(texts.is_valid(), joined.cast(pa.string()), pa.scalar(None, pa.string()))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, label, hyp)``: label is the whole text."""
    docs = documents(spark, folder).select("id", F.col("text").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _damaged(*b.columns)], names=["id", "label", "hyp"])

    bound_batches(spark)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("hyp", StringType())]))


def lengths(text: Column) -> Column:
    """Stand-in ids of a text: the length of each word plus 10."""
    return F.transform(words(text), lambda w: (F.length(w) + 10).cast("bigint"))


def id_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, x, y)``: source and target ids of the pairs."""
    return pairs(spark, folder).select("id", lengths(F.col("label")).alias("x"), lengths(F.col("hyp")).alias("y"))


def word_table(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("id", words(F.col("text")).alias("words"))


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, words, gold, pred)``: tag arrays over all words of a document."""
    gold = F.transform(
        "words", lambda w: F.when(F.length(w) >= 7, "X").when(F.length(w) >= 5, "Y").otherwise("O")
    )
    guess = F.transform(
        "words",
        lambda w, i: F.when((i + F.col("id")) % 9 == 0, "O").when(F.length(w) >= 6, "X")
        .when(F.length(w) >= 5, "Y").otherwise("O"),
    )
    bio = lambda c: F.transform(
        c,
        lambda t, i: F.when(t == "O", "O")
        .when((i > 0) & (F.get(F.col(c), i - 1) == t), F.concat(F.lit("I-"), t))
        .otherwise(F.concat(F.lit("B-"), t)),
    )
    return (
        word_table(spark, folder).withColumn("g", gold).withColumn("p", guess)
        .select("id", "words", bio("g").alias("gold"), bio("p").alias("pred"))
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return pair_turns(table(spark, folder, "conversations"))


def cls(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("id", "n_chars")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    return labels.join(docs, "id").select(
        "id", F.col("quality").alias("label"), F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("hyp")
    )


def aspects(spark: SparkSession, folder: str) -> DataFrame:
    size = lambda limit: F.when(F.col("n_chars") > limit, "long").otherwise("short")
    return documents(spark, folder).select(
        "id",
        F.array("lang", "source", size(800)).alias("label"),
        F.array(
            F.when(F.col("id") % 4 == 0, "en").otherwise(F.col("lang")),
            F.when(F.col("id") % 3 == 0, "src0").otherwise(F.col("source")), size(1000),
        ).alias("hyp"),
    )


def qa(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, context, question)``: every document with a benchmark passage as its question."""
    asked = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("question"))
    count = table(spark, folder, "benchmark").agg(F.count(F.lit(1))).scalar()
    docs = documents(spark, folder).select("id", F.col("text").alias("context"))
    return docs.withColumn("item_id", F.col("id") % count).join(asked, "item_id").select("id", "context", "question")


def qa_pred(spark: SparkSession, folder: str) -> DataFrame:
    """Answers: the whole text; guesses: with an article and a stop, rotated, or as it is."""
    moved = F.concat(F.slice("w", F.lit(3), F.greatest(F.size("w"), F.lit(1))), F.array(F.lit("zz")))
    return word_table(spark, folder).select(
        "id", F.col("words").alias("w")
    ).select(
        "id", F.array_join("w", " ").alias("label"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("The "), F.array_join("w", " "), F.lit(".")))
        .when(F.col("id") % 3 == 1, F.array_join(moved, " "))
        .otherwise(F.array_join(F.slice("w", 1, F.ceil(F.size("w") / 2).cast("int")), " ")).alias("hyp"),
    )


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, embedding, label, steps, gold)``: eight steps of eight scores, some gold labels ignored."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.slice("embedding", s * 8 + 1, F.lit(8)))
    gold = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda s: F.when((s > 0) & ((s + F.col("vec_id")) % 5 == 0), -100)
        .otherwise((s + F.col("label")) % 8).cast("bigint"),
    )
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label", steps.alias("steps"), gold.alias("gold")
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """``(exp, epoch, metric)``: the events of a user in time order."""
    from ..operators.ordering import group_row_number

    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    day = F.unix_date(F.col("ts").cast("date"))
    return group_row_number(events, ["user_id"], ["ts", "event_id"], day).select(
        F.col("user_id").alias("exp"), (F.col("rn") + 1).alias("epoch"), F.col("value").alias("metric")
    )


# --- the same inputs as SQL common table expressions -------------------------------------
SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}'), lambda x: x <> '')"


def sql_joined(array: str) -> str:
    return f"array_to_string({array}, ' ')"


def sql_lengths(text: str) -> str:
    return f"list_transform({sql_words(text)}, lambda x: length(x) + 10)"


WORDS_SQL = f"words as (select doc_id id, {sql_words('text')} w from documents)"

REPEATED_SQL = """repeated as (select doc_id // 2 * 2 id, case when doc_id % 6 < 2 then 'same' else "text" end "text" from documents)"""

PAIRS_SQL = f"""{WORDS_SQL},
damaged as (select id, list_filter(list_transform(w, lambda x, i: case when (i - 1 + id) % 7 = 0 then null
    when (i - 1 + id) % 5 = 1 then 'zz' else x end), lambda x: x is not null) h from words),
pairs as (select d.doc_id id, d.text label, array_to_string(list_transform(list_concat(h[6:], h[1:5]),
    lambda x, i: x || case when i % 11 = 0 then chr(10) else ' ' end), '') hyp
    from damaged join documents d on d.doc_id = damaged.id)"""

ID_PAIRS_SQL = f"""{PAIRS_SQL},
id_pairs as (select id, {sql_lengths('label')} x, {sql_lengths('hyp')} y from pairs)"""

TAGGED_SQL = f"""{WORDS_SQL},
classes as (select id, w,
    list_transform(w, lambda x: case when length(x) >= 7 then 'X' when length(x) >= 5 then 'Y' else 'O' end) g,
    list_transform(w, lambda x, i: case when (i - 1 + id) % 9 = 0 then 'O' when length(x) >= 6 then 'X'
        when length(x) >= 5 then 'Y' else 'O' end) p from words),
tagged as (select id, w,
    list_transform(g, lambda t, i: case when t = 'O' then 'O' when i > 1 and g[i - 1] = t then 'I-' || t else 'B-' || t end) gold,
    list_transform(p, lambda t, i: case when t = 'O' then 'O' when i > 1 and p[i - 1] = t then 'I-' || t else 'B-' || t end) pred
    from classes)"""

TURNS_SQL = """numbered as (select conv_id, text, row_number() over (partition by conv_id order by turn) - 1 rn
    from conversations where role <> 'system'),
turns as (select conv_id, cast(floor(rn / 2) as bigint) k, max(case when rn % 2 = 0 then text end) user_text,
    max(case when rn % 2 = 1 then text end) reply from numbered
    group by conv_id, cast(floor(rn / 2) as bigint) having count(*) = 2)"""

CLS_SQL = """cls as (select l.doc_id id, l.quality label, case when d.n_chars > 800 then 1 else 0 end hyp
    from labels l join documents d on l.doc_id = d.doc_id)"""

ASPECTS_SQL = """aspects as (select doc_id id,
    [lang, source, case when n_chars > 800 then 'long' else 'short' end] label,
    [case when doc_id % 4 = 0 then 'en' else lang end, case when doc_id % 3 = 0 then 'src0' else source end,
     case when n_chars > 1000 then 'long' else 'short' end] hyp from documents)"""

QA_SQL = """qa as (select d.doc_id id, d.text context, b.text question from documents d
    join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))"""

QA_PRED_SQL = f"""{WORDS_SQL},
qa_pred as (select id, array_to_string(w, ' ') label,
    case when id % 3 = 0 then 'The ' || array_to_string(w, ' ') || '.'
         when id % 3 = 1 then array_to_string(list_concat(w[3:], ['zz']), ' ')
         else array_to_string(w[1:cast(ceil(len(w) / 2) as bigint)], ' ') end hyp from words)"""

LOGITS_SQL = """logits as (select vec_id id, embedding, label,
    list_transform(range(8), lambda s: embedding[s * 8 + 1 : s * 8 + 8]) steps,
    list_transform(range(8), lambda s: case when s > 0 and (s + vec_id) % 5 = 0 then -100 else (s + label) % 8 end) gold
    from embeddings)"""

RUNS_SQL = """runs as (select user_id exp, row_number() over (partition by user_id order by ts, event_id) epoch,
    value metric from events)"""
