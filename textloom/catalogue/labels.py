"""Label and text column queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions.sequences import join_with_separator
from ..operators import predictions
from . import inputs as I
from .registry import query

SIZES = ["long", "short"]
LEVELS = ["neg", "neut", "pos"]
CLASS_NAMES = [f"class_{i}" for i in range(10)]


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_index(value: str, labels) -> str:
    return f"nullif(coalesce(list_position({_sql_list(labels)}, {value}), 0), 0) - 1"


@query("label_to_index", f"select doc_id id, cast({_sql_index('lang', I.LANGUAGES)} as bigint) label_index from documents")
def label_to_index(spark, folder):
    index = L.label_to_index(F.col("lang"), I.LANGUAGES, on_unknown="null")
    return I.documents(spark, folder).select("id", index.alias("label_index"))


@query("unknown_labels", """select source bad, count(*) n from documents
where source not in ('src0', 'src1', 'src2') group by source""")
def unknown_labels(spark, folder):
    bad = L.unknown_label(F.col("source"), ["src0", "src1", "src2"])
    return (
        I.documents(spark, folder).select(bad.alias("bad")).where("bad is not null")
        .groupBy("bad").agg(F.count(F.lit(1)).alias("n"))
    )


@query("tags_to_indices", f"""with {I.TAGGED_SQL}
select id, array_to_string(list_transform(gold, lambda t: list_position({_sql_list(I.TAGS)}, t) - 1), ' ') tag_indices
from tagged""")
def tags_to_indices(spark, folder):
    index = L.tags_to_indices(F.col("gold"), I.TAGS)
    return I.tagged(spark, folder).select("id", I.joined(index).alias("tag_indices"))


@query("index_to_label", f"""select vec_id id, ({_sql_list(CLASS_NAMES)})[label + 1] label_name from embeddings""")
def index_to_label(spark, folder):
    name = L.index_to_label(F.col("label"), CLASS_NAMES)
    return I.logits(spark, folder).select("id", name.alias("label_name"))


def _topics(spark, folder):
    size = F.when(F.col("n_chars") > 800, "long").otherwise("short")
    return I.documents(spark, folder).select("id", F.concat_ws(",", "lang", size).alias("cell"))


TOPICS_SQL = """topics as (select doc_id id, lang || ',' || case when n_chars > 800 then 'long' else 'short' end cell
    from documents)"""
TOPIC_INDICES_SQL = f"""list_transform(string_split(cell, ','),
    lambda t: list_position({_sql_list(I.LANGUAGES + SIZES)}, t) - 1)"""


@query("multi_label_to_indices", f"with {TOPICS_SQL} select id, array_to_string({TOPIC_INDICES_SQL}, ' ') topic_indices from topics")
def multi_label_to_indices(spark, folder):
    indices = L.multi_label_to_indices(F.col("cell"), I.LANGUAGES + SIZES)
    return _topics(spark, folder).select("id", I.joined(indices).alias("topic_indices"))


@query("multi_hot", f"""with {TOPICS_SQL}, ids as (select id, {TOPIC_INDICES_SQL} t from topics)
select id, array_to_string(list_transform(range(6), lambda k: case when list_contains(t, k) then 1 else 0 end), ' ') hot
from ids""")
def multi_hot(spark, folder):
    indices = L.multi_label_to_indices(F.col("cell"), I.LANGUAGES + SIZES)
    return _topics(spark, folder).select("id", I.joined(L.multi_hot(indices, 6)).alias("hot"))


def aspect_columns(spark, folder):
    level = lambda high, low: F.when(F.col("n_chars") > high, "pos").when(F.col("n_chars") > low, "neut").otherwise("neg")
    return I.documents(spark, folder).select(
        "id", "text", level(2000, 500).alias("size"),
        F.when(F.col("lang") == "en", "pos").when(F.col("lang") == "fr", "neut").otherwise("neg").alias("tongue"),
        level(4000, 1000).alias("depth"),
    )


ASPECT_COLUMNS_SQL = """aspect_columns as (select doc_id id, text,
    case when n_chars > 2000 then 'pos' when n_chars > 500 then 'neut' else 'neg' end size,
    case when lang = 'en' then 'pos' when lang = 'fr' then 'neut' else 'neg' end tongue,
    case when n_chars > 4000 then 'pos' when n_chars > 1000 then 'neut' else 'neg' end depth from documents)"""
ASPECT_ARRAY_SQL = f"list_transform([size, tongue, depth], lambda a: list_position({_sql_list(LEVELS)}, a) - 1)"


@query("aspects_to_array", f"""with {ASPECT_COLUMNS_SQL} select id, array_to_string({ASPECT_ARRAY_SQL}, ' ') aspect_labels
from aspect_columns""")
def aspects_to_array(spark, folder):
    labels = L.aspects_to_array(["size", "tongue", "depth"], LEVELS)
    return aspect_columns(spark, folder).select("id", I.joined(labels).alias("aspect_labels"))


@query("parse_list_literal", f"""with bare as (select doc_id id, translate(text, '''"\\', '') t from documents)
select id, array_to_string({I.sql_words('t')}, '|') items, len({I.sql_words('t')}) n from bare""")
def parse_list_literal(spark, folder):
    bare = T.words(F.translate("text", "'\"\\", ""))
    cells = I.documents(spark, folder).select(
        "id", F.when(F.size(bare) > 0, F.concat(F.lit("['"), F.array_join(bare, "', '"), F.lit("']"))).otherwise("[]").alias("cell")
    )
    parsed = cells.withColumn("parsed", T.parse_list_literal(F.col("cell")))
    return parsed.select("id", F.array_join("parsed", "|").alias("items"), F.size("parsed").cast("bigint").alias("n"))


@query("lowercase_text", "select doc_id id, lower(text) lowered from documents")
def lowercase_text(spark, folder):
    return I.documents(spark, folder).select("id", F.lower("text").alias("lowered"))


@query("swap_source_target", f"with {I.PAIRS_SQL} select id, hyp source, label target from pairs")
def swap_source_target(spark, folder):
    from ..plans.tasks import orient

    return orient(I.pairs(spark, folder), source="label", target="hyp", swap=True).select(
        "id", F.col("source"), F.col("target")
    )


@query("qa_input", f"""with {I.QA_SQL}
select id, array_to_string(list_concat(list_concat({I.sql_lengths('context')}, [4]), {I.sql_lengths('question')}), ' ') ids
from qa""")
def qa_input(spark, folder):
    ids = join_with_separator(I.lengths(F.col("context")), 4, I.lengths(F.col("question")))
    return I.qa(spark, folder).select("id", I.joined(ids).alias("ids"))


@query("pair_text", f"""with {I.QA_SQL} select id, question || '|' || context shown,
array_to_string({I.sql_words('question')}, ' ') || '|' || array_to_string({I.sql_words('context')}, ' ') shown_words from qa""")
def pair_text(spark, folder):
    q, c = F.col("question"), F.col("context")
    return I.qa(spark, folder).select(
        "id", T.pair_text(q, c).alias("shown"), T.word_pair_text(T.words(q), T.words(c)).alias("shown_words")
    )


@query("metric_line", f"""with {I.CLS_SQL},
acc as (select avg(case when hyp = label then 1.0 else 0.0 end) a, avg(hyp) h from cls)
select printf('ACC:%.2f RATE:%.2f', a, h) line from acc""")
def metric_line(spark, folder):
    rows = I.cls(spark, folder).agg(
        F.avg((F.col("hyp") == F.col("label")).cast("double")).alias("ACC"), F.avg("hyp").alias("RATE")
    )
    long = rows.select(F.posexplode(F.array(
        F.struct(F.lit("ACC").alias("metric"), F.col("ACC").alias("value")),
        F.struct(F.lit("RATE").alias("metric"), F.col("RATE").alias("value")),
    )).alias("position", "m")).select("position", "m.*")
    return predictions.format_metrics(long)


@query("language_ids", f"""select doc_id id, case lang when 'de' then 1000 + 3 when 'en' then 1000 + 4
 when 'es' then 1000 + 5 when 'fr' then 1000 + 8 end language_id from documents""")
def language_ids(spark, folder):
    from ..plans.tasks import language_id_table

    codes = {"de": "de_DE", "en": "en_XX", "es": "es_XX", "fr": "fr_XX"}
    named = I.documents(spark, folder).select(
        "id", F.element_at(F.create_map(*[F.lit(v) for kv in codes.items() for v in kv]), F.col("lang")).alias("code")
    )
    # Fewer than a hundred fixed rows.
    table = F.broadcast(language_id_table(spark, 1000))
    return named.join(table, "code", "left").select("id", "language_id")
