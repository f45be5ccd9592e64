"""Batch order and layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import encode_segments
from ..operators import alignment, batching, layouts
from ..functions import labels as L
from ..functions import text as T
from . import inputs as I
from .labels import ASPECT_ARRAY_SQL, ASPECT_COLUMNS_SQL, LEVELS, SIZES, TOPIC_INDICES_SQL, TOPICS_SQL, aspect_columns
from .registry import query
from .tokens import QA_IDS_SQL, QA_INDEX_SQL, QA_PIECES_SQL, QA_SEGMENTS_SQL, pieces, qa_pieces, sql_pieces, sql_spread

CAP = 512


def sql_pad(array: str, width: str, value: int) -> str:
    return f"list_concat(({array})[1:{width}], list_transform(range({width} - least(len({array}), {width})), lambda z: {value}))"


def sql_mask(length: str, width: str) -> str:
    return f"list_transform(range({width}), lambda z: case when z < {length} then 1 else 0 end)"


def _text(c):
    return I.joined(F.transform(c, lambda v: v.cast("bigint")))


@query("batch_order", """select doc_id id, row_number() over (order by doc_id) - 1 position,
(row_number() over (order by doc_id) - 1) // 8 batch_id from documents""")
def batch_order(spark, folder):
    return batching.assign_batches(I.documents(spark, folder).select("id")).select("id", "position", "batch_id")


SHUFFLED_SQL = "row_number() over (order by ('0x' || substr(md5('11:' || doc_id), 1, 15))::bigint, doc_id) - 1"


@query("shuffled_batches", f"select doc_id id, {SHUFFLED_SQL} position, ({SHUFFLED_SQL}) // 8 batch_id from documents")
def shuffled_batches(spark, folder):
    """Every example once, in an order fixed by the seed."""
    return batching.assign_batches(I.documents(spark, folder).select("id"), seed=11).select("id", "position", "batch_id")


@query("bucketed_batches", f"""with {I.WORDS_SQL}, p as (select id, len(w) n, row_number() over (order by len(w) // 64, id) - 1 position from words)
select id, position, position // 8 batch_id, position % 8 place, max(n) over (partition by position // 8) width from p""")
def bucketed_batches(spark, folder):
    """Examples of like length share a batch."""
    n = F.size("words")
    placed = batching.assign_batches(I.word_table(spark, folder), lengths={"w": n}, bucket=batching.length_class(n, 64))
    return placed.select("id", "position", "batch_id", "place", F.col("w").alias("width"))


@query("batches_repeated_ids", f"""with {I.REPEATED_SQL}, p as (select *, row_number() over (order by id, "text") - 1 position from repeated)
select id, "text", position, position // 8 batch_id, position % 8 place, max(length("text")) over (partition by position // 8) width from p""")
def batches_repeated_ids(spark, folder):
    """Rows that share an id stay rows of their own."""
    placed = batching.assign_batches(I.repeated(spark, folder), order=["id", "text"], lengths={"w": F.length("text")})
    return placed.select("id", "text", "position", "batch_id", "place", F.col("w").alias("width"))


@query("batch_widths", f"""with {I.WORDS_SQL}, b as (select id, len(w) n, (row_number() over (order by id) - 1) // 8 batch_id from words)
select id, batch_id, least({CAP}, max(n) over (partition by batch_id) + 2) width from b""")
def batch_widths(spark, folder):
    placed = batching.assign_batches(I.word_table(spark, folder), lengths={"w": F.size("words")})
    return placed.select("id", "batch_id", F.least(F.lit(CAP), F.col("w") + 2).alias("width"))


@query("padded_ids", f"""with {I.WORDS_SQL}, l as (select id, list_transform(w, lambda x: length(x) + 10) x from words),
b as (select *, (row_number() over (order by id) - 1) // 8 batch_id from l),
v as (select *, least({CAP}, max(len(x)) over (partition by batch_id)) ww from b)
select id, batch_id, array_to_string({sql_pad('x', 'ww', 1)}, ' ') ids, array_to_string({sql_mask('len(x)', 'ww')}, ' ') mask from v""")
def padded_ids(spark, folder):
    from ..functions.arrays import mask, pad

    rows = I.documents(spark, folder).select("id", I.lengths(F.col("text")).alias("x"))
    placed = batching.assign_batches(rows, lengths={"w": F.size("x")})
    width = F.least(F.lit(CAP), F.col("w"))
    return placed.select(
        "id", "batch_id", I.joined(pad(F.col("x"), width, 1)).alias("ids"),
        _text(mask(F.least(F.size("x"), width), width)).alias("mask"),
    )


GENERATION_SQL = f"""{I.ID_PAIRS_SQL},
b as (select *, (row_number() over (order by id) - 1) // 8 batch_id from id_pairs),
v as (select *, max(len(x)) over (partition by batch_id) lx, max(len(y)) over (partition by batch_id) ly from b)"""


def _generation(spark, folder, model_type, **ids):
    out = layouts.generation_batches(I.id_pairs(spark, folder), model_type, layouts.LayoutIds(max_len=CAP, **ids))
    shown = ["enc", "dec", "label", "enc_mask"] + (["dec_mask"] if layouts.model_family(model_type) == "gpt2" else [])
    return out.select("id", "batch_id", *[_text(F.col(c)).alias(c) for c in shown])


def _layout_sql(widths: str, columns: dict[str, str]) -> str:
    shown = ", ".join(f"array_to_string({sql}, ' ') {name}" for name, sql in columns.items())
    return f"with {GENERATION_SQL}, l as (select *, {widths} from v) select id, batch_id, {shown} from l"


TAGGED_LAYOUT_SQL = _layout_sql(f"least({CAP}, lx + 2) we, least({CAP}, ly + 2) wd", {
    "enc": sql_pad("list_concat(x[1:we - 2], [2, 40001])", "we", 1),
    "dec": sql_pad("list_concat(list_concat([40002], y[1:wd - 2]), [2])", "wd", 1),
    "label": sql_pad("list_concat(y[1:wd - 2], [2, 40002])", "wd", -100),
    "enc_mask": sql_mask("least(len(x), we - 2) + 2", "we"),
})


@query("layout_bart", TAGGED_LAYOUT_SQL)
def layout_bart(spark, folder):
    return _generation(spark, folder, "bart")


@query("layout_mbart", TAGGED_LAYOUT_SQL.replace("40001", "250005").replace("40002", "250032"))
def layout_mbart(spark, folder):
    return _generation(spark, folder, "baseline-mbart", source_language=250005, target_language=250032)


@query("layout_t5", _layout_sql(f"least({CAP}, lx + 3) we, least({CAP}, ly + 1) wd", {
    "enc": sql_pad("list_concat([7, 8, 9], x[1:we - 3])", "we", 1),
    "dec": sql_pad("list_concat([0], y[1:wd - 1])", "wd", 1),
    "label": sql_pad("list_concat(y[1:wd - 1], [2])", "wd", -100),
    "enc_mask": sql_mask("least(len(x), we - 3) + 3", "we"),
}))
def layout_t5(spark, folder):
    return _generation(spark, folder, "t5", prefix=(7, 8, 9))


@query("layout_mt5", _layout_sql(f"least({CAP}, lx) we, least({CAP}, ly + 1) wd", {
    "enc": sql_pad("x", "we", 1),
    "dec": sql_pad("list_concat([0], y[1:wd - 1])", "wd", 1),
    "label": sql_pad("list_concat(y[1:wd - 1], [2])", "wd", -100),
    "enc_mask": sql_mask("least(len(x), we)", "we"),
}))
def layout_mt5(spark, folder):
    return _generation(spark, folder, "baseline-mt5")


PROMPT_SQL = f"list_concat({sql_pad('x', 'we - 1', 1)}, [0])"
PROMPT_MASK_SQL = f"list_concat({sql_mask('len(x)', 'we - 1')}, [1])"


@query("layout_gpt2", _layout_sql(f"least({CAP}, lx + 1) we, least({CAP}, ly + 1) wd", {
    "enc": PROMPT_SQL,
    "dec": f"list_concat({PROMPT_SQL}, {sql_pad('y[1:511]', 'wd', 1)})",
    "label": f"list_concat(list_transform(range(we), lambda z: -100), {sql_pad('list_concat(y[1:511], [2])', 'wd', -100)})",
    "enc_mask": PROMPT_MASK_SQL,
    "dec_mask": f"list_concat({PROMPT_MASK_SQL}, {sql_mask('least(len(y), 511)', 'wd')})",
}))
def layout_gpt2(spark, folder):
    return _generation(spark, folder, "gpt2")


def _labelled(out, *columns):
    return out.select("id", "batch_id", *[_text(F.col(c)).alias(c) for c in columns], "label", "raw")


def _label_sql(source: str, columns: dict[str, str], extra: str = "") -> str:
    shown = ", ".join(f"array_to_string({sql}, ' ') {name}" for name, sql in columns.items())
    return f"""with {source},
b as (select *, (row_number() over (order by id) - 1) // 8 batch_id from rows_in),
v as (select *, least({CAP}, max(len(ids)) over (partition by batch_id)) ww {extra} from b)
select id, batch_id, {shown}, label, raw from v"""


IDS_MASK = {"ids": sql_pad("ids", "ww", 0), "mask": sql_mask("least(len(ids), ww)", "ww")}
CLASSIFIED_SQL = f"""rows_in as (select doc_id id, {I.sql_lengths('text')} ids,
    cast(list_position(['de', 'en', 'es', 'fr'], lang) - 1 as varchar) label, text raw from documents)"""


@query("classification_batches", _label_sql(CLASSIFIED_SQL, IDS_MASK))
def classification_batches(spark, folder):
    rows = I.documents(spark, folder).select(
        "id", I.lengths(F.col("text")).alias("ids"), L.label_to_index(F.col("lang"), I.LANGUAGES).alias("label"), "text"
    )
    out = layouts.labelling_batches(rows, raw="text", max_len=CAP)
    return _labelled(out.withColumn("label", F.col("label").cast("string")), "ids", "mask")


@query("pair_classification_batches", _label_sql(f"""{I.QA_SQL}, l as (select id, {I.sql_lengths('question')} a,
    {I.sql_lengths('context')} b, question || '|' || context raw from qa),
rows_in as (select id, list_concat(list_concat(list_concat([1], a), [2]), list_concat(b, [2])) ids,
    list_concat(list_transform(range(len(a) + 2), lambda z: 0), list_transform(range(len(b) + 1), lambda z: 1)) seg,
    cast(id % 2 as varchar) label, raw from l)""", {**IDS_MASK, "segments": sql_pad("seg", "ww", 0)}))
def pair_classification_batches(spark, folder):
    ids, segments = encode_segments(F.col("a"), F.col("b"), cls_id=1, sep_id=2)
    q, c = F.col("question"), F.col("context")
    rows = I.qa(spark, folder).select(
        "id", I.lengths(q).alias("a"), I.lengths(c).alias("b"), T.pair_text(q, c).alias("raw")
    ).select("id", ids.alias("ids"), segments.alias("seg"), (F.col("id") % 2).cast("string").alias("label"), "raw")
    out = layouts.labelling_batches(rows, segments="seg", raw="raw", max_len=CAP)
    return _labelled(out, "ids", "mask", "segments")


@query("aspect_batches", _label_sql(f"""{ASPECT_COLUMNS_SQL}, rows_in as (select id, {I.sql_lengths('text')} ids,
    array_to_string({ASPECT_ARRAY_SQL}, ' ') label, text raw from aspect_columns)""", IDS_MASK))
def aspect_batches(spark, folder):
    rows = aspect_columns(spark, folder).withColumn("ids", I.lengths(F.col("text")))
    out = layouts.labelling_batches(
        rows, label=L.aspects_to_array(["size", "tongue", "depth"], LEVELS), label_kind="vector", raw="text", max_len=CAP
    )
    return _labelled(out.withColumn("label", I.joined(F.col("label"))), "ids", "mask")


@query("multi_label_batches", _label_sql(f"""{TOPICS_SQL}, t as (select topics.id, text, {TOPIC_INDICES_SQL} t
    from topics join documents d on d.doc_id = topics.id),
rows_in as (select id, {I.sql_lengths('text')} ids, array_to_string(list_transform(range(6),
    lambda k: case when list_contains(t, k) then 1 else 0 end), ' ') label, text raw from t)""", IDS_MASK))
def multi_label_batches(spark, folder):
    size = F.when(F.col("n_chars") > 800, "long").otherwise("short")
    topics = L.multi_label_to_indices(F.concat_ws(",", "lang", size), I.LANGUAGES + SIZES)
    rows = I.documents(spark, folder).select("id", I.lengths(F.col("text")).alias("ids"), topics.alias("topics"), "text")
    out = layouts.labelling_batches(rows, label=L.multi_hot(F.col("topics"), 6), label_kind="vector", raw="text", max_len=CAP)
    return _labelled(out.withColumn("label", I.joined(F.col("label"))), "ids", "mask")


TAG_INDEX_SQL = f"list_transform(gold, lambda t: list_position({I.TAGS}, t) - 1)"
WITH_TAGS = ", max(len(tags)) over (partition by batch_id) wt"


@query("tagging_batches", _label_sql(f"""{I.TAGGED_SQL}, p as (select id, w, {TAG_INDEX_SQL} tags, {sql_pieces('w')} p from tagged),
rows_in as (select id, list_concat(list_concat([1], flatten(p)), [2]) ids, tags,
    list_concat(list_concat([-1], {sql_spread('p')}), [-1]) wi, array_to_string(w, '|') raw from p)""",
    {**IDS_MASK, "word_index": sql_pad("wi", "ww", -1), "label": sql_pad("tags", "wt", -100)}, WITH_TAGS).replace(", label, raw from v", ", raw from v"))
def tagging_batches(spark, folder):
    ids, index = alignment.align_words(F.col("p"), 1, 2)
    rows = I.tagged(spark, folder).withColumn("p", pieces(F.col("words"))).select(
        "id", ids.alias("ids"), index.alias("wi"), L.tags_to_indices(F.col("gold"), I.TAGS).alias("tags"), "words"
    )
    out = layouts.labelling_batches(
        rows, label="tags", label_kind="tags", word_index="wi", raw=F.array_join("words", "|"), max_len=CAP
    )
    return _labelled(out.withColumn("label", I.joined(F.col("label"))), "ids", "mask", "word_index")


@query("span_qa_batches", _label_sql(f"""{QA_PIECES_SQL}, a as (select id, {QA_IDS_SQL} ids, {QA_INDEX_SQL} wi,
    {QA_SEGMENTS_SQL} seg, list_transform(passage, lambda x: case when length(x) >= 6 then 1 else 0 end) tags from qa_pieces),
rows_in as (select a.*, question || '|' || context raw from a join qa using (id))""",
    {**IDS_MASK, "segments": sql_pad("seg", "ww", 0), "word_index": sql_pad("wi", "ww", -1), "label": sql_pad("tags", "wt", -100)},
    WITH_TAGS).replace(", label, raw from v", ", raw from v"))
def span_qa_batches(spark, folder):
    ids, index, segments = alignment.align_question_passage(F.col("q"), F.col("p"), 1, 2)
    tags = F.transform("passage", lambda w: F.when(F.length(w) >= 6, 1).otherwise(0).cast("bigint"))
    shown = I.qa(spark, folder).select("id", T.pair_text(F.col("question"), F.col("context")).alias("raw"))
    rows = qa_pieces(spark, folder).select(
        "id", ids.alias("ids"), index.alias("wi"), segments.alias("seg"), tags.alias("tags")
    ).join(shown, "id")
    out = layouts.labelling_batches(
        rows, label="tags", label_kind="tags", segments="seg", word_index="wi", raw="raw", max_len=CAP
    )
    return _labelled(out.withColumn("label", I.joined(F.col("label"))), "ids", "mask", "segments", "word_index")
