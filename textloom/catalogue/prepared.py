"""Whole jobs of the task registry: files to batches, and files with predictions to scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lower_words
from ..operators import ordering, vocab
from ..operators.layouts import LayoutIds
from ..plans import tasks
from ..plans.prepare import prepare_task
from ..session import scratch_path
from ..sources import readers, sinks
from . import inputs as I
from .batches import CAP, TAGGED_LAYOUT_SQL, _text
from .metrics import CHUNKS_SQL
from .registry import SQL, query


def _lower(text: str) -> str:
    return I.sql_words(f"lower({text})")


def _encoded(side: str) -> str:
    return f"e{side} as (select id, list(token_id order by pos) {side} from (select id, unnest({side}) token, generate_subscripts({side}, 1) pos from s) join known using (token) group by id)"


# A swapped task: the label is the source, in the language with id 40002; the text is the target, with id 40001.
PREPARED_SQL = TAGGED_LAYOUT_SQL.replace("40001", "source").replace("40002", "40001").replace("source", "40002").replace(
    I.ID_PAIRS_SQL, f"""{I.PAIRS_SQL},
s as (select id::varchar id, {_lower('label')} x, {_lower('hyp')} y from pairs),
known as (select token, row_number() over (order by token) - 1 token_id from (select distinct unnest(list_concat(x, y)) token from s)),
{_encoded('x')}, {_encoded('y')},
id_pairs as (select s.id, coalesce(ex.x, []) x, coalesce(ey.y, []) y from s left join ex using (id) left join ey using (id))""")


@query("prepare_task_batches", PREPARED_SQL)
def prepare_task_batches(spark, folder):
    """A translation task from its JSON arrays to padded batches, source and target swapped."""
    path = scratch_path(spark, "task")
    sinks.write_json_array(I.pairs(spark, folder).select(F.col("id").cast("string").alias("id"), F.col("hyp").alias("text"), "label"), path, compression="gzip")
    rows = readers.read_parallel(spark, path)
    known = vocab.build_vocab(rows.select(F.explode(F.concat(lower_words(F.col("text")), lower_words(F.col("label")))).alias("token")))
    out = prepare_task(spark, "mt-sunibs-inzntv-swap", path=path, vocab=known, ids=LayoutIds(max_len=CAP))
    return out.select("id", "batch_id", *[_text(F.col(c)).alias(c) for c in ("enc", "dec", "label", "enc_mask")])



def _named(tags):
    return F.transform(tags, lambda t: F.replace(F.replace(t, F.lit("X"), F.lit("PERSON")), F.lit("Y"), F.lit("PLACE")))


@query("run_task_tagging", f"""with {CHUNKS_SQL.replace('from classes)', 'from classes where len(w) > 0)')}
select metric, round(value, 6) as "value" from (select unnest(['ACC', 'F1', 'REC', 'PRE']) metric,
unnest([(equal_tags + sentences) / (tokens + sentences), 2 * correct / (guessed + gold), correct / gold, correct / guessed]) "value" from counts)""")
def run_task_tagging(spark, folder):
    """A tagging task from its file, paired with predictions by sentence number, to its scores."""
    path = scratch_path(spark, "task-tags")
    rows = I.tagged(spark, folder).where(F.size("words") > 0)
    lines = F.zip_with("words", _named(F.col("gold")), lambda w, t: F.concat(w, F.lit("\t"), t))
    texts = rows.select("id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value")).orderBy("id")
    texts.select("value").write.option("compression", "gzip").text(path)
    # Tags are shuffled as one text a row, which takes a fraction of the space of an array; no tag holds a space.
    tags = rows.select("id", F.array_join(_named(F.col("pred")), " ").alias("hyp"))
    guesses = ordering.running_sum(tags, ["id"], out="place").select(F.col("place").alias("id"), F.split("hyp", " ").alias("hyp"))
    scores = tasks.run_task(spark, "ner_grit", guesses, path)
    return scores.select("metric", F.round("value", 6).alias("value"))


@query("run_task_answers", f"""select metric, "value" from (select unnest(['EM', 'F1']) metric, unnest(["EM", "F1"]) "value" from ({SQL['answer_scores']}))""")
def run_task_answers(spark, folder):
    """A question task from its JSON arrays, paired with predictions by id, to its scores."""
    path = scratch_path(spark, "task-answers")
    rows = I.qa_pred(spark, folder).withColumn("id", F.col("id").cast("string"))
    asked = rows.select("id", F.lit("{c}").alias("context"), F.lit('"q"').alias("question"), "label")
    sinks.write_json_array(asked, path)
    scores = tasks.run_task(spark, "tydi-qa", rows.select("id", "hyp"), path)
    return scores.select("metric", F.round("value", 6).alias("value"))
