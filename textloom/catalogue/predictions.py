"""Prediction decoding and run-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..operators import predictions as P
from . import inputs as I
from .labels import CLASS_NAMES
from .registry import query

NAMES = [f"class_{i}" for i in range(64)]
BEST_SQL = "list_transform(steps, lambda l: list_position(l, list_max(l)) - 1)"


@query("top_class", f"""with {I.LOGITS_SQL} select id, list_position(embedding, list_max(embedding)) - 1 best,
'class_' || (list_position(embedding, list_max(embedding)) - 1) hyp from logits""")
def top_class(spark, folder):
    return I.logits(spark, folder).select(
        "id", argmax(F.col("embedding")).alias("best"), P.sequence_class(F.col("embedding"), NAMES).alias("hyp")
    )


@query("token_classes", f"""with {I.LOGITS_SQL}, b as (select id, {BEST_SQL} best, list_position(gold, -100) stop from logits)
select id, array_to_string(case when stop > 0 then best[1:stop - 1] else best end, ' ') best,
array_to_string(list_transform(case when stop > 0 then best[1:stop - 1] else best end, lambda b: 'class_' || b), ' ') hyp from b""")
def token_classes(spark, folder):
    steps, gold = F.col("steps"), F.col("gold")
    return I.logits(spark, folder).select(
        "id", I.joined(P.token_classes(steps, gold)).alias("best"),
        I.joined(P.token_labels(steps, gold, CLASS_NAMES)).alias("hyp"),
    )


@query("aspect_classes", f"with {I.LOGITS_SQL} select id, array_to_string({BEST_SQL}, ' ') best from logits")
def aspect_classes(spark, folder):
    return I.logits(spark, folder).select("id", I.joined(P.aspect_classes(F.col("steps"))).alias("best"))


@query("generated_ids", f"""with {I.LOGITS_SQL}, b as (select id, gold, {BEST_SQL} best from logits)
select id, array_to_string(list_filter(best, lambda h, i: gold[i] <> -100), ' ') hyp,
array_to_string(list_filter(gold, lambda g: g <> -100), ' ') label from b""")
def generated_ids(spark, folder):
    return I.logits(spark, folder).select(
        "id", I.joined(P.generated_ids(F.col("steps"), F.col("gold"))).alias("hyp"),
        I.joined(P.visible_ids(F.col("gold"))).alias("label"),
    )


@query("remove_prompt", f"""with {I.ID_PAIRS_SQL}, b as (select *, (row_number() over (order by id) - 1) // 8 batch_id from id_pairs),
v as (select id, x, y, max(len(x)) over (partition by batch_id) w from b)
select id, array_to_string(y, ' ') hyp from v""")
def remove_prompt(spark, folder):
    """Prompts are padded to the batch, answers follow; what is left must be the answers."""
    from ..functions.arrays import pad
    from ..operators.batching import assign_batches

    placed = assign_batches(I.id_pairs(spark, folder), lengths={"w": F.size("x")})
    whole = F.concat(pad(F.col("x"), F.col("w"), 1), F.col("y"))
    return placed.select("id", I.joined(P.remove_prompt(whole, F.col("w"))).alias("hyp"))


@query("paired_predictions", f"with {I.PAIRS_SQL} select id, hyp, label from pairs")
def paired_predictions(spark, folder):
    pairs = I.pairs(spark, folder)
    halves = [pairs.where(F.col("label").contains("a")), pairs.where(~F.col("label").contains("a"))]
    hypotheses = P.stack([h.select("id", "hyp") for h in halves])
    return P.pair_with_references(hypotheses, I.documents(spark, folder).withColumnRenamed("text", "label"))


@query("prediction_preview", f"with {I.PAIRS_SQL} select id, hyp, label from pairs order by id limit 5")
def prediction_preview(spark, folder):
    return P.preview(I.pairs(spark, folder).select("id", "hyp", "label"))


@query("epoch_losses", f"""with {I.RUNS_SQL} select exp, (epoch - 1) // 10 epoch_no, round(avg(metric), 6) mean_loss,
round(sum(metric), 6) sum_loss from runs group by all""")
def epoch_losses(spark, folder):
    """Ten consecutive values of a run stand for the batches of one epoch."""
    batches = I.runs(spark, folder).withColumn("epoch_no", F.floor((F.col("epoch") - 1) / 10))
    losses = P.epoch_losses(batches, ["exp", "epoch_no"], loss="metric")
    return losses.select("exp", "epoch_no", F.round("mean_loss", 6).alias("mean_loss"), F.round("sum_loss", 6).alias("sum_loss"))


STOP_SQL = f"""{I.RUNS_SQL},
imp as (select *, metric > greatest(coalesce(max(metric) over (partition by exp order by epoch
    rows between unbounded preceding and 1 preceding), -100), -100) improved from runs),
grp as (select *, coalesce(max(case when improved then epoch end) over (partition by exp order by epoch), 0) last from imp),
stop as (select exp, min(case when epoch - last >= 3 then epoch end) stop_epoch from grp group by exp)"""


@query("early_stop_epoch", f"with {STOP_SQL} select exp, stop_epoch from stop")
def early_stop_epoch(spark, folder):
    return P.early_stop(I.runs(spark, folder))


BEST_EPOCH_SQL = f"""{STOP_SQL}, best as (select exp, max(case when improved then epoch end) best_epoch,
    max(case when improved then metric end) best_metric from grp join stop using (exp)
    where stop_epoch is null or epoch <= stop_epoch group by exp)"""


@query("best_epoch", f"with {BEST_EPOCH_SQL} select exp, best_epoch, best_metric from best")
def best_epoch(spark, folder):
    return P.best_epoch(I.runs(spark, folder))


@query("metric_summary", f"""with {I.RUNS_SQL}, s as (select cast(count(metric) as double) "count", avg(metric) mean,
stddev_samp(metric) std, min(metric) "min", quantile_cont(metric, 0.25) q1, quantile_cont(metric, 0.5) q2,
quantile_cont(metric, 0.75) q3, max(metric) "max" from runs)
select 'metric' metric, statistic, round(value, 6) "value" from (select unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) statistic,
unnest(["count", mean, std, "min", q1, q2, q3, "max"]) "value" from s)""")
def metric_summary(spark, folder):
    return P.describe(I.runs(spark, folder), ["metric"]).select("metric", "statistic", F.round("value", 6).alias("value"))
