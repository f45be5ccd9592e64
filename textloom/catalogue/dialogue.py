"""Dialogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialogue as D
from . import inputs as I
from .registry import query

MAX_TOKENS = 64

ENTRIES_SQL = f"""{I.TURNS_SQL},
entries as (select conv_id, k, reply, len(h) n, h, list_transform(h, lambda t: {I.sql_words('lower(t)')}) toks from
    (select conv_id, k, reply, user_text, list_concat(coalesce(flatten(list([user_text, reply]) over
        (partition by conv_id order by k rows between unbounded preceding and 1 preceding)), []), [user_text]) h from turns))"""


def _kept_sql(options: str) -> str:
    return f"""{ENTRIES_SQL},
sizes as (select *, list_transform(toks, lambda t: len(t)) s from entries),
kept as (select *, coalesce(list_filter(list_transform({options}, lambda d: n - d),
    lambda keep: coalesce(list_sum(s[n - keep + 1 : n]), 0) <= {MAX_TOKENS} - 2 - 2 * keep)[1], 0) kept from sizes)"""


TRIANGULAR_SQL = _kept_sql("list_transform(range(n + 1), lambda r: least(n, r * (r + 1) // 2))")
MINIMAL_SQL = _kept_sql("range(n + 1)")


def histories(spark, folder, policy="triangular"):
    return D.truncate_history(D.running_history(I.turns(spark, folder), MAX_TOKENS), MAX_TOKENS, policy)


@query("dialogue_pairs", f"with {I.TURNS_SQL} select conv_id, k, conv_id || '-' || k id, user_text, reply from turns")
def dialogue_pairs(spark, folder):
    return I.turns(spark, folder).select("conv_id", "k", "id", "user_text", "reply")


@query("dialogue_turns", """with l as (select doc_id conv_id, string_split(text, chr(10)) l from documents),
u as (select conv_id, unnest(range((len(l) + 1) // 2)) k, l from l)
select conv_id, k, conv_id || '-' || k id, l[2 * k + 1] user_text, l[2 * k + 2] reply from u""")
def dialogue_turns(spark, folder):
    """Nested dialogues: the lines of a document two by two; a last line alone has no reply yet (null)."""
    lines = F.split("text", "\n")
    count = F.ceil(F.size("lines") / 2)
    pair = lambda k: F.slice("lines", 2 * k + 1, F.lit(2))
    nested = I.documents(spark, folder).select(F.col("id").alias("conv_id"), lines.alias("lines")).where(
        F.size("lines") >= 1
    )
    steps = F.sequence(F.lit(0), count.cast("int") - 1)
    return D.flatten_dialogues(nested.select("conv_id", F.transform(steps, pair).alias("dialogue")))


@query("dialogue_running_id", f"""with {I.TURNS_SQL} select conv_id, k, row_number() over (order by conv_id, k) - 1 id from turns""")
def dialogue_running_id(spark, folder):
    return D.with_running_id(I.turns(spark, folder)).select("conv_id", "k", "id")


@query("dialogue_history", f"with {ENTRIES_SQL} select conv_id, k, n, array_to_string(h, '|') history, reply from entries")
def dialogue_history(spark, folder):
    shown = F.array_join("history", "|")
    return D.complete_history(I.turns(spark, folder)).select("conv_id", "k", "n", shown.alias("history"), "reply")


HISTORY_COLUMNS_SQL = "conv_id, k, n, kept, n - kept dropped, array_to_string(h[n - kept + 1 : n], '|') history"


def _shown(df):
    shown = F.array_join(F.transform("history", lambda e: e["text"]), "|")
    return df.select("conv_id", "k", "n", F.col("kept").cast("bigint").alias("kept"), "dropped", shown.alias("history"))


@query("dialogue_truncated_history", f"with {TRIANGULAR_SQL} select {HISTORY_COLUMNS_SQL} from kept")
def dialogue_truncated_history(spark, folder):
    return _shown(histories(spark, folder))


@query("dialogue_truncated_history_minimal", f"with {MINIMAL_SQL} select {HISTORY_COLUMNS_SQL} from kept")
def dialogue_truncated_history_minimal(spark, folder):
    return _shown(histories(spark, folder, "minimal"))


def _marked_sql(shift: str, content: str) -> str:
    return f"""flatten(list_transform({content}, lambda t, i:
        list_concat([case when (i - 1 + {shift}) % 2 = 0 then '5' else '6' end], t)))"""


KEPT_TOKENS, KEPT_TEXTS = "toks[n - kept + 1 : n]", "list_transform(h[n - kept + 1 : n], lambda t: [t])"


@query("dialogue_speaker_markers", f"""with {TRIANGULAR_SQL} select conv_id, k,
array_to_string({_marked_sql('0', KEPT_TOKENS)}, ' ') by_position, array_to_string({_marked_sql('n - kept', KEPT_TOKENS)}, ' ') by_role,
array_to_string({_marked_sql('0', KEPT_TEXTS)}, '|') texts from kept""")
def dialogue_speaker_markers(spark, folder):
    df = D.mark_speakers(histories(spark, folder), "5", "6", out="m1")
    df = D.mark_speakers(df, "5", "6", anchor="role", out="m2")
    df = D.mark_speakers(df, "5", "6", field="text", out="m3")
    return df.select(
        "conv_id", "k", I.joined(F.col("m1")).alias("by_position"), I.joined(F.col("m2")).alias("by_role"),
        F.array_join("m3", "|").alias("texts"),
    )


@query("dialogue_longest_history", f"""with {TRIANGULAR_SQL}
select cast(max(kept + coalesce(list_sum(s[n - kept + 1 : n]), 0)) as bigint) max_len from kept""")
def dialogue_longest_history(spark, folder):
    return D.longest_history(D.mark_speakers(histories(spark, folder), "5", "6"))
