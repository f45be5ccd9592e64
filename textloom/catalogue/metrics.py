"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.metrics import answers, bleu as B, chunks, classification, loss, rouge as R
from ..operators.metrics.overlap import Scheme, ngram_overlap
from ..plans import bundles
from . import inputs as I
from .registry import query


def _rounded(df, *keep, places=6):
    return df.select(*keep, *[F.round(c, places).alias(c) for c in df.columns if c not in keep])


# --- classification ------------------------------------------------------------------------
def _macro_sql(source: str, name: str) -> str:
    return f"""with {source},
classes as (select label c from {name} union select hyp from {name}),
per as (select c, sum(case when label = c and hyp = c then 1 else 0 end) tp,
    sum(case when hyp = c then 1 else 0 end) g, sum(case when label = c then 1 else 0 end) t from classes, {name} group by c),
pr as (select *, case when g = 0 then 0 else tp / g end p, case when t = 0 then 0 else tp / t end r from per),
f as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end f1 from pr)"""


MACRO_SELECT = """select round(sum(tp) / sum(t), 6) "ACC", round(avg(f1), 6) "F1", round(avg(r), 6) "REC", round(avg(p), 6) "PRE" from f"""


@query("class_accuracy", f"""with {I.CLS_SQL} select round(avg(case when hyp = label then 1.0 else 0.0 end), 6) "ACC" from cls""")
def class_accuracy(spark, folder):
    return _rounded(classification.accuracy(I.cls(spark, folder)))


@query("macro_scores", _macro_sql(I.CLS_SQL, "cls") + MACRO_SELECT)
def macro_scores(spark, folder):
    return _rounded(classification.macro_scores(I.cls(spark, folder)))


FLAT_ASPECTS_SQL = f"{I.ASPECTS_SQL}, flat as (select unnest(label) label, unnest(hyp) hyp from aspects)"


@query("macro_scores_multi", _macro_sql(FLAT_ASPECTS_SQL, "flat") + MACRO_SELECT)
def macro_scores_multi(spark, folder):
    return _rounded(classification.macro_scores_multi(I.aspects(spark, folder)))


@query("class_report", _macro_sql(FLAT_ASPECTS_SQL, "flat") + """select c cls, cast(tp as bigint) tp, cast(g - tp as bigint) fp,
cast(t - tp as bigint) fn, round(p, 6) "precision", round(r, 6) recall, round(f1, 6) f1 from f""")
def class_report(spark, folder):
    flat = I.aspects(spark, folder).select(F.inline(F.arrays_zip("label", "hyp")))
    return _rounded(classification.per_class(flat).drop("gold"), "cls", "tp", "fp", "fn")


# --- chunks --------------------------------------------------------------------------------
CHUNKS_SQL = f"""{I.TAGGED_SQL},
long as (select id, unnest(gold) gold, unnest(pred) pred, unnest(range(len(gold))) pos from tagged),
sides as (select id, pos, 'g' side, split_part(gold, '-', 1) p, split_part(gold, '-', 2) t from long
    union all select id, pos, 'h', split_part(pred, '-', 1), split_part(pred, '-', 2) from long
    union all select id, len(gold), s, 'O', '' from tagged, (select unnest(['g', 'h']) s)),
steps as (select *, coalesce(lag(p) over w, 'O') lp, coalesce(lag(t) over w, '') lt from sides
    window w as (partition by id, side order by pos)),
marks as (select *, p = 'B' or (lp = 'O' and p = 'I') or (p <> 'O' and lt <> t) s,
    (lp in ('B', 'I') and p in ('B', 'O')) or (lp <> 'O' and lt <> t) e from steps),
ends as (select *, min(case when e then pos end) over (partition by id, side order by pos
    rows between 1 following and unbounded following) stop from marks),
spans as (select id, side, pos, stop, t from ends where s),
counts as (select (select count(*) from spans a join spans b on a.id = b.id and a.side = 'g' and b.side = 'h'
        and a.pos = b.pos and a.stop = b.stop and a.t = b.t) correct,
    (select count(*) from spans where side = 'h') guessed, (select count(*) from spans where side = 'g') gold,
    (select count(*) from long) tokens, (select count(*) from long where gold = pred) equal_tags,
    (select count(*) from tagged) sentences)"""


@query("chunk_counts", f"with {CHUNKS_SQL} select * from counts")
def chunk_counts(spark, folder):
    return chunks.chunk_counts(I.tagged(spark, folder), hyp="pred", label="gold")


@query("chunk_scores", f"""with {CHUNKS_SQL} select round((equal_tags + sentences) / (tokens + sentences), 6) "ACC",
round(correct / guessed, 6) "PRE", round(correct / gold, 6) "REC", round(2 * correct / (guessed + gold), 6) "F1" from counts""")
def chunk_scores(spark, folder):
    return _rounded(chunks.chunk_scores(I.tagged(spark, folder), hyp="pred", label="gold"))


MISSING_SQL = CHUNKS_SQL.replace(I.TAGGED_SQL, I.TAGGED_SQL.replace("tagged as (", "whole as (") + """,
tagged as (select id, w, gold, case when id % 3 = 0 then list_transform(gold, lambda t: 'O') else pred end pred from whole)""")


@query("chunk_scores_missing", f"""with {MISSING_SQL} select round((equal_tags + sentences) / (tokens + sentences), 6) "ACC",
round(correct / guessed, 6) "PRE", round(correct / gold, 6) "REC", round(2 * correct / (guessed + gold), 6) "F1" from counts""")
def chunk_scores_missing(spark, folder):
    """Every third prediction is missing and counts as all outside."""
    some = I.tagged(spark, folder).withColumn("pred", F.when(F.col("id") % 3 != 0, F.col("pred")))
    return _rounded(chunks.chunk_scores(some, hyp="pred", label="gold"))


@query("chunk_scores_by_type", f"""with {CHUNKS_SQL},
hits as (select a.t, count(*) c from spans a join spans b on a.id = b.id and a.side = 'g' and b.side = 'h'
    and a.pos = b.pos and a.stop = b.stop and a.t = b.t group by a.t),
per as (select t, sum(case when side = 'g' then 1 else 0 end) gold, sum(case when side = 'h' then 1 else 0 end) guessed
    from spans group by t)
select t "type", cast(gold as bigint) gold, cast(guessed as bigint) guessed, coalesce(c, 0) tp, cast(guessed - coalesce(c, 0) as bigint) fp,
cast(gold - coalesce(c, 0) as bigint) fn, round(coalesce(c, 0) / guessed, 6) "precision", round(coalesce(c, 0) / gold, 6) recall,
round(2 * coalesce(c, 0) / (gold + guessed), 6) f1 from per left join hits using (t)""")
def chunk_scores_by_type(spark, folder):
    by_type = chunks.chunk_scores_by_type(I.tagged(spark, folder), hyp="pred", label="gold")
    return _rounded(by_type, "type", "gold", "guessed", "tp", "fp", "fn")


# --- n-gram scores -------------------------------------------------------------------------
def sql_overlap(tokens: str, orders) -> str:
    """Per row and order: clipped matches ``m``, possible n-grams of both sides ``th``, ``tr``."""
    parts = " union all ".join(
        f"select id, 'h' side, {n} n, unnest(list_transform(range(1, len(h) - {n - 2}), lambda i: array_to_string(h[i:i + {n - 1}], ' '))) g from toks"
        f" union all select id, 'r', {n}, unnest(list_transform(range(1, len(r) - {n - 2}), lambda i: array_to_string(r[i:i + {n - 1}], ' '))) from toks"
        for n in orders
    )
    sizes = " union all ".join(
        f"select id, {n} n, greatest(len(h) - {n - 1}, 0) th, greatest(len(r) - {n - 1}, 0) tr from toks" for n in orders
    )
    return f"""toks as ({tokens}), grams as ({parts}),
per_gram as (select id, n, g, least(sum(case when side = 'h' then 1 else 0 end), sum(case when side = 'r' then 1 else 0 end)) m
    from grams group by id, n, g),
hits as (select id, n, sum(m) m from per_gram group by id, n),
sizes as ({sizes}),
overlap as (select sizes.*, coalesce(m, 0) m from sizes left join hits using (id, n)),
total as (select n, sum(m) m, sum(th) th from overlap group by n),
lens as (select sum(len(h)) hl, sum(len(r)) rl from toks)"""


def sql_bleu(name: str) -> str:
    return f"""select round(100 * case when hl > rl then 1 else exp(1 - rl / hl) end *
    (select case when min(m) > 0 then exp(avg(ln(m / th))) else 0 end from total), 6) "{name}" from lens"""


WORD_TOKENS_SQL = f"select id, {I.sql_words('lower(hyp)')} h, {I.sql_words('lower(label)')} r from pairs"


@query("bleu_words", f"with {I.PAIRS_SQL}, {sql_overlap(WORD_TOKENS_SQL, (1, 2, 3, 4))} {sql_bleu('BLEU')}")
def bleu_words(spark, folder):
    return _rounded(B.bleu(I.pairs(spark, folder), text=F.lower))


@query("ngram_totals", f"""with {I.PAIRS_SQL}, {sql_overlap(WORD_TOKENS_SQL, (1, 2, 3, 4))}
select n, cast(sum(m) as bigint) matches, cast(sum(th) as bigint) possible, cast(sum(tr) as bigint) reference from overlap group by n""")
def ngram_totals(spark, folder):
    counts = ngram_overlap(I.pairs(spark, folder), {"w": Scheme(F.lower, B.ORDERS)}, method="group")
    row = lambda n: F.struct(
        F.lit(n).alias("n"), F.sum(f"w_m{n}").alias("matches"),
        F.sum(F.greatest(F.col("w_hyp") - (n - 1), F.lit(0))).alias("possible"),
        F.sum(F.greatest(F.col("w_ref") - (n - 1), F.lit(0))).alias("reference"),
    )
    return counts.agg(F.array(*[row(n) for n in B.ORDERS]).alias("rows")).select(F.inline("rows"))


def sql_chain(text: str, patterns) -> str:
    for pattern, replacement in patterns:
        p, r = pattern.replace("'", "''"), replacement.replace("'", "''")
        text = f"regexp_replace({text}, '{p}', '{r}', 'g')"
    return text


V13A_SQL = [
    (r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]


def sql_v13a(text: str) -> str:
    out = f"regexp_replace({text}, '{I.SPACE}$', '')"
    for old, new in [("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"),
                     ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")]:
        out = f"replace({out}, {old}, {new})"
    return I.sql_words(sql_chain(f"' ' || {out} || ' '", V13A_SQL))


SMOOTH_SQL = """s as (select n, m, th, power(2, sum(case when m = 0 then 1 else 0 end) over (order by n)) k from total),
lg as (select avg(case when min_th = 0 then -9999999999.0 when m = 0 then ln(100 / (k * th)) else ln(100 * m / th) end) l
    from (select *, min(th) over (order by n) min_th from s))"""


@query("sacrebleu", f"""with {I.PAIRS_SQL}, {sql_overlap(f"select id, {sql_v13a('hyp')} h, {sql_v13a('label')} r from pairs", (1, 2, 3, 4))},
{SMOOTH_SQL} select round(case when hl >= rl then 1 when hl = 0 then 0 else exp(1 - rl / hl) end * exp(l), 6) "SacreBLEU" from lens, lg""")
def sacrebleu(spark, folder):
    return _rounded(B.sacrebleu(I.pairs(spark, folder)))


# Treebank tokens, for an engine without look-around: single quotes before a lone letter are
# matched by listing the letters, and stops of abbreviations are hidden before the split.
TREEBANK_SQL = [
    (r"([«“‘„]|[`]+)", r" \1 "), (r'^"', "``"), (r"(``)", r" \1 "), (r"([ \(\[{<])(\"|'{2})", r"\1 `` "),
    (r"(')([a-ce-ln-ru-zA-CE-LN-RU-Z0-9_]|[^\x00-\x7f\PL])([^\pL\pN_]|$)", r"\1 \2\3"),
    (r"([^\.])(\.)([\]\)}>\"'»”’ ]*)\s*$", r"\1 \2 \3 "), (r"([:,])([^\d])", r" \1 \2"), (r"([:,])$", r" \1 "),
    (r"\.\.\.", " ... "), (r"([;@#\$%&])", r" \1 "), (r"([^\.])(\.)([\]\)}>\"']*)\s*$", r"\1 \2\3 "), (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "), (r"([\]\[\(\)\{\}<>])", r" \1 "), (r"--", " -- "),
]
TREEBANK_END_SQL = [
    (r"([»”’])", r" \1 "), (r"''", " '' "), (r'"', " '' "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
]


def sql_sentences(text: str) -> str:
    known = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|[^\\pL\\pN])((?i:{known}))\\.({I.SPACE[:-1]})', '\\1\\2' || chr(3) || '\\3', 'g')"
    marked = f"regexp_replace({text}, '([.?!][\"''\\)\\]}}»”’]*){I.SPACE}', '\\1' || chr(2), 'g')"
    return f"list_filter(string_split(replace({marked}, chr(3), '.'), chr(2)), lambda s: s <> '')"


def sql_treebank(text: str) -> str:
    inner = sql_chain(f"' ' || {sql_chain('s', TREEBANK_SQL)} || ' '", TREEBANK_END_SQL)
    return I.sql_words(f"array_to_string(list_transform({sql_sentences(text)}, lambda s: {inner}), ' ')")


@query("treebank_tokens", f"select doc_id id, array_to_string({sql_treebank('text')}, ' ') tokens from documents")
def treebank_tokens(spark, folder):
    return I.documents(spark, folder).select("id", I.joined(T.treebank_tokens(F.col("text"))).alias("tokens"))


@query("bleu", f"""with {I.PAIRS_SQL},
{sql_overlap(f"select id, {sql_treebank('hyp')} h, {sql_treebank('label')} r from pairs", (1, 2, 3, 4))} {sql_bleu('BLEU')}""")
def bleu(spark, folder):
    return _rounded(B.bleu(I.pairs(spark, folder)))


def sql_rouge_tokens(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


ROUGE_TOKENS_SQL = f"select id, {sql_rouge_tokens('hyp')} h, {sql_rouge_tokens('label')} r from pairs"
F_SQL = "case when m = 0 then 0 else 2 * (m / th) * (m / tr) / (m / th + m / tr) end"


@query("rouge_1_2", f"""with {I.PAIRS_SQL}, {sql_overlap(ROUGE_TOKENS_SQL, (1, 2))}, f as (select n, {F_SQL} f from overlap)
select round(avg(case when n = 1 then f end) * 100, 6) "ROUGE1", round(avg(case when n = 2 then f end) * 100, 6) "ROUGE2" from f""")
def rouge_1_2(spark, folder):
    return _rounded(R.rouge(I.pairs(spark, folder), kinds=("ROUGE1", "ROUGE2")))


@query("rouge_l")
def rouge_l(spark, folder):
    """No SQL twin: the LCS of whole texts is too slow there; checked by brute force in tests."""
    return _rounded(R.rouge(I.pairs(spark, folder), kinds=("ROUGEL",)))


@query("rouge_lsum")
def rouge_lsum(spark, folder):
    return _rounded(R.rouge(I.pairs(spark, folder), kinds=("ROUGELsum",)))


_P = R.PRIME


def _hex(text: str, at: int) -> str:
    return f"(('0x' || substr(md5({text}), {at}, 8))::bigint >> 1)"


@query("rouge_bootstrap", f"""with {I.PAIRS_SQL}, {sql_overlap(ROUGE_TOKENS_SQL, (1, 2))}, f as (select id, n, {F_SQL} f from overlap),
drawn_rows as (select {_hex('id::varchar', 1)} % {_P} r, max(case when n = 1 then f end) x1, max(case when n = 2 then f end) x2 from f group by id),
numbers as (select rep, {_hex("'0:' || rep", 1)} % {_P - 1} + 1 m, {_hex("'0:' || rep", 9)} % {_P} a, {_hex("'0:' || rep", 17)} % {_P - 1} + 1 m2
  from range(1, 1001) t(rep)),
mixed as (select rep, m2, x1, x2, (r * m + a) % {_P} u from drawn_rows, numbers),
drawn as (select rep, x1, x2, (xor(u, u >> 15) * m2) % {_P} x from mixed),
weighed as (select rep, x1, x2, {' + '.join(f'(x >= {step})::int' for step in R.poisson_steps())} w from drawn),
means as (select rep, sum(x1 * w) / sum(w) * 100 "ROUGE1", sum(x2 * w) / sum(w) * 100 "ROUGE2" from weighed group by rep),
long as (unpivot means on "ROUGE1", "ROUGE2" into name metric value mean)
select metric, round(quantile_cont(mean, 0.025), 6) low, round(quantile_cont(mean, 0.5), 6) mid, round(quantile_cont(mean, 0.975), 6) high
from long group by metric""")
def rouge_bootstrap(spark, folder):
    rows = R.rouge_rows(I.pairs(spark, folder), kinds=("ROUGE1", "ROUGE2"))
    return _rounded(R.bootstrap(rows, ("ROUGE1", "ROUGE2")), "metric")


@query("generation_scores")
def generation_scores(spark, folder):
    """All text-generation metrics of a table in one pass."""
    scores = bundles.score("generation", I.pairs(spark, folder))
    return scores.select("position", "metric", F.round("value", 6).alias("value"))


# --- answers -------------------------------------------------------------------------------
def sql_answer_tokens(text: str) -> str:
    bare = f"regexp_replace(lower({text}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"list_filter({I.sql_words(bare)}, lambda x: x not in ('a', 'an', 'the'))"


ANSWER_TOKENS_SQL = f"select id, {sql_answer_tokens('hyp')} h, {sql_answer_tokens('label')} r from qa_pred"


@query("exact_match", f"""with {I.QA_PRED_SQL}, toks as ({ANSWER_TOKENS_SQL})
select round(avg(case when h = r then 100.0 else 0.0 end), 6) "EM" from toks""")
def exact_match(spark, folder):
    return _rounded(answers.exact_match(I.qa_pred(spark, folder)))


@query("answer_scores", f"""with {I.QA_PRED_SQL}, {sql_overlap(ANSWER_TOKENS_SQL, (1,))},
f as (select id, case when th = 0 or tr = 0 then case when th = tr then 1 else 0 end else {F_SQL} end f from overlap)
select round((select avg(case when h = r then 100.0 else 0.0 end) from toks), 6) "EM", round(avg(f) * 100, 6) "F1" from f""")
def answer_scores(spark, folder):
    return _rounded(answers.answer_scores(I.qa_pred(spark, folder)))


# --- loss ----------------------------------------------------------------------------------
@query("masked_loss", f"""with {I.LOGITS_SQL}, p as (select unnest(steps[1:7]) l, unnest(gold[2:8]) t from logits),
l as (select list_max(l) mx, l, t from p where t <> -100)
select round(avg(mx + ln(list_sum(list_transform(l, lambda x: exp(cast(x as double) - mx)))) - l[t + 1]), 5) loss from l""")
def masked_loss(spark, folder):
    return _rounded(loss.masked_loss(I.logits(spark, folder), "steps", "gold"), places=5)
