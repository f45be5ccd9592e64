"""Token and vocabulary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import text as T
from ..operators import alignment, vocab
from . import inputs as I
from .registry import query

VOCAB_SQL = f"""{I.WORDS_SQL},
vocab as (select token, row_number() over (order by token) - 1 token_id from
    (select distinct unnest({I.sql_words('lower(text)')}) token from documents))"""
N = "(select count(*) from vocab)"
LOOKUP_SQL = f"""toks as (select doc_id id, unnest({I.sql_words('lower(text)')}) token,
    generate_subscripts({I.sql_words('lower(text)')}, 1) pos from documents),
found as (select id, pos, token_id from toks join vocab using (token)),
coded as (select d.doc_id id, coalesce(list(token_id order by pos) filter (token_id is not null), []) ids
    from documents d left join found on found.id = d.doc_id group by d.doc_id)"""
ENCODED_SQL = f"{VOCAB_SQL}, {LOOKUP_SQL}"


def document_vocab(spark, folder):
    """Lower-case words of all documents with dense ids, in token order."""
    tokens = I.documents(spark, folder).select(F.explode(T.lower_words(F.col("text"))).alias("token"))
    return vocab.build_vocab(tokens)


def encoded(spark, folder):
    table = document_vocab(spark, folder)
    docs = I.documents(spark, folder)
    return vocab.encode(docs, "id", {"ids": T.lower_words(F.col("text"))}, table), table


@query("word_split", f"with {I.WORDS_SQL} select id, len(w) n_words, array_to_string(w, ' ') tokens from words")
def word_split(spark, folder):
    return I.word_table(spark, folder).select(
        "id", F.size("words").cast("bigint").alias("n_words"), I.joined(F.col("words")).alias("tokens")
    )


SPECIALS_SQL = "[" + ", ".join(f"'{s}'" for s in vocab.SPECIAL_TOKENS) + "]"


@query("vocab_with_specials", f"""with {VOCAB_SQL} select token, token_id from vocab
union all select unnest({SPECIALS_SQL}), {N} + unnest(range({len(vocab.SPECIAL_TOKENS)}))""")
def vocab_with_specials(spark, folder):
    return vocab.add_special_tokens(document_vocab(spark, folder))


@query("vocab_is_one_to_one", f"""with {VOCAB_SQL}, a as (select token from vocab group by token having count(*) > 1
union all select cast(token_id as varchar) from vocab group by token_id having count(*) > 1)
select count(*) duplicates from a""")
def vocab_is_one_to_one(spark, folder):
    return vocab.duplicate_entries(vocab.add_special_tokens(document_vocab(spark, folder))).agg(
        F.count(F.lit(1)).alias("duplicates")
    )


@query("vocab_size", f"with {VOCAB_SQL} select count(*) + {len(vocab.SPECIAL_TOKENS)} vocab_size from vocab")
def vocab_size(spark, folder):
    return vocab.vocab_size(vocab.add_special_tokens(document_vocab(spark, folder)))


def _special_ids(table):
    """Ids of <cls> and <sep>: the table ends with the special tokens, so ids follow its size."""
    n = table.agg(F.count(F.lit(1))).scalar()
    return n + vocab.SPECIAL_TOKENS.index("<cls>"), n + vocab.SPECIAL_TOKENS.index("<sep>")


@query("encode_text", f"""with {ENCODED_SQL} select id, array_to_string(ids, ' ') plain,
array_to_string(list_concat(list_concat([{N} + 5], ids), [{N} + 6]), ' ') wrapped from coded""")
def encode_text(spark, folder):
    rows, table = encoded(spark, folder)
    cls_id, sep_id = _special_ids(table)
    rows = rows.withColumns({"cls_id": cls_id, "sep_id": sep_id})
    wrapped, _ = S.encode_segments(F.col("ids"), cls_id=F.col("cls_id"), sep_id=F.col("sep_id"))
    return rows.select("id", I.joined(F.col("ids")).alias("plain"), I.joined(wrapped).alias("wrapped"))


@query("encode_by_shuffle", f"with {ENCODED_SQL} select id, array_to_string(ids, ' ') ids from coded")
def encode_by_shuffle(spark, folder):
    """The way of a vocabulary too large to broadcast: frequent words found by a mergeable summary, the others by shuffle."""
    words = T.lower_words(F.col("text"))
    found = vocab.encode(I.documents(spark, folder), "id", {"ids": words}, document_vocab(spark, folder), broadcast_bytes=0)
    return found.select("id", I.joined(F.col("ids")).alias("ids"))


@query("encode_repeated_ids", f"""with {I.REPEATED_SQL}, w as (select row_number() over () r, id, {I.sql_words('"text"')} w from repeated),
known as (select token, row_number() over (order by token) - 1 token_id from (select distinct unnest(w) token from w)),
e as (select r, list(token_id order by pos) ids from (select r, unnest(w) token, generate_subscripts(w, 1) pos from w) join known using (token) group by r)
select id, array_to_string(coalesce(ids, []), ' ') ids from w left join e using (r)""")
def encode_repeated_ids(spark, folder):
    """Rows that share an id stay rows of their own."""
    rows = I.repeated(spark, folder).select("id", T.words(F.col("text")).alias("w"))
    known = vocab.build_vocab(rows.select(F.explode("w").alias("token")))
    return vocab.encode(rows, "id", {"ids": F.col("w")}, known).select("id", I.joined(F.col("ids")).alias("ids"))


@query("encode_pair_segments", f"""with {I.QA_SQL}, l as (select id, {I.sql_lengths('question')} a,
{I.sql_lengths('context')} b from qa)
select id, array_to_string(list_concat(list_concat(list_concat([5], a), [6]), list_concat(b, [6])), ' ') ids,
repeat('0 ', len(a) + 2) || repeat('1 ', len(b)) || '1' segments,
array_to_string(list_concat(a, b), ' ') plain_ids,
array_to_string(list_concat(list_transform(a, lambda x: 0), list_transform(b, lambda x: 1)), ' ') plain_segments from l""")
def encode_pair_segments(spark, folder):
    rows = I.qa(spark, folder).select(
        "id", I.lengths(F.col("question")).alias("a"), I.lengths(F.col("context")).alias("b")
    )
    ids, segments = S.encode_segments(F.col("a"), F.col("b"), cls_id=5, sep_id=6)
    plain_ids, plain_segments = S.encode_segments(F.col("a"), F.col("b"))
    columns = {"ids": ids, "segments": segments, "plain_ids": plain_ids, "plain_segments": plain_segments}
    return rows.select("id", *[I.joined(c).alias(n) for n, c in columns.items()])


@query("decode_ids", f"with {I.WORDS_SQL} select doc_id id, array_to_string({I.sql_words('lower(text)')}, ' ') text from documents")
def decode_ids(spark, folder):
    rows, table = encoded(spark, folder)
    return vocab.decode(rows, "id", F.col("ids"), table)


@query("decode_without_specials", f"""with {I.WORDS_SQL} select doc_id id,
array_to_string({I.sql_words('lower(text)')}, ' ') text from documents""")
def decode_without_specials(spark, folder):
    rows, table = encoded(spark, folder)
    wrapped = S.wrap_sentence(F.col("ids"), start_id=-5, end_id=-6)
    return vocab.decode(rows, "id", S.remove_ids(wrapped, [-5, -6]), table)


# Stand-in sub-words: pieces of up to four characters, coded by place and length.
def pieces(words):
    return F.transform(
        F.transform(words, F.length),
        lambda n: F.transform(
            F.sequence(F.lit(1), n, F.lit(4)),
            lambda p: (p * 10 + F.least(F.lit(4), n - p + 1)).cast("bigint"),
        ),
    )


def sql_pieces(words: str) -> str:
    return f"""list_transform({words}, lambda w: list_transform(range(1, length(w) + 1, 4),
        lambda p: p * 10 + length(substr(w, p, 4))))"""


def sql_spread(pieces_: str) -> str:
    return f"flatten(list_transform({pieces_}, lambda p, i: list_transform(p, lambda q: i - 1)))"


@query("word_alignment", f"""with {I.WORDS_SQL}, p as (select id, {sql_pieces('w')} p from words)
select id, array_to_string(list_concat(list_concat([1], flatten(p)), [2]), ' ') ids,
array_to_string(list_concat(list_concat([-1], {sql_spread('p')}), [-1]), ' ') word_index from p""")
def word_alignment(spark, folder):
    rows = I.word_table(spark, folder).select("id", pieces(F.col("words")).alias("p"))
    ids, index = alignment.align_words(F.col("p"), 1, 2)
    return rows.select("id", I.joined(ids).alias("ids"), I.joined(index).alias("word_index"))


def qa_pieces(spark, folder):
    return I.qa(spark, folder).select(
        "id", pieces(T.words(F.col("question"))).alias("q"), pieces(T.words(F.col("context"))).alias("p"),
        T.words(F.col("context")).alias("passage"),
    )


QA_PIECES_SQL = f"""{I.QA_SQL}, qa_pieces as (select id, {sql_pieces(I.sql_words('question'))} q,
    {sql_pieces(I.sql_words('context'))} p, {I.sql_words('context')} passage from qa)"""
QA_IDS_SQL = "list_concat(list_concat(list_concat([1], flatten(q)), [2]), list_concat(flatten(p), [2]))"
QA_INDEX_SQL = f"list_concat(list_concat(list_transform(range(len(flatten(q)) + 2), lambda z: -1), {sql_spread('p')}), [-1])"
QA_SEGMENTS_SQL = """list_concat(list_transform(range(len(flatten(q)) + 2), lambda z: 0),
    list_transform(range(len(flatten(p)) + 1), lambda z: 1))"""


@query("question_alignment", f"""with {QA_PIECES_SQL} select id, array_to_string({QA_IDS_SQL}, ' ') ids,
array_to_string({QA_INDEX_SQL}, ' ') word_index, array_to_string({QA_SEGMENTS_SQL}, ' ') segments from qa_pieces""")
def question_alignment(spark, folder):
    ids, index, segments = alignment.align_question_passage(F.col("q"), F.col("p"), 1, 2)
    return qa_pieces(spark, folder).select(
        "id", I.joined(ids).alias("ids"), I.joined(index).alias("word_index"), I.joined(segments).alias("segments")
    )


@query("pieces_to_text", f"""with {I.WORDS_SQL} select id, array_to_string(w, ' ') text from words""")
def pieces_to_text(spark, folder):
    rows = I.word_table(spark, folder)
    # A piece per four characters; the first piece of a word carries the marker.
    marked = F.flatten(F.transform(
        "words",
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w), F.lit(4)),
            lambda p: F.concat(F.when(p == 1, "▁").otherwise(""), F.substr(w, p, F.lit(4))),
        ),
    ))
    return rows.select("id", T.pieces_to_text(marked).alias("text"))


WRAPS_SQL = f"""{I.QA_SQL}, l as (select id, {I.sql_lengths('question')} a, {I.sql_lengths('context')} b from qa),
w as (select id, a, b, list_concat(list_concat([0], a), [2]) s,
    list_concat(list_concat(list_concat([0], a), [2, 2]), list_concat(b, [2])) sp,
    list_concat(list_concat([40001], a), [2]) t, list_concat(list_concat([40002], a), list_concat(b, [2])) tp from l),
m as (select *, list_transform(a, lambda x: 0) za, list_transform(b, lambda x: 0) zb from w)"""


def _wrap_rows(spark, folder):
    return I.qa(spark, folder).select(
        "id", I.lengths(F.col("question")).alias("a"), I.lengths(F.col("context")).alias("b")
    )


@query("wrap_sentence", f"""with {WRAPS_SQL} select id, array_to_string(s, ' ') single, array_to_string(sp, ' ') pair,
array_to_string(list_concat(list_concat([1], za), [1]), ' ') single_mask,
array_to_string(list_concat(list_concat(list_concat([1], za), [1, 1]), list_concat(zb, [1])), ' ') pair_mask,
array_to_string(list_transform(sp, lambda x: case when x in (0, 2) then 1 else 0 end), ' ') found_mask,
array_to_string(list_transform(sp, lambda x: 0), ' ') segments from m""")
def wrap_sentence(spark, folder):
    a, b = F.col("a"), F.col("b")
    pair = S.wrap_sentence(a, b)
    columns = {
        "single": S.wrap_sentence(a), "pair": pair, "single_mask": S.wrap_sentence_mask(a),
        "pair_mask": S.wrap_sentence_mask(a, b), "found_mask": S.special_mask(pair), "segments": S.zero_segments(pair),
    }
    return _wrap_rows(spark, folder).select("id", *[I.joined(c).alias(n) for n, c in columns.items()])


@query("wrap_language", f"""with {WRAPS_SQL} select id, array_to_string(t, ' ') single, array_to_string(tp, ' ') pair,
array_to_string(list_concat(list_concat([1], za), [1]), ' ') single_mask,
array_to_string(list_concat(list_concat(list_concat([1], za), zb), [1]), ' ') pair_mask from m""")
def wrap_language(spark, folder):
    a, b = F.col("a"), F.col("b")
    columns = {
        "single": S.wrap_language(a, language_id=40001), "pair": S.wrap_language(a, b, language_id=F.lit(40002)),
        "single_mask": S.wrap_language_mask(a), "pair_mask": S.wrap_language_mask(a, b),
    }
    return _wrap_rows(spark, folder).select("id", *[I.joined(c).alias(n) for n, c in columns.items()])


@query("seq2seq_inputs", f"""with {I.ID_PAIRS_SQL} select id, array_to_string(list_concat(list_concat([250005], x), [2]), ' ') input_ids,
array_to_string(list_concat(list_concat([250032], y), [2]), ' ') labels from id_pairs""")
def seq2seq_inputs(spark, folder):
    columns = S.seq2seq_inputs(F.col("x"), F.col("y"), source_language=250005, target_language=250032)
    return I.id_pairs(spark, folder).select("id", *[I.joined(c).alias(n) for n, c in columns.items()])


def _vectors(spark, folder):
    """Vectors of the words seen in a document whose number is a vector number."""
    words = I.documents(spark, folder).select("id", F.explode(T.lower_words(F.col("text"))).alias("token"))
    last = words.groupBy("token").agg(F.max("id").alias("id"))
    vectors = I.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return last.join(vectors, "id").select("token", F.col("id").alias("line"), F.col("embedding").alias("vector"))


VECTORS_SQL = f"""{VOCAB_SQL}, last as (select token, max(id) id from
    (select doc_id id, unnest({I.sql_words('lower(text)')}) token from documents) group by token),
vectors as (select token, embedding from last join embeddings e on e.vec_id = last.id)"""


@query("embedding_coverage", f"""with {VECTORS_SQL} select count(v.token) known, count(*) total,
round(count(v.token) * 100.0 / count(*), 6) percent from vocab left join vectors v using (token)""")
def embedding_coverage(spark, folder):
    embedded = vocab.embed_vocab(document_vocab(spark, folder), _vectors(spark, folder), 64)
    return vocab.embedding_coverage(embedded).select("known", "total", F.round("percent", 6).alias("percent"))


@query("embedding_matrix", f"""with {VECTORS_SQL} select token, token_id, v.token is not null known,
case when v.token is not null then round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) end vector_sum
from vocab left join vectors v using (token)""")
def embedding_matrix(spark, folder):
    embedded = vocab.embed_vocab(document_vocab(spark, folder), _vectors(spark, folder), 64)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    inside = F.forall("vector", lambda x: (x >= 0) & (x < 1)) & (F.size("vector") == 64)
    checked = F.when(F.col("known"), F.round(total, 4)).when(~inside, -1.0)
    return embedded.select("token", "token_id", "known", checked.alias("vector_sum"))
