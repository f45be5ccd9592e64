import pytest
from pyspark.sql import functions as F

from textloom.functions import labels as L
from textloom.functions import sequences as S
from textloom.functions import text as T
from textloom.operators import alignment
from textloom.operators.literals import parse_any_list_literal


def value(spark, column, **data):
    df = spark.range(1)
    for name, v in data.items():
        df = df.withColumn(name, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]))
    return df.select(column.alias("v")).head().v


def test_labels(spark):
    names = ["a", "b", "c"]
    assert value(spark, L.label_to_index(F.col("x"), names), x="c") == 2
    assert value(spark, L.label_to_index(F.col("x"), names, "null"), x="q") is None
    assert value(spark, L.label_to_index(F.col("x"), names, "unk", 9), x="q") == 9
    with pytest.raises(Exception, match="unknown label: q"):
        value(spark, L.label_to_index(F.col("x"), names), x="q")
    with pytest.raises(ValueError):
        L.label_to_index(F.col("x"), names, "what")
    assert value(spark, L.index_to_label(F.col("x"), names), x=1) == "b"
    assert value(spark, L.multi_label_to_indices(F.col("x"), names), x="c,a") == [2, 0]
    assert value(spark, L.multi_hot(F.col("x"), 4), x=[3, 1]) == [0, 1, 0, 1]
    assert value(spark, L.unknown_label(F.col("x"), names), x="q") == "q"
    assert value(spark, L.unknown_label(F.col("x"), names), x="a") is None


@pytest.mark.parametrize("text, tokens", [
    ("Hello, world.", ["Hello", ",", "world", "."]),
    ("They'll save and invest more.", ["They", "'ll", "save", "and", "invest", "more", "."]),
    ("hi, my name can't hello,", ["hi", ",", "my", "name", "ca", "n't", "hello", ","]),
    ("Good muffins cost $3.88 in New York.", ["Good", "muffins", "cost", "$", "3.88", "in", "New", "York", "."]),
    ('He said "no (really)" twice.', ["He", "said", "``", "no", "(", "really", ")", "''", "twice", "."]),
    ("I cannot; gonna -- wait... ok?", ["I", "can", "not", ";", "gon", "na", "--", "wait", "...", "ok", "?"]),
    ("One. Two! Three?", ["One", ".", "Two", "!", "Three", "?"]),
    ("Dr. Who met Mr. X. Then left.", ["Dr.", "Who", "met", "Mr.", "X", ".", "Then", "left", "."]),
    ("at 3:45, 1,000 left: done", ["at", "3:45", ",", "1,000", "left", ":", "done"]),
    ("", []),
])
def test_treebank(spark, text, tokens):
    assert value(spark, T.treebank_tokens(F.col("x")), x=text) == tokens


@pytest.mark.parametrize("text, tokens", [
    ("Hello, world.", ["Hello", ",", "world", "."]),
    ("1,000.5 and 3-4", ["1,000.5", "and", "3", "-", "4"]),
    ("a&quot;b&amp;c", ["a", '"', "b", "&", "c"]),
    ("line-\nbreak\nnext <skipped>x", ["linebreak", "next", "x"]),
])
def test_v13a(spark, text, tokens):
    assert value(spark, T.v13a_tokens(F.col("x")), x=text) == tokens


def test_v13a_needs_no_pattern_in_the_row(spark):
    """Its patterns run on whole batches, in one function for all texts of a table."""
    df = spark.createDataFrame([("x.\u2003\n", "a,b"), (None, "")], "x string, y string")
    found = df.select(T.v13a_text(F.col("x")).alias("x"), T.v13a_text(F.col("y")).alias("y"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("ArrowEvalPython") == 1
    assert [[t and t.split() for t in r] for r in found.collect()] == [[["x", "."], ["a", ",", "b"]], [None, []]]


def test_normalisers(spark):
    assert value(spark, T.rouge_tokens(F.col("x")), x="Été: it's 3-fold!") == ["t", "it", "s", "3", "fold"]
    assert value(spark, T.normalise_answer(F.col("x")), x="The cat, a  hat.") == "cat hat"
    assert value(spark, T.words(F.col("x")), x=" a b\x1cc\n") == ["a", "b", "c"]
    assert value(spark, T.pieces_to_text(F.col("x")), x=["▁he", "llo", "▁you"]) == "hello you"
    assert value(spark, T.word_pair_text(F.col("x"), F.col("y")), x=["a", "b"], y=["c"]) == "a b|c"


@pytest.mark.parametrize("cell, items", [
    ("['a', 'b c']", ["a", "b c"]), ('["a","b"]', ["a", "b"]), ("[]", []), (" [ 'x' , ] ", ["x"]),
    ("""["it's", 'b']""", ["it's", "b"]), (r"['a\'b']", ["a'b"]), ("no list", None), ("__import__('os')", None),
])
def test_list_literals(spark, cell, items):
    assert value(spark, parse_any_list_literal(F.col("x")), x=cell) == items


def test_tokenizer_registry(spark):
    T.register_tokenizer("letters", lambda c: F.split(c, ""))
    assert value(spark, T.tokenizer("letters")(F.col("x")), x="ab")[:2] == ["a", "b"]
    assert value(spark, T.tokenizer("v13a")(F.col("x")), x="a,b") == ["a", ",", "b"]
    with pytest.raises(ValueError):
        T.tokenizer("none")


def test_long_list_literal(spark):
    words = [f"w{i}" for i in range(20000)]
    assert value(spark, T.parse_list_literal(F.col("x")), x=repr(words)) == words


def test_wrapping(spark):
    a, b = F.col("a"), F.col("b")
    run = lambda c: value(spark, c, a=[7], b=[8])
    assert run(S.wrap_sentence(a)) == [0, 7, 2]
    assert run(S.wrap_sentence(a, b)) == [0, 7, 2, 2, 8, 2]
    assert run(S.wrap_sentence_mask(a)) == [1, 0, 1]
    assert run(S.wrap_sentence_mask(a, b)) == [1, 0, 1, 1, 0, 1]
    assert run(S.wrap_language(a, b, language_id=5)) == [5, 7, 8, 2]
    assert run(S.wrap_language_mask(a, b)) == [1, 0, 0, 1]
    assert run(S.special_mask(S.wrap_sentence(a))) == [1, 0, 1]
    assert run(S.zero_segments(S.wrap_sentence(a, b))) == [0] * 6
    assert run(S.join_with_separator(a, 4, b)) == [7, 4, 8]
    assert run(S.remove_ids(S.wrap_sentence(a), [0, 2])) == [7]


def test_segments(spark):
    ids, segments = S.encode_segments(F.col("a"), F.col("b"), cls_id=5, sep_id=6)
    assert value(spark, ids, a=[1, 2], b=[3]) == [5, 1, 2, 6, 3, 6]
    assert value(spark, segments, a=[1, 2], b=[3]) == [0, 0, 0, 0, 1, 1]
    ids, segments = S.encode_segments(F.col("a"))
    assert value(spark, segments, a=[1, 2]) == [0, 0]


def test_alignment(spark):
    df = spark.sql("select array(array(10, 11), array(12)) q, array(array(13), array(14, 15)) p")
    ids, index = alignment.align_words(F.col("p"), 1, 2)
    assert list(df.select(ids, index).head()) == [[1, 13, 14, 15, 2], [-1, 0, 1, 1, -1]]
    ids, index, segments = alignment.align_question_passage(F.col("q"), F.col("p"), 1, 2)
    assert list(df.select(ids, index, segments).head()) == [
        [1, 10, 11, 12, 2, 13, 14, 15, 2], [-1, -1, -1, -1, -1, 0, 1, 1, -1], [0, 0, 0, 0, 0, 1, 1, 1, 1],
    ]


def test_projections_on_a_stream(spark, tmp_path):
    """Column functions are stateless, so they also run on a stream."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "The cat.", "label": "b"}\n{"text": "A dog", "label": "a"}\n')
    stream = spark.readStream.schema("text string, label string").json(str(tmp_path / "in"))
    out = stream.select(
        L.label_to_index(F.col("label"), ["a", "b"]).alias("i"), T.normalise_answer(F.col("text")).alias("t")
    )
    q = out.writeStream.format("memory").queryName("projected").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("projected").collect())) == [(0, "dog"), (1, "cat")]


def test_a_list_is_split_once(spark):
    """what the parser finds out on the way is not worked out again for every use."""
    plan = spark.range(1).select(T.parse_list_literal(F.col("id").cast("string")).alias("p"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("split(") == 1 and text.count("regexp_replace(") == 1


@pytest.mark.parametrize("cell", [
    "['a', 'b'],", "['a',]", "['a' , \"it's\"\t]", "[]", "[ ]", "['a' 'b']", "['']", "[\"a\\\"b\", 'c\\\\']", "['\\n']", "['a', 3]",
    "['''a''']", "['a\nb']", "['a',\n 'b']", "['a', # x\n 'b']", "[['a']]", "['a\\", "['a\"]", "['a',, 'b']", "['é ']",
])
def test_plain_strings_are_read_as_literals(cell):
    """the short way either gives what the literal means or leaves the cell to the long one."""
    import ast

    from textloom.operators.literals import _strings

    found = _strings(cell)
    if found is not None:
        assert found == list(ast.literal_eval(cell))
    assert (found is not None) == (cell in {"['a',]", "['a' , \"it's\"\t]", "[]", "['']", "[\"a\\\"b\", 'c\\\\']", "['a',\n 'b']", "['é ']"})


def test_joined_without_a_function_per_element(spark):
    from textloom.catalogue.inputs import joined

    df = spark.sql("select array(1L, null, -3L) a, array(1.5D, 1e20D, double('nan')) b, array('x', '', null) c, cast(null as array<int>) d, cast(array() as array<float>) e")
    out = df.select(*[joined(F.col(c)).alias(c) for c in df.columns])
    assert tuple(out.head()) == ("1 -3", "1.5 1.0E20 NaN", "x ", None, "")
    assert "lambda" not in out._jdf.queryExecution().toString()


def test_pieces_from_lengths_alone(spark):
    from textloom.catalogue.tokens import pieces

    df = spark.createDataFrame([(1, ["a", "abcd", "abcde", "é😀x", "x" * 12]), (2, []), (3, None)], "id int, w array<string>")
    out = df.select("id", pieces(F.col("w")).alias("p")).sort("id")
    assert [r.p for r in out.collect()] == [[[11], [14], [14, 51], [13], [14, 54, 94]], [], None]
    assert "substr" not in out._jdf.queryExecution().toString()
