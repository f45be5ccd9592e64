"""From task files to batches, one case per layout."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators.layouts import LayoutIds
from textloom.plans import tasks
from textloom.plans.prepare import prepare_task

WORDS = ["a", "b", "c", "d", "e", "f", "hi", "yes"]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(w, 10 + i) for i, w in enumerate(WORDS)], "token string, token_id bigint")


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")
    return str(path)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_every_task_has_a_layout(spark):
    assert {t.layout for t in tasks.TASKS.values()} == {
        "pairs", "question", "dialogue", "tags", "span", "single", "two_texts", "vector", "several",
    }
    assert tasks.task_table(spark).where("layout is null").count() == 0


def test_pairs_and_swap(spark, vocab, tmp_path):
    path = put(tmp_path, "p.json", [{"id": "1", "text": "A b", "label": "c"}, {"id": "2", "text": "d", "label": "E f a"}, {"id": "2", "text": "", "label": "b"}])
    got = [r for r in prepare_task(spark, "mt-sunibs-inzntv", path=path, vocab=vocab).orderBy("place").collect()]
    assert [r.place for r in got] == [0, 1, 2] and {r.batch_id for r in got} == {0} and [r.id for r in got] == ["1", "2", "2"]
    assert got[0].enc == [10, 11, 2, 40001] and got[0].dec == [40002, 12, 2, 1, 1]
    swapped = by_id(prepare_task(spark, "mt-sunibs-inzntv-swap", path=path, vocab=vocab).where("id = '1'"))
    assert swapped["1"].enc[:3] == [12, 2, 40002] and swapped["1"].dec[:4] == [40001, 10, 11, 2]
    with pytest.raises(Exception, match="unknown entry: b"):
        prepare_task(spark, "mt-sunibs-inzntv", path=path, vocab=vocab.where("token <> 'b'")).collect()
    gpt = prepare_task(spark, "indosum", path=path, vocab=vocab.where("token <> 'b'"), model_type="gpt2", on_unknown="unk", unknown=99)
    assert 99 in by_id(gpt)["1"].enc


def test_question_and_dialogue(spark, vocab, tmp_path):
    path = put(tmp_path, "q.json", [{"id": "1", "context": "a b", "question": "C", "label": "b"}])
    got = prepare_task(spark, "tydi-qa", path=path, vocab=vocab).head()
    assert got.enc[:5] == [10, 11, 4, 12, 2] and got.dec[1:] == [11, 2]
    path = put(tmp_path, "d.json", [{"persona": [], "dialogue": [["hi a", "yes"], ["b", "c d"]]}])
    got = by_id(prepare_task(spark, "xpersona", path=path, vocab=vocab, ids=LayoutIds(max_len=30)))
    assert got["0-0"].enc[:5] == [5, 16, 10, 2, 40002] and got["0-1"].enc[:9] == [5, 16, 10, 6, 17, 5, 11, 2, 40002]
    assert got["0-1"].dec == [40002, 12, 13, 2]


def test_labelling_layouts(spark, vocab, tmp_path):
    path = put(tmp_path, "t.txt", "a\tB-PERSON\nb\tO\n\nc\tO\n")
    got = by_id(prepare_task(spark, "ner_grit", path=path, vocab=vocab))
    assert got[0].ids == [0, 10, 11, 2] and got[0].word_index == [-1, 0, 1, -1] and got[0].label == [6, 5]
    assert got[1].ids == [0, 12, 2, 0] and got[1].mask == [1, 1, 1, 0] and got[1].label == [5, -100]
    path = put(tmp_path, "e.csv", "tweet,label\nA b,love\n")
    got = prepare_task(spark, "emotion", path=path, vocab=vocab).head()
    assert (got.ids, got.label) == ([0, 10, 11, 2], 2)
    path = put(tmp_path, "s.tsv", "a b\tneutral\n")
    assert prepare_task(spark, "document_sentiment", path=path, vocab=vocab).head().label == 1
    path = put(tmp_path, "n.csv", "id,sent_A,sent_B,label\n7,a,b c,NotEntail\n")
    got = prepare_task(spark, "entailment", path=path, vocab=vocab).head()
    assert (got.ids, got.segments, got.label) == ([0, 10, 2, 11, 12, 2], [0, 0, 0, 1, 1, 1], 0)
    path = put(tmp_path, "c.csv", "sentence,fuel,machine,others,part,price,service\na,neutral,positive,neutral,neutral,negative,neutral\n")
    got = prepare_task(spark, "absa_car", path=path, vocab=vocab).head()
    assert (got.ids, got.label) == ([0, 10, 2], [1, 2, 1, 1, 0, 1])
    path = put(tmp_path, "n.tsv", "a\tisu politik domestik,tidak berisiko\n")
    got = prepare_task(spark, "news_category", path=path, vocab=vocab).head()
    assert [i for i, x in enumerate(got.label) if x] == [5, 12]
    path = put(tmp_path, "f.csv", "question,passage,seq_label\n\"['a']\",\"['b', 'c']\",\"['O', 'B']\"\n")
    got = prepare_task(spark, "qa_factoid", path=path, vocab=vocab).head()
    assert (got.ids, got.word_index, got.segments, got.label) == ([0, 10, 2, 11, 12, 2], [-1, -1, -1, 0, 1, -1], [0, 0, 0, 1, 1, 1], [0, 1])


def test_order_and_buckets(spark, vocab, tmp_path):
    rows = [{"id": str(i), "text": " ".join(["a"] * (i % 7 + 1)), "label": "b"} for i in range(40)]
    path = put(tmp_path, "p.json", rows)
    once, again = [
        [r.id for r in prepare_task(spark, "indosum", path=path, vocab=vocab, seed=5).orderBy("batch_id", "place").collect()] for _ in range(2)
    ]
    assert once == again != [r["id"] for r in rows] and sorted(once) == sorted(r["id"] for r in rows)
    widths = lambda **o: prepare_task(spark, "indosum", path=path, vocab=vocab, seed=5, **o).agg(F.sum(F.size("enc"))).first()[0]
    assert widths(bucket=1) < widths()
