import os
import json

import pytest
from pyspark.sql import functions as F

from textloom.catalogue import files
from textloom.plans import tasks
from textloom.sources import readers, sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def sentences(df):
    return [(r.id, r.tokens, r.tags) for r in df.orderBy("id").collect()]


def test_json_readers(spark, tmp_path):
    data = [{"id": "a", "text": "x\ny", "label": "z", "more": 1}, {"id": "b", "text": "p", "label": "q"}]
    path = put(tmp_path, "p.json", json.dumps(data, indent=1))
    assert [tuple(r) for r in readers.read_parallel(spark, path).orderBy("id").collect()] == [("a", "x\ny", "z"), ("b", "p", "q")]
    out = str(tmp_path / "once")
    readers.convert_once(readers.read_parallel(spark, path), out)
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        readers.convert_once(readers.read_parallel(spark, path), out)
    qa = put(tmp_path, "q.json", json.dumps([{"id": "1", "context": "c", "question": "d", "label": "e"}]))
    assert tuple(readers.read_questions(spark, qa).head()) == ("1", "c", "d", "e")
    talk = put(tmp_path, "d.json", json.dumps([
        {"persona": ["i like tea"], "dialogue": [["hi", "hello"], ["how", "well"]]}, {"persona": [], "dialogue": [["a", "b"]]},
    ]))
    df = readers.read_dialogues(spark, talk)
    assert df.columns == ["conv_id", "dialogue"]
    turns = tasks.read_task(spark, "xpersona", "test", talk).orderBy("conv_id", "k")
    assert [tuple(r) for r in turns.collect()] == [
        (0, 0, "0-0", "hi", "hello"), (0, 1, "0-1", "how", "well"), (1, 0, "1-0", "a", "b"),
    ]


TAGGED = "Budi\tB-PER\nada\tO\n\nIni\tO\n \t \nItu\tO\n\n\nx\tO\n"


def test_tagged(spark, tmp_path):
    path = put(tmp_path, "t.txt", TAGGED)
    want = [(0, ["Budi", "ada"], ["B-PER", "O"]), (1, ["Ini"], ["O"]), (2, ["Itu"], ["O"]), (3, ["x"], ["O"])]
    assert sentences(readers.read_tagged(spark, path)) == want
    assert sentences(readers.read_tagged(spark, path, strict_tail=True)) == want[:3]
    closed = put(tmp_path, "c.txt", "a\tO\n\nb\tO\n\n")
    assert len(sentences(readers.read_tagged(spark, closed, strict_tail=True))) == 2
    spaced = put(tmp_path, "s.txt", "a\tO\n\nb\tO\n \n")
    assert len(sentences(readers.read_tagged(spark, spaced, strict_tail=True))) == 2
    bare = put(tmp_path, "b.txt", "a\tO\n\nb\tO")
    assert len(sentences(readers.read_tagged(spark, bare, strict_tail=True))) == 1
    windows = put(tmp_path, "w.txt", TAGGED.replace("\n", "\r\n"))
    assert sentences(readers.read_tagged(spark, windows, newline="\r\n")) == want


def test_tagged_any_break(spark, tmp_path):
    path = put(tmp_path, "t.txt", "a\tO\nno tab\nb\tB-ASPECT\n\n\nc\tO\nend")
    want = [(0, ["a"], ["O"]), (1, ["b"], ["B-ASPECT"]), (2, ["c"], ["O"])]
    assert sentences(readers.read_tagged(spark, path, any_break=True)) == want
    assert sentences(readers.read_tagged(spark, path, any_break=True, strict_tail=True)) == want
    long = put(tmp_path, "long.txt", "a\tO\n" + "no tab\n" * 50_000 + "b\tO\n")
    assert [r[1] for r in sentences(readers.read_tagged(spark, long, any_break=True))] == [["a"], ["b"]]
    blank = put(tmp_path, "blank.txt", "a\tO\n" + " \n" * 50_000 + "b\tO\n")
    assert [r[1] for r in sentences(readers.read_tagged(spark, blank))] == [["a"], ["b"]]
    rows = tasks.read_task(spark, "aspect_extraction", "train", path).orderBy("id").collect()
    assert [r.seq_label for r in rows] == [[1], [4], [1]]


def test_tagged_any_break_over_splits(spark, tmp_path):
    """A file without a blank line is no single chunk; sentences cross splits, and the last one of a file may lack its end."""
    folder = tmp_path / "any"
    folder.mkdir()
    want, files = [], []
    for part in range(3):
        text = "start\n" if part == 1 else ""
        for n in range(40):
            words = [f"w{part}.{n}.{k}" for k in range(n % 7 + 1)]
            want.append(words)
            text += "".join(f"{w}\tO\n" for w in words) + ("" if n == 39 else "end of\nsentence\n" if n % 3 else "\n")
        files.append(put(folder, f"{part}.txt", text))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.read_tagged(spark, str(folder), any_break=True)
            assert [(i, t) for i, t, _ in sentences(rows)] == list(enumerate(want))
            ended = readers.read_tagged(spark, str(folder), any_break=True, strict_tail=True)
            assert [(i, t) for i, t, _ in sentences(ended)] == list(enumerate(w for n, w in enumerate(want) if n % 40 != 39))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert readers.read_tagged(spark, files[0], any_break=True).tail(1)[0].tokens


def test_tagged_over_many_splits(spark, tmp_path):
    text = "".join(f"w{i}\tO\nv{i}\tB\n\n" for i in range(4000))
    path = put(tmp_path, "big.txt", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sentences(readers.read_tagged(spark, path))
        vocab = put(tmp_path, "v.txt", "".join(f"t{i}\n" for i in range(5000)) + "t3\n")
        ids = {r.token: r.token_id for r in readers.read_vocab(spark, vocab).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, [f"w{i}", f"v{i}"], ["O", "B"]) for i in range(4000)]
    assert ids == {**{f"t{i}": i for i in range(5000)}, "t3": 5000}


def test_delimited(spark, tmp_path):
    path = put(tmp_path, "e.csv", 'tweet,label\n"a ""b"", c\nd",love\nx,fear\n')
    got = tasks.read_task(spark, "emotion", "train", path).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, 'a "b", c\nd', "love", 2), (1, "x", "fear", 3)]
    path = put(tmp_path, "n.csv", "id,sent_A,sent_B,label\n7,a,b,NotEntail\n")
    assert tuple(tasks.read_task(spark, "entailment", "train", path).head()) == (0, "a", "b", "NotEntail", 0)
    path = put(tmp_path, "s.tsv", "good one\tpositive\nbad, one\tnegative\n")
    got = tasks.read_task(spark, "document_sentiment", "train", path).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "good one", "positive", 0), (1, "bad, one", "negative", 2)]
    path = put(tmp_path, "n.tsv", "t\tisu politik domestik,tidak berisiko\n")
    assert tasks.read_task(spark, "news_category", "train", path).head().label_indices == [5, 12]
    path = put(tmp_path, "c.csv", "sentence,fuel,machine,others,part,price,service\ns,neutral,positive,neutral,neutral,negative,neutral\n")
    assert tasks.read_task(spark, "absa_car", "train", path).head().label_indices == [1, 2, 1, 1, 0, 1]
    path = put(tmp_path, "f.csv", "question,passage,seq_label\n" + '"[\'who\', \'?\']","[""it\'s"", \'me\']","[\'O\', \'B\']"\n')
    got = tasks.read_task(spark, "qa_factoid", "train", path).head()
    assert (got.question, got.passage, got.label_indices) == (["who", "?"], ["it's", "me"], [0, 1])
    bad = put(tmp_path, "bad.csv", "tweet,label\nx,joy\n")
    with pytest.raises(Exception, match="unknown label: joy"):
        tasks.read_task(spark, "emotion", "train", bad).collect()


def test_vectors(spark, tmp_path):
    path = put(tmp_path, "v.vec", "3 2\na 1 2\nb 3\na 5 6\n")
    good, bad = readers.read_vectors(spark, path, 2)
    assert [tuple(r) for r in good.orderBy("line").collect()] == [("a", 1, [1.0, 2.0]), ("a", 3, [5.0, 6.0])]
    assert [tuple(r) for r in bad.collect()] == [(2, "b", 2)]


def test_splits(spark, tmp_path):
    paths = {s: put(tmp_path, f"{s}.json", json.dumps([{"id": s, "text": "a", "label": "b"}])) for s in ("train", "valid", "test")}
    df = readers.read_splits(spark, tasks.task("indosum"), paths)
    out = str(tmp_path / "splits")
    sinks.write_splits(df, out)
    back = spark.read.parquet(out).where("split = 'valid'")
    assert back.head().id == "valid" and back.count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "x"\nnow', "b"), (1, "c", "d")], "id bigint, hyp string, label string")
    out = str(tmp_path / "pred")
    sinks.write_predictions(df, out)
    read = lambda p: spark.read.option("multiLine", True).option("escape", '"').csv(p, header=True)
    assert sorted(map(tuple, read(out).collect())) == [("1", "c", "d"), ("2", 'say "x"\nnow', "b")]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_predictions(df, out)
    sinks.write_predictions(df, out, overwrite=True)
    for single in (True, False):
        target = str(tmp_path / f"sub{single}")
        sinks.write_submission(df, target, ["id"], ["hyp"], single_file=single)
        assert [tuple(r) for r in read(target).orderBy("index").collect()] == [("0", "c"), ("1", 'say "x"\nnow')]
    metrics = spark.createDataFrame([("F1", 0.5)], "metric string, value double")
    for penalty in (1.5, 2.0):
        sinks.write_metric_summary(metrics, str(tmp_path / "m"), length_penalty=penalty)
    back = spark.read.csv(str(tmp_path / "m"), header=True)
    assert sorted(r.length_penalty for r in back.collect()) == [1.5, 2.0]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_metric_summary(metrics, str(tmp_path / "m"), length_penalty=1.5)
    sinks.write_metric_summary(metrics, str(tmp_path / "m2"))
    sinks.write_vocab(spark.createDataFrame([("a", 0)], "token string, token_id bigint"), str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).head().asDict() == {"token": "a", "token_id": 0}


# --- task registry -------------------------------------------------------------------------
def test_registry(spark):
    generation = [t for t in tasks.TASKS.values() if t.metrics in ("generation", "answers")]
    assert len(generation) == 17 and sum(t.swap for t in generation) == 6
    swapped = tasks.task("mt-javnrf-inzntv-swap")
    assert (swapped.source_language, swapped.target_language, swapped.target_code) == ("[indonesia]", "[java]", "jv_JV")
    assert tasks.task("liputan6_xtreme").selection == "BLEU" and tasks.task("tydi-qa").selection == "F1"
    assert tasks.task_table(spark).count() == len(tasks.TASKS)
    assert {k: len(v) for k, v in tasks.LABELS.items()} == {
        "aspect_extraction": 5, "ner_grit": 7, "ner_prosa": 11, "pos_idn": 41, "pos_prosa": 26, "emotion": 5, "entailment": 2,
        "document_sentiment": 3, "keyword_extraction": 3, "qa_factoid": 3, "absa_hotel": 4, "absa_car": 3, "news_category": 16,
    }
    assert tasks.markers("baseline-mbart") == tasks.Markers(2, 250055, 250056)
    assert tasks.markers("baseline-mt5").separator == 3
    assert tasks.language_id("[sundanese]") == tasks.language_id("[sunda]") == 40001
    assert tasks.language_code_ids(250000)["<speaker_2>"] == 250056
    assert tasks.language_id_table(spark, 250000).where("code = 'id_ID'").head().language_id == 250032
    for call in (lambda: tasks.task("x"), lambda: tasks.markers("elmo"), lambda: tasks.language_id("[x]"),
                 lambda: tasks.read_task(spark, "emotion", "train")):
        with pytest.raises(ValueError):
            call()


def test_run_task(spark, tmp_path):
    data = [{"id": "1", "text": "Satu dua tiga empat", "label": "ONE two three four"}]
    path = put(tmp_path, "t.json", json.dumps(data))
    hyp = spark.createDataFrame([("1", "one two three four")], "id string, hyp string")
    got = {r.metric: r.value for r in tasks.run_task(spark, "mt-ted-multi", hyp, path).collect()}
    assert got["BLEU"] == pytest.approx(100) and got["ROUGEL"] == pytest.approx(100)
    hyp = spark.createDataFrame([("1", "satu dua tiga empat")], "id string, hyp string")
    got = {r.metric: r.value for r in tasks.run_task(spark, "mt-ted-multi-swap", hyp, path).collect()}
    assert got["SacreBLEU"] == pytest.approx(100)
    qa = put(tmp_path, "q.json", json.dumps([{"id": "1", "context": "c", "question": "d", "label": "The Cat"}]))
    hyp = spark.createDataFrame([("1", "cat")], "id string, hyp string")
    assert {r.metric: r.value for r in tasks.run_task(spark, "tydi-qa", hyp, qa).collect()} == {"EM": 100, "F1": 100}
    labels = spark.createDataFrame([(1, "a", "a"), (2, "b", "a")], "id bigint, hyp string, label string")
    assert {r.metric: r.value for r in tasks.score_predictions("emotion", labels).collect()}["ACC"] == 0.5


LABELLING = ["aspect_extraction", "ner_grit", "ner_prosa", "pos_idn", "pos_prosa", "keyword_extraction", "qa_factoid", "emotion",
             "entailment", "document_sentiment", "absa_hotel", "absa_car", "news_category"]


@pytest.mark.parametrize("name", LABELLING)
def test_run_labelling_task(spark, tmp_path, name):
    t = tasks.task(name)
    first, second = t.labels[0], t.labels[1]
    text = {
        "tagged": f"a\t{first}\nb\t{second}\n\n", "tagged_any_break": f"a\t{first}\nb\t{second}\n\n",
        "factoid": f"question,passage,seq_label\n\"['q']\",\"['a', 'b']\",\"['{first}', '{second}']\"\n",
        "emotion": f"label,tweet\n{first},a\n", "entailment": f"sent_A,sent_B,label\na,b,{first}\n",
        "sentiment": f"a\t{first}\n", "news": f"a\t\"{first},{second}\"\n",
    }.get(t.reader) or f"review,sentence,{','.join(t.aspects)}\na,b,{','.join([first] * len(t.aspects))}\n"
    path = put(tmp_path, "t.txt", text)
    gold = tasks.read_task(spark, name, "test", path).select("id", tasks.gold_labels(t).alias("hyp"))
    assert gold.count() == 1
    got = {r.metric: r.value for r in tasks.run_task(spark, name, gold, path).collect()}
    assert got["ACC"] == 1 and set(got) == {"ACC", "F1", "REC", "PRE"}
    missing = {r.metric: r.value for r in tasks.run_task(spark, name, gold.where("false"), path).collect()}
    assert missing["ACC"] < 1


def test_register(spark):
    tasks.register_task(tasks.Task("mine", "mine", "classes", "F1", {"test": "nowhere"}))
    tasks.register_reader("mine", lambda s, path, task: s.createDataFrame([(1, path)], "id bigint, p string"))
    assert tasks.read_task(spark, "mine", "test").head().p == "nowhere"


def test_json_arrays_bound_the_batches_of_their_tasks(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for step in (lambda: sinks.write_json_array(spark.range(9), str(tmp_path / "j")), lambda: readers.read_parallel(spark, str(tmp_path / "j")).count()):
        try:
            spark.conf.set(key, "10000")
            step()
            assert int(spark.conf.get(key)) <= 1000
        finally:
            spark.conf.set(key, before)


def test_tagged_ids_over_as_many_files_as_the_shuffle(spark, tmp_path, monkeypatch):
    rows = [(i, f"w{i} word again") for i in range(64)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(files, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert tuple(files.tagged_file_ids(spark, str(tmp_path)).first()) == (64, 64, 0, 63)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(list((tmp_path / "tagged").glob("part-*"))) == 7


def test_rows_are_numbered_where_they_are_read(spark, tmp_path):
    """No row is shuffled for its number, whatever the splits; compressed files are read as well."""
    from textloom.sources import files

    for n, name in enumerate(["a", "b", "c"]):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(40 + n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "70")
        odd = (F.substring("value", -1, 1).cast("int") % 2 == 1)
        rows = files.number_rows(files.mark_position(spark.read.text(str(tmp_path))), "line", odds=odd)
        got = sorted((r.line, r.value, r.odds) for r in rows.where("value not like 'a1%'").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    lines = [f"{name}{i}" for n, name in enumerate("abc") for i in range(40 + n)]
    want = [(k, v, sum(int(x[-1]) % 2 for x in lines[:k])) for k, v in enumerate(lines) if not v.startswith("a1")]
    assert got == want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Window [") == 1
    path = str(tmp_path / "packed")
    packed = spark.createDataFrame([(str(i), "t\n}", "l" * i) for i in range(30)], "id string, text string, label string").repartition(3)
    sinks.write_json_array(packed, path, compression="gzip")
    assert all(f.endswith(".gz") for f in os.listdir(path) if f.startswith("part-"))
    assert sorted(readers.read_parallel(spark, path).collect()) == sorted(packed.collect())
