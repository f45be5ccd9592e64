"""Records of files read in splits, beside whole-file parsers, with splits at every place."""

import csv
import io
import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from textloom.sources import readers, records, sinks

HARD = ["plain", "", "a } b", "{[\"x\"]}", 'say "hi"', "back\\slash", "\\", '\\"}', "line\nbreak", "é你\U0001f600", "}" * 40, "{" * 9, ", [", "\t"]


@contextmanager
def splits(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(size))
    try:
        yield
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)


def chunks(text, delimiter, size):
    """The chunks of each split, as a line reader gives them: a chunk belongs to the split in which it starts."""
    starts, at = [], 0
    parts = text.split(delimiter)
    for p in parts[:-1] if parts[-1] == "" else parts:
        starts.append((at, p))
        at += len(p) + len(delimiter)
    out = {}
    for at, p in starts:
        out.setdefault(at // size, []).append(p)
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("syntax", [records.JsonObjects(), records.QuotedLines(header=False)])
def test_states_and_counts_are_those_of_one_pass(syntax):
    rng = random.Random(3)
    for _ in range(300):
        if isinstance(syntax, records.JsonObjects):
            made = [{"id": rng.choice(HARD), "l": [{"x": rng.choice(HARD)}] * rng.randint(0, 2)} for _ in range(rng.randint(0, 6))]
            text = json.dumps(made, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) + rng.choice(["", "\n"])
        else:
            out = io.StringIO()
            csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows([[rng.choice(HARD) for _ in range(3)] for _ in range(rng.randint(0, 6))])
            text = out.getvalue()
        split = chunks(text, syntax.delimiter, rng.randint(1, 60))
        state, total, true = syntax.begin, 0, syntax.begin
        for part in split:
            assert state == true
            ended = 0
            for chunk in part:
                true, kind = syntax.step(true, chunk)
                ended += kind == records.ENDS
            summary = syntax.summaries(iter(part))[bool(state[0])]
            state, count = syntax.after(state, summary)
            assert count == ended
            total += ended
        if isinstance(syntax, records.JsonObjects):
            assert total == len(made) and state == syntax.begin


def test_stray_quotes_open_nothing():
    lines = records.QuotedLines(separator="\t", header=False)
    for line, inside, want in [('a"b\tc', False, False), ('"a\tb', False, True), ('x\t"y', False, True), ('b"\tc', True, False), ('""', True, True),
                               ('a""b"', True, False), ('a"\t"', True, True), ('"a""', False, True), ('"a"x"\ty', False, False)]:
        assert lines.step((inside,), line)[0] == (want,), line


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_json_arrays_over_splits(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for name in ("b", "a", "c"):
        rows = [{"id": f"{name}{i}", "text": rng.choice(HARD) * rng.randint(1, 9), "label": rng.choice(HARD), "more": {"deep": [{"x": "}"}]}} for i in range(80)]
        text = json.dumps(rows, ensure_ascii=name == "a", indent=2 if name == "b" else None)
        if name == "c":
            text = "\n".join(map(json.dumps, rows))  # objects after each other
        (tmp_path / f"{name}.json").write_bytes((b"\xef\xbb\xbf" if name == "a" else b"") + text.encode())
    (tmp_path / "d.json").write_text("[]\n")
    rng = random.Random(size)
    for name in ("b", "a", "c"):
        want += [(f"{name}{i}", rng.choice(HARD) * rng.randint(1, 9), rng.choice(HARD)) for i in range(80)]
    with splits(spark, size):
        got = readers.read_parallel(spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(want)
        rows, _ = records.read_records(spark, str(tmp_path), records.JsonObjects())
        order = [json.loads(r.value)["id"] for r in rows.orderBy("id").collect()]
        assert [r.id for r in rows.orderBy("id").collect()] == list(range(240))
    assert order == [f"{n}{i}" for n in "abc" for i in range(80)]


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_quoted_rows_over_splits(spark, tmp_path, size):
    rng = random.Random(size)
    want = []
    for name in "ab":
        rows = [[f"{name}{i} " + rng.choice(HARD), rng.choice(HARD) or "x"] for i in range(90)]
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\r\n" if name == "b" else "\n", escapechar=None)
            out.writerow(["label", "tweet"])
            out.writerows(rows)
            f.write("\n" if name == "a" else "")
        want += [(t, lab) for lab, t in rows]
    with splits(spark, size):
        got = readers.read_emotion(spark, str(tmp_path))
        rows = got.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(180))
    assert [(r.tweet, r.label) for r in rows] == want


def test_large_file_is_many_tasks(spark, tmp_path):
    path = str(tmp_path / "array")
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit('a } " { \n'), 20).alias("text"), F.lit("l").alias("label"))
    sinks.write_json_array(rows.coalesce(1), path)
    with splits(spark, 32 << 10):
        read = readers.read_parallel(spark, path)
        assert read.rdd.getNumPartitions() > 10
        assert sorted(int(r.id) for r in read.collect()) == list(range(3000)) and read.where("text <> repeat('a } \" { \\n', 20)").count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_json_array(rows, path)


def test_broken_files_are_errors(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"id": "1", "text": "a", "label": "b"}, {"id": "2", "te')
    with pytest.raises(Exception):
        readers.read_parallel(spark, str(tmp_path / "cut.json")).collect()
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_emotion(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "head.csv").write_text("tweet,label\n")
    assert readers.read_emotion(spark, str(tmp_path / "head.csv")).count() == 0
