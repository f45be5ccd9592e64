import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators.metrics import answers, bleu, chunks, classification, loss, overlap, rouge
from textloom.plans import bundles


def frame(spark, rows, hyp="string", label=None):
    return spark.createDataFrame(
        [(i, h, r) for i, (h, r) in enumerate(rows)], f"id bigint, hyp {hyp}, label {label or hyp}"
    )


# --- chunks --------------------------------------------------------------------------------
def walk(gold_tags, guess_tags):
    """Plain reading of one sentence, tag by tag: correct, guessed, gold chunks."""
    part = lambda t: (t.split("-", 1) + [""])[:2] if "-" in t else (t, "")

    def spans(tags):
        out, open_at, last = [], None, ("O", "")
        for i, now in enumerate([part(t) for t in tags] + [("O", "")]):
            changed = last[1] != now[1]
            ends = last[0] in "ES" or (last[0] in "BI" and now[0] in "BSO") or (last[0] not in "O." and changed)
            starts = now[0] in "BS" or (last[0] in "ESO" and now[0] in "EI") or (now[0] not in "O." and changed)
            if open_at is not None and ends:
                out.append((*open_at, i))
                open_at = None
            if starts:
                open_at = (i, now[1])
            last = now
        return set(out)

    a, b = spans(gold_tags), spans(guess_tags)
    return len(a & b), len(b), len(a)


ALPHABETS = [["B", "I", "O"], ["B-X", "I-X", "B-Y", "I-Y", "O"], ["B-X", "I-X", "E-X", "S-X", "S-Y", "O"], ["B-X", "B-Y", "I-Y"]]


def test_chunks_against_plain_reading(spark):
    rnd = random.Random(3)
    rows, want = [], Counter()
    for _ in range(4000):
        tags, n = rnd.choice(ALPHABETS), rnd.randint(0, 9)
        gold, guess = [[rnd.choice(tags) for _ in range(n)] for _ in range(2)]
        rows.append((guess, gold))
        for name, v in zip(("correct", "guessed", "gold"), walk(gold, guess)):
            want[name] += v
    df = frame(spark, rows, "array<string>")
    got = chunks.chunk_counts(df).head()
    assert {k: got[k] for k in want} == dict(want)
    by_type = chunks.chunk_scores_by_type(df).agg(F.sum("tp"), F.sum("guessed"), F.sum("gold")).head()
    assert list(by_type) == [want["correct"], want["guessed"], want["gold"]]


def test_chunks_of_a_batch_need_no_expression_per_tag(spark):
    """odd and null tags, a side without a prediction, a cut side; nothing is worked out tag by tag in a lambda."""
    rows = [
        (["B-X", "I-X", None, "S-Y"], ["B-X", "I-X", None, "S-Y"]), (None, ["B-X", "O"]), (["B-a:b"], None), (["E-X", "E-X", "O"], ["B-X", "E-X"]),
        (["B-X"], ["B-X", "I-X"]), ([".", "I", "O"], [".", "I", "O"]), ([], []),
    ]
    found = chunks.sentence_chunks(frame(spark, rows, "array<string>"), keep=("id",))
    got = {r.id: tuple(r)[1:] for r in found.collect()}
    assert got[0] == (["0:4:X", "3:Y"],) * 3 + (4, 3)  # a null tag ends no chunk
    assert got[1] == (["0:1:X"], [], [], 2, 1)
    assert got[2] == ([], [], [], 0, 0)
    assert got[3] == (["0:2:X"], ["0:1:X", "1:2:X"], [], 2, 1)
    assert got[4] == (["0:1:X"], ["0:1:X"], ["0:1:X"], 1, 1)
    assert got[5] == (["2"], ["2"], ["2"], 3, 3)
    assert got[6] == ([], [], [], 0, 0)
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_chunk_examples(spark):
    one = lambda gold, pred: chunks.chunk_counts(frame(spark, [(pred.split(), gold.split())], "array<string>")).head()
    got = one("B I O", "B O O")
    assert (got.gold, got.guessed, got.correct) == (1, 1, 0)
    assert one("O I-X", "O B-X").correct == 1
    assert one("O I-X B-X", "O B-X").tokens == 2
    df = frame(spark, [("B O O".split(), "B I O".split())], "array<string>")
    assert chunks.chunk_scores(df).head().ACC == 0.75
    assert chunks.chunk_scores(df, acc="tokens").head().ACC == pytest.approx(2 / 3)


# --- classification ------------------------------------------------------------------------
def test_macro_scores(spark):
    df = frame(spark, [("a", "a"), ("b", "a"), ("c", "b"), ("b", "b")])
    got = classification.macro_scores(df).head()
    assert got.ACC == 0.5
    assert got.PRE == pytest.approx((1 + 0.5 + 0) / 3)
    assert got.REC == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert got.F1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_missing_predictions(spark):
    df = frame(spark, [("cat", "cat"), (None, "cat")])
    assert classification.accuracy(df).head().ACC == 0.5
    assert classification.macro_scores(df).head().ACC == 0.5
    assert answers.exact_match(df).head().EM == answers.answer_scores(df).head().EM == 50
    tags = frame(spark, [(["B"], ["B"]), (None, ["B"])], "array<string>")
    counts = chunks.chunk_counts(tags).head()
    assert (counts.tokens, counts.gold, counts.correct) == (2, 2, 1)
    scores = chunks.chunk_scores(tags).head()
    assert (scores.PRE, scores.REC) == (1, 0.5) and scores.ACC == pytest.approx(3 / 4)
    multi = frame(spark, [(["a", "b"], ["a", "b"]), (None, ["a", "b"])], "array<string>")
    got = classification.macro_scores_multi(multi).head()
    assert (got.ACC, got.REC, got.PRE) == (0.5, 0.5, 1) and got.F1 == pytest.approx(2 / 3)
    assert classification.per_class(df).count() == 1  # a null is no class
    none = spark.createDataFrame([], tags.schema)
    assert chunks.chunk_scores(none, acc="tokens").head().ACC == 0


# --- text scores ---------------------------------------------------------------------------
def plain_bleu(rows, smooth):
    hyp_len = sum(len(h) for h, _ in rows)
    ref_len = sum(len(r) for _, r in rows)
    logs, divisor = [], 1.0
    for n in range(1, 5):
        grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
        m = sum(sum((grams(h) & grams(r)).values()) for h, r in rows)
        t = sum(max(len(h) - n + 1, 0) for h, _ in rows)
        if not smooth and m == 0:
            return 0.0
        if m == 0:
            divisor *= 2
        logs.append(math.log(m / t if m else 1 / (divisor * t)))
    bp = 1.0 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return 100 * bp * math.exp(sum(logs) / 4)


def random_rows(seed, n=40):
    rnd = random.Random(seed)
    words = lambda: [rnd.choice("abcdefg") for _ in range(rnd.randint(4, 15))]
    return [(words(), words()) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_bleu_against_plain_count(spark, seed):
    rows = random_rows(seed)
    df = frame(spark, [(" ".join(h), " ".join(r)) for h, r in rows])
    for parts, method in ((1, "row"), (7, "row"), (7, "group")):
        got = bleu.bleu(df.repartition(parts), text=F.lower, method=method).head().BLEU
        assert got == pytest.approx(plain_bleu(rows, False))
        got = bleu.sacrebleu(df.repartition(parts), method=method).head().SacreBLEU
        assert got == pytest.approx(plain_bleu(rows, True))


def test_both_ways_of_counting_agree(spark):
    rnd = random.Random(9)
    text = lambda: "".join(rnd.choice(["The ", "cat ", "can't ", "3.5, ", "end.\n", "a ", "“x” "]) for _ in range(rnd.randint(0, 40)))
    df = frame(spark, [(text(), text()) for _ in range(80)] + [(None, "a"), ("a", None)])
    one, two = [bundles.generation_scores(df, method=m).head().asDict() for m in ("row", "group")]
    assert one == pytest.approx(two)
    one, two = [sorted(answers.answer_rows(df, method=m).collect()) for m in ("row", "group")]
    assert one == two
    with pytest.raises(ValueError):
        bleu.bleu(df, method="other")


def test_smoothing(spark):
    df = frame(spark, [("a b c d", "a x c y")])
    assert bleu.bleu(df).head().BLEU == 0
    assert bleu.sacrebleu(df).head().SacreBLEU == pytest.approx(plain_bleu([("a b c d".split(), "a x c y".split())], True))
    assert bleu.sacrebleu(frame(spark, [("a b", "a b")])).head().SacreBLEU == 0


def test_identity(spark):
    texts = ["The quick brown fox jumps.", "over the\nlazy dog (again), yes!"]
    row = {r.metric: r.value for r in bundles.score("generation", frame(spark, [(t, t) for t in texts])).collect()}
    assert row == {k: pytest.approx(100) for k in ("BLEU", "SacreBLEU", "ROUGE1", "ROUGE2", "ROUGEL", "ROUGELsum")}
    row = answers.answer_scores(frame(spark, [(t, t) for t in texts])).head()
    assert (row.EM, row.F1) == (100, 100)


def test_empty_texts(spark):
    row = {r.metric: r.value for r in bundles.score("generation", frame(spark, [("", "a b"), ("a b", "")])).collect()}
    assert set(row.values()) == {0.0}


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t


def lcs_walk(a, b):
    t, i, j, out = lcs_table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def plain_union_hits(ref, hyp):
    left_r, left_h, hits = Counter(sum(ref, [])), Counter(sum(hyp, [])), 0
    for line in ref:
        for i in sorted(set().union(*[lcs_walk(line, h) for h in hyp])):
            if left_h[line[i]] > 0 and left_r[line[i]] > 0:
                hits += 1
                left_h[line[i]] -= 1
                left_r[line[i]] -= 1
    return hits


tokens = st.lists(st.sampled_from("abcde"), max_size=9)


@settings(max_examples=300, deadline=None)
@given(tokens, tokens)
def test_lcs(a, b):
    assert rouge.lcs_length(a, b) == lcs_table(a, b)[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(tokens, max_size=5), st.lists(tokens, max_size=5))
def test_union_hits(ref, hyp):
    assert rouge.union_hits(ref, hyp) == plain_union_hits(ref, hyp)


def test_rouge_against_plain_count(spark):
    rows = random_rows(5, 60)
    cut = lambda t: [t[i : i + 4] for i in range(0, len(t), 4)]
    text = lambda t: "\n".join(" ".join(line) for line in cut(t))
    f = lambda hits, h, r: 0 if not hits else 2 * (hits / h) * (hits / r) / (hits / h + hits / r)
    want = Counter()
    for h, r in rows:
        for n in (1, 2):
            grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
            want[f"ROUGE{n}"] += f(sum((grams(h) & grams(r)).values()), len(h) - n + 1, len(r) - n + 1)
        want["ROUGEL"] += f(lcs_table(h, r)[-1][-1], len(h), len(r))
        want["ROUGELsum"] += f(plain_union_hits(cut(r), cut(h)), len(h), len(r))
    got = rouge.rouge(frame(spark, [(text(h), text(r)) for h, r in rows])).head().asDict()
    assert got == {k: pytest.approx(100 * v / len(rows)) for k, v in want.items()}


def test_bootstrap(spark):
    values = [random.Random(i).random() for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, x double")
    got = rouge.bootstrap(df, ["x"], replicates=500).head()
    again = rouge.bootstrap(df.repartition(7), ["x"], replicates=500).head()
    mean = 100 * sum(values) / 1000
    spread = 100 * 1.96 * math.sqrt(1 / 12 / 1000)
    assert got.mid == pytest.approx(mean, abs=0.3)
    assert got.high - got.low == pytest.approx(2 * spread, rel=0.2)
    assert got.low == pytest.approx(again.low)


def test_bootstrap_is_its_brute_force(spark):
    import hashlib

    import numpy as np

    values = {str(i): random.Random(i).random() for i in range(700)}
    df = spark.createDataFrame([(k, v, None if k == "5" else 1 - v) for k, v in values.items()], "id string, x double, y double").repartition(4)
    steps = rouge.poisson_steps()
    means = {"x": [], "y": []}
    for rep in range(1, 41):
        m, a, m2 = rouge.replicate_numbers(rep, 3)
        total, sums = 0, {"x": 0.0, "y": 0.0}
        for k, v in values.items():
            u = ((int(hashlib.md5(k.encode()).hexdigest()[:8], 16) >> 1) % rouge.PRIME * m + a) % rouge.PRIME
            u = ((u ^ (u >> 15)) * m2) % rouge.PRIME
            w = sum(u >= s for s in steps)
            total += w
            sums["x"] += w * v
            sums["y"] += w * (1 - v) if k != "5" else 0
        for c in means:
            means[c].append(100 * sums[c] / total)
    for r in rouge.bootstrap(df, ["x", "y"], replicates=40, seed=3).collect():
        assert (r.low, r.mid, r.high) == pytest.approx(tuple(np.quantile(means[r.metric], [0.025, 0.5, 0.975])))
    assert rouge.bootstrap(df.limit(0), ["x"], replicates=4).where("mid is not null").count() == 0


@pytest.mark.parametrize("gold, pred, em, f1", [
    ("The cat.", "cat", 1, 1), ("the", "", 1, 1), ("the", "dog", 0, 0), ("a b c d", "b c", 0, 0.8), ("x x y", "x x x", 0, 2 / 3),
])
def test_answers(spark, gold, pred, em, f1):
    got = answers.answer_rows(frame(spark, [(pred, gold)])).head()
    assert (got.em, got.f1) == (em, pytest.approx(f1))


def test_masked_loss(spark):
    df = spark.createDataFrame(
        [([[1.0, 2.0], [0.0, 0.0], [3.0, 1.0]], [0, 1, -100]), ([[0.5, 0.5], [1.0, 4.0]], [1, 0])],
        "logits array<array<float>>, labels array<bigint>",
    )
    nll = lambda row, t: math.log(sum(map(math.exp, row))) - row[t]
    want = (nll([1, 2], 1) + nll([0.5, 0.5], 0)) / 2
    assert loss.masked_loss(df).head().loss == pytest.approx(want)
    inputs = df.withColumn("input_ids", F.transform("labels", lambda x: F.abs(x) % 2))
    want = (nll([1, 2], 1) + nll([0, 0], 0) + nll([0.5, 0.5], 0)) / 3
    assert loss.masked_loss(inputs, labels=None).head().loss == pytest.approx(want)


def test_unknown_bundle(spark):
    with pytest.raises(ValueError):
        bundles.score("nope", frame(spark, [("a", "a")]))
    bundles.register_metric("count", lambda df, **c: df.agg(F.count("*").alias("N")), ("N",))
    assert bundles.score("count", frame(spark, [("a", "a")])).head().value == 1


def test_masked_loss_refuses_targets_without_a_score(spark):
    df = spark.createDataFrame([([[0.0, 1.0], [0.0, 1.0]], [0, 5])], "logits array<array<double>>, labels array<int>")
    with pytest.raises(Exception, match="no score for target 5"):
        loss.masked_loss(df).collect()


def test_batch_matches_against_counters():
    rng = np.random.default_rng(3)
    space = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    text = lambda: "".join(w + str(rng.choice(space)) * int(rng.integers(1, 3)) for w in rng.choice(["a", "b", "c", "dd"], int(rng.integers(0, 30))))
    hyps, refs = [["", " a", *(text() for _ in range(60))] for _ in range(2)]
    orders = (1, 2, 3, 4)
    want = [(len(h), len(r), *(overlap.clipped_matches(h, r, n) for n in orders)) for h, r in zip(map(str.split, hyps), map(str.split, refs))]
    for rows in (slice(0, None), slice(0, 1), slice(0, 0)):
        found = overlap.batch_matches(pa.array(hyps[rows], pa.large_string()), pa.array(refs[rows], pa.large_string()), orders)
        assert list(zip(*(c.tolist() for c in found))) == want[rows]
    assert len(overlap.batch_matches(pa.array(hyps), pa.array(refs), ())) == 2


def test_grouped_counts_keep_their_partitions(spark):
    """Adaptive execution must not join partitions whose exploded n-grams are many times larger."""
    df = frame(spark, [("a b c", "a b d")] * 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        counts = overlap.ngram_overlap(df, {"w": overlap.Scheme(F.lower, (1, 2))}, method="group")
        assert counts.rdd.getNumPartitions() == 7 and {(r.w_m1, r.w_m2) for r in counts.collect()} == {(2, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _unpadded(texts):
    """An array whose buffer goes on with bytes that are no text, as one of a larger message may."""
    data, ends = "".join(texts).encode(), np.cumsum([0, *(len(t.encode()) for t in texts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.tobytes()), pa.py_buffer(data + b"\xff" * 64).slice(0, len(data)))


def test_white_space_at_the_end_of_a_batch():
    """Arrow's split alone leaves the space on the last word."""
    found = overlap.batch_matches(_unpadded(["a b", "c d "]), _unpadded(["a b ", "c d\n"]), (1, 2))
    assert [c.tolist() for c in found] == [[2, 2], [2, 2], [2, 2], [1, 1]]


def test_groups_are_counted_by_integers(spark, monkeypatch):
    """Rows of an id count as one, also a null id's; n-grams are exploded only for an id with very much text."""
    rnd = random.Random(6)
    text = lambda: " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) + rnd.choice(["", " "])
    rows = [(rnd.choice([None, *range(30)]), text(), text()) for _ in range(90)]
    df = spark.createDataFrame(rows, "id bigint, hyp string, label string").repartition(5)
    want = {}
    for i in {r[0] for r in rows}:
        sides = [[t.split() for t in side] for side in zip(*[r[1:] for r in rows if r[0] == i])]
        grams = lambda t, n: sum((Counter(zip(*(x[k:] for k in range(n)))) for x in t), Counter())
        want[i] = tuple(sum((grams(sides[0], n) & grams(sides[1], n)).values()) for n in (1, 3)) + tuple(sum(map(len, t)) for t in sides)
    scheme = {"w": overlap.Scheme(F.lower, (1, 3))}
    for limit, part in ((overlap.GROUP_BYTES, overlap.PART_BYTES), (40, 10), (0, 1)):
        monkeypatch.setattr(overlap, "GROUP_BYTES", limit)
        monkeypatch.setattr(overlap, "PART_BYTES", part)
        counts = overlap.ngram_overlap(df, scheme, method="group")
        assert {r.id: (r.w_m1, r.w_m3, r.w_hyp, r.w_ref) for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "Window" in plan


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=14), st.lists(st.sampled_from("abcdef"), min_size=1, max_size=9))
def test_walk_by_the_other_line(ref, line):
    by_ref = rouge._matched_positions(ref, rouge._columns_of(line), len(line))
    assert rouge._matched_by_line(line, rouge._columns_of(ref), len(ref)) == by_ref
