import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import batching, dialogue, layouts, ordering, predictions, vocab


def rows(df):
    return sorted(map(tuple, df.collect()))


# --- ordering ------------------------------------------------------------------------------
def test_running_sum_over_blocks(spark):
    data = [(f"k{(i * 7919) % 1000:04d}", i % 5) for i in range(1000)]
    df = spark.createDataFrame(data, "k string, w int").repartition(5)
    got = {r.k: r.ix for r in ordering.running_sum(df, ["k"], ranges=7).collect()}
    assert got == {k: i for i, k in enumerate(sorted(k for k, _ in data))}
    total, want = 0, {}
    for k, w in sorted(data):
        want[k] = total
        total += w
    got = {r.k: r.ix for r in ordering.running_sum(df, ["k"], "w", ranges=7).collect()}
    assert got == want


def test_group_row_number_and_running_max(spark):
    rnd = random.Random(2)
    data = [(0 if i % 3 else i % 10, i, rnd.random()) for i in range(900)]
    df = spark.createDataFrame(data, "g int, t int, v double").repartition(6)
    got = ordering.group_row_number(df, ["g"], ["t"], F.floor(F.col("t") / 40))
    want, seen = {}, {}
    for g, t, v in data:
        want[(g, t)] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1
    assert {(r.g, r.t): r.rn for r in got.collect()} == want
    for current in (True, False):
        best = ordering.group_running_max(got, ["g"], "rn", "v", "m", current, block_rows=16)
        got_max = {(r.g, r.t): r.m for r in best.collect()}
        top, expected = {}, {}
        for g, t, v in data:
            before = top.get(g)
            top[g] = v if before is None else max(before, v)
            expected[(g, t)] = top[g] if current else before
        assert got_max == expected


def test_quantiles_with_one_hot_value(spark):
    import numpy as np

    values = [1.5] * 400 + [float(i) / 7 for i in range(777)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.p: r.quantile for r in ordering.quantiles(df, "v", [0, 0.25, 0.5, 0.75, 1], ranges=7).collect()}
    assert got == {p: pytest.approx(float(np.quantile(values, p))) for p in (0, 0.25, 0.5, 0.75, 1)}


def test_running_sum_with_repeated_keys(spark):
    df = spark.createDataFrame([(7, i) for i in range(500)] + [(3, i) for i in range(5)], "k int, v int").repartition(6)
    got = ordering.running_sum(df, ["k"], ranges=8)
    assert sorted(r.ix for r in got.collect()) == list(range(505)) and {r.ix for r in got.where("k = 3").collect()} == set(range(5))
    assert ordering.running_sum(df.limit(0), ["k"]).count() == 0
    weighted = ordering.running_sum(df.withColumn("w", F.when(F.col("v") % 2 == 0, 3)), ["k", "v"], "w", ranges=8)
    assert weighted.where("k = 7 and v = 499").head().ix == 3 * 3 + 250 * 3


def test_repeated_ids_keep_their_rows(spark):
    docs = spark.createDataFrame([(1, "b a"), (1, "a"), (1, "a"), (None, "b")], "id bigint, text string").repartition(3)
    tokens = F.split("text", " ")
    table = vocab.build_vocab(docs.select(F.explode(tokens).alias("token")))
    for limit in (vocab.BROADCAST_BYTES, 0):
        got = vocab.encode(docs, "id", {"ids": tokens}, table, broadcast_bytes=limit).collect()
        assert sorted((r.id or 0, r.ids) for r in got) == [(0, [1]), (1, [0]), (1, [0]), (1, [1, 0])]
    placed = batching.assign_batches(docs, batch_size=3, lengths={"w": F.size(tokens)}).collect()
    assert sorted((r.position, r.batch_id, r.place) for r in placed) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0)]
    assert sorted((r.id or 0, r.text) for r in placed) == [(0, "b"), (1, "a"), (1, "a"), (1, "b a")]
    pairs = predictions.pair_with_references(spark.createDataFrame([(1, "h")], "id bigint, hyp string"), docs.withColumnRenamed("text", "label"))
    assert sorted((r.label, r.hyp) for r in pairs.collect()) == [("a", "h"), ("a", "h"), ("b", None), ("b a", "h")]
    with pytest.raises(Exception, match="more than one hypothesis for id 1"):
        predictions.pair_with_references(docs.withColumnRenamed("text", "hyp"), docs.withColumnRenamed("text", "label")).collect()


def test_length_classes_come_together(spark):
    df = spark.range(200).withColumn("n", (F.col("id") * 37 % 100).cast("int")).repartition(5)
    placed = batching.assign_batches(df, batch_size=10, lengths={"w": F.col("n")}, bucket=batching.length_class(F.col("n"), 25), seed=3)
    for r in placed.groupBy("batch_id").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c"), F.countDistinct("place").alias("p")).collect():
        assert r.a // 25 == r.b // 25 and r.c == r.p == 10


# --- vocabulary ----------------------------------------------------------------------------
def test_vocab_both_join_paths(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "c a")], "id bigint, text string")
    words = F.split("text", " ")
    tokens = F.filter(words, lambda w: w != "")
    table = vocab.build_vocab(docs.select(F.explode(tokens).alias("token")))
    assert rows(table.select("token", "token_id")) == [("a", 0), ("b", 1), ("c", 2)]
    for limit in (vocab.BROADCAST_BYTES, 0):
        ids = vocab.encode(docs, "id", {"ids": tokens, "twice": F.concat(tokens, tokens)}, table, broadcast_bytes=limit)
        assert rows(ids.select("id", "ids")) == [(1, [1, 0, 1]), (2, []), (3, [2, 0])]
        assert rows(ids.select("id", "twice"))[2] == (3, [2, 0, 2, 0])
        assert rows(vocab.decode(ids, "id", F.col("ids"), table, broadcast_bytes=limit)) == [(1, "b a b"), (2, ""), (3, "c a")]
    many = spark.range(3000).select("id", F.concat(F.lit("b a b "), F.col("id") % 7).alias("text"))
    every = vocab.build_vocab(many.select(F.explode(words).alias("token")))
    one, two = [rows(vocab.encode(many, "id", {"ids": words}, every, broadcast_bytes=b)) for b in (vocab.BROADCAST_BYTES, 0)]
    assert one == two and len(one) == 3000
    part = table.where("token <> 'c'")
    assert rows(vocab.encode(docs, "id", {"ids": tokens}, part, on_unknown="null"))[2] == (3, [None, 0])
    assert rows(vocab.encode(docs, "id", {"ids": tokens}, part, on_unknown="unk", unknown=9))[2] == (3, [9, 0])
    with pytest.raises(Exception, match="unknown entry: c"):
        vocab.encode(docs, "id", {"ids": tokens}, part).collect()
    full = vocab.add_special_tokens(table)
    assert rows(full.where("token_id > 2").select("token_id", "token")) == list(
        zip(range(3, 10), vocab.SPECIAL_TOKENS)
    )
    assert vocab.duplicate_entries(full).count() == 0
    assert vocab.duplicate_entries(full.union(full.limit(1))).count() == 2


def test_embeddings(spark):
    table = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, token_id bigint")
    vectors = spark.createDataFrame(
        [("a", 1, [1.0, 2.0]), ("a", 5, [3.0, 4.0]), ("q", 2, [0.0, 0.0])], "token string, line bigint, vector array<float>"
    )
    out = vocab.embed_vocab(table, vectors, 2, seed=4)
    got = {r.token: (r.vector, r.known) for r in out.collect()}
    assert got["a"] == ([3.0, 4.0], True)
    assert got["b"][1] is False and all(0 <= x < 1 for x in got["b"][0]) and got["b"][0] != got["c"][0]
    assert {r.token: (r.vector, r.known) for r in vocab.embed_vocab(table.repartition(3), vectors, 2, seed=4).collect()} == got
    assert rows(vocab.embedding_coverage(out)) == [(1, 3, pytest.approx(100 / 3))]


# --- dialogue ------------------------------------------------------------------------------
def plain_history(texts, max_tokens, policy):
    """Drop from the front, as a loop."""
    kept, step = list(texts), 0
    for step in range(len(texts)):
        if sum(len(t.split()) for t in kept) <= max_tokens - 2 - 2 * len(kept):
            break
        kept = kept[step + 1 if policy == "triangular" else 1:]
    return kept


@pytest.mark.parametrize("policy", ["triangular", "minimal"])
@pytest.mark.parametrize("max_tokens, block", [(22, 4096), (22, 8), (60, 20), (3, 5)])
def test_history(spark, policy, max_tokens, block):
    rnd = random.Random(max_tokens)
    data, want = [], {}
    for conv, n in enumerate([1, 2, 5, 60]):
        history = []
        for k in range(n):
            user, reply = [" ".join("w" * 1 for _ in range(rnd.randint(0, 6))) + f" {conv}.{k}{s}" for s in "ur"]
            data.append((conv, k, f"{conv}-{k}", user, reply))
            history.append(user)
            want[(conv, k)] = plain_history(history, max_tokens, policy)
            history = history + [reply]
    turns = spark.createDataFrame(data, "conv_id bigint, k bigint, id string, user_text string, reply string")
    out = dialogue.truncate_history(
        dialogue.running_history(turns.repartition(3), max_tokens, turns_per_block=block), max_tokens, policy
    )
    got = {(r.conv_id, r.k): [e.text for e in r.history] for r in out.collect()}
    assert got == want


def test_markers(spark):
    turns = spark.createDataFrame(
        [(0, 0, "0-0", "a", "b"), (0, 1, "0-1", "c", "d")], "conv_id bigint, k bigint, id string, user_text string, reply string"
    )
    history = dialogue.truncate_history(dialogue.running_history(turns), 512)
    marked = dialogue.mark_speakers(history, "5", "6").where("k = 1").head()
    assert marked.marked == ["5", "a", "6", "b", "5", "c"]
    assert dialogue.longest_history(dialogue.mark_speakers(history, "5", "6")).head().max_len == 6
    short = dialogue.truncate_history(dialogue.running_history(turns, 8), 8)
    # Three entries cost 9 of 6 places, two cost 6: one is dropped and the first kept is a reply.
    assert dialogue.mark_speakers(short, "5", "6").where("k = 1").head().marked == ["5", "b", "6", "c"]
    assert dialogue.mark_speakers(short, "5", "6", anchor="role").where("k = 1").head().marked == ["6", "b", "5", "c"]


def test_pairing(spark):
    messages = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 0, "user", "x")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    assert rows(dialogue.pair_turns(messages).select("conv_id", "k", "user_text", "reply")) == [(1, 0, "a", "b")]


# --- layouts -------------------------------------------------------------------------------
def batch(spark, data, model, **ids):
    df = spark.createDataFrame(data, "id bigint, x array<bigint>, y array<bigint>").repartition(3)
    out = layouts.generation_batches(df, model, layouts.LayoutIds(**ids))
    return {r.id: r for r in out.collect()}


def test_bart_layout(spark):
    r = batch(spark, [(0, [7, 8], [9])], "bart")[0]
    assert (r.enc, r.dec, r.label) == ([7, 8, 2, 40001], [40002, 9, 2], [9, 2, 40002])
    assert r.enc_mask == [1, 1, 1, 1] and r.dec_mask is None
    r = batch(spark, [(0, [7, 8, 9, 10], [5]), (1, [7], [5, 6])], "baseline-mbart", max_len=5)
    assert r[0].enc == [7, 8, 9, 2, 40001] and r[1].enc == [7, 2, 40001, 1, 1]
    assert r[1].enc_mask == [1, 1, 1, 0, 0] and r[0].label == [5, 2, 40002, -100]


def test_gpt_layout(spark):
    r = batch(spark, [(0, [7, 8], [9]), (1, [7], [9])], "gpt2")[1]
    assert (r.enc, r.dec, r.label, r.enc_mask) == ([7, 1, 0], [7, 1, 0, 9, 1], [-100, -100, -100, 9, 2], [1, 0, 1])
    assert r.dec_mask == [1, 0, 1, 1, 0]


def test_t5_layouts(spark):
    r = batch(spark, [(0, [7, 8], [9]), (1, [7], [5, 6])], "t5", prefix=(3, 4))
    assert r[1].enc == [3, 4, 7, 1] and r[1].enc_mask == [1, 1, 1, 0] and r[0].dec == [0, 9, 1] and r[0].label == [9, 2, -100]
    r = batch(spark, [(0, [7, 8], [9]), (1, [7], [5, 6])], "baseline-mt5", max_len=2)
    assert r[1].enc == [7, 1] and r[1].dec == [0, 5] and r[1].label == [5, 2]
    with pytest.raises(ValueError):
        layouts.layout_for("elmo")


@pytest.mark.parametrize("kind, label, want", [("single", 4, 4), ("vector", [1, 0], [1, 0]), ("tags", [3], [3, -100])])
def test_labelling_layout(spark, kind, label, want):
    other = {"single": 5, "vector": [0, 1], "tags": [1, 2]}[kind]
    types = "bigint" if kind == "single" else "array<bigint>"
    df = spark.createDataFrame(
        [(0, [7, 8], [0, 1], [-1, 0], label), (1, [7, 8, 9], [0, 1, 1], [-1, 0, -1], other)],
        f"id bigint, ids array<bigint>, seg array<bigint>, wi array<bigint>, label {types}",
    )
    out = layouts.labelling_batches(df, label_kind=kind, segments="seg", word_index="wi", max_len=3)
    r = {x.id: x for x in out.collect()}[0]
    assert (r.ids, r.mask, r.segments, r.word_index, r.label) == ([7, 8, 0], [1, 1, 0], [0, 1, 0], [-1, 0, -1], want)
    with pytest.raises(ValueError):
        layouts.labelling_batches(df, label_kind="other")


def test_batches(spark):
    df = spark.range(100).withColumn("n", F.col("id") % 13).repartition(9)
    out = batching.assign_batches(df, batch_size=8, lengths={"w": F.col("n")}, ranges=9)
    for r in out.collect():
        assert r.position == r.id and r.batch_id == r.id // 8
        assert r.w == max(i % 13 for i in range(r.batch_id * 8, min(100, r.batch_id * 8 + 8)))
    shuffled = lambda d, s: [r.id for r in batching.assign_batches(d, seed=s, ranges=9).orderBy("position").collect()]
    assert shuffled(df, 1) == shuffled(df.repartition(2), 1) != shuffled(df, 2)
    assert sorted(shuffled(df, 1)) == list(range(100))


# --- predictions ---------------------------------------------------------------------------
def test_decoding(spark):
    df = spark.sql("select array(array(1, 3, 3), array(9, 0, 1), array(0, 0, 5)) l, cast(array(2, -100, 1) as array<bigint>) g")
    l, g = F.col("l"), F.col("g")
    got = df.select(
        predictions.token_classes(l, g), predictions.aspect_classes(l), predictions.generated_ids(l, g),
        predictions.visible_ids(g), predictions.remove_prompt(g, 2), predictions.remove_prompt(g, 7),
        predictions.token_labels(l, g, ["a", "b", "c"]),
    ).head()
    assert list(got) == [[1], [1, 0, 2], [1, 2], [2, 1], [1], [], ["b"]]


def test_pairing_keeps_every_reference(spark):
    hyps = spark.createDataFrame([(1, "x"), (9, "y")], "id bigint, hyp string")
    refs = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, label string")
    assert rows(predictions.pair_with_references(hyps, refs)) == [(1, "x", "a"), (2, None, "b")]
    assert rows(predictions.preview(predictions.stack([refs, refs]), rows=2)) == [(1, "a"), (1, "a")]


def plain_run(metrics, limit):
    best, at, stop = -100.0, None, 0
    for epoch, m in enumerate(metrics, 1):
        if best < m:
            best, at, stop = m, epoch, 0
        else:
            stop += 1
            if stop == limit:
                return epoch, at
    return None, at


def test_runs(spark):
    rnd = random.Random(8)
    data, want = [], {}
    for exp in range(60):
        metrics = [float(rnd.randint(0, 9)) - (200 if exp == 7 else 0) for _ in range(rnd.randint(1, 30))]
        data += [(exp, e, m) for e, m in enumerate(metrics, 1)]
        want[exp] = plain_run(metrics, 3)
    df = spark.createDataFrame(data, "exp bigint, epoch bigint, metric double").repartition(5)
    stops = {r.exp: r.stop_epoch for r in predictions.early_stop(df, 3).collect()}
    best = {r.exp: r.best_epoch for r in predictions.best_epoch(df, 3).collect()}
    assert {e: (stops[e], best[e]) for e in want} == want
    losses = predictions.epoch_losses(df, ["exp"], "metric", test=True).head()
    assert (losses.mean_loss, losses.sum_loss) == (0, 0)


def test_complete_history(spark):
    turns = spark.range(400).selectExpr("'c' conv_id", "id k", "concat('u', id) user_text", "concat('r', id) reply")
    rows = {r.k: r for r in dialogue.complete_history(turns).collect()}
    assert len(rows) == 400 and rows[399].n == len(rows[399].history) == 799
    assert rows[1].history == ["u0", "r0", "u1"] and rows[399].history[0] == "u0"
    for block in (1, 7, 399):  # cut into blocks, each with the texts before it
        assert {r.k: r for r in dialogue.complete_history(turns, block).collect()} == rows


def test_mapped_arrays_keep_their_partitions(spark):
    """Adaptive execution must not join partitions that are about to be exploded."""
    words = spark.createDataFrame([("a", 0), ("b", 1)], "token string, token_id bigint")
    rows = spark.createDataFrame([(i, ["a", "b"]) for i in range(20)], "id bigint, w array<string>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        found = vocab.encode(rows, "id", {"ids": F.col("w")}, words)
        assert found.rdd.getNumPartitions() == 7 and {tuple(r.ids) for r in found.collect()} == {(0, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_stay_whole_with_a_small_vocabulary(spark):
    """nothing is exploded or grouped; odd arrays come out as by the join, which a vocabulary that repeats a key still takes."""
    words = spark.createDataFrame([("a", 0), ("b", 1), ("c", None)], "token string, token_id bigint")
    data = [(1, ["b", None, "a"], ["a"], "k"), (1, [], ["b"], None), (None, None, ["a"], "k"), (2, ["c", "z"], ["z"], "k")]
    rows_ = spark.createDataFrame(data, "id bigint, w array<string>, v array<string>, other string")
    arrays = {"x": F.col("w"), "y": F.col("v")}
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for options in ({"on_unknown": "null"}, {"on_unknown": "unk", "unknown": 9}, {"on_unknown": "unk"}):
        small = vocab.encode(rows_, "id", arrays, words, keep=["other"], **options)
        assert "Generate" not in small._jdf.queryExecution().optimizedPlan().toString()
        assert key(small) == key(vocab.encode(rows_, "id", arrays, words, keep=["other"], broadcast_bytes=0, **options))
        assert small.columns == ["id", "other", "x", "y"]
    twice = words.unionByName(spark.createDataFrame([("a", 7)], "token string, token_id bigint"))
    assert key(vocab.encode(rows_.where("id = 1"), "id", arrays, twice))[0][1:] == ([1, None, 0, 7], [0, 7])
    with pytest.raises(Exception, match="unknown entry: z"):
        vocab.encode(rows_, "id", arrays, words).collect()


def test_a_large_vocabulary_meets_the_entries_of_blocks(spark):
    """an entry is looked up once for a block of rows, and one without a value is named by its text."""
    rows_ = spark.range(3000).select("id", F.array(F.lit("b"), (F.col("id") % 3).cast("string"), F.lit(None)).alias("w"))
    words = spark.createDataFrame([("b", 5), ("0", 6), ("1", 7), ("2", None)], "token string, token_id bigint")
    found = vocab.encode(rows_, "id", {"ids": F.col("w")}, words, broadcast_bytes=0, on_unknown="null")
    assert {(r.id % 3, tuple(r.ids)) for r in found.collect()} == {(0, (5, 6, None)), (1, (5, 7, None)), (2, (5, None, None))}
    assert found.count() == 3000 and "_code" in found._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="unknown entry: 2"):
        vocab.encode(rows_, "id", {"ids": F.col("w")}, words, broadcast_bytes=0).collect()
    decoded = vocab.decode(found, "id", F.filter("ids", lambda x: x.isNotNull()), words.where("token_id is not null"), broadcast_bytes=0)
    assert {(r.id % 3, r.text) for r in decoded.collect()} == {(0, "b 0"), (1, "b 1"), (2, "b")}
