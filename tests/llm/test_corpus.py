"""Corpus operators beside brute force on small tables with nulls, empty and repeated rows and extra columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import (
    exact_dedup, html_extraction, imatch, language_id, mixing, near_copies, packing, simhash, substring_dedup, token_files, url_filter,
)
import corpus_pipeline
from textloom.llm.queries import tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu xi omicron pi rho sigma tau".split()
LONG = " ".join(f"{w}{i}" for i in range(6) for w in WORDS)
ROWS = [
    (1, LONG, "en", "a", 9), (2, LONG, "en", "a", 9), (2, LONG, "en", "a", 9), (3, None, None, None, 0), (4, "", "en", "b", 0),
    (5, "x " + LONG + "\n tail  here", "de", "b", 1), (6, "1234 ...", "de", "a", 1), (7, "the  cat\tsat", "en", "a", 1),
    (None, "the cat", "en", "b", 1), (8, LONG + " " + LONG, "en", "c", 3), (9, "w" * 5000 + " é", "fr", "c", 3),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, kept bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got = exact_dedup.decisions(docs).collect()
    groups = Counter(r[1] or "" for r in ROWS)
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): n for t, n in groups.items()}
    assert all(by_hash[r.text_sha256] == r.group_size for r in got)
    assert {r.keep_id for r in got if r.doc_id in (3, 4)} == {4}
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.decisions(empty).count() == exact_dedup.drop_copies(empty).count() == 0


def test_substring_dedup(docs, empty):
    window, counts = 35, Counter()
    words = [(r[1] or "").encode().split() for r in ROWS]
    for w in words:
        counts.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = Counter()
    for (i, *_), w in zip(ROWS, words):
        gone = {p + k for p in range(len(w) - window + 1) if counts[tuple(w[p : p + window])] > 1 for k in range(window)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup.repeated_spans(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_simhash(docs, empty):
    import xxhash

    def plain(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(r[0], plain(r[1])) for r in ROWS]
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter(fps)
    label = [min((i for i, g in fps if i is not None and bin(f ^ g).count("1") <= 2), default=None) for _, f in fps]
    for _ in range(5):
        label = [min((m for m, (_, g) in zip(label, fps) if m is not None and bin(f ^ g).count("1") <= 2), default=None) for _, f in fps]
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, m) for (i, _), m in zip(fps, label))
    assert simhash.keep_one(docs).columns[0] == "doc_id" and simhash.near_duplicates(empty).count() == 0


def test_components_over_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    roots = {r.fp: r.root for r in simhash.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for r in ROWS:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            want[r[0], k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    got = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), length=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_genetic_packing_is_never_worse_than_best_fit():
    rng = np.random.default_rng(3)
    sizes = rng.integers(20, 70, 300).tolist()
    down = packing.best_fit([], sorted(range(300), key=lambda i: -sizes[i]), sizes, 100)
    bins, _ = packing.evolve(sizes, 100, 5, [])
    assert sorted(i for b in bins for i in b) == list(range(300)) and max(packing.fill(b, sizes) for b in bins) <= 100
    assert len(bins) <= len(down)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = token_files.round_trip(docs.where("doc_id is not null"), tokenizer_path("byte_bpe_50k.json"), 2, length=64).collect()
    want, start = Counter(), 0
    for i, text in sorted((r[0], r[1] or "") for r in ROWS if r[0] is not None):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want[i, start, len(ids), zlib.crc32(ids.tobytes())] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in got) == want


def test_imatch(docs, empty):
    got = imatch.fingerprints(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    texts = sorted({r[0]: r[1] or "" for r in ROWS if r[0] is not None}.items(), reverse=True)
    want = {i: (len(t), hashlib.sha256(imatch.edited(t, texts[(k + 1) % len(texts)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(texts)}
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[2].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 for r in got) and imatch.fingerprints(empty).count() == 0


def test_language_id(spark, empty):
    rng = np.random.default_rng(1)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["she", "thr", "ing"]}
    rows = [(i, " ".join("".join(rng.choice(parts[t], 3)) for _ in range(30)), t) for i, t in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 34", "bb")], "doc_id bigint, text string, lang string")
    got = language_id.predict(docs, language_id.fit(docs), keep=("doc_id", "lang", "text")).collect()
    held = [r for r in got if r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id >= 900} == {"und"}
    assert language_id.fit(empty) is None


def test_gradients_match_differences():
    model = language_id.BiGru.fresh(["a", "b"], hidden=3)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    x, length = language_id.padded([b"ab", b"cde"])
    y = np.array([0, 1])
    _, grads = model.gradients(x, length, y)
    for name in ("hf", "hb", "out"):
        p = model.params[name]
        p[1, 1] += 1e-3
        up = model.gradients(x, length, y)[0]
        p[1, 1] -= 2e-3
        down = model.gradients(x, length, y)[0]
        p[1, 1] += 1e-3
        assert grads[name][1, 1] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4)


def test_mixing(docs, empty):
    plan = mixing.weights(docs, entropy_share=1.0, block_words=50)
    rows = {r.source: r for r in plan.collect()}
    assert abs(sum(r.weight for r in rows.values()) - 1) < 1e-9 and rows[""].weight == 0
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.assign(docs, plan).count() == len(ROWS) and mixing.mix(empty).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 11 == 0).alias("listed"))
    cascade = url_filter.build(keys)
    assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    urls = spark.createDataFrame([(1, None), (2, "no url"), (3, "http://A.Org/x"), (4, "http://b.example.org/es/1?q"), (5, "x://org")], "page_id int, url string")
    rules = [("org/", "allow"), ("example.org/es/", "block")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(urls, url_filter.Cascade(), rules).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.org", "/x", "org/", "allow"),
                   4: ("b.example.org", "/es/1", "example.org/es/", "block"), 5: ("org", "", None, "allow")}


def test_html_extraction(spark):
    page = ("<html><head><title>t</title><script>var a='</p>'</script></head><body><header>Site</header><ul class=menu><li><a href=/>Home</a></ul>"
            "<div id=main><h1>Title {0}</h1><p>First &amp; <b>bold</b>\n {0} text.<p>Second<br>line {0}<p>Read our terms</div>"
            "<section class='comments'><p>nice {0}</p></section><form><input><p>mail</form><footer>&copy; {0}</footer></body></html>")
    rows = [(i, f"http://h.org/{i}", page.format(f"n{i}" * 3)) for i in range(6)] + [(10, None, None), (11, "http://h.org/x", ""), (12, "y", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    assert got[0] == "Title n0n0n0\nFirst & bold n0n0n0 text.\nSecond line n0n0n0"  # the constant line is template
    assert got[10] == got[11] == "" and got[12] == "deep"
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_tree_matching_keeps_order_and_labels():
    a, b = html_extraction.from_text("r(x(y),z,w)"), html_extraction.from_text("r(x(y,q),w)")
    assert html_extraction.match(a, b)[0] == 4


def _plain_match(a, b):
    """Simple tree matching as it is written down, with every pair of siblings and the whole table."""
    if a[0] != b[0]:
        return 0, []
    left, right = a[1], b[1]
    found = [[_plain_match(x, y) for y in right] for x in left]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left)):
        for j in range(len(right)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + found[i][j][0])
    pairs, i, j = [(id(a), id(b))], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += found[i][j][1]
    return best[-1][-1] + 1, pairs


def test_tree_matching_is_one_for_all_widths():
    rng = np.random.default_rng(4)

    def tree(depth):
        return [str(rng.choice(list("abc"))), [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []]

    for width in (0, 1, 3, 30, 99, 120, 205):  # the last has more than 40,000 pairs of siblings
        a, b = (["r", [tree(2) for _ in range(n)]] for n in (width, width + 2))
        got, want = html_extraction.match(a, b), _plain_match(a, b)
        assert got[0] == want[0] == len(want[1]) and sorted(got[1]) == sorted(want[1])


def test_constant_text_in_wide_pages_is_template(spark):
    """The parts of very wide elements differ from page to page, but their constant lines stand in one node."""
    more = ["", "<ul><li>own {0}</ul>", "<ul><li>own {0}</ul><pre>more {0}</pre>"]
    part = "<div class={1}><p>line {0}</p><h4>Read our terms</h4>{2}</div>"
    rows = []
    for k, extra in enumerate(more):
        parts = "".join(part.format(f"n{k}x{i}", "ab"[i % 2], extra.format(f"n{k}x{i}")) for i in range(210))
        rows.append((k, f"http://h.org/{k}", f"<html><body>{parts}</body></html>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    texts = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    assert all("Read our terms" not in t and t.count("line n") == 210 for t in texts.values())


def test_near_copies_of_pipeline(spark):
    rng = np.random.default_rng(5)
    rows, base = [], 0
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 9000, 200)]
        rows.append((base, " ".join(words)))
        for k in range(6):
            changed = list(words)
            for at in rng.choice(200, 1 + g % 6, replace=False):
                changed[at] = f"v{g}x{k}x{at}"
            rows.append((base + k + 1, " ".join(changed).upper() if k == 3 else " ".join(changed)))
        base += 10
    rows += [(500, "one line " * 3 + f"tail {k}") for k in range(2)] + [(600, None), (601, " \n"), (None, rows[0][1])]
    rows += [(0, rows[7][1] + " more")]  # an id repeated with a text of another group
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id bigint, text string, source string").repartition(5)
    plain = [(lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})((t or "").lower().split()) for _, t in rows]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min(root[j] for j, b in enumerate(plain) if len(a & b) >= 0.8 * len(a | b)) for a in plain]
        new = [min(x, root[x]) for x in new]
        if new == root:
            break
        root = new
    first = {r: min((i for (i, _), s in zip(rows, root) if s == r and i is not None), default=None) for r in set(root)}
    want = Counter((i, t) for (i, t), r in zip(rows, root) if i is None or i == first[r])
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert near_copies.keep_one(docs.limit(0)).count() == 0 and dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").count() == sum(want.values())


def test_mixing_carries_the_budget_over_blocks(spark):
    long = [("long", 400)] * 150
    mixed = [("mixed", 1000 if i % 50 == 7 else 2) for i in range(2000)]
    docs = spark.createDataFrame([(i, s, "w " * n, n) for i, (s, n) in enumerate(long + mixed)], "doc_id bigint, source string, text string, n int").repartition(7)
    total = Counter()
    for s, n in long + mixed:
        total[s] += n
    for ratio in (0.2, 0.4, 0.6, 1.3):
        plan = spark.createDataFrame([(s, ratio, w // 328 + 1) for s, w in total.items()], "source string, ratio double, blocks bigint")
        got = {(r.source, r.n): r.k for r in mixing.mix(docs, plan).groupBy("source", "n").agg(F.count("*").alias("k")).collect()}
        have = Counter(long + mixed)
        assert all(abs(got.get(k, 0) - ratio * c) <= 1 for k, c in have.items())
    rows = docs.union(docs.where("doc_id < 20")).withColumn("source", F.when(F.col("source") == "mixed", F.col("source")))
    plan = spark.createDataFrame([("", 2.0, 9), ("mixed", 1.0, 300)], "source string, ratio double, blocks bigint")
    assert mixing.mix(rows, plan).groupBy("source").count().collect() and mixing.mix(rows, plan).count() == 2 * 170 + 2000


def test_imatch_lexicon_is_exact(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join([f"own{i}x{k}" for k in range(400)] + [f"Shared{x}" for x in rng.integers(0, 3000, 200)]) for i in range(600)]
    df = Counter(w for t in texts for w in set(t.lower().encode().split()))
    inside = [w for w, n in df.items() if 2.0 <= np.log(len(texts) / n) <= 6.0]
    want = np.sort(imatch.WordHashes(seed=17).of(inside))
    docs = spark.createDataFrame([(t,) for t in texts] , "text string").repartition(5)
    assert 0 < len(want) < len(df) and np.array_equal(imatch.lexicon(docs, low=2.0, high=6.0), want)
    lone = texts[0].lower().encode().split()[0]
    assert imatch.WordHashes(seed=17).of([lone])[0] not in want
    assert len(imatch.lexicon(docs.limit(0))) == 0 and not imatch.fingerprint(None, want).any() and imatch.fingerprint("a b", want[:0]).any()


def test_pipeline_follows_simhash_links(spark):
    """Repeats of a line leave the fingerprint as it is, but not the set of five-word runs."""
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda "  # an odd number of words: no bit is a draw
    texts = [line * 40, line * 40 + "one two three four five six seven", "something else of its own", line * 40 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    by_hash = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert by_hash == {0: 0, 1: 0, 2: 2, 3: 0} and near_copies.similarity(near_copies.shingles(texts[0]), near_copies.shingles(texts[1])) < 0.8
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()} == {0, 2}


def test_near_copies_in_large_groups_and_buckets(spark, monkeypatch):
    """A group of copies, and texts that share half of theirs but are no copies; buckets of any size give the same."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for k in range(400):  # near copies of one text: one word in 120 differs, so 110 of 121 or more shingles agree with the first
        words = list(base)
        words[int(rng.integers(0, 120))] = f"own{k}"
        rows.append((k, " ".join(words)))
    passage = [f"p{x}" for x in range(60)]
    rows += [(1000 + k, " ".join(passage + [f"q{k}x{x}" for x in rng.integers(0, 9000, 40)])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    kept = {r.doc_id for r in near_copies.keep_one(docs).collect()}
    assert kept == {0} | {1000 + k for k in range(400)}
    monkeypatch.setattr(near_copies, "TILE", 50)
    monkeypatch.setattr(near_copies, "SHINGLES", 3000)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == kept


def test_near_copies_never_make_pairs(spark):
    words = [f"w{x}" for x in range(200)]
    rows = [(k, " ".join(words[:k] + [f"v{k}"] + words[k + 1 :])) for k in range(200)]
    nodes = spark.createDataFrame(rows, "id bigint, text string").select(near_copies.text_key("text").alias("fp"), "text")
    sketches = near_copies.sketched(nodes).cache()
    assert near_copies.clusters(sketches).count() < near_copies.BANDS * len(rows)
    roots = near_copies.components(near_copies.clusters(sketches))
    assert near_copies.verified(roots, nodes, sketches).count() == len(rows) - 1
