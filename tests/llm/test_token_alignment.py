"""Token alignment beside brute force over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import token_alignment as alignment
from textloom.llm.queries import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "   ", "a", "Hello, world!", "  two  spaces ", "tab\there\nline\n\n  in", "café naïve 你好世界 \U0001f600\U0001f468‍\U0001f469",
    "a▁b", "<|endoftext|> </s><s> <unk> <0x41>", "x" * 3000, "don't it's we'll 3.14 1,000", "\x00\x01 nul", " nbsp 　wide",
    "Σİﬁ Ä", "word. " * 400, "a\x1c b\x1d  c", "▁", "end \n", "﻿bom", "same text here", "same text here",
]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    letters = alignment.byte_letters()
    found, counts = [], Counter()
    for doc, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            found.append((doc, 0, 0, 0, [], ""))
            continue
        x_ends, y_ends = np.cumsum([*map(len, xs)]).tolist(), np.cumsum([*map(len, ys)]).tolist()
        common = sorted({*x_ends} & {*y_ends})
        links, groups, at = [], [], 0
        for end in common:
            own = [[i for i, e in zip(ids, ends) if at < e <= end] for ids, ends in ((x, x_ends), (y, y_ends))]
            groups.append(",".join(map(str, own[0])) + "|" + ",".join(map(str, own[1])))
            links.append((own[0][-1], own[1][-1]))
            at = end
        counts.update(links)
        found.append((doc, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return Counter(
        (doc, n_a, n_b, n_g, len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), digest)
        for doc, n_a, n_b, n_g, links, digest in found
    )


def corpus():
    rng = random.Random(4)
    odd = ["éa", "你", "\U0001f600", "\n", "\t", "  ", "'s", "1234", "--", " ", "...", "Σ", "_", "the", "ing", "\x1f", " "]
    texts = TEXTS + ["".join(rng.choice([*odd, " ", " ", "word", "qu"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return [(k // 2 if k % 7 else None, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 100])
def test_report_is_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id bigint, text string, links string, n_a int").repartition(5)
    got = alignment.report(docs, tokenizer_path(A), tokenizer_path(B))
    assert Counter(tuple(r) for r in got.collect()) == plain(rows)
    assert alignment.report(docs.limit(0), tokenizer_path(A), tokenizer_path(B)).count() == 0


def test_groups_are_given_as_text(spark):
    docs = spark.createDataFrame([("k", "Hello, world!"), ("n", None)], "name string, body string")
    got = {r.doc_id: r for r in alignment.align(docs, tokenizer_path(A), tokenizer_path(B), "name", "body").collect()}
    assert hashlib.sha256(got["k"].groups.encode()).hexdigest() == got["k"].groups_sha256 and got["n"].groups == got["n"].groups_sha256 == ""
    assert got["k"].groups.count(";") + 1 == got["k"].n_groups == len(got["k"].links)


def test_pointer_jumping_labels_components():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a, b = (np.append(np.sort(rng.choice(n, rng.integers(0, n), replace=False)) + 1, n + 1) for _ in range(2))
        want = np.searchsorted(b, np.intersect1d(a, b))
        last = alignment.last_of_group(a, b)
        assert [*last] == [int(want[want >= np.searchsorted(b, e)][0]) for e in [*a, *b]]
    assert len(alignment.last_of_group(np.zeros(0, int), np.zeros(0, int))) == 0


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    own, fresh = (alignment.Aligner(tokenizer_path(A), tokenizer_path(B)) for _ in range(2))
    for k in range(20):
        texts = [f"w{k * 3 + j} the w{j} of {'z' * 80}" for j in range(30)]
        assert [*own.align(texts)] == [x for t in texts for x in fresh.align([t])]
        assert len(own.now) + len(own.old) < 300 and not any("z" in p for p in own.now)
    t = own.tokenizers
    assert alignment.possible_pairs(t.a_bytes, t.b_bytes) < 1_000_000
