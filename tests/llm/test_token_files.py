"""Sequence files and the piecewise encoder beside plain calls."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textloom.llm import token_files, tokenizer
from textloom.llm.queries import tokenizer_path

ODD = ["Σ", "İ", "ß", "É", " ", "\n", "\t", "  ", "'s", "!", "<|endoftext|>", "<|startoftext|>", "<", "|>", "你好", "\U0001f600", "a", "B", "1", "\xa0",
       "\x1c", "...", "word", "́", "ﬁ", "_", "\x01", "x" * 70]


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_is_the_plain_call(name, spaces, monkeypatch):
    monkeypatch.setattr(tokenizer, "CACHE_PIECES", 500)
    plain = Tokenizer.from_file(tokenizer_path(name))
    rng = random.Random(6)
    texts = [None, "", *("".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(3000))]
    own = tokenizer.Encoder(tokenizer_path(name), spaces)
    for at in range(0, len(texts), 100):
        for text, got in zip(texts[at : at + 100], own.encode(texts[at : at + 100])):
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_sequences_by_number(spark, tmp_path):
    rng = np.random.default_rng(0)
    path = f"{tmp_path}/ids.arrow"
    ids = rng.integers(0, 60_000, 4 * token_files.BATCH_SEQUENCES * 3 + 6)
    with pa.OSFile(path, "wb") as sink:
        out = token_files.SequenceFile(sink, pa.uint16(), 4)
        at = 0
        while at < len(ids):
            step = int(rng.integers(0, 1500))
            out.add(ids[at : at + step].astype("<u4"))
            at += step
        out.close()
    n = -(-len(ids) // 4)
    for k in (0, 1, token_files.BATCH_SEQUENCES - 1, token_files.BATCH_SEQUENCES, n - 2, n - 1):
        got, mask = token_files.sequence(path, k)
        assert got[mask].tolist() == ids[4 * k : 4 * k + 4].tolist() and mask.sum() == min(4, len(ids) - 4 * k)
    with pytest.raises(IndexError):
        token_files.sequence(path, n)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (3, "c"), (3, "c")], "doc_id bigint, text string")
    got = token_files.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3, 3] and sorted(r.n_tokens for r in got) == [1, 2, 2, 3]
    assert token_files.round_trip(docs.limit(0), tokenizer_path("byte_bpe_50k.json"), 2).count() == 0
