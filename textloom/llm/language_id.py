"""Language identification with a bidirectional gated recurrent network over bytes, in numpy.

The network reads the UTF-8 bytes of a word, with a space on either side, in both directions, and labels every position. It
is trained by backpropagation through time on words of a bounded sample of labelled documents. A document's probabilities
are the mean over all positions of all its words; as the state starts anew at each word, a word seen before needs no second
run. Words longer than ``MAX_WORD`` bytes are read in pieces; nothing is left out.

A null text, or one without a letter, is ``und`` with score 0. Rows without a label are not learned from. Repeated rows are
labelled alike. Without labelled rows every row is ``und``. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, saved, words_of

# The training sample: documents per label, documents and words in all, characters of each document.
DOCS_PER_LABEL = 400
MAX_DOCS = 4000
SLICE = 400
MAX_WORDS = 24_000
EPOCHS = 3

HIDDEN = 16
MAX_WORD = 46
CHUNK = 4096
CACHE_WORDS = 300_000
WAITING = 100_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class BiGru:
    """Two gated recurrent layers, one per direction, and a softmax over their states at every position."""

    labels: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 1) -> BiGru:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        params = {"out": draw(2 * hidden, len(labels), scale=0.2), "bias": np.zeros(len(labels), np.float32)}
        for d in "fb":
            params["x" + d] = draw(256, 3 * hidden, scale=0.3)
            params["h" + d] = draw(hidden, 3 * hidden, scale=0.25)
        return cls(labels, params)

    def _states(self, x: np.ndarray, d: str, keep: bool):
        """States after each step of one direction; with ``keep`` also what the way back needs."""
        table, u = self.params["x" + d], self.params["h" + d]
        size, steps = u.shape[0], x.shape[1]
        h = np.zeros((len(x), size), np.float32)
        states = np.empty((steps, len(x), size), np.float32)
        kept = []
        for t in range(steps):
            a, b = table[x[:, t]], h @ u
            gates = _sigmoid(a[:, : 2 * size] + b[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            n = np.tanh(a[:, 2 * size :] + r * b[:, 2 * size :])
            if keep:
                kept.append((h, z, r, n, b[:, 2 * size :]))
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def _both(self, x: np.ndarray, length: np.ndarray, keep: bool):
        steps = np.arange(x.shape[1])
        back = np.where(steps < length[:, None], length[:, None] - 1 - steps, steps)  # padding stays at the end
        fs, fk = self._states(x, "f", keep)
        bs, bk = self._states(np.take_along_axis(x, back, 1), "b", keep)
        rows = np.arange(len(x))[:, None]
        both = np.concatenate([fs.transpose(1, 0, 2), bs.transpose(1, 0, 2)[rows, back]], axis=2)
        logits = both @ self.params["out"] + self.params["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        return p, both, back, fk, bk

    def positions(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sum over a word's positions of the label probabilities."""
        p = self._both(x, length, False)[0]
        mask = np.arange(x.shape[1]) < length[:, None]
        return (p * mask[:, :, None]).sum(axis=1)

    def gradients(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradients, by backpropagation through time."""
        p, both, back, fk, bk = self._both(x, length, True)
        mask = (np.arange(x.shape[1]) < length[:, None]).astype(np.float32)
        total, rows = mask.sum(), np.arange(len(x))[:, None]
        loss = float(-(np.log(p[np.arange(len(x)), :, y] + 1e-9) * mask).sum() / total)
        d = p.copy()
        d[np.arange(len(x)), :, y] -= 1
        d *= mask[:, :, None] / total
        size = both.shape[2] // 2
        grads = {"out": np.einsum("btk,btl->kl", both, d), "bias": d.sum(axis=(0, 1))}
        d_both = d @ self.params["out"].T
        halves = {"f": d_both[:, :, :size], "b": d_both[:, :, size:][rows, back]}
        inputs = {"f": x, "b": np.take_along_axis(x, back, 1)}
        for way, kept in (("f", fk), ("b", bk)):
            u = self.params["h" + way]
            gx, gu = np.zeros_like(self.params["x" + way]), np.zeros_like(u)
            dh = np.zeros((len(x), size), np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                h, z, r, n, hn = kept[t]
                dh = dh + halves[way][:, t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                db = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(gx, inputs[way][:, t], da)
                gu += h.T @ db
                dh = dh * z + db @ u.T
            grads["x" + way], grads["h" + way] = gx, gu
        return loss, grads

    def train(self, words: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.01, seed: int = 1) -> list[float]:
        """Adam on mini-batches of words of like length; returns each epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(w) for k, w in self.params.items()}
        size = np.array([len(w) for w in words])
        step, losses = 0, []
        for epoch in range(epochs):
            order = np.argsort(size + rng.random(len(words)) * 2, kind="stable")
            starts, sums = rng.permutation(range(0, len(order), batch)), []
            for start in starts:
                pick = order[start : start + batch]
                x, length = padded([words[i] for i in pick])
                loss, grads = self.gradients(x, length, y[pick])
                norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
                step += 1
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    scale = rate * 0.5**epoch / (1 - 0.9**step)
                    self.params[k] -= (scale * m[k] / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                sums.append(loss)
            losses.append(float(np.mean(sums)))
        return losses


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each between spaces, in one matrix, and their lengths."""
    length = np.array([len(w) + 2 for w in words], np.int64)
    width = int(length.max())
    data = b"".join([(b" " + w + b" ").ljust(width) for w in words])
    return np.frombuffer(data, np.uint8).reshape(len(words), width), length


def cut(words: list[bytes]) -> list[bytes]:
    """Words no longer than ``MAX_WORD`` bytes; longer ones in pieces."""
    if not words or max(map(len, words)) <= MAX_WORD:
        return words
    return [w[i : i + MAX_WORD] for w in words for i in range(0, len(w), MAX_WORD)]


class Reader:
    """Label probabilities of documents; remembers the position sums of words up to a bound."""

    def __init__(self, model: BiGru):
        self.model, self.index = model, {}
        self.sums = np.zeros((0, len(model.labels) + 1), np.float32)

    def _learn(self, new: list[bytes]) -> None:
        new.sort(key=len)
        found = [self.sums]
        for i in range(0, len(new), CHUNK):
            x, length = padded(new[i : i + CHUNK])
            found.append(np.concatenate([self.model.positions(x, length), length[:, None].astype(np.float32)], axis=1))
        base = len(self.sums)
        self.sums = np.concatenate(found)
        self.index.update((w, base + i) for i, w in enumerate(new))

    def _sums(self, words: list[bytes]) -> np.ndarray:
        """Rows of ``sums`` for the words; all of them fit the memory at once."""
        found = [*map(self.index.get, words)]
        if None in found:
            new = {w for w, k in zip(words, found) if k is None}
            if len(self.index) + len(new) > CACHE_WORDS:
                self.index.clear()
                self.sums = self.sums[:0]
                new = set(words)
            self._learn(list(new))
            found = [*map(self.index.__getitem__, words)]
        return self.sums[np.array(found, np.int64)]

    def probabilities(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Mean over all positions of each text; None for a text without a letter. New words of many texts run together."""
        totals = [np.zeros(self.sums.shape[1]) if t and _LETTER.search(t) else None for t in texts]
        waiting, owner = [], []

        def settle() -> None:
            if waiting:
                ends = np.cumsum([n for _, n in owner])
                rows = self._sums(waiting).astype(np.float64)
                for (i, _), part in zip(owner, np.add.reduceat(rows, np.append(0, ends[:-1]), axis=0)):
                    totals[i] += part
                waiting.clear()
                owner.clear()

        for i, t in enumerate(texts):
            if totals[i] is None:
                continue
            words = cut(words_of(t))
            for at in range(0, len(words), WAITING):
                some = words[at : at + WAITING]
                waiting.extend(some)
                owner.append((i, len(some)))
                if len(waiting) >= WAITING:
                    settle()
        settle()
        return [None if t is None else t[:-1] / t[-1] for t in totals]


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1. A null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 != 1, F.lit(False))


def sample(docs: DataFrame, label: str = "lang", text: str = "text", doc_id: str = "doc_id") -> list[tuple[str, str]]:
    """``(label, slice of the text)`` of a bounded sample, about equally many documents of each label."""
    known = docs.where(learnable(doc_id) & F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("h")
    )
    counts = saved(known.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels")
    share = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = F.pmod(F.shiftright("h", 30), F.greatest(F.length("text") - SLICE, F.lit(1)).cast("bigint")) + 1
    part = F.col("text").substr(start.cast("int"), F.lit(SLICE))
    rows = known.join(counts, "label").where(share < F.lit(float(DOCS_PER_LABEL)) / F.col("n")).select("label", part.alias("part"))
    return sorted((r.label, r.part) for r in rows.limit(MAX_DOCS).collect())


def fit(docs: DataFrame, label: str = "lang", text: str = "text", doc_id: str = "doc_id") -> BiGru | None:
    """A trained network, or None without labelled rows."""
    rows = [(tag, words_of(part)) for tag, part in sample(docs, label, text, doc_id)]
    labels = sorted({tag for tag, _ in rows})
    if not labels:
        return None
    quota, words, y = MAX_WORDS // len(labels) + 1, [], []
    rng = np.random.default_rng(7)
    for k, tag in enumerate(labels):
        # A slice may begin and end inside a word.
        own = cut([w for t, ws in rows if t == tag for w in (ws[1:-1] or ws)])
        pick = rng.permutation(len(own))[:quota]
        words += [own[i] for i in pick]
        y += [k] * len(pick)
    model = BiGru.fresh(labels)
    if words and len(labels) > 1:
        model.train(words, np.array(y))
    return model


def predict(docs: DataFrame, model: BiGru | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``; ``text`` may be one of them."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*keep, *([] if text in keep else [F.col(text).alias("_read")]))
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model) if model else None
        for b in batches:
            tags, scores = [], []
            texts = b.column(at).to_pylist()
            for p in reader.probabilities(texts) if reader else [None] * len(texts):
                tags.append(UNKNOWN if p is None else model.labels[int(p.argmax())])
                scores.append(0.0 if p is None else float(min(1.0, p.max())))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(tags, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, (kinds + ", " if kinds else "") + "lang_pred string, score double")
