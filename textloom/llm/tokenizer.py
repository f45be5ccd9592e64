"""Token ids of whole texts from a tokenizer file, with a bounded memory of word pieces.

A text is cut only where no token of the file can reach across: before a space that follows a
character that is no white space. The ids of the pieces in order are then the ids of the text, as one plain call
gives them, and frequent pieces are encoded once per Python worker. Texts that reading in pieces could change are encoded
whole: those with the string of a special token, and, where the file lower-cases, those with a letter whose
lower case depends on its neighbours. Long pieces are not remembered.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np

CACHE_PIECES = 600_000  # of each of two generations
TOGETHER = 30_000
TAIL = "".join(c for c in string.punctuation if c not in "'<>|")
MARK = "\x01"
GROUP = 200
LONG_PIECE = 64
NEIGHBOURLY = re.compile("[\u03a3\u0130]")  # capital sigma, dotted capital I
_SPACE_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<!\s)(?= )")


class Encoder:
    """``encode(texts)`` gives the ids of each text as little-endian unsigned 32-bit bytes.

    ``spaces`` says whether the file encodes white space (byte-level files) or drops it. A byte-level
    piece keeps its leading space. A private mark, a token of its own between spaces, separates
    pieces that are encoded in one call; pieces that hold the mark are encoded alone.
    """

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.spaces = spaces
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode(" " + MARK, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if "<" in text and self.whole.search(text):
            return [text]
        if not self.spaces:
            return [text] if NEIGHBOURLY.search(text) else [p for p in text.lower().split(" ") if p]
        if _SPACE_RUN.search(text):
            return [p for p in _CUT.split(text) if p]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + p for p in rest]

    def _apart(self, piece: str) -> bool:
        """Whether a piece is encoded by a call of its own."""
        return len(piece) > LONG_PIECE or MARK in piece or bool(NEIGHBOURLY.search(piece)) or "<" in piece and bool(self.whole.search(piece))

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of new pieces. A word and the punctuation at its end are encoded apart."""
        ends, unknown = {}, set()
        for p in new:
            if self._apart(p):
                unknown.add(p)
                continue
            base = p.rstrip(TAIL)
            if base != p and base and base[-1].isalnum():
                ends[p] = base, p[len(base) :]
                unknown.update(ends[p])
            else:
                unknown.add(p)
        unknown = [p for p in unknown if p not in self.cache]
        alone = [p for p in unknown if (self.spaces and p[0] != " ") or self._apart(p)]
        for piece, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self.cache[piece] = np.array(e.ids, "<u4").tobytes()
        together = list(set(unknown).difference(alone))
        groups = [together[i : i + GROUP] for i in range(0, len(together), GROUP)]
        between = " " + MARK if self.spaces else f" {MARK} "
        lead, last = len(self.mark) - 1, self.mark[-1]
        for start in range(0, len(groups), 50):
            some = groups[start : start + 50]
            encoded = self.tokenizer.encode_batch_fast([between.join(g) for g in some], add_special_tokens=False)
            for group, e in zip(some, encoded):
                ids = np.array(e.ids, "<u4")
                marks = np.flatnonzero(ids == last)
                starts, stops = [0, *(4 * marks + 4).tolist()], [*(4 * marks - 4 * lead).tolist(), 4 * len(ids)]
                if len(starts) != len(group):
                    raise RuntimeError("the separator mark was not kept apart by the tokenizer")
                raw = ids.tobytes()
                self.cache.update(zip(group, [raw[a:b] for a, b in zip(starts, stops)]))
        self.cache.update((p, self.cache[base] + self.cache[tail]) for p, (base, tail) in ends.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text has no ids."""
        out, i = [], 0
        while i < len(texts):
            cut, n = [], 0
            while i < len(texts) and n < TOGETHER:  # few enough to stay in the processor's cache
                pieces = self.pieces(texts[i] or "")
                found = [*map(self.cache.get, pieces)]
                cut.append((pieces, found, {p for p, ids in zip(pieces, found) if ids is None} if None in found else ()))
                n += len(pieces)
                i += 1
            out += self._finish(cut)
        return out

    def _finish(self, cut: list[tuple]) -> list[bytes]:
        new = set().union(*(n for _, _, n in cut))
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.old, self.cache = self.cache, {}
        if self.old:  # pieces that are asked for again move to the new generation
            again = {p: self.old[p] for p in new if p in self.old}
            self.cache.update(again)
            new.difference_update(again)
        self._learn(list(new))
        get = self.cache.__getitem__
        out = [
            b"".join([get(p) if ids is None else ids for p, ids in zip(pieces, found)] if missing else found)
            for pieces, found, missing in cut
        ]
        for p in new:
            if len(p) > LONG_PIECE:
                del self.cache[p]
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """One encoder per Python worker and file."""
    key = (path, spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, spaces)
    return _ENCODERS[key]
