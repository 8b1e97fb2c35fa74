"""Exact ids of a public word-end tokenizer at speed: each pre-token is encoded by the library once and then looked up."""
from __future__ import annotations

import os
import re

import numpy as np

from .textkit import LOWER, Memo, Texts, span_hashes

#: Pre-tokens that a process keeps before it starts anew.
KEPT_WORDS = 1_000_000
#: Bytes that the kernel below classes like the tokenizer: printable ASCII, blanks, and the letters of U+00C0 to U+00FF. Texts with others, or with a special token's start, go to the library whole.
_ODD = re.compile(rb"[^\t\n\r\x20-\x7e\x80-\xbf\xc3]|\xc3[\x97\xb7]|<\|")
_CONTRACTION = re.compile(rb"'(?:[stmd]|re|ve|ll)", re.I)
_KIND = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other
_KIND[[9, 10, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2
_loaded: dict[str, "WordTokenizer"] = {}


def load(path: str) -> "WordTokenizer":
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class WordTokenizer:
    """Ids of word_bpe_49k.json; equal to Tokenizer.encode(text, add_special_tokens=False).ids for every text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.final = np.zeros(self.own.get_vocab_size(with_added_tokens=True), bool)
        self.final[[i for piece, i in self.own.get_vocab().items() if piece.endswith("</w>")]] = True
        self.memo = Memo()
        self.forget()

    def forget(self) -> None:
        self.memo.clear()
        self.kept, self.used = 0, 0
        self.first, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)

    def _add(self, words: list[str]) -> np.ndarray:
        """Encodes words joined by blanks; the ids that end a word tell them apart again. Returns their places."""
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.own.encode_batch_fast([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)], add_special_tokens=False)])
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer doesn't close each pre-token with one final piece")
        k, n = self.kept, len(words)
        for name, need in (("first", k + n), ("size", k + n), ("pool", self.used + len(ids))):
            a = getattr(self, name)
            if len(a) < need:
                setattr(self, name, np.concatenate([a, np.zeros(max(len(a), need - len(a)), a.dtype)]))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[k : k + n] = self.used + np.concatenate([[0], ends[:-1]])
        self.size[k : k + n] = np.diff(ends, prepend=0)
        self.used += len(ids)
        self.kept += n
        return np.arange(k, k + n, dtype=np.int32)

    def _pieces(self, buf: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, and starts and ends of pre-tokens."""
        low = LOWER[buf]
        lead = np.flatnonzero(buf == 0xC3) + 1
        big = lead[(buf[lead] >= 0x80) & (buf[lead] <= 0x9E)]
        low[big] += 0x20
        kind = _KIND[buf]
        n = len(buf)
        start = np.empty(n + 1, bool)
        start[0] = True
        start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start[n] = True
        start[lo] = True
        if (low == 0x27).any():
            raw = low.tobytes()
            edges = set(lo.tolist())
            for m in _CONTRACTION.finditer(raw):
                p, q = m.span()
                if p and kind[p - 1] == 3 and p not in edges or any(x in edges for x in range(p + 1, q)):
                    continue
                start[p + 1 : q] = False
                start[q] = True
        at = np.flatnonzero(start)
        a, b = at[:-1], at[1:]
        keep = kind[a] != 0
        return low, a[keep], b[keep]

    def encode(self, t: Texts) -> list[np.ndarray]:
        """int32 ids of each text."""
        raw = t.buf.tobytes()
        lo, hi = t.lo.tolist(), t.hi.tolist()
        odd = [i for i, (a, b) in enumerate(zip(lo, hi)) if b > a and _ODD.search(raw, a, b)]
        buf = t.buf
        if odd:
            buf = t.buf.copy()
            for i in odd:
                buf[lo[i] : hi[i]] = 32
        out = [np.zeros(0, np.int32)] * len(lo)
        if len(buf):
            low, a, b = self._pieces(buf, t.lo)
            if len(a):
                h = span_hashes(low, a, b)
                place = self.memo.find(h)
                miss = np.flatnonzero(place < 0)
                if len(miss):
                    if self.kept > KEPT_WORDS:
                        self.forget()
                        miss = np.arange(len(h))
                    new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
                    text = low.tobytes()
                    at = miss[at]
                    where = self._add([text[x:y].decode() for x, y in zip(a[at].tolist(), b[at].tolist())])
                    self.memo.put(new, where)
                    place[miss] = where[back]
                size = self.size[place].astype(np.int64)
                ends = np.cumsum(size)
                ids = self.pool[np.repeat(self.first[place] - (ends - size), size) + np.arange(ends[-1])]
                ends = np.concatenate([[0], ends])
                x, y = ends[np.searchsorted(a, t.lo)].tolist(), ends[np.searchsorted(a, t.hi)].tolist()
                out = [ids[p:q] for p, q in zip(x, y)]
        for i in odd:
            out[i] = np.array(self.own.encode(raw[lo[i] : hi[i]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
        return out
