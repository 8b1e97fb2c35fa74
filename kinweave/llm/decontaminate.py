"""Benchmark passages in documents, within an edit budget.

Both sides are lower-cased with runs of white space as one blank. An item of m characters may differ by k = floor(m * RATE) edits. Cut into k + 1
pieces, at least one piece of it stands unedited in any such occurrence (pigeonhole), so each exact piece hit gives a place where the item would
lie; Myers' bit-parallel recurrence finds the least distance of the item to any substring there. Items are read in blocks of at most BLOCK_CHARS
characters, each one automaton that is broadcast; more items mean more passes over the documents, not a larger broadcast.

Null or empty texts and items match nothing; repeated rows match alike; ties go to the leftmost end; empty tables give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_batch, tune

RATE = 0.08
BLOCK_CHARS = 1_000_000
FIELDS = "doc_id long, item_id long, distance int, match_start long, match_end long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their places."""
    m = len(item)
    at = [m * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:]) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of text, and the first end where it is reached."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = peq.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, i + 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not text:
                continue
            k = int(len(text) * rate)
            n = len(self.items)
            self.items.append((item_id, text, k, masks(text), masks(text[::-1])))
            for at, piece in pieces(text, k):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.empty = not where
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best occurrence of each item within its budget."""
        if self.empty or not text:
            return
        places: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for n, at in uses:
                places.setdefault(n, []).append(end + 1 - size - at)
        for n, starts in places.items():
            item_id, item, k, peq, back = self.items[n]
            m = len(item)
            best = (k + 1, 0)
            # hits whose windows overlap are looked at together, a window of bounded length at a time
            starts.sort()
            lo = hi = None
            for s in [*starts, None]:
                if s is not None and hi is not None and s - k <= hi and hi - lo < 8 * m:
                    hi = max(hi, s + m + k)
                    continue
                if hi is not None:
                    a = max(lo, 0)
                    d, e = myers(peq, m, text[a:hi])
                    if d < best[0]:
                        best = (d, a + e)
                    if not best[0]:
                        break
                if s is not None:
                    lo, hi = s - k, s + m + k
            d, e = best
            if d <= k:
                a = max(0, e - m - k)
                _, size = myers(back, m, text[a:e][::-1])
                yield item_id, d, e - size, e


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for k, t in benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long"), F.col(text).cast("string")).toLocalIterator():
        t = normal(t)
        if size + len(t) > block_chars and block:
            yield block
            block, size = [], 0
        block.append((k, t))
        size += len(t)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item that occurs in it; places are in the normalised text."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    out = None
    for block in blocks(benchmark, item_id, item_text, block_chars):
        held = spark.sparkContext.broadcast(block)

        def make(held=held):
            m = Matcher(held.value, rate)

            def f(b):
                found = [(k, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in m.find(normal(t))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "distance", "match_start", "match_end"])

            return f

        part = rows.mapInArrow(by_batch(make), FIELDS)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FIELDS) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay."""
    spark = docs.sparkSession
    tune(spark)
    out, at = docs, docs.columns.index(text)
    for block in blocks(benchmark, item_id, item_text, block_chars):
        held = spark.sparkContext.broadcast(block)

        def make(held=held):
            m = Matcher(held.value, rate)

            def f(b):
                yield b.filter(pa.array([t is None or next(m.find(normal(t)), None) is None for t in b.column(at).to_pylist()]))

            return f

        out = out.mapInArrow(by_batch(make), docs.schema)
    return out
