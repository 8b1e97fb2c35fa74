"""Order-preserving packing of documents into token windows by dynamic programming.

Documents keep their order in the scan. Each task runs over its documents in blocks of about BLOCK tokens; in a block, a window is cut
at a document end (free), a sentence end or, where neither is near, at a fixed grid; the cut set minimises padding plus penalties for
cut documents and sentences. Transitions use a monotone queue over the last WINDOW tokens; windows whose length is a power of two need
no padding and are further transitions. A null text is empty, so its document is the end id alone; repeated rows and ids are packed like
others; very long texts run over many windows; an empty table gives no rows.
"""
from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokenizer
from .common import arrow_schema, tune
from .textkit import texts

WINDOW = 4096
END_ID = 2
BLOCK = 1 << 19
SENTENCE_CUT, GRID_CUT = 8, 64
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, is_padded_to long"
SCHEMA = arrow_schema(FIELDS)


def cuts(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Window bounds from 0 to total that minimise padding plus penalties."""
    tail = total - total % window
    grid = [np.arange(0, total, window)]
    for bit in range(window.bit_length() - 1, -1, -1):
        if (total - tail) >> bit & 1:
            tail += 1 << bit
            grid.append(np.array([tail]))
    grid = np.concatenate([*grid, [total]])
    pos = np.unique(np.concatenate([grid, doc_ends, sentence_ends]))
    pen = np.full(len(pos), GRID_CUT, np.int64)
    pen[np.searchsorted(pos, sentence_ends)] = SENTENCE_CUT
    pen[np.searchsorted(pos, doc_ends)] = 0
    exact: dict[int, list[int]] = {}
    for bit in range(window.bit_length()):
        want = pos - (1 << bit)
        at = np.minimum(np.searchsorted(pos, want), len(pos) - 1)
        for i in np.flatnonzero((want >= 0) & (pos[at] == want)).tolist():
            exact.setdefault(i, []).append(int(at[i]))
    p, pen = pos.tolist(), pen.tolist()
    cost, back = [0] * len(p), [0] * len(p)
    queue = deque([(0, 0)])  # (cost + position, index), increasing
    for i in range(1, len(p)):
        here = p[i]
        while p[queue[0][1]] < here - window:
            queue.popleft()
        best, j = queue[0]
        best += window - here
        if i in exact:
            for k in exact[i]:
                if cost[k] < best:
                    best, j = cost[k], k
        cost[i] = best = best + pen[i]
        back[i] = j
        g = best + here
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, i))
    out, i = [p[-1]], len(p) - 1
    while i:
        i = back[i]
        out.append(p[i])
    return np.array(out[::-1])


def _block(ids: list[np.ndarray], doc_ids: list, sentence: np.ndarray, base: int) -> tuple[pa.RecordBatch, int]:
    size = np.array([len(x) for x in ids])
    flat = np.concatenate(ids).astype("<u4")
    ends = np.cumsum(size)
    starts = ends - size
    bounds = cuts(len(flat), ends, np.flatnonzero(sentence[flat]) + 1)
    a = np.union1d(bounds[:-1], starts)
    b = np.append(a[1:], len(flat))
    doc = np.searchsorted(starts, a, "right") - 1
    seq = np.searchsorted(bounds, a, "right") - 1
    length = np.diff(bounds)
    padded = np.where((length & (length - 1)) == 0, length, WINDOW)
    raw = memoryview(flat.tobytes())
    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
    cols = [pa.array([doc_ids[i] for i in doc.tolist()], pa.int64()), a - starts[doc], b - a, np.array(crc, np.int64), size[doc], base + seq, a - bounds[seq], padded[seq]]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.asarray(x, np.int64)) for x in cols], schema=SCHEMA), len(bounds) - 1


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts there and in its sequence, its length and the crc32 of its ids."""
    tune(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        tok = tokenizer.load(tokenizer_path)
        vocab = tok.own.get_vocab(with_added_tokens=True)
        sentence = np.zeros(len(tok.final) + 1, bool)
        sentence[[i for w, i in vocab.items() if w.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        sentence[END_ID] = False
        base = TaskContext.get().partitionId() << 40
        ids, keys, n = [], [], 0
        end = np.array([END_ID], np.int32)
        for b in batches:
            names = b.column(0).to_pylist()
            for t in texts(b.column(1)):
                for i, x in zip(t.rows.tolist(), tok.encode(t)):
                    ids.append(np.append(x, end))
                    keys.append(names[i])
                    n += len(x) + 1
                if n >= BLOCK:
                    out, k = _block(ids, keys, sentence, base)
                    yield out
                    base += k
                    ids, keys, n = [], [], 0
        if ids:
            yield _block(ids, keys, sentence, base)[0]

    return docs.select(F.col(doc_id).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, FIELDS)
