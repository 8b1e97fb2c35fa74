"""Document token counts by separator scan over flat token files.

A flat token file is a run of unsigned 16-bit ids in which each document ends with an end-of-document id; there is no index. It is
kept as fixed-size blocks (file_id, block, ids) that any task can scan alone. Each block is searched for the end id with one vectorised comparison;
a document may start in one block and end in a later one, so a prefix scan over the few numbers of each block (tokens, ends,
tokens after the last end) gives every block the count that it continues. Tokens after a file's last end are a document without an end, marked closed = false.
Empty documents count 1 (their end id); null texts are empty; empty blocks and tables give no rows; repeated rows are documents of their own.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tokenizer
from .common import arrow_schema, by_batch, materialize, tune
from .textkit import texts

#: Ids in a block.
BLOCK = 1 << 18

END_ID = 49407
#: Stands in the files for an end_id that a text itself holds: beyond the vocabulary, so it ends no document.
ESCAPED = 65535


def write_blocks(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Flat token blocks of docs in scan order: (file_id, block, ids little-endian uint16, keys: the doc_id of each end in it, for the reader's check)."""
    tune(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        tok = tokenizer.load(tokenizer_path)
        part, no = TaskContext.get().partitionId(), 0
        parts, keys, n = [], [], 0  # keys: (place of the end, doc_id)

        def cut(flat, upto, keys):
            own = [k for at, k in keys if at < upto]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([no], pa.int32()), pa.array([flat[:upto].astype("<u2").tobytes()], pa.binary()), pa.array([own], pa.list_(pa.int64()))], ["file_id", "block", "ids", "keys"])

        for b in batches:
            names = b.column(0).to_pylist()
            for t in texts(b.column(1)):
                for i, x in zip(t.rows.tolist(), tok.encode(t)):
                    parts += [np.where(x == end_id, ESCAPED, x), np.array([end_id], np.int32)]
                    n += len(x) + 1
                    keys.append((n - 1, names[i]))
                while n >= block:
                    flat = np.concatenate(parts)
                    yield cut(flat, block, keys)
                    no += 1
                    parts, n, keys = [flat[block:]], n - block, [(at - block, k) for at, k in keys if at >= block]
        if n:
            yield cut(np.concatenate(parts), n, keys)

    return docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")).cast("binary")).mapInArrow(run, "file_id long, block int, ids binary, keys array<long>")


def scan(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(file_id, doc_no, start, n_tokens, closed, block) of every document in the files."""

    def edges(b):
        rows = []
        for file, no, raw in zip(b.column("file_id").to_pylist(), b.column("block").to_pylist(), b.column("ids").to_pylist()):
            ids = np.frombuffer(raw, "<u2")
            rows.append((file, no, len(ids), (np.flatnonzero(ids == end_id) + 1).astype(np.int32)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["file_id", "block", "n", "stops"])

    edge = blocks.select("file_id", "block", "ids").mapInArrow(by_batch(lambda: edges), "file_id long, block int, n long, stops array<int>")
    # prefix scan over the blocks of a file, which is what one task wrote; the ids themselves aren't shuffled
    before = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    edge = edge.withColumn("at", zero(F.sum("n").over(before))).withColumn("doc_no", zero(F.sum(F.size("stops").cast("long")).over(before)))
    # where the open document starts: after the last end in an earlier block
    edge = edge.withColumn("open_at", zero(F.max(F.when(F.size("stops") > 0, F.col("at") + F.element_at("stops", -1))).over(before)))
    edge = edge.withColumn("last", F.col("block") == F.max("block").over(Window.partitionBy("file_id")))

    def lengths(b):
        cols = [b.column(c).to_pylist() for c in ("file_id", "block", "n", "stops", "at", "doc_no", "open_at", "last")]
        for file, no, n, stops, at, doc_no, open_at, last in zip(*cols):
            stop = np.array(stops, np.int64) + at
            start = np.concatenate([[open_at], stop])
            closed = np.ones(len(stop), bool)
            if last and start[-1] < at + n:
                stop, closed = np.append(stop, at + n), np.append(closed, False)
            start, k = start[: len(stop)], len(stop)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, file)), pa.array(doc_no + np.arange(k)), pa.array(start), pa.array(stop - start), pa.array(closed), pa.array(np.full(k, no, np.int32)), pa.array(np.arange(k, dtype=np.int32))], ["file_id", "doc_no", "start", "n_tokens", "closed", "block", "nth"])

    return edge.mapInArrow(by_batch(lambda: lengths), "file_id long, doc_no long, start long, n_tokens long, closed boolean, block int, nth int")


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes docs as flat token files in the shared folder, scans these, and gives each count its doc_id back."""
    blocks = materialize(write_blocks(docs, tokenizer_path), "token-blocks")
    keys = blocks.select("file_id", "block", F.posexplode("keys").alias("nth", "doc_id"))
    return scan(blocks).join(keys, ["file_id", "block", "nth"], "left").select("doc_id", "file_id", "doc_no", "start", "n_tokens", "closed")
