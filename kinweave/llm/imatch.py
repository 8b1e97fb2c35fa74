"""I-Match fingerprints over randomised lexicons.

The lexicon keeps the words whose document frequency lies in a band of inverse document frequency, relative to the number of documents, so
its size is at most (mean distinct words of a document) / BAND[0], whatever the corpus. From it ORDERS chains of LEVELS random lexicons are drawn, the same
for all documents: the first of a chain is the whole lexicon, each next one holds a random half of the one before. A fingerprint has one hash for each
lexicon, over the sorted distinct terms that the document has in it: 0 where it has none. Likeness is the share of chains whose smallest lexicon
with a term of either text gives both the same hash: small lexicons forgive edits, whole ones tell equal sets of terms.

A null text is empty. A text without terms in the band uses all its words; without words, the whole text is hashed. Equal texts get
equal fingerprints, so repeated rows do; very long texts are handled alone; other columns play no part; an empty table gives no rows.
The next document is that with the next doc_id (ties by text hash; the last is followed by the first, one alone by itself).
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import by_batch, materialize, partitions, tune
from .textkit import Keys, mix, texts, words

ORDERS, LEVELS = 12, 13
#: Kept terms occur in at least the first and at most the second share of documents.
BAND = (0.0005, 0.1)
#: Bytes of texts that are unpacked at a time, unless a single text is longer.
UNPACKED = 8 << 20
_SALT = np.random.default_rng(31).integers(1, 2**63, ORDERS, dtype=np.uint64)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, df): 64-bit word hash and the number of documents that hold the word."""
    tune(docs.sparkSession)

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([y for _, y in held])).astype(np.int64)
            return h, n

        for b in batches:
            for t in texts(b.column(0)):
                w = words(t)
                order = np.lexsort((w.hash, w.text))
                h, d = w.hash[order], w.text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                u, n = np.unique(h[new], return_counts=True)
                held.append((u, n))
                size += len(u)
                if size > 2_000_000:
                    held = [out()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield from emit(*held.pop())
                        size = 0
        if held:
            yield from emit(*out())

    def emit(h, n):
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["h", "df"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary")).mapInArrow(count, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> np.ndarray:
    """Sorted hashes of the words in the band; bounded as said above."""
    n = docs.count()
    rows = document_frequencies(docs, text).where((F.col("df") >= F.lit(band[0] * n)) & (F.col("df") <= F.lit(max(2.0, band[1] * n)))).select("h")
    table = rows.toArrow()
    return np.sort(table.column(0).to_numpy().view(np.uint64))


_STEP = 0x9FB21C651E98DF25


def _hashes(terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[documents, ORDERS, LEVELS] hashes of 16 bits: terms are sorted and distinct in each document, first is where each document's begin."""
    n, docs = len(terms), len(first)
    out = np.zeros((LEVELS, ORDERS * docs), np.uint16)
    power = np.full(n, _STEP, np.uint64)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    # by order, document and term; the level is the number of leading zero bits of a term's draw
    draw = mix(terms[None, :] ^ _SALT[:, None]).ravel()
    group = np.tile(np.repeat(np.arange(docs), np.diff(np.append(first, n))), ORDERS) + np.repeat(np.arange(ORDERS) * docs, n)
    value = np.tile(mix(terms ^ np.uint64(0x51ED270B)), ORDERS)
    for level in range(LEVELS):
        if level:
            inside = np.flatnonzero(draw < np.uint64(1 << 64 - level))
            draw, group, value = draw[inside], group[inside], value[inside]
        if not len(group):
            break
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
        total = mix(np.add.reduceat(value * power[place], start)) >> np.uint64(48)
        out[level, group[start]] = np.maximum(total, np.uint64(1)).astype(np.uint16)
    return out.reshape(LEVELS, ORDERS, docs).transpose(2, 1, 0)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints [documents, ORDERS, LEVELS]: the share of chains that agree on the smallest lexicon with a term of either."""
    some = (a != 0) | (b != 0)
    last = LEVELS - 1 - np.argmax(some[:, :, ::-1], axis=2)[:, :, None]
    return (np.take_along_axis(a, last, 2) == np.take_along_axis(b, last, 2)).mean((1, 2)) if len(a) else np.zeros(0)


class Prints:
    def __init__(self, band: np.ndarray):
        self.band = Keys(band)

    def of(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros((0, ORDERS, LEVELS), np.uint16)]
        for t in texts(column):
            w = words(t)
            known = self.band.find(w.hash) >= 0
            bare = np.bincount(w.text[known], minlength=len(t.lo)) == 0
            use = known | bare[w.text]
            term, doc = w.hash[use], w.text[use]
            order = np.lexsort((term, doc))
            term, doc = term[order], doc[order]
            new = np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.zeros(0, bool)
            term, doc = term[new], doc[new]
            owner, first = np.unique(doc, return_index=True)
            own = np.zeros((len(t.lo), ORDERS, LEVELS), np.uint16)
            if len(term):
                own[owner] = _hashes(term, first)
            raw = t.buf.tobytes()
            for i in np.flatnonzero(w.count == 0).tolist():
                own[i] = max(1, int.from_bytes(hashlib.blake2b(raw[t.lo[i] : t.hi[i]], digest_size=2).digest()))
            out.append(own)
        return np.concatenate(out)


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, raw: list[bytes], prints: Prints) -> list[pa.Array]:
    """The result columns of all texts but the last, each followed by the next."""
    n_chars, edited = [], []
    for a, b in zip(raw, raw[1:]):
        s = a.decode("utf-8", "replace")
        k = len(s) // 4
        n_chars.append(len(s))
        edited.append((s[: len(s) - k] + b[: 4 * k + 4].decode("utf-8", "ignore")[:k]).encode())
    fp, fe = prints.of(pa.array(raw, pa.binary())), prints.of(pa.array(edited, pa.binary()))
    fp, fn = fp[:-1], fp[1:]
    hexed = lambda x: [r.astype(">u2").tobytes().hex() for r in x]
    return [pa.array(ids[:-1], pa.int64()), pa.array(n_chars, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()), pa.array(hexed(fp), pa.string()), pa.array(hexed(fe), pa.string()), pa.array(likeness(fp, fe)), pa.array(likeness(fp, fn))]


def _packed(rows: DataFrame) -> DataFrame:
    """rows (k, h, t) with each t packed: whole texts are shuffled once, and this less than halves them."""

    def make():
        c = zstandard.ZstdCompressor(level=3)

        def f(b):
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), pa.array([c.compress(t) for t in b.column("t").to_pylist()], pa.binary())], ["k", "h", "t"])

        return f

    return rows.mapInArrow(by_batch(make), "k long, h long, t binary")


def _unpacked(batch: pa.RecordBatch):
    """(ids, texts) of a batch in runs of about UNPACKED bytes."""
    d = zstandard.ZstdDecompressor()
    ids, raw, size = [], [], 0
    for k, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        n = zstandard.frame_content_size(z)
        if raw and size + n > UNPACKED:
            yield ids, raw
            ids, raw, size = [], [], 0
        ids.append(k)
        raw.append(d.decompress(z))
        size += n
    if raw:
        yield ids, raw


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and to the next text's."""
    spark = docs.sparkSession
    tune(spark)
    lex = spark.sparkContext.broadcast(lexicon(docs, text, band))
    rows = docs.select(F.col(doc_id).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).withColumn("h", F.xxhash64("t"))
    rows = _packed(rows).repartitionByRange(partitions(spark), "k", "h").sortWithinPartitions("k", "h").select("k", "t")
    names = [x.split(" ")[0] for x in FIELDS.split(", ")]
    blank = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        from pyspark import TaskContext

        part, prints = TaskContext.get().partitionId(), Prints(lex.value)
        held, first = None, True

        def edge(kind, k, t):
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.nulls(1, x) for x in blank), pa.array([kind]), pa.array([part], pa.int32()), pa.array([t], pa.binary())], [*names, "kind", "part", "t"])

        for ids, raw in (run_ for b in batches for run_ in _unpacked(b)):
            if first:
                first = False
                yield edge("head", ids[0], raw[0])
            if held:
                ids, raw = [held[0], *ids], [held[1], *raw]
            held = ids[-1], raw[-1]
            if len(ids) > 1:
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([*_rows(ids, raw, prints), pa.array(["done"] * n), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.binary())], [*names, "kind", "part", "t"])
        if held:
            yield edge("tail", *held)

    table = materialize(rows.mapInArrow(run, f"{FIELDS}, kind string, part int, t binary"), "imatch")
    # the last text of each partition is followed by the first of the next: a row for each partition
    heads = table.where("kind = 'head'").select("part", F.col("t").alias("head"))
    follow = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top")).select("part", F.coalesce("next", "top").alias("next"))
    tails = table.where("kind = 'tail'").select("part", "doc_id", "t").join(follow, "part").join(heads.select(F.col("part").alias("next"), "head"), "next").select("doc_id", "t", "head")

    def make():
        prints = Prints(lex.value)

        def f(b):
            for k, t, head in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays(_rows([k, None], [t, head], prints), names)

        return f

    return table.where("kind = 'done'").select(*names).unionByName(tails.mapInArrow(by_batch(make), FIELDS))
