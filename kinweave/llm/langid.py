"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree over lower-cased words and the blank that ends each; contexts are the up to ORDER
bytes before, back to the blank that starts the word. A symbol costs -log2 of its PPM-C probability: at each order the escape is
d / (n + d) for n symbols of d kinds seen there, down to 1/256. Statistics are frozen after training, so the code length of a word
is a constant that each task computes once. Trees are trained on whole texts of a bounded sample: at least SAMPLE_BYTES a language where it has as much, taken in the order of a
hash; every text is scored whole.

A null, empty or letterless text, or one scored when nothing could be learned (an empty table), is `und` with score 0. Ties go to the first language by name.
Repeated rows are predicted alike. Very long texts are scored whole, a word at a time. Other columns are kept, whatever their names.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import by_batch, tune, unused
from .textkit import LOWER, Keys, Memo, texts, words

ORDER = 5
SAMPLE_BYTES = 1_500_000
#: Cells of the hash by which training documents are taken.
CELLS = 1024
KEPT = 600_000
UNKNOWN = "und"


def training_words(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(lang, word, n): lower-cased words of the sampled training texts."""
    tune(docs.sparkSession)
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("t"), F.col(doc_id).alias("k"))
    rows = rows.withColumn("u", F.pmod(F.xxhash64("k", F.crc32("t"), F.lit("langid")), F.lit(CELLS)))
    # the bytes of each cell of the hash; cells are taken in order until they hold enough, so every language has some documents
    cells = {}
    for name, u, n in rows.groupBy("lang", "u").agg(F.sum(F.octet_length("t"))).collect():
        cells.setdefault(name, {})[u] = n or 0
    last = F.lit(-1)
    for name, own in cells.items():
        at = np.cumsum([own.get(u, 0) for u in range(CELLS)])
        last = F.when(F.col("lang") == name, F.lit(int(np.searchsorted(at, min(SAMPLE_BYTES, at[-1]))))).otherwise(last)
    sample = rows.where(F.col("u") <= last)

    def count(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(name, Counter()).update(t.lower().split())
        for name, c in seen.items():
            items = list(c.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["lang", "word", "n"])

    return sample.select("lang", "t").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _contexts(flat: np.ndarray, first: np.ndarray):
    """By order, hashes of the bytes before each place of flat, which holds a blank, then words each ended by a blank; first: place of each symbol's word start."""
    n = len(flat)
    at = np.arange(n)
    h = np.zeros(n, np.uint64)
    yield h
    for k in range(1, ORDER + 1):
        src = at - k
        ok = src >= first - 1
        byte = np.where(ok, flat[np.maximum(src, 0)], 0).astype(np.uint64)
        h = (h * np.uint64(0x100000001B3)) ^ (byte + np.uint64(257))
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
        yield np.where(ok, h, np.uint64(0))  # 0: the context would go beyond the word


def _flat(word_list: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(b" " + b" ".join(word_list) + b" ", np.uint8)
    size = np.array([len(w) + 1 for w in word_list])
    start = np.cumsum(size) - size + 1
    return flat, np.concatenate([[1], np.repeat(start, size)]), start


def _pair(ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
    h = (ctx ^ (sym.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Trees:
    """Context trees of all languages, side by side, built order by order."""

    def __init__(self, counts: dict[str, dict[bytes, int]]):
        self.langs = sorted(counts)
        self.levels = []
        parts = []
        for j, name in enumerate(self.langs):
            if own := counts[name]:
                flat, first, start = _flat(list(own))
                n = np.repeat(np.array(list(own.values()), np.int64), np.diff(np.append(start, len(flat))))
                parts.append((j, flat[1:], n, _contexts(flat, first)))
        for k in range(ORDER + 1):
            ctx, sym, n, lang = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for j, own, many, contexts in parts:
                c = next(contexts)[1:]
                ok = (c != 0) if k else np.ones(len(c), bool)
                ctx.append(c[ok])
                sym.append(own[ok])
                n.append(many[ok])
                lang.append(np.full(int(ok.sum()), j))
            self.levels.append(self._level(*map(np.concatenate, (ctx, sym, n, lang))))

    def _level(self, ctx, sym, n, lang):
        """Keys of symbols after contexts and of contexts, with frozen code lengths of the symbol and of the escape (0 where the language hasn't seen the context)."""
        langs = len(self.langs)
        keys, kb = np.unique(_pair(ctx, sym), return_inverse=True)
        cks, cb = np.unique(ctx, return_inverse=True)
        of = np.zeros(len(keys), np.int64)
        of[kb] = cb
        count = np.bincount(kb * langs + lang, n, len(keys) * langs).reshape(len(keys), langs)
        of = of[:, None] * langs + np.arange(langs)
        total = np.bincount(of.ravel(), count.ravel(), len(cks) * langs)
        kinds = np.bincount(of.ravel(), (count > 0).ravel(), len(cks) * langs)
        den = np.maximum(total + kinds, 1)
        with np.errstate(divide="ignore"):
            bits = np.where(count > 0, -np.log2(count / den[of]), np.inf).astype(np.float32)
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / den), 0).astype(np.float32).reshape(len(cks), langs)
        return Keys(keys), bits, Keys(cks), escape

    def lengths(self, word_list: list[bytes]) -> np.ndarray:
        """Bits of each word, its ending blank included, in each language."""
        flat, first, start = _flat(word_list)
        contexts = list(_contexts(flat, first))
        n, k_langs = len(flat), len(self.langs)
        cost = np.zeros((n, k_langs), np.float32)
        open_ = np.ones((n, k_langs), bool)
        open_[0] = False
        for k in range(ORDER, -1, -1):
            keys, bits, cks, escape = self.levels[k]
            ctx = contexts[k]
            at = np.flatnonzero(((ctx != 0) if k else np.ones(n, bool)) & open_.any(1))
            if not len(at):
                continue
            c = cks.find(ctx[at])
            at, c = at[c >= 0], c[c >= 0]
            s = keys.find(_pair(ctx[at], flat[at]))
            sym = np.where((s >= 0)[:, None], bits[np.maximum(s, 0)] if len(bits) else np.inf, np.inf)
            hit = np.isfinite(sym)
            now = open_[at]
            cost[at] += np.where(now, np.where(hit, np.where(hit, sym, 0), escape[c]), 0)
            open_[at] = now & ~hit
        cost += np.where(open_, 8, 0)
        return np.add.reduceat(cost[1:], start - 1, axis=0)


def train(counts: DataFrame) -> Trees:
    """counts: of training_words; its size is bounded by the sample."""
    found: dict[str, dict[bytes, int]] = {}
    table = counts.toArrow()
    for name, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n"))):
        found.setdefault(name, {})[word] = n
    return Trees(found)


class Scorer:
    def __init__(self, trees: Trees):
        self.trees, self.memo = trees, Memo()
        self.pool, self.kept = np.zeros((1 << 16, len(trees.langs)), np.float32), 0

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        nulls = column.is_null().to_pylist()
        for t in texts(column):
            k = len(t.lo)
            raw = t.buf.tobytes()
            letter = ((t.buf | 32) >= 97) & ((t.buf | 32) <= 122) & (t.buf < 128)
            seen = np.concatenate([[0], np.cumsum(letter)])
            has = seen[t.hi] > seen[t.lo]
            for i in np.flatnonzero(~has & (t.hi > t.lo)).tolist():
                has[i] = any(map(str.isalpha, raw[t.lo[i] : t.hi[i]].decode("utf-8", "replace")))
            if not self.trees.langs:
                names += [UNKNOWN] * k
                scores += [0.0] * k
                continue
            w = words(t)
            place = self.memo.find(w.hash)
            miss = np.flatnonzero(place < 0)
            if len(miss):
                if self.kept > KEPT:
                    self.memo.clear()
                    self.kept, miss = 0, np.arange(len(w.hash))
                new, at, back = np.unique(w.hash[miss], return_index=True, return_inverse=True)
                low = LOWER[t.buf].tobytes()
                at = miss[at]
                lengths = self.trees.lengths([low[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())])
                while self.kept + len(new) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
                self.pool[self.kept : self.kept + len(new)] = lengths
                where = np.arange(self.kept, self.kept + len(new), dtype=np.int32)
                self.kept += len(new)
                self.memo.put(new, where)
                place[miss] = where[back]
            cost = np.concatenate([np.zeros((1, self.pool.shape[1])), np.cumsum(self.pool[place], axis=0, dtype=np.float64)])
            bits = cost[w.first + w.count] - cost[w.first]
            best = np.argmin(bits, axis=1)
            post = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
            for i in range(k):
                ok = has[i] and not nulls[t.rows[i]]
                names.append(self.trees.langs[best[i]] if ok else UNKNOWN)
                scores.append(float(post[i]) if ok else 0.0)
        return names, np.array(scores)


def identify(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with two more columns, lang_pred and score, with as many _ before their names as it takes to clash with none; all rows and columns are kept."""
    spark = docs.sparkSession
    tune(spark)
    model = spark.sparkContext.broadcast(trees)
    new = [unused("lang_pred", docs.columns), unused("score", docs.columns)]
    rows = docs.withColumn(unused("_t", docs.columns), F.col(text).cast("binary"))

    def make():
        scorer = Scorer(model.value)

        def f(b):
            names, scores = scorer.predict(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:-1], *new])

        return f

    return rows.mapInArrow(by_batch(make), T.StructType([*docs.schema.fields, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())]))
