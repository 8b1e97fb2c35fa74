"""Removal of bytes covered by strings of LENGTH bytes that also start elsewhere.

Each run of SPAN grams of GRAM bytes has a least gram hash, its anchor; a string of LENGTH bytes holds whole runs, so equal strings hold equal anchors. A string
can be repeated only if every anchor in it is, and it goes to the shard of its rarest one, which equal strings share. A shard holds the
regions of its strings; a suffix array by prefix doubling over unsorted groups (Larsson-Sadakane) and common prefixes with its neighbours tell
which strings occur twice. The common prefixes are read off the ranks that the refinement has made, as Kasai's scan is a loop over bytes.
An anchor of more than HOT occurrences is split over shards of bounded size; these merge by binary search in each other's sorted fingerprints of strings, a
bounded range of them in each task.

Texts that are equal as a whole take part once and, from LENGTH bytes on, are removed whole. Null texts are empty; shorter texts keep all; repeated rows are copies.
A very long text lies in as many shards as its anchors ask for; other columns play no part; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_batch, materialize, numbered, tune
from .textkit import mix, span_hashes

LENGTH, GRAM = 400, 32
SPAN = (LENGTH - GRAM) // 2 + 1
HOT = 400
SHARD_BYTES = 1 << 20
#: Fingerprints that one merging task holds.
MERGE = 1 << 19


def _sliding_min(a: np.ndarray, k: int) -> np.ndarray:
    """Least of a[i:i + k] for each i."""
    n, size = len(a) - k + 1, 1
    while size * 2 <= k:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = k - size
    return np.minimum(a[:n], a[rest : rest + n])


def runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and the least of each run of SPAN grams; the text has at least LENGTH bytes."""
    h = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size, mult = 1, 0x9FB21C651E98DF25
    while size < GRAM:
        h = h[:-size] * np.uint64(mult) + h[size:]
        mult = mult * mult % 2**64
        size *= 2
    h = mix(h) >> np.uint64(1)
    return h, _sliding_min(h, SPAN)


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and how often each is the anchor of some run."""
    h, least = runs(text)
    pad = np.zeros(SPAN - 1, np.uint64)
    most = np.uint64(2**64 - 1) - _sliding_min(np.uint64(2**64 - 1) - np.concatenate([pad, least, pad]), SPAN)
    return np.unique(h[most == h], return_counts=True)


def describe(rows: DataFrame) -> DataFrame:
    def f(b):
        n, d1, d2, sha, keys, counts = [], [], [], [], [], []
        for t in b.column(2).to_pylist():
            d = hashlib.blake2b(t, digest_size=16).digest()
            n.append(len(t))
            d1.append(int.from_bytes(d[:8], "little", signed=True))
            d2.append(int.from_bytes(d[8:], "little", signed=True))
            sha.append(hashlib.sha256(t).hexdigest())
            k, c = anchors(np.frombuffer(t, np.uint8)) if len(t) >= LENGTH else ([], [])
            keys.append(np.asarray(k, np.uint64).view(np.int64))
            counts.append(np.asarray(c, np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), pa.array(sha), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], ["rid", "doc_id", "n_bytes", "d1", "d2", "sha", "keys", "counts"])

    return materialize(rows.select("rid", "doc_id", "t").mapInArrow(by_batch(lambda: f), "rid long, doc_id long, n_bytes long, d1 long, d2 long, sha string, keys array<long>, counts array<int>"), "suffix-docs")


def regions(text: np.ndarray, keys: np.ndarray, counts: np.ndarray, rid: int, shards: int):
    """(sid, anchor, subs, start, bytes, starts) of the strings that may be repeated; keys: the text's repeated anchors, sorted, with their counts."""
    _, least = runs(text)
    edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    own = least[edge]
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    hit = keys[at] == own
    # rarest first, then by hash; an anchor that isn't repeated comes before all
    order = np.lexsort((keys, counts))
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(1, len(keys) + 1)
    rank = np.repeat(np.where(hit, place[at], 0), np.diff(np.append(edge, len(least))))
    best = _sliding_min(rank, SPAN)
    for r in np.unique(best[best > 0]).tolist():
        k = order[r - 1]
        key, count = int(keys[k]), int(counts[k])
        starts = np.flatnonzero(best == r)
        subs = -(-count // HOT)
        sid = int(mix(np.array([key], np.uint64))[0] % np.uint64(shards)) if subs == 1 else -1 - int(mix(np.array([key ^ (1 + (rid * 0x9E37 + rid // 7919) % subs) * 0x51ED27], np.uint64))[0] >> np.uint64(2))
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > LENGTH) + 1):
            a, b = int(part[0]), int(part[-1]) + LENGTH
            yield sid, key if subs > 1 else None, subs, a, text[a:b].tobytes(), (part - a).astype(np.int32).tobytes()


def suffix_order(t: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array of bytes, sorted to at least depth bytes, and the ranks after 8, 16, ... bytes. Only groups that are still tied are sorted again."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    sa = np.argsort(key)
    new = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(head, np.diff(np.append(head, n)))
    levels, h = {8: rank.copy()}, 8
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in sa
    while h < depth and len(tied):
        pos = sa[tied]
        nxt = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        # one number for both: n is bounded by the shard, so it fits; ties stay tied
        order = np.argsort(rank[pos] * (n + 1) + nxt)
        pos, nxt, old = pos[order], nxt[order], rank[pos][order]
        sa[tied] = pos
        first = np.concatenate([[True], (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])])
        group = np.flatnonzero(first)
        rank = rank.copy()
        rank[pos] = np.repeat(tied[group], np.diff(np.append(group, len(pos))))
        alone = first & np.append(first[1:], True)
        tied = tied[~alone]
        h *= 2
        levels[h] = rank
    while h < depth:
        h *= 2
        levels[h] = rank
    return sa, levels


def neighbours(sa: np.ndarray, levels: dict[int, np.ndarray]) -> np.ndarray:
    """Common prefix of each suffix in order with the one before, in steps of 8 bytes, up to the ranks' depth."""
    n = len(levels[8])
    a, b = sa[1:], sa[:-1]
    out = np.zeros(len(a), np.int64)
    for h in sorted(levels, reverse=True):
        x, y = a + out, b + out
        ok = (x < n) & (y < n)
        out += h * (ok & (levels[h][np.minimum(x, n - 1)] == levels[h][np.minimum(y, n - 1)]))
    return np.concatenate([[0], out])


def _shard(table: pa.Table) -> pa.Table:
    """Marked string starts of a shard as (rid, a, b); of a hot one also its strings' fingerprints, packed by range."""
    rows = table.to_pylist()
    # one text may have more than one region here; where they overlap they are one
    rows.sort(key=lambda r: (r["rid"], r["start"]))
    merged: list[list] = []
    for r in rows:
        starts = np.frombuffer(r["starts"], np.int32) + r["start"]
        if merged and merged[-1][0] == r["rid"] and r["start"] < merged[-1][1] + len(merged[-1][2]):
            m = merged[-1]
            m[2] += r["bytes"][m[1] + len(m[2]) - r["start"] :] if r["start"] + len(r["bytes"]) > m[1] + len(m[2]) else b""
            m[3] = np.union1d(m[3], starts)
        else:
            merged.append([r["rid"], r["start"], r["bytes"], starts])
    t = np.frombuffer(b"".join(m[2] for m in merged), np.uint8)
    base = np.cumsum([0, *(len(m[2]) for m in merged)])
    at = np.concatenate([m[3] - m[1] + base[i] for i, m in enumerate(merged)])
    owner = np.repeat(np.arange(len(merged)), [len(m[3]) for m in merged])
    sa, levels = suffix_order(t, LENGTH)
    # only strings that lie in their region count: others are left out of the order
    valid = np.zeros(len(t), bool)
    valid[at] = True
    sa = sa[valid[sa]]
    common = np.append(neighbours(sa, levels), 0) >= LENGTH
    twice = np.zeros(len(t), bool)
    twice[sa[common[:-1] | common[1:]]] = True
    marked = twice[at]
    out = {k: [] for k in ("kind", "rid", "a", "b", "anchor", "bucket", "fps", "rids", "at")}

    def put(kind, rid, a, b, anchor=None, bucket=None, fps=None, rids=None, starts=None):
        for k, v in zip(out, (kind, rid, a, b, anchor, bucket, fps, rids, starts)):
            out[k].append(v)

    for i, m in enumerate(merged):
        s = m[3][marked[owner == i]] if len(merged) < 50 else m[3][marked[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]]
        if len(s):
            for part in np.split(s, np.flatnonzero(np.diff(s) > 1) + 1):
                put(0, m[0], int(part[0]), int(part[-1]))
    subs = rows[0]["subs"]
    if subs > 1:
        fp = span_hashes(t, at, at + LENGTH)
        rid = np.array([m[0] for m in merged], np.int64)[owner]
        start = np.concatenate([m[3] for m in merged]).astype(np.int32)
        # of a string marked already one is enough, as a witness
        first = np.zeros(len(at), bool)
        first[np.unique(fp, return_index=True)[1]] = True
        keep = ~marked | first
        fp, rid, start = fp[keep], np.where(marked[keep], -1, rid[keep]), start[keep]
        order = np.argsort(fp)
        fp, rid, start = fp[order], rid[order], start[order]
        # from what all shards of the anchor share: an occurrence lies in at most LENGTH - GRAM + 1 strings
        buckets = max(1, -(-subs * HOT * (LENGTH - GRAM + 1) // MERGE))
        which = (fp >> np.uint64(40)) % np.uint64(1 << 24) * np.uint64(buckets) >> np.uint64(24)
        for k in np.unique(which).tolist():
            own = which == k
            put(1, None, None, None, rows[0]["anchor"], int(k), fp[own].tobytes(), rid[own].tobytes(), start[own].tobytes())
    kinds = {"kind": pa.int32(), "rid": pa.int64(), "a": pa.int32(), "b": pa.int32(), "anchor": pa.int64(), "bucket": pa.int32(), "fps": pa.binary(), "rids": pa.binary(), "at": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _merge(table: pa.Table) -> pa.Table:
    """Strings that two shards of a hot anchor share: each shard's sorted fingerprints are searched in all the others'."""
    parts = [(np.frombuffer(f, np.uint64), np.frombuffer(r, np.int64), np.frombuffer(s, np.int32)) for f, r, s in zip(*(table.column(c).to_pylist() for c in ("fps", "rids", "at")))]
    every = np.sort(np.concatenate([np.unique(f) for f, _, _ in parts]))
    rid, start = [], []
    for f, r, s in parts:
        more = np.searchsorted(every, f, "right") - np.searchsorted(every, f) > 1
        more &= r >= 0
        rid.append(r[more])
        start.append(s[more])
    s = np.concatenate(start)
    return pa.table({"rid": np.concatenate(rid), "a": s, "b": s})


def _removed(text: bytes, a: list[int], b: list[int]) -> tuple[int, int, str]:
    """Bytes removed, maximal runs of them, and the hash of the rest; strings start from a to b."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, np.array(a), 1)
    np.add.at(edge, np.minimum(np.array(b) + LENGTH, len(text)), -1)
    gone = np.cumsum(edge)[:-1] > 0
    n = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    return int(gone.sum()), n, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    tune(spark)
    rows = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")), "suffix-rows")
    found = describe(rows)
    rows = rows.select("rid", "t")
    groups = materialize(found.where(F.col("n_bytes") >= LENGTH).groupBy("d1", "d2").agg(F.min("rid").alias("rid"), F.count("*").alias("copies")), "suffix-groups")
    once = found.join(groups.select("rid"), "rid", "left_semi").select("rid", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("rid", F.col("x.keys").alias("key"), F.col("x.counts").alias("k"))
    often = once.groupBy("key").agg(F.sum("k").alias("n")).where("n > 1")
    own = once.join(often, "key").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("own"))
    own = materialize(own, "suffix-anchors")
    total = own.agg(F.sum(F.size("own"))).first()[0] or 0
    shards = max(1, total * 3 * LENGTH // 2 // SHARD_BYTES)

    def cut(b):
        out = []
        for rid, t, x in zip(b.column("rid").to_pylist(), b.column("t").to_pylist(), b.column("own").to_pylist()):
            k, n = np.array([y["key"] for y in x], np.uint64), np.array([y["n"] for y in x], np.int64)
            out += [(sid, anchor, subs, rid, a, raw, s) for sid, anchor, subs, a, raw, s in regions(np.frombuffer(t, np.uint8), k, n, rid, shards)]
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["sid", "anchor", "subs", "rid", "start", "bytes", "starts"])

    pieces = rows.join(own, "rid").mapInArrow(by_batch(lambda: cut), "sid long, anchor long, subs int, rid long, start int, bytes binary, starts binary")
    marks = materialize(pieces.groupBy("sid").applyInArrow(_shard, "kind int, rid long, a int, b int, anchor long, bucket int, fps binary, rids binary, at binary"), "suffix-marks")
    merged = marks.where("kind = 1").groupBy("anchor", "bucket").applyInArrow(_merge, "rid long, a int, b int")
    alone = groups.where("copies = 1").select("rid")
    spans = marks.where("kind = 0").select("rid", "a", "b").unionByName(merged).join(alone, "rid", "left_semi").groupBy("rid").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def drop(b):
        done = [_removed(t, x, y) for t, x, y in zip(*(b.column(c).to_pylist() for c in ("t", "a", "b")))]
        yield pa.RecordBatch.from_arrays([b.column("rid"), *(pa.array(c, k) for c, k in zip(zip(*done), (pa.int64(), pa.int64(), pa.string())))], ["rid", "n_removed", "n_spans", "kept"])

    removed = rows.join(spans, "rid").mapInArrow(by_batch(lambda: drop), "rid long, n_removed long, n_spans long, kept string")
    copies = groups.where("copies > 1").select("d1", "d2", F.lit(True).alias("copied"))
    out = found.select("rid", "doc_id", "n_bytes", "d1", "d2", "sha").join(copies, ["d1", "d2"], "left").join(removed, "rid", "left")
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    return out.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
