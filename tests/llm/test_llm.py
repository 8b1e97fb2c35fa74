"""Each operator against brute force, and on nulls, empty and very long texts, repeated rows, empty tables and clashing names."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from kinweave.llm import components, decontaminate, imatch, langid, lm_scoring, ngram_join, packing, pii, sharding, suffix_dedup, textkit, token_counts, tokenizer  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, cls long, n long"


def corpus():
    rng = random.Random(1)
    vocab = {k: ["".join(rng.choice(s) for _ in range(rng.randint(2, 7))) for _ in range(150)] for k, s in (("en", "thesandrio"), ("de", "ungschkeit"))}
    rows = []
    passage = " ".join(rng.choice(vocab["en"]) for _ in range(110))
    for i in range(40):
        lang = "de" if i % 3 == 0 else "en"
        w = [rng.choice(vocab[lang]) for _ in range(rng.randint(1, 160))]
        if i % 7 == 0:
            w += passage.split()
        rows.append((i, " ".join(w), lang))
    base = rows[5][1] + " " + passage
    rows += [(50, base, "en"), (51, base, "en"), (52, base.replace(" ", "  ", 3).upper(), "en"), (53, base + " extra word", None)]
    rows += [(60, None, "en"), (61, "", "de"), (62, " \n ", None), (63, "123 456", "en"), (None, "a b c", "en"), (5, rows[5][1], "en"), (64, passage * 30, "en")]
    return [(d, t, k, "s", len(t or ""), 0, 0, 0) for d, t, k in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    # from a file: a row's place in the scan is then fixed
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokenizer_is_exact():
    w, rng = tokenizer.load(PATH), random.Random(1)
    al = "abzZ09'’_-.,!?  \t\n\réÉßİ²ªµ ẞΣ́中ǅ힣<|>endoftext\x1c\x85ŉſ×÷°Ĳsretvlmd"
    s = ["".join(rng.choice(al) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    got = [x for t in textkit.texts(pa.array([x.encode() for x in s])) for x in w.encode(t)]
    assert all(list(a) == e.ids for a, e in zip(got, w.own.encode_batch(s, add_special_tokens=False)))


def test_packing_round_trip(docs, rows, empty):
    own = tokenizer.load(PATH).own
    out = packing.pack(docs, PATH).collect()
    ids = {d: [*own.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in rows}
    seqs, seen = defaultdict(list), Counter()
    for r in out:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seqs[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += r.length
    copies = Counter(d for d, *_ in rows)
    assert all(seen[d] == len(x) * copies[d] for d, x in ids.items())
    for s in seqs.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at <= 4096
    assert packing.pack(empty, PATH).count() == 0


def test_packing_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(30):
        total = rng.randint(1, 60)
        docs = np.array(sorted({*rng.sample(range(1, total + 1), min(total, 4)), total}))
        sents = np.array(sorted(rng.sample(range(1, total + 1), min(total, 5))))
        got = packing.cuts(total, docs, sents, 16)
        grid = {*range(0, total, 16), 0, total}
        tail = total - total % 16
        for b in (8, 4, 2, 1):
            if (total % 16) & b:
                tail += b
                grid.add(tail)
        pos = sorted({*grid, *docs.tolist(), *sents.tolist()})
        cost = lambda a, b: 0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)
        pen = lambda p: 0 if p in docs else 8 if p in sents else 64
        best = {0: 0}
        for p in pos[1:]:
            best[p] = min(best[q] + cost(q, p) for q in pos if q < p and p - q <= 16) + pen(p)
        assert sum(cost(a, b) + pen(b) for a, b in zip(got, got[1:])) == best[total]


@pytest.mark.parametrize("hot", [400, 1])
def test_suffix_dedup(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    c = Counter(t[i : i + 400] for _, t in texts for i in range(len(t) - 399))
    want = Counter()
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if c[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        want[d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup.dedup(docs).collect()) == want
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_over_buckets(monkeypatch):
    # in this process, as workers import the module anew and see no patch
    monkeypatch.setattr(suffix_dedup, "HOT", 18)
    monkeypatch.setattr(suffix_dedup, "MERGE", 200)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    many = word(50_000)
    at = int(suffix_dedup.runs(np.frombuffer(many.encode(), np.uint8))[0].argmin())
    hot = many[at : at + 32]
    # templates with one hot gram, the anchor of all their strings: 30 of 402 bytes, each in two rows, and some long ones of which shards get unequal shares
    short = ["".join(hot + word(100) for _ in range(4))[:402] for _ in range(30)]
    long = ["".join(hot + word(100) for _ in range(rng.choice([4, 60]))) for _ in range(10)]
    texts = [np.frombuffer((word(60) + x + word(60)).encode(), np.uint8) for x in short + long + short]
    found = [suffix_dedup.anchors(t) for t in texts]
    total = Counter()
    for k, n in found:
        total.update(dict(zip(k.tolist(), n.tolist())))
    shards, buckets, got = defaultdict(list), defaultdict(list), set()
    for rid, (t, (k, _)) in enumerate(zip(texts, found)):
        k = k[[total[x] > 1 for x in k.tolist()]]
        for row in suffix_dedup.regions(t, k, np.array([total[x] for x in k.tolist()], np.int64), rid, 3):
            shards[row[0]].append(dict(zip(("sid", "anchor", "subs", "start", "bytes", "starts", "rid"), (*row, rid))))
    assert len(shards) > 10
    for rows in shards.values():
        for r in suffix_dedup._shard(pa.Table.from_pylist(rows)).to_pylist():
            if r["kind"]:
                buckets[r["anchor"], r["bucket"]].append(r)
            else:
                got |= {(r["rid"], i) for i in range(r["a"], r["b"] + 1)}
    for rows in buckets.values():
        got |= {(r["rid"], r["a"]) for r in suffix_dedup._merge(pa.Table.from_pylist(rows)).to_pylist()}
    raw = [t.tobytes() for t in texts]
    c = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    assert got == {(d, i) for d, t in enumerate(raw) for i in range(len(t) - 399) if c[t[i : i + 400]] > 1}


def test_ngram_join(docs, rows, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for d, t, *_ in rows:
        w = word.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = Counter((rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows)))
    assert Counter(tuple(r) for r in ngram_join.groups(docs).collect()) == want
    assert ngram_join.keep_one(docs).count() == len(set(group))
    assert ngram_join.groups(empty).count() == 0


def test_components_both_ways(spark, monkeypatch):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 1), (7, 9)], "a long, b long")
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    for limit in (components.ONE_TASK, 0):
        monkeypatch.setattr(components, "ONE_TASK", limit)
        assert {r.node: r.label for r in components.components(links).collect()} == want


def test_sharding(spark, docs, rows, empty):
    out = sharding.shard(docs, 4000).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b"), "shard", "depth", "oversized").collect()
    assert len(out) == len(rows)
    size, number = Counter(), Counter()
    for r in out:
        size[r.shard] += r.b
        number[r.shard] += 1
        assert r.depth == len(r.shard)
    assert all(b <= 4000 or number[s] == 1 for s, b in size.items())
    assert all(x == y or not x.startswith(y) for x in size for y in size)
    assert sharding.shard(empty, 4000).count() == 0
    one = spark.range(200).select(F.lit(1).alias("doc_id"), F.lit("x" * 50).alias("text"))
    assert max(r["count"] for r in sharding.shard(one, 1000).groupBy("shard").count().collect()) <= 20


def test_token_counts(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 64)
    own = tokenizer.load(PATH).own
    blocks = token_counts.write_blocks(docs, PATH, block=64)
    from kinweave.llm.common import materialize

    blocks = materialize(blocks, "t")
    out = token_counts.scan(blocks)
    assert Counter(r.n_tokens for r in out.collect()) == Counter(len(own.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert token_counts.count_tokens(empty, PATH).count() == 0
    assert {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, PATH).collect()} == {(d, len(own.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in rows}


def test_decontamination(spark, docs, empty):
    rng = random.Random(3)
    item = "".join(rng.choice("abcdefgh ") for _ in range(200)).strip()
    near = item[:50] + "X" + item[51:120] + item[123:]
    extra = spark.createDataFrame([(900, "pre " + item + " post"), (901, "pre " + near.upper() + " post"), (902, item[:100] + " " * 1 + item[150:]), (903, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(extra, bench, block_chars=10).collect()}
    assert got[900, 1] == 0 and 0 < got[901, 1] <= 16 and set(got) == {(900, 1), (901, 1)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(extra, bench).collect()} == {902, 903}
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(docs, empty.selectExpr("rid AS item_id", "text")).count() == 0


def test_myers_distance():
    rng = random.Random(5)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 9), rng.randint(0, 20)))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (x != c)))
            row = new
            best = min(best, row[-1])
        assert decontaminate.myers(decontaminate.masks(p), len(p), t)[0] == best


def test_language_id(docs, rows, empty):
    trees = langid.train(langid.training_words(docs, F.lit(True)))
    out = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text", "lang"), trees).collect()}
    assert {out[k].lang_pred for k in (60, 61, 62, 63)} == {"und"}
    long = [(d, k) for d, t, k, *_ in rows if k and t and len(t) > 200 and d is not None]
    assert sum(out[d].lang_pred == k for d, k in long) >= 0.95 * len(long)
    assert all(0 <= r.score <= 1 for r in out.values())
    none = langid.train(langid.training_words(empty, F.lit(True)))
    assert langid.identify(empty.select("doc_id", "text"), none).count() == 0 and langid.identify(docs.select("text"), none).first().lang_pred == "und"


def test_personal_data(spark, empty):
    texts = ["mail a.b@c.example.com or +1 (988) 555-2485.", "card 4111 1111 1111 1111, not 4111111111111112; ip 10.0.0.256 and 10.0.0.25", None, "", "plain words 2024", "reach bob [at] host.com now"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = pii.train([t for t in texts if t])
    out = {r.doc_id: r for r in pii.detect(df, model).collect()}
    assert (out[0].n_email, out[0].n_phone, out[1].n_card, out[1].n_ip) == (1, 1, 1, 1)
    assert out[2].spans == out[3].spans == out[4].spans == "" and out[5].spans == "email:6:23" and out[5].n_email == 0
    red = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert red[0] == "mail [EMAIL] or [PHONE]." and red[4] == texts[4] and red[2] is None
    assert pii.detect(empty).count() == 0


def test_fingerprints(docs, rows, empty):
    out = imatch.fingerprints(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[50].fingerprint == by[51].fingerprint and by[50].near_next == 1
    t = {d: x or "" for d, x, *_ in rows}
    k = len(t[0]) // 4
    assert by[0].edited_sha256 == hashlib.sha256((t[0][: len(t[0]) - k] + t[1][:k]).encode()).hexdigest()
    last = t[64]
    assert by[64].n_chars == len(last) and by[60].n_chars == 0
    assert imatch.fingerprints(empty).count() == 0


def test_lm_scores(docs, rows, empty):
    train = F.col("doc_id") % 5 != 0
    out = lm_scoring.score(docs, train).collect()
    c = Counter()
    for d, t, *_ in rows:
        if d is not None and d % 5:
            c.update((t or "").encode().lower().split())
            c["$"] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), "$"]
        want[d, d is None or d % 5 == 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert lm_scoring.score(empty, train).count() == 0


def test_lm_contexts_of_all_training_words(spark):
    rng = random.Random(9)
    long = ["".join(rng.choice("ab") for _ in range(24)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(["plain", "words", "of", "short", "texts"]) for _ in range(30))) for i in range(20)]
    # these words come only in a text beyond the sample's length; their short contexts tell little
    rows += [(100, " ".join(long * 40)), (101, " ".join(rng.sample(long, 20)))]
    out = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 101)
    assert out.where("held_out").first().bits_per_byte < 0.5


def test_token_counts_of_a_text_with_the_separator(spark):
    own = tokenizer.load(PATH).own
    rows = [(1, "before"), (2, "one <|endoftext|> two <|endoftext|>"), (3, "after it"), (4, "the last one")]
    found = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in found) == [(d, len(own.encode(t, add_special_tokens=False).ids) + 1) for d, t in rows]
