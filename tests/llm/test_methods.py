"""The methods themselves against plain versions: bit by bit, segmentation by segmentation, lexicon by lexicon; pipeline stages one by one."""
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from kinweave.llm import decontaminate, imatch, langid, lm_scoring as L, ngram_join, pii, sharding, textkit  # noqa: E402

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_base_spans_are_the_contract_s():
    rng = random.Random(4)
    digits = lambda s: re.sub("[^0-9]", "", s)
    for _ in range(6000):
        t = "".join(rng.choice("a@..-+ 0123456789()xé@%") for _ in range(rng.randint(0, 45)))
        want = [("email", *m.span()) for m in EMAIL.finditer(t)]
        want += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(t) == want, t


@pytest.mark.parametrize("text", ["a" * 400_000 + "@", "1" * 400_000 + ".2", "1." * 60_000, "+1" + " " * 400_000, "@" * 200_000, "a@b" * 100_000, "1 " * 60_000])
def test_personal_data_takes_linear_time(text):
    began = time.time()
    pii.find(text, pii.Model())
    assert time.time() - began < 20


def _segmentations(n, segs):
    """All ways to cover n tokens by segments with kinds, and single tokens without: lists of (kind, first, last + 1, segment or None)."""
    def go(at):
        if at == n:
            yield []
            return
        for rest in go(at + 1):
            yield [(pii.NONE, at, at + 1, None), *rest]
        for s, (i, j, _) in enumerate(segs):
            if i == at:
                for rest in go(j):
                    for k in range(pii.NONE):
                        yield [(k, i, j, s), *rest]

    return go(0)


def test_semi_markov_sums_and_best_segmentation():
    rng = random.Random(6)
    for _ in range(12):
        n = rng.randint(1, 4)
        segs = [(i, j, [f"f{rng.randint(0, 3)}", "one"]) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.6]
        model = pii.Model({f: tuple(rng.uniform(-2, 2) for _ in range(pii.NONE)) for f in ("f0", "f1", "f2", "f3", "one")}, [[rng.uniform(-1, 1) for _ in range(pii.NONE + 1)] for _ in range(pii.NONE + 1)])
        scores = [model.scores(f) for _, _, f in segs]
        every = []
        for way in _segmentations(n, segs):
            label, total = pii.NONE, 0.0
            for k, _, _, s in [*way, (pii.NONE, 0, 0, None)]:
                total += model.steps[label][k] + (scores[s][k] if s is not None else 0)
                label = k
            every.append((total, way))
        log_z = math.log(sum(math.exp(t) for t, _ in every))
        best = max(every, key=lambda x: x[0])[1]
        assert model.decode(n, segs) == [(k, i, j) for k, i, j, s in best if s is not None]
        if segs:
            lattice = pii.Lattices([n], [0] * len(segs), [s[0] for s in segs], [s[1] for s in segs])
            total, p, steps = lattice.sums(np.array(scores), np.array(model.steps))
            assert abs(total[0] - log_z) < 1e-9
            want, moves = np.zeros((len(segs), pii.NONE)), np.zeros((pii.NONE + 1, pii.NONE + 1))
            for t, way in every:
                label = pii.NONE
                for k, _, _, s in [*way, (pii.NONE, 0, 0, None)]:
                    moves[label, k] += math.exp(t - log_z)
                    label = k
                    if s is not None:
                        want[s, k] += math.exp(t - log_z)
            assert np.allclose(p, want) and np.allclose(steps, moves)


def test_personal_data_recall():
    model, found, all_ = pii.train([]), Counter(), Counter()
    wrong = 0
    for text, spans in pii.examples(random.Random(77), 1000):
        got = {x for x in pii.find(text, model)[1]}
        for x in spans:
            all_[x[0]] += 1
            found[x[0]] += x in got
        wrong += len([x for x in got if not any(y[1] < x[2] and x[1] < y[2] for y in spans)])
    assert all(found[k] >= 0.9 * all_[k] for k in pii.KINDS) and wrong <= 0.05 * sum(all_.values())


def test_fingerprints_by_hand(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90)))) for i in range(30)] + [(30, None), (31, " ")]
    band = (0.05, 0.5)
    out = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), band=band).collect()}
    text = {i: t or "" for i, t in rows}
    df = Counter(w for t in text.values() for w in set(t.split()))
    lexicon = {w for w, n in df.items() if band[0] * len(rows) <= n <= max(2, band[1] * len(rows))}
    one = lambda w: int(textkit.words(next(textkit.texts(pa.array([w.encode()], pa.binary())))).hash[0])
    h = {w: one(w) for w in vocab}
    mix = lambda x: int(textkit.mix(np.array([x], np.uint64))[0])

    def prints(t):
        words = set(t.split())
        terms = sorted(h[w] if w in h else one(w) for w in ((words & lexicon) or words))
        rows_ = []
        for order in range(imatch.ORDERS):
            row = []
            for level in range(imatch.LEVELS):
                own = [x for x in terms if mix(x ^ int(imatch._SALT[order])) < 2 ** (64 - level)]
                total = sum(mix(x ^ 0x51ED270B) * pow(imatch._STEP, i, 2**64) for i, x in enumerate(own)) % 2**64
                row.append(max(1, mix(total) >> 48) if own else 0)
            rows_.append(row)
        return rows_

    def like(a, b):
        same = 0
        for x, y in zip(a, b):
            last = max((i for i in range(imatch.LEVELS) if x[i] or y[i]), default=0)
            same += x[last] == y[last]
        return same / imatch.ORDERS

    ids = sorted(text)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        if not text[i].split() or not text[nxt].split():
            continue
        k = len(text[i]) // 4
        edited = text[i][: len(text[i]) - k] + text[nxt][:k]
        a, e, b = prints(text[i]), prints(edited), prints(text[nxt])
        assert out[i].fingerprint == "".join(f"{x:04x}" for row in a for x in row)
        assert out[i].edited_fingerprint == "".join(f"{x:04x}" for row in e for x in row)
        assert abs(out[i].near_edited - like(a, e)) < 1e-9 and abs(out[i].near_next - like(a, b)) < 1e-9


def test_language_code_lengths(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 6))) for _ in range(60)), k) for i, (k, s) in enumerate([("x", "abcd"), ("y", "cdef")] * 3)]
    counts = langid.training_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    trees = langid.train(counts)
    seen = {k: [defaultdict(Counter) for _ in range(langid.ORDER + 1)] for k in "xy"}
    for _, t, k in rows:
        for w in t.lower().split():
            s = " " + w + " "
            for i in range(1, len(s)):
                for o in range(min(langid.ORDER, i) + 1):
                    seen[k][o][s[i - o : i]][s[i]] += 1

    def bits(word, k):
        s, total = " " + word + " ", 0.0
        for i in range(1, len(s)):
            for o in range(min(langid.ORDER, i), -1, -1):
                c = seen[k][o].get(s[i - o : i])
                if c is None:
                    continue
                n, d = sum(c.values()), len(c)
                if s[i] in c:
                    total -= math.log2(c[s[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
            else:
                total += 8
        return total

    words = ["abca", "cdcd", "fff", "zq", "a", "dcdcdcd"]
    got = trees.lengths([w.encode() for w in words])
    assert np.allclose(got, [[bits(w, k) for k in trees.langs] for w in words], atol=1e-3)
    extra = spark.createDataFrame([(1, "abca", "kept", 5.0)], "doc_id long, text string, lang_pred string, score double")
    r = langid.identify(extra, trees).first()
    assert r.lang_pred == "kept" and r.score == 5.0 and r["_lang_pred"] == "x"


def test_decontamination_by_brute_force(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    items = [(i, decontaminate.normal(word(40))) for i in range(6)]
    docs = []
    for i in range(40):
        t = decontaminate.normal(rng.choice(items)[1])
        for _ in range(rng.randint(0, 6)):
            p = rng.randint(0, max(0, len(t) - 1))
            t = t[:p] + rng.choice(["", "x", "ab"]) + t[p + rng.randint(0, 1) :]
        docs.append((i, decontaminate.normal(word(20) + t + word(20))))

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, c in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != c)))
            row = new
        return min(row)

    want = {(d, k): least(p, t) for d, t in docs for k, p in items}
    want = {x: n for x, n in want.items() if n <= int(len(dict(items)[x[1]]) * decontaminate.RATE)}
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and want


def test_mixer_bit_by_bit(spark):
    rng = random.Random(12)
    vocab = {s: ["".join(rng.choice(s) for _ in range(rng.randint(1, 9))) for _ in range(40)] for s in ("abcd", "defg")}
    phrase = " ".join(rng.choice(vocab["abcd"]) for _ in range(30))
    rows = [(i, " ".join(rng.choice(v) for _ in range(50)) + (" " + phrase if i % 3 == 0 else "")) for i in range(24) for v in [vocab["abcd" if i % 2 else "defg"]]]
    train = F.col("doc_id") < 18
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = L.learn(docs, train)
    one = lambda w: textkit.words(next(textkit.texts(pa.array([w.encode()], pa.binary())))).hash
    cls = {}
    for _, t in rows:
        for w in t.split():
            at = model.tagger.keys.find(one(w))[0] if w not in cls else None
            if at is not None:
                cls[w] = int(model.tagger.classes[at]) if at >= 0 else 0

    def tokens(t):
        """(word, tag, the two words before) of a text, the end last."""
        seen, out, words = Counter(), [], t.split()
        for i, w in enumerate([*words, ""]):
            tag = min((c for c in seen if c and seen[c] == max(seen[x] for x in seen if x)), default=0) if any(seen) else 0
            out.append((w, tag, tuple(words[max(0, i - 2) : i])))
            if w:
                seen[cls[w]] += 1
        return out

    def contexts(s, i, tag):
        return [(0, s[max(0, i - 2) : i], tag), (1, s[max(0, i - 4) : i]), (2, s[:i]), (3, s[:i], tag)]

    follow, after = defaultdict(Counter), defaultdict(Counter)
    for d, t in rows:
        if d < 18:
            for w, tag, before in tokens(t):
                s = w.encode() + b" "
                after[before][s[:8].ljust(8, b"\0")] += 1
                for i, c in enumerate(s):
                    for x in contexts(s, i, tag):
                        follow[x][c] += 1
    size = lambda n: float(L._COUNT[int(L.scaled(np.array([n]))[0])])
    kept = {x: {c: size(n) for c, n in f.items() if n > 1 or x[0] == 0} for x, f in follow.items()}
    mid = (np.arange(L.STEPS) + 0.5) / 2

    def score(t):
        total, run = 0.0, 0
        for w, tag, before in tokens(t):
            s = w.encode() + b" "
            state, best = 0, None
            if before in after:
                f = after[before]
                best = min(f, key=lambda x: (-f[x], x))
                n, all_ = size(f[best]), size(sum(f.values()))
                if 2 * n >= all_:
                    state = 1 + (int(np.digitize(n, [1.5, 2.5, 5.5])) * 2 + (n >= all_)) * 4 + min(run, 3)
            holds = state > 0
            for i, c in enumerate(s):
                active = holds and i < 8
                found = [kept.get(x, {}) for x in contexts(s, i, tag)]
                trust = [min(6, int(1 + math.log2(max(sum(f.values()), 1)) / 2)) if sum(f.values()) > 0 else 0 for f in found]
                gate = (trust[2] * 7 + trust[3]) * L.RUNS + (1 + (state - 1) % 4 if active else 0)
                for j in range(8):
                    x = 0.0
                    for k, f in enumerate(found):
                        same = [n for y, n in f.items() if y >> (8 - j) == c >> (8 - j)]
                        like = sum(n for y, n in f.items() if y >> (7 - j) == c >> (7 - j))
                        x += float(np.float16(math.log((like + L.DELTA) / (sum(same) - like + L.DELTA)))) * model.mixer.weights[gate, k]
                    if active and holds:
                        right = best[i] >> (7 - j) & 1 == c >> (7 - j) & 1
                        x += (1 if right else -1) * float(model.mixer.expected()[state]) * model.mixer.weights[gate, L.KINDS]
                        holds = holds and right
                    x = max(-14, min(14, x))
                    p = 1 / (1 + np.exp(-mid))
                    own = model.mixer.right[gate % L.RUNS]
                    worth = np.clip(np.log((own[:, 0] + 8 * p) / (own[:, 1] + 8 * (1 - p))) - mid, -2, 2)
                    x += 0.5 * np.sign(x) * min(worth[min(int(abs(x) * 2), L.STEPS - 1)], abs(x))
                    total -= math.log10(1 + math.exp(-x))
            run = run + 1 if state and best == s[:8].ljust(8, b"\0") else 0
        return total

    got = {r.doc_id: r.score for r in L.score(docs, train).collect()}
    assert all(abs(got[d] - score(t)) < 0.02 * abs(got[d]) for d, t in rows[16:])
    base = {r.doc_id: r.base_score for r in L.score(docs, train).where("held_out").collect()}
    assert sum(got[d] for d in base) > sum(base.values())


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "some words of a text", 7, 8, 9, 10, 11.0), (1, "some words of a text", 7, 8, 9, 10, 11.0)], "doc_id long, text string, _c int, _p int, _rid int, shard int, _row double")
    out = sharding.shard(rows, 10)
    assert out.columns == [*rows.columns, "_shard", "depth", "oversized"] and {(r["_c"], r["_p"], r["shard"], r["_row"]) for r in out.collect()} == {(7, 8, 10, 11.0)}
    kept = ngram_join.keep_one(rows).collect()
    assert len(kept) == 1 and kept[0]["_rid"] == 9


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    vocab = {k: ["".join(rng.choice(s) for _ in range(rng.randint(2, 7))) for _ in range(120)] for k, s in (("en", "thesandrio"), ("de", "ungschkeit"))}
    text = lambda k, n=80: " ".join(rng.choice(vocab[k]) for _ in range(n))
    item = text("en", 40)
    rows = [(i, text("de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en") for i in range(30)]
    near = rows[4][1].split()
    rows += [(40, rows[4][1], "en"), (41, " ".join(near[:-1]), "en"), (42, text("en") + " " + item + " " + text("en"), "en"), (43, text("en") + " a.b@c.example.com", "en"), (44, None, "en"), (45, "", "de"), (46, "12 34", "en"), (None, text("de"), "de"), (47, text("en", 4000), "en")]
    docs = spark.createDataFrame([(d, t, k, "s", len(t or ""), 1, "x") for d, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, _t string")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    stage = dict(pipeline.STAGES)
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())
    every = key(docs.where("text IS NOT NULL"))
    gone = {44, 45, 46}
    found = stage["language ID"](spark, docs, sf)
    assert found.columns == docs.columns and key(found) == [x for x in every if x[1] not in gone]
    found = stage["n-gram Jaccard join"](spark, docs.where("text <> ''"), sf)
    assert found.columns == docs.columns and key(found) == [x for x in every if x[1] not in {40, 41, 45}]
    found = stage["benchmark decontamination"](spark, docs, sf)
    assert found.columns == docs.columns and found.count() == docs.count() - 1 and found.where("doc_id = 42").isEmpty()
    found = stage["PII"](spark, docs, sf)
    assert found.columns == docs.columns and found.count() == docs.count() and found.where("doc_id = 43").first().text.endswith(" [EMAIL]")
    assert found.where("doc_id <> 43 AND doc_id <> 46").select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).isEmpty()
    out = pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {d for d, *_ in rows} - gone - {40, 41, 42}
    nothing = docs.limit(0)
    for name, f in pipeline.STAGES:
        assert f(spark, nothing, sf).count() == 0, name


def test_segment_counts_agree():
    # every segmentation of no segments is the empty one
    assert list(itertools.islice(_segmentations(2, []), 3)) == [[(pii.NONE, 0, 1, None), (pii.NONE, 1, 2, None)]]


def test_ngram_join_leaves_no_large_scratch(spark):
    import os

    from kinweave.llm import ngram_join
    from kinweave.llm.common import shared_dir

    folder = f"{shared_dir(spark)}/kinweave"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:55], *(f"x{i}{j}" for j in range(i % 3))])) for i in range(40)] + [(100, "one other text of seven words here")]
    got = {r.doc_id: r.component_id for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(40)} | {100: 100}
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert not left & {"ngram-rows", "ngram-shared", "ngram-sets", "ngram-pairs", "ngram-spokes", "ngram-finer"}


def test_contexts_beyond_the_tables_count_in_full(spark, monkeypatch):
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(250)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120)))) for i in range(40)] + [(40, None), (41, "abc" * 9000), (42, "abc" * 9000)]
    docs, train = spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 != 2
    whole, _ = L.learn(docs, train)
    monkeypatch.setattr(L, "CONTEXTS", 300)
    monkeypatch.setattr(L, "BLOCK", 100)
    cut, _ = L.learn(docs, train)
    assert all(len(k) <= 300 < len(w) for (k, _), (w, _) in zip(cut.kinds[2:], whole.kinds[2:]))
    # every token is learned from, as often as it comes
    assert np.array_equal(cut.mixer.came, whole.mixer.came) and cut.mixer.visits.sum() == whole.mixer.visits.sum() and cut.mixer.right.sum() == whole.mixer.right.sum()
    assert np.array_equal(cut.mixer.visits, whole.mixer.visits)  # the trust in each context is the same
    # under equal weights every score is the same, however small the tables and the filter are
    monkeypatch.setattr(L, "fit", lambda model, *_: whole.mixer)
    got = []
    for contexts, size in ((1 << 20, 26), (300, 26), (0, 8)):
        monkeypatch.setattr(L, "CONTEXTS", contexts)
        monkeypatch.setattr(L, "FILTER", size)
        got.append({r.doc_id: r.score for r in L.score(docs, train).collect()})
    assert len(got[0]) == len(rows)
    for other in got[1:]:
        assert other.keys() == got[0].keys() and max(abs(other[d] / x - 1) for d, x in got[0].items()) < 1e-5


def test_other_contexts_take_as_many_rows_with_any_number_of_partitions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(L, "CONTEXTS", 100)
    ctx = np.unique(rng.integers(0, 1 << 55, 6000).astype(np.uint64) << np.uint64(8))
    rows = [(k, keys.tobytes(), np.full(len(keys), 2 + k, np.int64).tobytes()) for k in (2, 3) for keys in np.array_split(ctx | np.uint64(97), 30)]
    found = spark.createDataFrame(rows, "kind int, keys binary, counts binary").coalesce(2)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 211):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            kinds, others = L.kept_contexts(found)
            got.append(others.rows.collect())
            # the filter tells all of them, and nothing else of the tables
            m = L.Model(None, kinds, (np.zeros(0, np.uint64),))
            m.others = others.kinds, others.filter, others.bits
            assert all(m.among_others(k, ctx).all() and not m.in_tables(k, ctx).any() for k in (2, 3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for x in got:
        assert all(np.array_equal(np.sort(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in x if r["kind"] == k])), ctx | np.uint64(97)) for k in (2, 3))
    # a row of a part for each kind and task, not for each row that was read
    assert len(got[0]) == len(got[1]) <= 2 * 2 * 64


def test_tables_tell_their_contexts():
    rng = np.random.default_rng(6)
    # many contexts in one cell of the index, and contexts with many followers
    ctx = np.unique(np.concatenate([rng.integers(0, 1 << 55, 3000), (5 << 45) + rng.integers(0, 1 << 30, 300)]).astype(np.uint64) << np.uint64(8))
    inside = rng.random(len(ctx)) < 0.5
    keys = np.sort(np.concatenate([c | np.arange(n, dtype=np.uint64) for c, n in zip(ctx[inside], rng.choice([1, 2, 200], inside.sum()))]))
    m = L.Model(None, [(keys, np.full(len(keys), 8, np.uint8))] * L.KINDS, (np.zeros(0, np.uint64),))
    assert np.array_equal(m.in_tables(3, ctx), inside)
