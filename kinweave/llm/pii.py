"""Personal data by rules and a semi-Markov conditional random field.

Rules give the base spans; they always stay. The model's segments are runs of at most MAX_TOKENS tokens (letters, digits, or one other character) that begin and end
on a token of their kind and hold either four to MAX_DIGITS digits in at most MAX_GROUPS runs, apart by at most three marks or blanks, or an at mark, plain or written out. Each segment
has whole-span features (digit counts, check sums, separators, neighbours, the word before) weighed for each kind, and each
step from one label to the next a weight of its own. The probability of a segmentation is its exponentiated score over that of all segmentations of
the text; as a token that lies in no segment has but one label, this falls apart into the windows that segments cover. Weights maximise
the likelihood, with sums over all segmentations by forward and backward recursions, of generated sentences and of the rules' spans in a bounded sample of documents
(SAMPLE_DOCS of at most SAMPLE_CHARS characters, chosen by hash). Dynamic programming finds the best segmentation, boundaries and kinds at
once; its spans that touch no base span are added.

A null text is empty and has no spans; repeated rows are treated alike; ties go to the earlier label as in KINDS, then to none; the work is linear in a
text's length; other columns play no part; an empty table gives no rows.
"""
from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, by_batch, tune

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_DIGITS, MAX_GROUPS = 24, 19, 6
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
# Fixed by the contract; possessive and anchored at what each must hold, so that no run is scanned more than once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]+")
#: Where segments may lie: digits apart by few marks or blanks, and names around an at mark.
_NUMBERS = re.compile(r"[+(]?[0-9](?:[\x20()./+-]{0,3}[0-9])*+\)?")
_AT = re.compile(r"\x20?[\[(]at[\])]\x20?|@", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,64}){0,8}", re.I)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_CUE = re.compile(r"([A-Za-z]+)\W{0,3}$")
#: Words before a span that the model may weigh.
CUES = frozenset("call card cc credit email fax host ip mail mobile phone server tel telephone visa".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each holds one at mark, before it all that may stand there since the last one."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as in KINDS, then start."""
    out = []
    if "@" in text:
        out += [("email", *x) for x in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(len, _DIGIT.findall(m[0]))) <= 15]
    return out


@functools.lru_cache(maxsize=50_000)
def _features(s: str, left: str, right: str, cue: str) -> list[str]:
    groups = _DIGIT.findall(s)
    n = sum(map(len, groups))
    marks = "".join(sorted(set(re.sub("[A-Za-z0-9]", "", s))))
    out = ["one", f"digits{min(n, 21)}", f"groups{min(len(groups), 8)}", f"marks{marks}", f"sizes{','.join(str(min(len(g), 6)) for g in groups[:6])}", f"left{left}", f"right{right}"]
    if 13 <= n <= 19:
        out.append(f"luhn{luhn(''.join(groups))}")
    if s[0] == "+":
        out.append("plus")
    if len(groups) == 4 and s.count(".") == 3 and marks == ".":
        out.append(f"quad{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if re.search("[A-Za-z]", s):
        out.append("letters")
    if "@" in s or re.search(r"[\[(]at[\])]", s, re.I):
        tail = re.split(r"@|[\[(]at[\])]", s, flags=re.I)[-1]
        out.append("at" + ("dot" if re.search(r"\.|[\[(]dot[\])]", tail, re.I) else "bare"))
        out.append(f"ends{s[-1].isalnum()}")
    if cue:
        out.append(f"cue{cue}")
    return out


def _side(c: str) -> str:
    return "w" if c.isalnum() else "s" if not c or c.isspace() else "p"


def windows(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, holds an at mark) of the parts of a text in which all its segments lie; they don't overlap."""
    out, last = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > max(last, m.start() - 64) and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, m.end())
        if start < m.start() and host:
            out.append((start, host.end(), True))
            last = host.end()
    free, at = [], 0
    for a, b, _ in [*out, (len(text), len(text), True)]:
        free += [(*m.span(), False) for m in _NUMBERS.finditer(text, at, a) if m.end() - m.start() >= 4]
        at = b
    return sorted(out + free)


def segments(text: str, a: int, b: int, mail: bool) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """Token bounds of a window and its segments (first token, last token + 1, features)."""
    bounds = [m.start() for m in _TOKEN.finditer(text, a, b)] + [b]
    digits = [bounds[i + 1] - bounds[i] if text[bounds[i]] in "0123456789" else 0 for i in range(len(bounds) - 1)]
    cue = _CUE.search(text[max(0, a - 16) : a])
    cue = cue[1].lower() if cue and cue[1].lower() in CUES else ""
    out, last = [], len(bounds) - 1
    for i in range(last):
        c = text[bounds[i]]
        if not (c.isalnum() or c in "+("):
            continue
        n = groups = 0
        for j in range(i + 1, min(last, i + MAX_TOKENS) + 1):
            n += digits[j - 1]
            groups += digits[j - 1] > 0
            if (n > MAX_DIGITS or groups > MAX_GROUPS) and not mail:
                break
            e = bounds[j]
            if not (text[e - 1].isalnum() or text[e - 1] in ")]") or not mail and n < 4:
                continue
            s = text[bounds[i] : e]
            if mail and not _AT.search(s):
                continue
            out.append((i, j, _features(s, _side(text[bounds[i] - 1 : bounds[i]] if bounds[i] else ""), _side(text[e : e + 1]), cue if not i else "")))
    return bounds, out


class Covered:
    """What spans cover, as runs that don't touch."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda x: x[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def holds(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.starts, a) - 1
        return i >= 0 and b <= self.ends[i]

    def touches(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a


NONE = len(KINDS)


class Model:
    """Weights of features for each kind, and of steps from label to label; the last label is none."""

    def __init__(self, weights: dict[str, tuple[float, ...]] | None = None, steps: list[list[float]] | None = None):
        self.w, self.steps = weights or {}, steps or [[0.0] * (NONE + 1) for _ in range(NONE + 1)]

    def scores(self, features: list[str]) -> list[float]:
        out = [0.0] * NONE
        for f in features:
            if row := self.w.get(f):
                for k in range(NONE):
                    out[k] += row[k]
        return out

    def decode(self, n: int, segs: list[tuple[int, int, list[str]]]) -> list[tuple[int, int, int]]:
        """(kind, first token, last token + 1) of the best segmentation of n tokens."""
        by_end: dict[int, list] = {}
        for i, j, f in segs:
            by_end.setdefault(j, []).append((i, self.scores(f)))
        t = self.steps
        never = float("-inf")
        best, back = [[never] * NONE + [0.0]], [[None] * (NONE + 1)]
        for j in range(1, n + 1):
            row, where = [never] * (NONE + 1), [None] * (NONE + 1)
            for y in range(NONE + 1):
                if best[j - 1][y] + t[y][NONE] > row[NONE]:
                    row[NONE], where[NONE] = best[j - 1][y] + t[y][NONE], (j - 1, y)
            for i, score in by_end.get(j, ()):
                for y in range(NONE + 1):
                    if best[i][y] > never:
                        for k in range(NONE):
                            if (s := best[i][y] + t[y][k] + score[k]) > row[k]:
                                row[k], where[k] = s, (i, y)
            best.append(row)
            back.append(where)
        # labels are compared as a step to none follows
        y = max(range(NONE + 1), key=lambda y: best[n][y] + t[y][NONE])
        out, j = [], n
        while j:
            i, before = back[j][y]
            if y < NONE:
                out.append((y, i, j))
            j, y = i, before
        return out[::-1]

    def spans(self, text: str, taken: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int]]:
        """Of windows that don't lie in taken spans, whose own would touch these."""
        out, held = [], Covered(taken)
        for a, b, mail in windows(text):
            if held.holds(a, b):
                continue
            bounds, segs = segments(text, a, b, mail)
            if segs:
                out += [(KINDS[k], bounds[i], bounds[j]) for k, i, j in self.decode(len(bounds) - 1, segs)]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis))


class Lattices:
    """Many windows side by side: lengths in tokens; of each segment the window, first token and last token + 1."""

    def __init__(self, size: list[int], window: list[int], first: list[int], last: list[int]):
        self.size = np.array(size)
        self.window, self.first, self.last = (np.array(x, np.int64) for x in (window, first, last))
        most = int(self.size.max())
        self.ending = [np.flatnonzero(self.last == j) for j in range(most + 1)]
        self.starting = [np.flatnonzero(self.first == i) for i in range(most + 1)]

    def sums(self, score: np.ndarray, t: np.ndarray):
        """log of the sum over all segmentations of each window; probabilities of segments by kind; expected steps. score: [segments, kinds], t: [labels, labels]."""
        w, most, labels = len(self.size), int(self.size.max()), NONE + 1
        fore = np.full((w, most + 1, labels), -np.inf)
        fore[:, 0, NONE] = 0
        for j in range(1, most + 1):
            fore[:, j, NONE] = _log_sum(fore[:, j - 1] + t[:, NONE], 1)
            if len(own := self.ending[j]):
                v = _log_sum(fore[self.window[own], self.first[own]][:, :, None] + t[None, :, :NONE], 1) + score[own]
                np.logaddexp.at(fore[:, j, :NONE], self.window[own], v)
        at = np.arange(w)
        total = _log_sum(fore[at, self.size] + t[:, NONE], 1)
        aft = np.full((w, most + 1, labels), -np.inf)
        aft[at, self.size] = t[:, NONE]
        for i in range(most - 1, -1, -1):
            live = np.flatnonzero(self.size > i)
            v = t[None, :, NONE] + aft[live, i + 1, NONE][:, None]
            row = aft[:, i]
            row[live] = v
            if len(own := self.starting[i]):
                v = _log_sum(t[None, :, :NONE] + (score[own] + aft[self.window[own], self.last[own], :NONE])[:, None, :], 2)
                np.logaddexp.at(row, self.window[own], v)
        after = score + aft[self.window, self.last, :NONE] - total[self.window][:, None]
        step = np.exp(fore[self.window, self.first][:, :, None] + t[None, :, :NONE] + after[:, None, :])
        expected = np.zeros((labels, labels))
        expected[:, :NONE] = step.sum(0)
        inner = np.arange(most)[None, :] < self.size[:, None]
        with np.errstate(invalid="ignore"):
            none = np.exp(np.where(inner[:, :, None], fore[:, :-1] + t[:, NONE] + aft[:, 1:, NONE][:, :, None] - total[:, None, None], -np.inf))
        expected[:, NONE] = none.sum((0, 1)) + np.exp(fore[at, self.size] + t[:, NONE] - total[:, None]).sum(0)
        return total, step.sum(1), expected


def examples(rng: random.Random, n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with spans: each kind in several writings, and numbers that are none."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))

    def card():
        body = rng.choice("3456") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        # with a digit mistyped it's someone's number still, though no rule finds it
        body = rng.choice([body, digits(16)])
        return rng.choice([body, body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4))])

    def phone():
        a, b, c = str(rng.randint(2, 9)) + digits(2), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+{digits(11)}"])

    def email():
        user, host, top = word() + rng.choice(["", "." + digits(2), "_" + word()]), word(), rng.choice(["com", "org", "net", "example.com"])
        return rng.choice([f"{user}@{host}.{top}", f"{user}@{host}.{top}", f"{user} [at] {host}.{top.split('.')[-1]}", f"{user}(at){host}[dot]com"])

    def none():
        return rng.choice([digits(rng.randint(4, 8)), f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 31):02}", f"{rng.randint(1, 99)}.{digits(3)}.{digits(3)}", f"{rng.randint(300, 999)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(300, 999)}", digits(rng.randint(9, 12)), digits(rng.randint(20, 24)), word() + digits(6) + word() + digits(5), f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(2)}-{digits(2)} {digits(4)}", f"{word()}@{word()}", f"{digits(3)}-{digits(4)}", digits(20) + word() + digits(12), f"({rng.randint(1900, 2030)})"])

    make = {"email": email, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = word() + " ", []
        for again in range(rng.choice([1, 1, 1, 2, 3])):
            if again:
                text += rng.choice([" ", ", "])
            kind = rng.choice([*KINDS, None, None, None, None])
            s = make[kind]() if kind else none()
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s
        # an address without a mark after it has no end that could be told
        out.append((text + rng.choice([" ", ". ", ", ", *([""] if kind != "email" else [])]) + word(), spans))
    return out


def train(texts: list[str], seed: int = 5, generated: int = 1200, rounds: int = 60, rate: float = 0.3, ridge: float = 0.02) -> Model:
    """Most likely weights, less a ridge, by Adam steps over all examples; texts give the rules' spans as further examples."""
    rng = random.Random(seed)
    data = examples(rng, generated)
    for t in texts:
        base = base_spans(t)
        for a, b, _ in windows(t)[:3]:
            own = [x for x in base if x[1] < b and a < x[2]]
            # spans of two rules that overlap, or that reach beyond the window, tell no one segmentation
            if own and all(a <= x[1] and x[2] <= b for x in own) and not any(x is not y and x[1] < y[2] and y[1] < x[2] for x in own for y in own):
                lo = max(0, a - 20)
                data.append((t[lo : b + 20], [(k, x - lo, y - lo) for k, x, y in own]))
        if len(data) > generated * 2:
            break
    names: dict[str, int] = {}
    size, window, first, last, feats, gold = [], [], [], [], [], []
    truth = np.zeros((NONE + 1, NONE + 1))
    for text, spans in data:
        for a, b, mail in windows(text):
            bounds, segs = segments(text, a, b, mail)
            inside = {(x, y): KINDS.index(k) for k, x, y in spans if a <= x and y <= b}
            found = {(bounds[i], bounds[j]) for i, j, _ in segs}
            if not segs or not inside.keys() <= found:
                continue
            at = 0
            label = NONE
            for x, y in sorted(inside):
                i, j = bounds.index(x), bounds.index(y)
                for _ in range(at, i):
                    truth[label, NONE] += 1
                    label = NONE
                truth[label, inside[x, y]] += 1
                label, at = inside[x, y], j
            for _ in range(at, len(bounds)):
                truth[label, NONE] += 1
                label = NONE
            for i, j, f in segs:
                window.append(len(size))
                first.append(i)
                last.append(j)
                feats.append([names.setdefault(x, len(names)) for x in f])
                gold.append(inside.get((bounds[i], bounds[j]), NONE))
            size.append(len(bounds) - 1)
    if not size:
        return Model()
    lattices = Lattices(size, window, first, last)
    row = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    col = np.concatenate([np.array(f) for f in feats])
    right = np.eye(NONE + 1)[np.array(gold)][:, :NONE]
    x = np.zeros((len(names) + NONE + 1, NONE + 1))  # the last rows are steps; features have no weight for none
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        w = x[: len(names), :NONE]
        score = np.stack([np.bincount(row, w[col, c], len(feats)) for c in range(NONE)], 1)
        _, p, expected = lattices.sums(score, x[len(names) :])
        slope = -ridge * x
        for c in range(NONE):
            slope[: len(names), c] += np.bincount(col, (right - p)[row, c], len(names))
        slope[len(names) :] += truth - expected
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        x = x + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) / np.sqrt(k)
    return Model({name: tuple(x[i, :NONE].tolist()) for name, i in names.items()}, x[len(names) :].tolist())


def fit(docs: DataFrame, text: str = "text") -> Model:
    own = docs.where(F.col(text).rlike("[0-9@]") & (F.length(text) <= SAMPLE_CHARS)).select(F.col(text).alias("t"))
    return train([r[0] for r in bounded_sample(own, SAMPLE_DOCS).collect()])


def find(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans in the same order."""
    base = base_spans(text)
    held = Covered(base)
    more = [x for x in model.spans(text, base) if not held.touches(x[1], x[2])]
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def _quiet(text: str) -> bool:
    return not _DIGIT.search(text) and "@" not in text and not ("at" in text.lower() and re.search(r"[\[(]at[\])]", text, re.I))


FIELDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every text: counts by kind and the hash of the base spans, and all spans."""
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model or fit(docs, text))

    def make():
        m = held.value
        none = hashlib.sha256(b"").hexdigest()

        def f(b):
            rows = []
            for t in b.column(1).to_pylist():
                if _quiet(t):
                    rows.append((0, 0, 0, 0, none, "", 0))
                    continue
                base, spans = find(t, m)
                rows.append((*(sum(k == x[0] for x in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [x.split(" ")[0] for x in FIELDS.split(", ")])

        return f

    return docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(by_batch(make), FIELDS)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first and longest names the whole."""
    out, at = [], 0
    todo = sorted(((a, -b, k) for k, a, b in spans))
    i = 0
    while i < len(todo):
        a, b, k = todo[i]
        b = -b
        i += 1
        while i < len(todo) and todo[i][0] < b:
            b = max(b, -todo[i][1])
            i += 1
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with personal data in text replaced; all rows and columns stay, and n_chars, if there, is that of the new text."""
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model or fit(docs, text))
    names = docs.columns
    at = names.index(text)

    def make():
        m = held.value

        def f(b):
            new = [t if t is None or _quiet(t) else redacted(t, find(t, m)[1]) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

        return f

    out = docs.mapInArrow(by_batch(make), docs.schema)
    return out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
