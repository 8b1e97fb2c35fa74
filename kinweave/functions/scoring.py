"""Probabilities of links and paths."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .categories import CO_EMPLOYMENT, PROBABILITY

# Chance that an intermediary passes a request on: unguided, and guided for the first and later ones.
FORWARD, GUIDED_FIRST, GUIDED_LATER = 0.37, 0.85, 0.60
_OTHERS = [c for c in sorted(PROBABILITY) if c not in CO_EMPLOYMENT]


def used_categories(cats: Column) -> Column:
    """Sorted categories that count: of those from one employer only the likeliest (ties: the first by name); none for same-entity marks."""
    shared = None
    for c in sorted(CO_EMPLOYMENT, key=lambda c: (-PROBABILITY[c], c)):
        shared = F.when(F.array_contains(cats, c), F.lit(c)) if shared is None else shared.when(F.array_contains(cats, c), F.lit(c))
    rest = F.filter(cats, lambda c: ~c.isin(*CO_EMPLOYMENT, "SAME_ENTITY"))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(rest, F.array(shared)))))


def _missed(has) -> Column:
    """Product of (1 - p) over the categories that count, in a fixed order; has: category -> Column."""
    shared = None
    for c in sorted(CO_EMPLOYMENT, key=lambda c: (-PROBABILITY[c], c)):
        test, value = has(c), F.lit(1.0) - F.lit(PROBABILITY[c])
        shared = F.when(test, value) if shared is None else shared.when(test, value)
    out = shared.otherwise(F.lit(1.0))
    for c in _OTHERS:
        out = out * F.when(has(c), F.lit(1.0) - F.lit(PROBABILITY[c])).otherwise(F.lit(1.0))
    return out


def noisy_or(cats: Column) -> Column:
    """1 - product of (1 - p) over the categories that count, in a fixed order; null without any."""
    return F.when(F.size(used_categories(cats)) > 0, F.lit(1.0) - _missed(lambda c: F.array_contains(cats, c)))


#: Categories as bits of a number, for pairs by the million: bit_or needs no sets. A same-entity mark has none, as it doesn't count.
BITS = {c: 1 << i for i, c in enumerate(sorted(PROBABILITY))} | {"SAME_ENTITY": 0}


def _has(bits: Column):
    return lambda c: bits.bitwiseAND(F.lit(BITS[c])) != 0


def noisy_or_bits(bits: Column) -> Column:
    """noisy_or of bits, of which one is set."""
    return F.lit(1.0) - _missed(_has(bits))


def used_bits(bits: Column) -> Column:
    """used_categories of bits."""
    likelier, tests, has = 0, {}, _has(bits)
    for c in sorted(CO_EMPLOYMENT, key=lambda c: (-PROBABILITY[c], c)):
        tests[c] = has(c) & (bits.bitwiseAND(F.lit(likelier)) == 0)
        likelier |= BITS[c]
    return F.array_compact(F.array(*(F.when(tests[c] if c in tests else has(c), F.lit(c)) for c in sorted(PROBABILITY))))


def noisy_or_sql(cats: str) -> str:
    """The same as ANSI SQL over a list column."""
    shared = " ".join(f"WHEN list_contains({cats}, '{c}') THEN 1.0::DOUBLE - {PROBABILITY[c]}::DOUBLE" for c in sorted(CO_EMPLOYMENT, key=lambda c: (-PROBABILITY[c], c)))
    out = f"(CASE {shared} ELSE 1.0::DOUBLE END)"
    for c in _OTHERS:
        out = f"({out} * CASE WHEN list_contains({cats}, '{c}') THEN 1.0::DOUBLE - {PROBABILITY[c]}::DOUBLE ELSE 1.0::DOUBLE END)"
    return f"1.0::DOUBLE - {out}"


def edge_weight(prob: Column) -> Column:
    """Cost of a link on a path: -ln(p) - ln(forward)."""
    return -F.ln(F.greatest(prob, F.lit(1e-9))) - F.ln(F.lit(FORWARD))


def product(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(1.0), lambda x, y: x * y)


def forward(hops: Column) -> Column:
    return F.pow(F.lit(FORWARD), F.greatest(hops - 1, F.lit(0)).cast("double"))


def guided(hops: Column) -> Column:
    return F.when(hops <= 1, F.lit(1.0)).otherwise(F.lit(GUIDED_FIRST) * F.pow(F.lit(GUIDED_LATER), (hops - 2).cast("double")))


def band(p: Column) -> Column:
    return F.when(p >= 0.5, "Strong").when(p >= 0.1, "Plausible").when(p >= 0.01, "Weak").otherwise("Tenuous")


def one_in(p: Column) -> Column:
    near = "≈ "
    return F.when(p <= 0, near + "negligible").when(p >= 0.5, F.concat(F.rint(p * 100).cast("bigint").cast("string"), F.lit("%"))).otherwise(F.concat(F.lit(near + "1 in "), F.rint(F.lit(1.0) / p).cast("bigint").cast("string")))


def primary(cats: Column) -> Column:
    """The likeliest category of a link; ties: the first by name."""
    out = None
    for c in sorted(PROBABILITY, key=lambda c: (-PROBABILITY[c], c)):
        out = F.when(F.array_contains(cats, c), F.lit(c)) if out is None else out.when(F.array_contains(cats, c), F.lit(c))
    return out


def advantage(passive: Column, guided_p: Column) -> Column:
    """How many times likelier the guided path is."""
    return F.when(passive > 0, guided_p / passive)
