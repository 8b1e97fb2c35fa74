"""Extendible hashing into byte-bounded shards, with DataFrame functions only.

A row's address is 63 bits: 32 from the md5 of its key, then 31 from the md5 of the key and the row's place in the scan, so that
even one key that holds a third of all rows can be told apart. A bucket is an address prefix; it starts as the empty prefix, and only
a bucket whose bytes exceed the limit splits on the next bit. A row's shard is therefore its shortest prefix whose rows fit.
Null text counts 0 bytes; a null key is a key like any other; a single row over the limit gets a shard of its own marked oversized;
repeated rows are rows like others; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, unused

KEY_BITS, BITS = 32, 63
#: Bits that one round looks at below those that an even spread would need.
SLACK = 4
STEP = 8


def _hex(c: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, digits), 16, 10).cast("long")


def shard(docs: DataFrame, limit: int, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """docs with shard (prefix bits as text, '' for the whole), depth, and oversized, with as many _ before these names as it takes to clash with none; all rows
    and columns are kept. Rows and their addresses are written once, so that no later job numbers them anew."""
    size = F.coalesce((F.octet_length("text") if size is None else size).cast("long"), F.lit(0))
    new = [unused(x, docs.columns) for x in ("shard", "depth", "oversized")]
    key_text = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    place = F.call_function("shiftright", _hex(F.concat_ws("/", key_text, F.monotonically_increasing_id().cast("string")), 8), F.lit(1))
    # the caller's columns travel as one, so none of theirs can clash with ours
    rows = materialize(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), size.alias("_n"), (_hex(key_text, 8) * (1 << (BITS - KEY_BITS)) + place).alias("_a")), "shard-rows")
    total = rows.agg(F.sum("_n")).first()[0] or 0
    depth = min(BITS, max(0, -(-total // limit) - 1).bit_length() + SLACK)
    open_rows, found, done = rows.select("_a", "_n"), None, 0
    while True:
        cells = open_rows.groupBy(F.call_function("shiftright", F.col("_a"), F.lit(BITS - depth)).alias("_c")).agg(F.sum("_n").alias("_n"), F.count("*").alias("_r"))
        cells = materialize(cells, f"shard-cells-{depth}")
        # every prefix of a cell, from the last round's cells on, with the bytes below it
        prefixes = cells.withColumn("_d", F.explode(F.sequence(F.lit(done), F.lit(depth)))).withColumn("_p", F.expr(f"shiftright(_c, {depth} - _d)"))
        fits = prefixes.groupBy("_d", "_p").agg(F.sum("_n").alias("_b"), F.sum("_r").alias("_r")).where((F.col("_b") <= limit) | (F.col("_r") == 1))
        level = prefixes.select("_c", "_d", "_p").join(fits, ["_d", "_p"]).groupBy("_c").agg(F.min(F.struct("_d", "_p", "_b")).alias("_s"))
        level = cells.select("_c").join(level, "_c", "left").select("_c", F.lit(depth).alias("_at"), F.col("_s._d").alias("_d"), F.col("_s._p").alias("_p"), F.col("_s._b").alias("_b"))
        level = materialize(level, f"shard-level-{depth}")
        found = level if found is None else found.unionByName(level)
        if depth == BITS or level.where("_d IS NULL").isEmpty():
            break
        # only rows in cells that are still too large go on
        open_cells = level.where("_d IS NULL").select("_c")
        open_rows = open_rows.withColumn("_c", F.call_function("shiftright", F.col("_a"), F.lit(BITS - depth))).join(open_cells, "_c", "left_semi").select("_a", "_n")
        done, depth = depth, min(BITS, depth + STEP)
    depths = [r[0] for r in found.select("_at").distinct().collect()]
    out = rows
    if len(depths) <= 1:
        out = out.withColumn("_c", F.call_function("shiftright", F.col("_a"), F.lit(BITS - depth))).join(found.drop("_at"), "_c", "left")
    else:
        closed = found.where(F.col("_d").isNotNull() | (F.col("_at") == BITS))
        for at in sorted(depths):
            part = closed.where(F.col("_at") == at).select(F.col("_c").alias(f"_c{at}"), F.struct(F.coalesce("_d", F.lit(at)).alias("_d"), F.coalesce("_p", "_c").alias("_p"), "_b").alias(f"_s{at}"))
            out = out.withColumn(f"_c{at}", F.call_function("shiftright", F.col("_a"), F.lit(BITS - at))).join(part, f"_c{at}", "left")
        s = F.coalesce(*(F.col(f"_s{at}") for at in sorted(depths)))
        out = out.withColumn("_s", s).withColumn("_d", F.col("_s._d")).withColumn("_p", F.col("_s._p")).withColumn("_b", F.col("_s._b"))
    bits = F.when(F.col("_d") == 0, F.lit("")).otherwise(F.expr("lpad(bin(_p), _d, '0')"))
    return out.select("_row.*", bits.alias(new[0]), F.col("_d").cast("int").alias(new[1]), (F.col("_n") > limit).alias(new[2]))
