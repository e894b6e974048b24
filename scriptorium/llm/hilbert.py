"""Sharding by Hilbert-curve order; DataFrame functions only.

Several metadata columns are quantised to a few order-preserving levels each, the levels are woven
into a position on a Hilbert curve, and the curve is cut into runs of equal row counts. Neighbours
on the curve are neighbours in every column, so the value ranges that a file's statistics hold stay narrow in
all of them at once, and filters on any of them prune files.

Rows are ranked without a global sort: a cell of the curve, split by a hash of ``doc_id`` where it is
large, is ordered by itself, and the cells' offsets come from their counts. Null metadata has level 0; null text has no
bytes; repeated rows take separate slots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import materialize

#: Rows that one part of a cell should hold.
PART_ROWS = 100_000
#: Distinct values of a text column up to which its table of levels is broadcast (at most a few MB).
BROADCAST_VALUES = 50_000


def hilbert_tables(dims: int) -> tuple[list[int], list[int]]:
    """For state * 2^dims + cell: the cell's place along the curve, and the next state.

    A state is an entry corner and a direction; the rules are those of Gray-code sub-cubes.
    """
    side = 1 << dims

    def rotl(x: int, k: int) -> int:
        k %= dims
        return (x << k | x >> (dims - k)) & (side - 1)

    def gray(i: int) -> int:
        return i ^ i >> 1

    place = {gray(i): i for i in range(side)}

    def entry(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    def turn(i: int) -> int:
        return 0 if i == 0 else ones(i - 1 if i % 2 == 0 else i) % dims

    digits, following = [], []
    for e in range(side):
        for d in range(dims):
            for cell in range(side):
                w = place[rotl(cell ^ e, dims - (d + 1) % dims)]
                digits.append(w)
                following.append((e ^ rotl(entry(w), d + 1)) * dims + (d + turn(w) + 1) % dims)
    return digits, following


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Position along the curve of a point whose coordinates are ``bits``-bit integers."""
    dims = len(levels)
    digits, following = (F.array(*[F.lit(x) for x in t]) for t in hilbert_tables(dims))
    state, index = F.lit(0), F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        cell = reduce(lambda acc, k: acc.bitwiseOR(F.shiftleft(F.shiftright(levels[k].cast("int"), bit).bitwiseAND(1), k)), range(dims), F.lit(0))
        at = state * (1 << dims) + cell
        index = index * (1 << dims) + F.get(digits, at)
        state = F.get(following, at)
    return index


def _numeric_level(df: DataFrame, column: str, bits: int) -> Column:
    """Equal-depth level by the column's quantiles (one small aggregate)."""
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(F.percentile_approx(column, cuts, 1000).alias("q")).first()["q"] or []
    return sum(((F.coalesce(F.col(column), F.lit(found[0])) > F.lit(x)).cast("int") for x in found), F.lit(0))


def _text_level(df: DataFrame, column: str, bits: int) -> DataFrame:
    """Adds ``<column>_level``: the share of rows with a smaller value, so levels keep the values' order."""
    counts = df.groupBy(column).count()
    share = (F.sum("count").over(Window.orderBy(F.col(column).asc_nulls_first())) - F.col("count")) / F.sum("count").over(Window.partitionBy())
    levels = counts.select(F.col(column).alias("__value"), F.floor(share * (1 << bits)).cast("int").alias(f"{column}_level"))
    if counts.count() <= BROADCAST_VALUES:
        levels = F.broadcast(levels)
    return df.join(levels, df[column].eqNullSafe(F.col("__value")), "left").drop("__value")


def curve_order(docs: DataFrame, numeric: tuple[str, ...], text: tuple[str, ...], bits: int = 4) -> DataFrame:
    """Adds ``cell``, the position along the Hilbert curve, to narrow rows."""
    for name in text:
        docs = _text_level(docs, name, bits)
    levels = [F.col(f"{name}_level") for name in text] + [_numeric_level(docs, name, bits) for name in numeric]
    return docs.withColumn("cell", hilbert_index(levels, bits))


def hilbert_shards(docs: DataFrame, shards: int = 40, numeric: tuple[str, ...] = ("doc_id", "size"), text: tuple[str, ...] = ("source", "lang"), bits: int = 4) -> DataFrame:
    """Every document's shard and slot along the curve; shard row counts differ by one at most."""
    narrow = docs.select(
        "doc_id", *text, (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    narrow = materialize(narrow, "metadata")
    n = narrow.count()
    parts = max(16, -(-n // PART_ROWS))
    placed = curve_order(narrow, numeric, text, bits).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "cell", "sub"), "cells")
    coarse = F.shiftright("cell", max(0, bits * (len(numeric) + len(text)) - 8))
    counts = placed.groupBy("cell", "sub").count().withColumn("coarse", coarse)
    tops = counts.groupBy("coarse").agg(F.sum("count").alias("total"))
    tops = tops.select(F.col("coarse").alias("__coarse"), (F.sum("total").over(Window.orderBy("coarse")) - F.col("total")).alias("above"))
    inside = F.sum("count").over(Window.partitionBy("coarse").orderBy("cell", "sub")) - F.col("count")
    offsets = counts.withColumn("inside", inside).join(tops, F.col("coarse") == F.col("__coarse")).select("cell", "sub", (F.col("above") + F.col("inside")).alias("offset"))
    row = F.row_number().over(Window.partitionBy("cell", "sub").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = placed.withColumn("row", row).join(offsets, ["cell", "sub"]).withColumn("position", F.col("offset") + F.col("row"))
    shard = F.expr(f"position * {shards} div {max(n, 1)}L")
    ranked = ranked.withColumn("shard", shard.cast("int"))
    slot = F.col("position") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", "cell", "position", "shard", slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write the documents as one sorted file per shard, so that file statistics are narrow in every dimension."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
