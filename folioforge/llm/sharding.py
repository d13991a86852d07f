"""Sharding by a Feistel permutation of global row numbers.

Law `rows`: the N rows are numbered 0..N-1 in ascending id order; a keyed Feistel
permutation of 0..N-1 (cycle walking past the end of its power-of-two domain)
shuffles the numbers; position p goes to shard p mod S, slot p div S. So shard
counts differ by one at most, slots are gapless, and shard and slot of any row
number (and, by the inverse, the row number of any shard and slot) are computed
without looking at other rows. The permutation moves single rows, so rows with
equal texts do not share a shard.

The numbering is distributed: range partitions on the id, one count a partition,
and prefix sums over those counts (as many rows as partitions, hence the bound of
the broadcast). Ties of the id are ordered by size and checksum; rows equal in all
three are interchangeable. Null ids sort first, null texts count as no bytes, an
empty table gives an empty result, and extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import cut

ROUNDS = 6
#: Rows of a range at most, about.
RANGE_ROWS = 4_000_000
_M1, _M2, _GOLD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """The splitmix64 finaliser of x + key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _once(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (_mix(right, key) & mask)
    return (right << shift) | left  # swapped, so that reversed keys undo it


def _walk(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    bits = _half_bits(n)
    out = _once(x.astype(np.uint64), bits, keys)
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = _once(out[beyond], bits, keys)
    return out.astype(np.int64)


def round_keys(seed: int) -> list[int]:
    return [(seed * 0x2545F4914F6CDD1D + i * _GOLD) % (1 << 64) for i in range(1, ROUNDS + 1)]


def permute(row: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A bijection of 0..n-1, the same for the same n and seed."""
    return _walk(row, n, round_keys(seed))


def unpermute(position: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The inverse of permute."""
    return _walk(position, n, round_keys(seed)[::-1])


def _permuted(row: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return position(row)


def number_rows(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """rows with a column of global row numbers 0..N-1 in the given order, and N."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("__ff_at", F.monotonically_increasing_id()))
    part = F.shiftright("__ff_at", 33)
    counts = placed.groupBy(part.alias("__ff_part")).count()
    before = Window.orderBy("__ff_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the exchange: bounded by its number of partitions
    bases = cut(counts.select("__ff_part", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__ff_base")).coalesce(1))
    total = bases.agg(F.sum("count")).first()[0] or 0
    local = F.col("__ff_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("__ff_part", part).join(F.broadcast(bases.drop("count")), "__ff_part")
    return joined.withColumn(name, F.col("__ff_base") + local).drop("__ff_at", "__ff_part", "__ff_base"), total


def shard(docs: DataFrame, shards: int = 24, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and the row number of every row of docs."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    numbered, total = number_rows(slim, [id_col, "size", "text_crc32"], "row_number")
    placed = numbered.withColumn("position", _permuted(F.col("row_number"), max(total, 1), seed))
    return placed.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
