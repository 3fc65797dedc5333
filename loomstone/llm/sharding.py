"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 .. n-1 in a total order. A keyed Feistel network permutes the smallest range
of 2**bits numbers that holds n; a number that lands at n or above is permuted again until it falls
inside (cycle walking), which leaves a permutation of 0 .. n-1. The permuted number p gives shard
p mod shards and slot p div shards. Both are computable from a row number alone, in either
direction, shards differ by one row at most, and the same seed gives the same shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import shared, textkit

ROUNDS = 6


def _half(value: np.ndarray, key: int, bits: int) -> np.ndarray:
    return textkit.mix(value + np.uint64(key)) >> np.uint64(64 - bits) if bits else np.zeros_like(value)


def _keys(seed: int) -> list[int]:
    return [int(k) for k in textkit.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (1 << 64) - 1))]


def _network(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    """One pass over [0, 2**bits): rounds xor the low part by the high part and the other way round in turn."""
    low = bits // 2
    high = bits - low
    mask = np.uint64((1 << low) - 1)
    for r, key in reversed(list(enumerate(_keys(seed)))) if back else enumerate(_keys(seed)):
        if r % 2:
            x = x ^ (_half(x & mask, key, high) << np.uint64(low))
        else:
            x = x ^ _half(x >> np.uint64(low), key, low)
    return x


def permute(numbers: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of [0, n) at `numbers`, or its inverse."""
    x = np.asarray(numbers).astype(np.uint64)
    bits = max(1, (max(n, 1) - 1).bit_length())
    x = _network(x, bits, seed, back)
    while (out := np.flatnonzero(x >= np.uint64(n))).size:
        x[out] = _network(x[out], bits, seed, back)
    return x.astype(np.int64)


def numbered(spark: SparkSession, df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """`df` with row_number, 0 .. n-1 in the order of the named columns, and n.

    Range partitions are sorted in place; a row's number is its place in its partition plus the rows
    of the partitions before, so no task sees more than its partition. The place in the source breaks
    ties, so a run of equal rows is dealt over many partitions.
    """
    keyed = df.withColumn("__place", F.monotonically_increasing_id())
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sort = [F.col(f"`{c}`").asc_nulls_first() for c in order] + [F.col("__place")]
    ranged = keyed.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).drop("__place").withColumn("__at", F.monotonically_increasing_id())
    kept = shared.written(spark, ranged, "numbered")
    part = F.shiftright("__at", 33)
    sizes = sorted((r["part"], r["count"]) for r in kept.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for p, count in sizes:
        before.append((p, total))
        total += count
    offsets = F.create_map(*(F.lit(x) for pair in before for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    number = offsets[part.cast("int")].cast("long") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return kept.withColumn("row_number", number).drop("__at"), total


def shard_rows(spark: SparkSession, df: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """`df` with shard (0 .. shards-1) and slot (gapless from 0 in each shard).

    Any row takes part, with null or empty columns and repeated rows too; equal rows get different
    slots. An empty table gives an empty one. Only the columns of `df` itself are moved, so pass
    fingerprints in place of long texts.
    """
    shared.ship(spark)
    rows, n = numbered(spark, df, order)

    @F.pandas_udf("long")
    def shuffled(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    at = shuffled("row_number")
    return rows.withColumn("__p", at).withColumn("shard", (F.col("__p") % shards).cast("int")).withColumn("slot", F.expr(f"__p div {int(shards)}")).drop("__p", "row_number")


def shard_documents(spark: SparkSession, documents: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """The op3 contract over documents, by the law `rows`: shards differ by at most one row.

    A null text has size 1 and CRC 0; a null doc_id sorts first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    small = documents.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = shard_rows(spark, small, shards, ["doc_id", "text_crc32", "size"], seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
