"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, nulls first; a hash of the
text).  A Feistel network permutes the smallest domain of 2**(2h) numbers that
holds n, and cycle walking (permuting again while the result is n or more)
keeps the permutation within 0..n-1.  A row at place p goes to shard
p mod S, slot p div S: counts differ by one at most (the law `rows`), slots are
gapless from 0, and `place` computes shard and slot of any row number without
looking at the others.  The same rows, seed and shard count give the same
shuffle on every run.

Only ids, sizes and checksums are sorted; the texts stay where they are.

Edge cases: a null text has no bytes, so size 1 and checksum 0.  Rows that
share a doc_id (null too) are ordered by their text's hash; rows that repeat in
full are interchangeable, and each has a place of its own.  An empty table
gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.common import materialize
from tableflow.llm.flat import mix

SHARDS, SEED, ROUNDS = 16, 20_240_229, 6


def permute(x: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 (or its inverse), element by element."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed % (1 << 64)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << shift) | right

    out = once(x.astype(np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def place(row_number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of one row number."""
    p = int(permute(np.array([row_number]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def number_rows(df: DataFrame, *order) -> DataFrame:
    """df sorted by `order` with gapless `row_number` from 0.

    The range-partitioned rows are written once, so that the counts per
    partition and the rows come from the same partitioning even when tasks
    are run again.  The offsets are one row per partition.
    """
    bits = 33  # monotonically_increasing_id: partition above, row in it below
    rows = materialize(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", bits)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = rows.withColumn("__part", part).join(offsets, "__part")
    return joined.withColumn("row_number", F.col("__before") + F.col("__at").bitwiseAND((1 << bits) - 1)).drop("__part", "__before", "__at")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law
    moves rows when a shard is added), row_number."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("__hash"),
    )
    rows = number_rows(narrow, F.col("doc_id").asc_nulls_first(), "__hash", "size")
    n = docs.count()

    @F.pandas_udf("bigint")
    def permuted(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in numbers:
            yield pd.Series(permute(x.to_numpy(), n, seed))

    placed = rows.withColumn("__place", permuted("row_number"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("__place") % shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
