"""Sharding by a Feistel permutation over global row numbers: a reproducible shuffle with computable shard and slot."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix

SHARDS = 40
ROUNDS = 6
SEED = 20240101


class Permutation:
    """A keyed bijection of 0 .. n - 1: Feistel rounds on a slightly larger a * b grid, walked until the value is below n.

    The grid exceeds n by less than a + b cells, so a walk is rarely longer than one step.
    """

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        self.a = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**63 - 1)))

    def _step(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for i in reversed(range(len(self.keys))) if back else range(len(self.keys)):
            fixed, moved, size = (right, left, self.a) if i % 2 == 0 else (left, right, self.b)
            f = (mix(fixed.astype(np.uint64) ^ self.keys[i]) % np.uint64(size)).astype(np.int64)
            moved = (moved - f if back else moved + f) % size
            left, right = (moved, fixed) if i % 2 == 0 else (fixed, moved)
        return left * self.b + right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.int64)
        if len(x) and (x.min() < 0 or x.max() >= self.n):
            raise ValueError(f"row numbers must be from 0 to {self.n - 1}")
        x = self._step(x, back)
        while len(far := np.flatnonzero(x >= self.n)):
            x[far] = self._step(x[far], back)
        return x

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, False)

    def inverse(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, True)

    def locate(self, row: int, shards: int = SHARDS) -> tuple[int, int]:
        """Shard and slot of a row number."""
        place = int(self.forward(np.array([row]))[0])
        return place % shards, place // shards

    def row_at(self, shard: int, slot: int, shards: int = SHARDS) -> int:
        """The row number that stands in a slot of a shard."""
        return int(self.inverse(np.array([slot * shards + shard]))[0])


def number_rows(df: DataFrame, *order: Column | str) -> tuple[DataFrame, int]:
    """df sorted, with a gapless global row_number from 0, and the number of rows.

    Rows are range-partitioned and sorted in parallel, written once, and numbered by
    their place in their partition plus the counts of those before, which is a table
    of one row for each partition.
    """
    placed = materialize(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_place", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    rows = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return rows.withColumn("row_number", F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_place"), total


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number of each document.

    Law ``rows``: shards differ by one row at most.  The order that is permuted is by
    id, checksum and size, nulls first, so repeated rows are numbered side by side and
    the result depends on the rows alone, not on files or partitions.  A null text
    has size 16 and the checksum of an empty one.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    numbered, total = number_rows(rows, F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    moves = Permutation(total, seed)

    def permute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(moves.forward(x.to_numpy()))

    place = F.pandas_udf(permute, "long")  # type: ignore[call-overload]
    out = numbered.withColumn("_to", place("row_number"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_to") % shards).cast("int").alias("shard"), F.floor(F.col("_to") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
