"""Operator 8: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 by (bucket, doc_id, crc32 of the text, size), where bucket is a hash of all three; a generalised Feistel network
over Z_a x Z_b (Black and Rogaway 2002), walked along its cycle until it falls below n, permutes the numbers. The place of a row
then gives its shard (place mod shards) and its slot (place div shards): both can be computed from row number, n and seed alone.

Nulls: a null text has size 8 and crc32 0; null doc_ids are rows like others. Ties: equal rows are interchangeable. Very long texts count by their bytes alone. Empty table: no row.
Other columns are ignored, whatever their names. Law: rows (counts of any two shards are at most one apart).
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

PRIME = (1 << 31) - 1
#: Rows that one task numbers, about, and how many such buckets there are at most.
BUCKET_ROWS, BUCKETS = 4096, 1 << 16
#: Equal rows that one task writes one after another at most.
CHUNK = 100_000


class Feistel:
    """A permutation of 0..n-1. n: below 2**60."""

    def __init__(self, n: int, seed: int = 0, rounds: int = 6):
        self.n = n
        self.a = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        if max(self.a, self.b) >= PRIME:
            raise ValueError("too many rows for this network")
        draw = random.Random(seed)
        self.keys = [tuple(draw.randrange(1, PRIME) for _ in range(3)) for _ in range(rounds)]
        self.walks = self._walks()

    def once(self, x):
        """One pass of the network over numbers (an array or an integer) below a * b."""
        left, right = x // self.b, x % self.b
        for k, (m, c, d) in enumerate(self.keys):
            value = (left if k % 2 else right) % PRIME
            value = (value * m + c) % PRIME
            value = (value * value + d) % PRIME
            left, right = (left, (right + value) % self.b) if k % 2 else ((left + value) % self.a, right)
        return left * self.b + right

    def _walks(self) -> int:
        """The most passes that any number below n needs after its first. Only the numbers from n to a * b, at most about sqrt(n), walk on."""
        beyond, most = np.arange(self.n, self.a * self.b if self.n else 0, dtype=np.int64), 0
        outside = np.setdiff1d(beyond, self.once(beyond))  # reached from a number below n; the others are walked through, or lie on cycles of their own
        while len(outside):
            outside, most = self.once(outside), most + 1
            outside = outside[outside >= self.n]
        return most

    def _pass(self, df: DataFrame, x: str) -> DataFrame:
        """df with columns _l and _r, the halves of one pass over column x."""
        df = df.withColumns({"_l": F.expr(f"{x} div {self.b}"), "_r": F.col(x) % self.b})
        for k, (m, c, d) in enumerate(self.keys):
            side, size = ("_r", self.b) if k % 2 else ("_l", self.a)
            other = "_l" if k % 2 else "_r"
            df = df.withColumn("_v", (F.col(other) * F.lit(m).cast("long") + c) % PRIME)
            df = df.withColumn(side, (F.col(side) + (F.col("_v") * F.col("_v") + d) % PRIME) % size)
        return df

    def apply(self, df: DataFrame, number: str, out: str) -> DataFrame:
        """df with a column out: the permuted place of the row number."""
        joined = (F.col("_l") * F.lit(self.b).cast("long") + F.col("_r")).cast("long")
        df = self._pass(df, number).withColumn(out, joined)
        for _ in range(self.walks):
            df = self._pass(df, out).withColumn(out, F.when(F.col(out) < self.n, F.col(out)).otherwise(joined))
        return df.drop("_l", "_r", "_v")


def number_rows(df: DataFrame, by: list[str], out: str = "row_number") -> tuple[DataFrame, int]:
    """The columns `by` of df with gapless row numbers from 0, and how many rows there are. The order is that of a hash bucket, then of the columns.

    Equal rows are counted before they are numbered, and a large number of them is dealt over all tasks again, so it may be any share of the rows.
    """
    groups = stored(df.groupBy(*by).agg(F.count("*").alias("_c")).withColumn("_h", F.xxhash64(*by)), "rows")
    seen = groups.agg(F.count("*"), F.coalesce(F.sum("_c"), F.lit(0))).first()
    bucket = F.pmod("_h", F.lit(max(1, min(BUCKETS, -(-seen[0] // BUCKET_ROWS)))))
    groups = groups.withColumn("_bucket", bucket)
    # at most BUCKETS rows: small enough for one task and a broadcast
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.groupBy("_bucket").agg(F.sum("_c").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    within = F.coalesce(F.sum("_c").over(Window.partitionBy("_bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = groups.withColumn("_k", within).join(F.broadcast(firsts), "_bucket").withColumn("_at", F.col("_first") + F.col("_k"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_c - 1) div {CHUNK}")))
    few, many = placed.where(F.col("_c") <= CHUNK).withColumn("_part", F.lit(0).cast("long")), placed.where(F.col("_c") > CHUNK).withColumn("_part", part).repartition("_at", "_part")
    each = F.explode(F.sequence(F.col("_part") * CHUNK, F.least(F.col("_c"), (F.col("_part") + 1) * CHUNK) - 1))
    numbered = few.unionByName(many).select(*by, "_at", each.alias("_i"))
    return numbered.select(*by, (F.col("_at") + F.col("_i")).cast("long").alias(out)), seen[1]


def digest(text: Column) -> dict[str, Column]:
    plain = F.coalesce(text, F.lit("")).cast("binary")
    return {"size": (F.octet_length(plain) + 8).cast("long"), "text_crc32": F.crc32(plain)}


def shard(docs: DataFrame, shards: int = 24, seed: int = 2024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law has no stable growth) of each row."""
    rows, n = number_rows(docs.select("doc_id", *(c.alias(k) for k, c in digest(F.col("text")).items())), ["doc_id", "text_crc32", "size"])
    placed = Feistel(n, seed).apply(rows, "row_number", "place")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
