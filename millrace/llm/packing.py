"""Operator 1: packing along a space-filling curve.

A document's words are hashed into a vector, which a fixed random matrix projects to three dimensions; the Hilbert key of that
point orders the documents, so that neighbours on the curve share words. Spark range-sorts by the key and each range fills
its sequences one after another, cutting documents where a sequence is full: only the last sequence of a range is padded. There are as many ranges as
RANGE_BYTES of text ask for, and as many as the session's shuffle has at least, so a task does not grow with the input.

Nulls: a null text is empty. Ties of the key, which may hold any share of the rows, equal rows among them, are dealt one by one over the ranges that share it, and in a range are ordered by a hash of doc_id and text, then by text. A text without words has
the key of the origin. Very long texts are cut into as many pieces as they fill. Empty table: no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import hashing
from millrace.llm.common import remove_stored, stored
from millrace.llm.tokens import TOGETHER, encoder

BUCKETS, DIMS, BITS = 512, 3, 10
#: Rows whose keys set the bounds of the ranges, about.
SAMPLE = 200_000
#: Bytes of text in a range, about.
RANGE_BYTES = 64 << 20


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys on the Hilbert curve of integer points (rows x dims) of so many bits, by Skilling's transposition (2004)."""
    x = [c.astype(np.int64) for c in points.T]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def keys(texts: pa.Array) -> np.ndarray:
    """The Hilbert key of each text."""
    matrix = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    out = []
    for _, _, data, offsets in hashing.slices(texts):
        h, begins = hashing.words(data, offsets)
        rows = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        tf = np.sqrt(np.bincount(rows * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=(len(begins) - 1) * BUCKETS).reshape(-1, BUCKETS))
        point = tf @ matrix / np.maximum(1e-9, np.linalg.norm(tf, axis=1, keepdims=True))
        out.append(hilbert(np.clip((np.tanh(point) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _keyed(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """doc_id, text, curve_key, tie and range: the number of the stretch of the curve between the bounds. A key that several bounds share is dealt over all their stretches."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, deal = keys(b.column("text")), b.column("deal").to_numpy()
            low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": b.column("text"), "tie": b.column("tie"), "curve_key": key, "range": (low + deal % (high - low + 1)).astype(np.int32)})

    deal = F.xxhash64(F.monotonically_increasing_id(), F.lit("deal"))  # the row's place in the table, so that equal rows part
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("tie"), deal.alias("deal")).mapInArrow(add, "doc_id long, text string, tie long, curve_key long, range int")


def _bounds(sample: DataFrame, size: int, ranges: int) -> list[int]:
    """The keys at which the sample's bytes are parted into so many equal shares; a key that holds several shares stands as often."""
    upto = F.sum("size").over(Window.orderBy("curve_key"))  # a row for each key of the sample
    keyed = sample.groupBy("curve_key").agg(F.sum(F.col("size") + 1).alias("size")).withColumn("upto", upto)
    total = keyed.agg(F.sum("size").alias("total"))
    share = lambda x: F.floor(x * ranges / F.col("total"))
    cut = keyed.join(total, how="cross").select("curve_key", share(F.col("upto") - F.col("size")).alias("low"), F.least(share(F.col("upto")), F.lit(ranges - 1)).alias("high")).where("high > low")  # one row
    return sorted(r[0] for r in cut.select(F.explode(F.expr("array_repeat(curve_key, cast(high - low as int))"))).collect())  # fewer than the ranges


def along_curve(docs: DataFrame) -> DataFrame:
    """The documents, range-sorted along the curve. A sample of about SAMPLE rows or fewer, drawn by the rows' places so that equal rows part, sets the number of ranges and their bounds, weighed by the texts' bytes; they steer the balance of tasks alone."""
    one_in = max(32, docs.count() // SAMPLE)
    drawn = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("sample")), F.lit(one_in)) == 0)
    sample = stored(_keyed(drawn, []).select("curve_key", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")), "curve-sample")
    size = sample.agg(F.sum("size")).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size * one_in // RANGE_BYTES))
    at = _bounds(sample, size, ranges) if size else None
    remove_stored(sample)
    return _keyed(docs, at or []).repartitionById(ranges, F.col("range")).sortWithinPartitions("curve_key", "tie", "text")


def pack(docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key, ids (binary, little-endian unsigned 16- or 32-bit).

    Sequence ids are unique, and ascend along the curve; offsets have no gap from 0.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at = encoder(vocabulary), 0
        first, end = TaskContext.get().partitionId() << 40, np.array([end_id], coder.dtype).tobytes()
        size = coder.dtype.itemsize
        for batch in batches:
            for row, to, _, _ in hashing.slices(batch.column("text"), TOGETHER):
                part = batch.slice(row, to - row)
                out: list[tuple] = []
                docs_ids, curve = part.column("doc_id").to_pylist(), part.column("curve_key").to_pylist()
                for doc, key, ids in zip(docs_ids, curve, coder.encode(part.column("text").to_pylist()), strict=True):
                    raw, n, start = ids.tobytes() + end, len(ids) + 1, 0
                    wide = np.frombuffer(raw, coder.dtype).astype("<u4").tobytes()
                    while start < n:
                        offset = at % length
                        take = min(n - start, length - offset)
                        out.append((doc, start, take, zlib.crc32(wide[4 * start : 4 * (start + take)]), n, first + at // length, offset, key, raw[size * start : size * (start + take)]))
                        start, at = start + take, at + take
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 8 + [pa.binary()], strict=True)], names=NAMES)

    return along_curve(docs).select("doc_id", "text", "curve_key").mapInArrow(fill, ", ".join(f"{n} long" for n in NAMES[:-1]) + ", ids binary")


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key", "ids"]
