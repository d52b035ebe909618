"""Operator 10: a linear-chain conditional random field that labels every line good or bad.

The field has two labels, features of a line and of its two neighbours, and a weight for each pair of labels that follow one another. It is
fitted on at most SAMPLE labelled documents of LINES lines together at most, each line with its document's label, by the gradient of the exact likelihood; a document's quality
is the mean of its lines' forward-backward marginals, weighted by their words. A logistic curve, fitted on the same rows, makes the score.

Nulls: a null text is empty. A text without words has no line and the score 0. A null label is no label. Repeated rows are scored alike; of rows of one doc_id with different
texts the least text is learned from. Very long texts are scored whole.
Empty table: no row. Labelled rows of one kind alone: every text with words scores as that kind, 1 or 0; without any, 1, as nothing speaks against a text. Other columns are kept (score() replaces a column score).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.llm import hashing
from millrace.llm.common import free_name, remove_stored, stored

#: Labelled documents to learn from at most; those with the least hashes of doc_id are taken.
SAMPLE = 6_000
#: Their lines at most; documents beyond, in the order of the hashes, are not learned from, nor are those with more than a tenth of it.
LINES = 300_000
#: In fitting, longer documents are parted into chains of so many lines.
CHAIN = 48

_CLASS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&<>", "bar": b"|", "bang": b"!?", "stop": b".,;:"}
_TABLES = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)).astype(np.uint8) for k, v in _CLASS.items()} | {"high": (np.arange(256) >= 192).astype(np.uint8)}
N_FEATURES = 13


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: its row, its features and its words."""
    rows, features, weights = [], [], []
    for first, _, data, offsets in hashing.slices(texts):
        if not len(data):
            continue
        breaks = np.flatnonzero(data == 10) + 1
        starts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)])))
        hashes, begins = hashing.words(data, np.append(starts, len(data)))
        n = np.diff(begins)
        count = {k: np.add.reduceat(t[data], starts, dtype=np.int64) for k, t in _TABLES.items()}
        line = np.repeat(np.arange(len(starts)), n)
        order = np.lexsort((hashes, line))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (line[order][1:] != line[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        distinct = np.bincount(line[order][fresh], minlength=len(starts))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes)))
        whole = total[begins[1:]] - total[begins[:-1]]
        row = np.searchsorted(offsets, starts, "right") - 1
        again = np.zeros(len(starts), bool)
        by = np.lexsort((np.arange(len(starts)), whole, row))
        again[by[1:]] = (row[by[1:]] == row[by[:-1]]) & (whole[by[1:]] == whole[by[:-1]])
        ends = np.append(starts[1:], len(data)) - 1
        ends = np.where((data[ends] == 10) & (ends > starts), ends - 1, ends)
        ink = sum(count.values())
        letters = np.maximum(1, count["upper"] + count["lower"] + count["high"])
        each = np.maximum(1, n)
        x = np.stack([
            np.log1p(n), np.minimum(20, ink / each), count["upper"] / letters, count["digit"] / np.maximum(1, ink), np.minimum(2, count["symbol"] / each), np.minimum(2, count["bar"] / each), np.minimum(2, count["bang"] / each),
            np.minimum(2, count["stop"] / each), data[ends] == 46, 1 - distinct / each, again, count["high"] / letters, _TABLES["upper"][data[starts]],
        ], axis=1)
        held = n > 0
        rows.append(row[held] + first)
        features.append(x[held])
        weights.append(n[held])
    if not rows:
        return np.empty(0, np.int64), np.empty((0, N_FEATURES)), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(features), np.concatenate(weights)


def with_neighbours(x: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it in its chain (0 at an end), and two marks of the ends."""
    same = chain[1:] == chain[:-1]
    first, last = np.append(True, ~same)[: len(x)], np.append(~same, True)[: len(x)]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1] * same[:, None] if len(x) else 0
    after[:-1] = x[1:] * same[:, None] if len(x) else 0
    return np.concatenate((x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))), axis=1)


def marginals(good: np.ndarray, step: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, the sum over neighbours of P(label, next label), and the log of the partition sums.

    good: the score of good over bad; step: scores (label, next label); chain: ascending numbers. All chains move on together.
    """
    if not len(good):
        return good, np.zeros((2, 2)), 0.0
    starts = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    sizes = np.diff(np.append(starts, len(chain)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # chains that have a line at each place
    ahead, behind = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    own = np.stack((np.zeros_like(good), good), axis=1)
    ahead[starts] = own[starts]
    for t, k in enumerate(active[1:].tolist(), 1):
        at = starts[:k] + t
        ahead[at] = np.logaddexp(ahead[at - 1, :1] + step[0], ahead[at - 1, 1:] + step[1]) + own[at]
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        later = own[at] + behind[at]
        behind[at - 1] = np.logaddexp(step[:, 0] + later[:, :1], step[:, 1] + later[:, 1:])
    log_z = np.logaddexp(*ahead[starts + sizes - 1].T)
    z = np.empty(len(starts))
    z[order] = log_z
    z = np.repeat(z, np.diff(np.append(np.sort(starts), len(chain))))
    p = np.exp(np.minimum(0, ahead[:, 1] + behind[:, 1] - z))
    inner = np.flatnonzero(np.append(chain[1:] == chain[:-1], False)) if len(chain) > 1 else np.empty(0, np.int64)
    pairs = np.exp(ahead[inner][:, :, None] + step + (own[inner + 1] + behind[inner + 1])[:, None, :] - z[inner][:, None, None])
    return p, pairs.sum(axis=0), float(log_z.sum())


@dataclass
class LineCrf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def line_marginals(self, x: np.ndarray, chain: np.ndarray) -> np.ndarray:
        return marginals(with_neighbours((x - self.mean) / self.scale, chain) @ self.weights, self.step, chain)[0]

    def quality(self, texts: pa.Array) -> np.ndarray:
        """The word-weighted mean of the marginals of each text; -1 without words."""
        rows, x, n = lines(texts)
        p = self.line_marginals(x, rows)
        words = np.bincount(rows, n, len(texts))
        return np.where(words > 0, np.bincount(rows, n * p, len(texts)) / np.maximum(1, words), -1)

    def score(self, texts: pa.Array) -> np.ndarray:
        q = self.quality(texts)
        return np.where(q < 0, 0.0, 1 / (1 + np.exp(-np.clip(self.slope * q + self.shift, -60, 60))))


def fit(x: np.ndarray, chain: np.ndarray, good: np.ndarray, words: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> LineCrf:
    """x, words: lines; chain: the document of each; good: its label, 0 or 1. Adam on the mean log-likelihood of a line."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    starts = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    part = np.arange(len(chain)) - np.repeat(starts, np.diff(np.append(starts, len(chain))))
    short = np.cumsum(np.append(0, (chain[1:] != chain[:-1]) | (part[1:] % CHAIN == 0)))
    z, y = with_neighbours((x - mean) / scale, chain), good.astype(float)
    inner = short[1:] == short[:-1]
    label = good.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][inner], label[1:][inner]), 1)
    theta, m, v = np.zeros(z.shape[1] + 4), 0.0, 0.0
    for k in range(1, rounds + 1):
        p, pairs, _ = marginals(z @ theta[:-4], theta[-4:].reshape(2, 2), short)
        g = np.concatenate((z.T @ (y - p), (seen - pairs).ravel())) / len(y) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = LineCrf(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    docs, at = np.unique(chain, return_inverse=True)
    p = model.line_marginals(x, chain)
    quality = np.bincount(at, words * p) / np.bincount(at, words)
    model.slope, model.shift = _logistic(quality, np.bincount(at, good) / np.bincount(at))
    return model


def _logistic(q: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method with a little ridge; the slope is positive."""
    a = np.stack((q, np.ones_like(q)), axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.05, 0.05])
        w = w + np.clip(np.linalg.solve(h, a.T @ (y - p) - 0.05 * w), -3, 3)
    return max(1e-3, float(w[0])), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = LINES) -> LineCrf:
    """Line features, not texts, of at most so many labelled documents and lines come to the driver."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("_good"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_good").alias("_good"))
    rows = stored(rows.withColumn("_lines", F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1), "labelled")
    # a row of two numbers for each document of the sample
    before = F.sum("_lines").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fit_on = rows.select("doc_id", "_lines").where(F.col("_lines") <= most_lines // 10).withColumn("_before", before).where(F.col("_before") <= most_lines).select("doc_id")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x, n = lines(b.column("text"))
            yield pa.record_batch({"doc_id": b.column("doc_id").take(pa.array(rows)), "good": b.column("_good").take(pa.array(rows)).cast(pa.int32()), "words": n.astype(np.int64), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))})

    got = rows.join(F.broadcast(fit_on), "doc_id").select("doc_id", "text", "_good").mapInArrow(of, "doc_id long, good int, words long, x array<double>").toPandas()
    remove_stored(rows)
    if not len(got) or got.good.nunique() < 2:
        return LineCrf(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(3 * N_FEATURES + 3), np.zeros((2, 2)), 0.0, 60.0 if not len(got) or got.good.iloc[0] else -60.0)
    got = got.sort_values("doc_id", kind="stable")
    return fit(np.array(got.x.tolist()), got.doc_id.to_numpy(), got.good.to_numpy(), got.words.to_numpy())


def score(docs: DataFrame, model: LineCrf, name: str = "score") -> DataFrame:
    """docs with the score in a column of that name, which replaces one of the table's own."""
    held = docs.drop(name)
    names = held.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(names.index("text"))))], names=[*b.schema.names, name])

    return held.mapInArrow(add, StructType([*held.schema.fields, StructField(name, DoubleType())]))


def kept(docs: DataFrame, model: LineCrf) -> DataFrame:
    """The documents that score as good, with their own columns alone."""
    name = free_name(docs, "score")
    return score(docs, model, name).where(F.col(name) >= GOOD).drop(name)


#: Least score of a document that is predicted to be good.
GOOD = 0.7
