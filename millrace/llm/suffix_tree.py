"""Operator 11: a probabilistic suffix tree over words, learned and applied in blocks.

The documents are cut into blocks of about BLOCK tokens. A block is one row: the hashes of its words, its tokens as numbers of them, and what it has learned so far about each
token. In each round a block asks for the sums, over all blocks, of the values of its own distinct keys: counts of longer and longer grams, and divergences of contexts. Keys are
parted by their first bits, so a common word or context is one entry a block, and no bucket holds more than its share of all keys. Answers come back in the order of the keys.

* Level 0: P0(x) = (c + 0.1) / (N + 0.1 (V + 1)), as the base score. A longer state: P(x | context) = (n(context, x) + (T + STRENGTH) P(x | next shorter state)) / (n(context) + T + STRENGTH),
  where T is the number of different tokens that follow the context in training.
* A context of up to DEPTH words that occurs at least SUPPORT times in training is retained where its divergence is at least GAIN nats: the sum over its training tokens of
  ln(P(x | context) / P(x | next shorter state)) with the token itself left out of all counts. Of a token seen again after the context, the share that comes from the shorter state is left away, so the sum
  is never overstated, and follows from three sums that blocks can add up: of ln((n(context, x) - 1) / P(x | shorter)) over repeated ones, of tokens seen once, and of 1 / n(context, x), which is T.
* Each token is scored by the longest context before it that is retained. Contexts do not cross the bounds of documents.

Words are compared by 63 bits of a hash, longer grams by 56. Nulls: a null text is empty (its end token alone); a null doc_id counts as an empty text in the choice of held-out rows, and is so held out. Repeated rows each
count and are scored alike. A very long text makes a block of its own. Empty table: no row. Other columns are ignored, whatever their names. No training rows: N and V are 0, and nothing is known.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import hashing
from millrace.llm.common import remove_stored, stored

DEPTH, SUPPORT, GAIN, STRENGTH = 2, 4, 6.0, 4.0
#: Of ten residues of crc32(doc_id), the one that is held out.
FOLDS, HELD = 10, 0
#: Tokens of a block, and keys of a bucket, about.
BLOCK, BUCKET = 600_000, 500_000
#: Parts of the blocks that meet their answers one after another, so that only a part is on its way at a time.
PARTS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.random.default_rng(611).integers(0, 1 << 64, DEPTH + 2, dtype=np.uint64) | np.uint64(1)
_END = np.uint64(0x5BD1E9955BD1E995)
_ODD = np.uint64(1)

#: Bits of a key that stay: of a word or a context, whose last bit is 1, and of a gram.
_WORD, _GRAM = ~np.uint64(1), ~np.uint64(255)

BLOCKS = "block long, ids array<long>, ends array<long>, held array<boolean>, vocab binary, tokens binary, known binary, counts array<binary>, spread array<binary>"
ASKS = "bucket int, block long, keys binary, counts binary, stats binary"
ANSWERS = "bucket int, block long, words long, values binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers or of rows of them, all first bytes first: where high bytes are alike, Spark's own compression takes them out."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def _numbers(raw: bytes, kind: str, wide: int = 1) -> np.ndarray:
    """The numbers of _planes(), of rows of so many one after another."""
    size = np.dtype(kind).itemsize * wide
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the place of each key among them: a sort of the keys' first bits with the row in the last ones, which is quick; where first bits do not tell keys apart, NumPy's own way."""
    low = np.uint64((1 << max(1, len(keys) - 1).bit_length()) - 1)
    sorted_ = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    order = (sorted_ & low).astype(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        return np.unique(keys, return_inverse=True)
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(_planes(x), "zstd", asbytes=True) if len(x) else b""


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return _numbers(pa.decompress(raw, 4 * n, "zstd", asbytes=True), "<u4") if n else np.empty(0, "<u4")


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def _added(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by place."""
    return np.stack([np.bincount(place, v, n) for v in values.T], 1)


class Block:
    """Some documents' tokens, and what is known of them. Position i of `tokens` has `back[i]` tokens of its document before it."""

    def __init__(self, row: dict):
        self.row = row
        self.ends = np.array(row["ends"], np.int64)
        self.vocab, self.tokens = _numbers(row["vocab"], "<u8"), _unpacked(row["tokens"], int(self.ends[-1]))
        self.begins = np.concatenate(([0], self.ends[:-1]))
        lengths = self.ends - self.begins
        self.back = np.arange(len(self.tokens)) - np.repeat(self.begins, lengths)
        self.train = np.repeat(~np.array(row["held"], bool), lengths)
        self.known = _numbers(row["known"], "<u8").astype(np.float64)
        self.counts = [_unpacked(c, len(self.tokens)).astype(np.float64) for c in row["counts"]]
        self.spread = [_unpacked(t, len(self.tokens)).astype(np.float64) for t in row["spread"]]  # T of the context before each token; 0: not retained

    def grams(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the n tokens that end at the positions."""
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            out += self.vocab[self.tokens[at - k]] * _MIX[k]
        return hashing.mix(out)

    def occurrences(self, k: int) -> np.ndarray:
        """How often the k tokens before each position occur in training; 0 where there are fewer, or where a shorter one was too rare to ask."""
        before = self.known[self.tokens] if k == 1 else self.counts[k - 2]
        return np.where(self.back >= k, np.concatenate(([0.0], before[:-1])), 0.0)

    def probabilities(self, total: float, words: float, depth: int, out: float = 0.0) -> np.ndarray:
        """Of each token after the longest retained context of at most depth words. out = 1: counts without the token itself."""
        p = (self.known[self.tokens] - out + 0.1) / (total - out + 0.1 * (words + 1))
        for k in range(1, depth + 1):
            p = np.where(self.spread[k - 1] > 0, self.level(k, p, out), p)
        return p

    def level(self, k: int, p: np.ndarray, out: float = 0.0) -> np.ndarray:
        weight = self.spread[k - 1] + STRENGTH
        return (self.counts[k - 1] - out + weight * p) / (np.maximum(self.occurrences(k) - out, 0.0) + weight)

    def asked(self, step: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Distinct keys of a round in ascending order, and for each part of the question its positions and the places of their keys.

        Round 0 asks for words and pairs; round k for contexts of k words and for grams of k + 2 tokens, but in the last one.
        """
        keys, at = [], []
        if step == 0:
            here = np.arange(len(self.vocab))
            keys.append(self.vocab & _WORD | _ODD)
        else:
            here = np.flatnonzero(self.occurrences(step) >= SUPPORT)
            keys.append(self.grams(step, here - 1) & _GRAM | _ODD)
        at.append(here)
        if step < DEPTH:
            enough = self.back >= step + 1
            if step:  # a gram is as rare as its rarest part
                enough &= (self.occurrences(step + 1) >= SUPPORT) & (self.counts[step - 1] > 0)
            here = np.flatnonzero(enough)
            keys.append(self.grams(step + 2, here) & _GRAM)
            at.append(here)
        own, place = _distinct(np.concatenate(keys))
        return own, list(zip(at, np.split(place, np.cumsum([len(k) for k in keys])[:-1]), strict=True))

    def told(self, step: int, total: float, words: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of a round, their counts in this block's training rows, and three more sums of each context."""
        own, parts = self.asked(step)
        (here, place), *more = parts
        contexts = (own & _ODD) == 1
        counts = np.bincount(place, np.bincount(self.tokens[self.train], minlength=len(self.vocab)) if step == 0 else self.train[here], len(own))
        for at, gram in more:
            counts += np.bincount(gram, self.train[at], len(own))
        stats = _added((np.cumsum(contexts) - 1)[place], self.divergence(step, here, total, words), int(contexts.sum())) if step else np.empty((0, 3))
        return own, counts.astype("<u8"), stats.astype("<f4")

    def divergence(self, k: int, here: np.ndarray, total: float, words: float) -> np.ndarray:
        """What each position adds to the three sums of the k words before it; nothing where it is held out."""
        n, own = self.counts[k - 1][here], self.train[here]
        seen, again = np.where(own, n, 1.0), own & (n > 1)
        shorter = self.probabilities(total, words, k - 1, 1.0)[here]
        gain = np.log(np.where(again, (seen - 1) / np.where(again, shorter, 1.0), 1.0))
        return np.stack([gain, own & (n == 1), own / seen], 1)

    def learn(self, step: int, answers: np.ndarray) -> None:
        """Takes in the values of a round's keys: counts, and T of contexts, 0 where one is not retained."""
        (at, place), *more = self.asked(step)[1]
        if step == 0:
            self.row["known"] = _planes(answers[place])
            self.known = answers[place].astype(np.float64)
        else:
            self._add("spread", at, answers[place])
        for at, place in more:
            self._add("counts", at, answers[place])

    def _add(self, name: str, at: np.ndarray, values: np.ndarray) -> None:
        own = np.zeros(len(self.tokens), "<u4")
        own[at] = np.minimum(values, (1 << 32) - 1)
        self.row[name].append(_packed(own))
        getattr(self, name).append(own.astype(np.float64))

    def scores(self, total: float, words: float) -> pa.Table:
        each = lambda x: np.add.reduceat(x, self.begins)
        columns = [
            pa.array(self.row["ids"], pa.int64()), pa.array(self.row["held"], pa.bool_()), self.ends - self.begins, each((self.known > 0)[self.tokens].astype(np.int64)), np.full(len(self.ends), int(total)),
            each(np.log10(self.probabilities(total, words, 0))), each(np.log10(self.probabilities(total, words, DEPTH))),
        ]
        return pa.table(dict(zip([c.split()[0] for c in SCORES.split(", ")], columns, strict=True)))


def retained(n: np.ndarray, gain: np.ndarray, once: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """T of contexts whose divergence is at least GAIN, 0 of others; from a context's occurrences and the three sums."""
    left = np.maximum(spread - 1, 0.0) + STRENGTH
    rest = np.maximum(n - 1, 0.0)
    return np.where(gain - (n - once) * np.log(rest + spread + STRENGTH) + once * np.log(left / (rest + left)) >= GAIN, np.maximum(np.rint(spread), 1), 0)


def _block(number: int, ids: list, held: list[bool], words: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([len(w) + 1 for w in words])
    every = np.insert(np.concatenate(words), ends - np.arange(1, len(ends) + 1), _END)
    vocab, tokens = _distinct(every)
    order = np.argsort(-np.bincount(tokens), kind="stable")  # common words have small numbers
    place = np.empty(len(order), "<u4")
    place[order] = np.arange(len(order))
    row = {"block": number, "ids": ids, "ends": ends.tolist(), "held": held, "vocab": _planes(vocab[order]), "tokens": _packed(place[tokens].astype("<u4")), "known": b"", "counts": [], "spread": []}
    return _rows([row])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], k) for c, k in zip(BLOCKS.split(", "), kinds, strict=True)]))


def blocks(docs: DataFrame) -> DataFrame:
    """The documents in blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, own, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for row, to, data, offsets in hashing.slices(batch.column("text")):
                h, begins = hashing.words(_LOWER[data], offsets)
                for doc, a, b in zip(batch.column("doc_id")[row:to].to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    ids.append(doc)
                    held.append(held_out(doc))
                    own.append(h[a:b])
                    size += b - a + 1
                    if size >= BLOCK:
                        yield _block(number, ids, held, own)
                        number, ids, held, own, size = number + 1, [], [], [], 0
        if ids:
            yield _block(number, ids, held, own)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(cut, BLOCKS)


def _answers(held: DataFrame, step: int, total: float, words: float, bits: int) -> DataFrame:
    """The values of all keys that the blocks ask for, for each bucket and block."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts, stats = Block(row).told(step, total, words)
                cuts = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else 0, len(keys))
                contexts = np.concatenate(([0], np.cumsum((keys & _ODD).astype(np.int64))))
                parts = [(b, s, e) for b, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > s]
                for start in range(0, len(parts), 64):
                    some = parts[start : start + 64]
                    yield pa.record_batch({
                        "bucket": pa.array([b for b, _, _ in some], pa.int32()), "block": pa.array([row["block"]] * len(some), pa.int64()),
                        "keys": pa.array([_planes(np.diff(keys[s:e], prepend=np.uint64(0))) for _, s, e in some], pa.binary()), "counts": pa.array([_planes(counts[s:e]) for _, s, e in some], pa.binary()),
                        "stats": pa.array([_planes(stats[contexts[s] : contexts[e]]) for _, s, e in some], pa.binary()),
                    })

    def answer(asks: pa.Table) -> pa.Table:
        asks = asks.sort_by("block")  # sums of fractions in one order
        keys = [np.cumsum(_numbers(k, "<u8"), dtype=np.uint64) for k in asks.column("keys").to_pylist()]
        every = np.concatenate(keys)
        own, place = _distinct(every)
        values = np.bincount(place, np.concatenate([_numbers(c, "<u8") for c in asks.column("counts").to_pylist()]), len(own))
        contexts = (own & _ODD) == 1
        n = int((contexts & (values > 0)).sum())
        if step:
            of = (np.cumsum(contexts) - 1)[place[(every & _ODD) == 1]]
            stats = np.concatenate([_numbers(s, "<f4", 3).reshape(-1, 3) for s in asks.column("stats").to_pylist()]).astype(np.float64)
            values[contexts] = retained(values[contexts], *_added(of, stats, int(contexts.sum())).T)
        packed = [_planes(values[p].astype("<u8")) for p in np.split(place, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({"bucket": asks.column("bucket"), "block": asks.column("block"), "words": pa.array([n] * len(keys), pa.int64()), "values": pa.array(packed, pa.binary())})

    return stored(held.mapInArrow(ask, ASKS).groupBy("bucket").applyInArrow(answer, ANSWERS), f"suffix-answers-{step}")


def _learner(step: int, total: float, words: float):
    def learn(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows.to_pylist()[0])
        values = [_numbers(v, "<u8") for v in answers.sort_by("bucket").column("values").to_pylist()]
        block.learn(step, np.concatenate([*values, np.empty(0, "<u8")]))
        return block.scores(total, words) if step == DEPTH else pa.Table.from_batches([_rows([block.row])])

    return learn


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text."""
    held = stored(blocks(docs), "suffix-blocks")
    sizes = held.select(F.explode(F.arrays_zip("ends", F.concat(F.array(F.lit(0).cast("long")), "ends").alias("begins"), "held"))).select((F.col("col.ends") - F.col("col.begins")).alias("n"), "col.held")
    every, total = sizes.agg(F.sum("n"), F.sum(F.when(~F.col("held"), F.col("n")))).first()
    total, words, bits = float(total or 0), 0.0, max(0, int(2 * (every or 0) // BUCKET)).bit_length()
    part = F.pmod(F.hash("block"), F.lit(PARTS))
    parts = [held.where(part == k) for k in range(PARTS)]
    for step in range(DEPTH + 1):
        answers = _answers(functools.reduce(DataFrame.unionByName, parts), step, total, words, bits)
        if step == 0:
            words = float(answers.groupBy("bucket").agg(F.max("words").alias("n")).agg(F.sum("n")).first()[0] or 0)
        learner = _learner(step, total, words)
        met = [own.groupBy("block").cogroup(answers.where(part == k).groupBy("block")) for k, own in enumerate(parts)]
        if step == DEPTH:
            return functools.reduce(DataFrame.unionByName, [m.applyInArrow(learner, SCORES) for m in met])
        for k, m in enumerate(met):
            before, parts[k] = parts[k], stored(m.applyInArrow(learner, BLOCKS), "suffix-blocks")
            if step:
                remove_stored(before)
        remove_stored(answers, *[held] * (not step))
