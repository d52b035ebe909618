"""Operator 12: spelling variants, by rolling hashes of words with one code point deleted.

Words are counted in tasks before they are shuffled. Of each word, prefix and suffix polynomial hashes give an integer for the word without its i-th code point, for all i at once in NumPy.
Two words differ by one replaced code point where they agree without it at the same place, and by one inserted where one of them is the other without a code point. The keys are parted by their first
bits and sorted; only keys at which words can meet fetch their words, and are then held against the strings, so a collision of hashes makes no pair. At one key and place there are at most as many words as the
alphabet has letters, and no pairs are made: each word takes from its group the size and the best two.

* near: exactly one inserted, deleted or replaced code point. form: the near word of largest n (ties: smallest in code-point order), if that n >= 2 n of the word. n doubles along a chain of forms, so
  chains are short; roots are found by pointer jumping, which takes the logarithm of the longest chain in rounds, each a stored table.

Nulls: a null text has no words; a null doc_id is written `null` in the damaging hash. Empty texts have no words. Very long texts are read whole; a very long word makes keys in number of its length, without copies of it.
Repeated rows count each. Empty table: no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import hashing
from millrace.llm.common import remove_stored, stored

LEAST_LENGTH, LEAST_N, DAMAGED = 5, 3, 97
RUN = re.compile("[a-zÀ-ÿ]{5,}")
#: Code points of distinct words that a task counts before it passes them on, and of words whose keys are made at once.
HELD, TOGETHER = 8_000_000, 1 << 20
#: The bits of a key that name its partition.
RADIX = 16

_LETTER = np.random.default_rng(1207).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def counted(docs: DataFrame) -> DataFrame:
    """word and n of each word that is long and frequent enough, after the damage to one run in DAMAGED or so."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                head = zlib.crc32(b"%s:" % ("null" if doc is None else str(doc)).encode())
                for run, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), head)
                    if h % DAMAGED == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    if run not in held:
                        size += len(run)
                    held[run] += n
                if size > HELD:
                    yield pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
                    held, size = Counter(), 0
        yield pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    parts = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, and for each the number of its word and the place deleted: every place of every word, and -1 for the whole word."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    starts = np.cumsum(lengths) - lengths
    bits = int(len(codes)).bit_length()
    up, down = hashing._powers(_BASE, bits), hashing._powers(_INVERSE, bits)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_LETTER[codes] * up[: len(codes)], out=sums[1:])
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes))
    first, end = sums[starts], sums[starts + lengths]
    prefix, suffix = sums[at] - first[word], end[word] - sums[at + 1]
    scale = down[starts]
    without = (prefix + suffix * np.uint64(_INVERSE)) * scale[word] + (lengths[word] - 1).astype(np.uint64)
    whole = (end - first) * scale + lengths.astype(np.uint64)
    return hashing.mix(np.concatenate([without, whole])), np.concatenate([word, np.arange(len(words))]), np.concatenate([at - starts[word], np.full(len(words), -1)])


def _keyed(words: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, _, _ in hashing.slices(batch.column("word"), TOGETHER):
                key, word, at = deletion_keys(batch.column("word")[row:to].to_pylist())
                yield pa.record_batch({"part": (key >> np.uint64(64 - RADIX)).astype(np.int32), "key": key.view(np.int64), "at": at.astype(np.int32), "id": batch.column("id").slice(row, to - row).take(pa.array(word))})

    return words.select("word", "id").mapInArrow(make, "part int, key long, at int, id long")


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a key ends; what is held back is one key's rows."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        keys = rows.column("key").to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys at which words can meet: two at one place, or a whole word and one without a code point."""
    for rows in _whole_keys(batches):
        key, at = rows.column("key").to_numpy(), rows.column("at").to_numpy()
        same = (key[1:] == key[:-1]) & (at[1:] == at[:-1]) & (at[1:] >= 0)
        pair = np.zeros(len(key), bool)
        pair[1:] |= same
        pair[:-1] |= same
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        whole = at[starts] == -1  # sorted by key and place, whole words first
        sizes = np.diff(np.append(starts, len(key)))
        wholes = np.add.reduceat((at == -1).astype(np.int64), starts)
        meets = np.repeat(whole & (sizes > wholes), sizes)
        yield from rows.select(["part", "key", "at", "id"]).filter(pa.array(pair | meets)).combine_chunks().to_batches()


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, near, most, form, form_id: what a word has from one group of words that agree without a code point."""
    for rows in _whole_keys(batches):
        out: list[tuple] = []
        groups: dict = defaultdict(dict)  # (key, place, string without it) -> words; place -1: the string whole, with the words that give it
        wholes: dict = {}
        for key, at, number, word, n in zip(*(rows.column(c).to_pylist() for c in ("key", "at", "id", "word", "n")), strict=True):
            one = (-n, word, number)
            if at < 0:
                wholes[key, word] = one
                continue
            rest = word[:at] + word[at + 1 :]
            groups[key, at, rest][word] = one
            if at == 0 or word[at - 1] != word[at]:  # of a run of one letter, the first stands for all
                groups[key, -1, rest][word] = one
        for (key, at, rest), members in groups.items():
            each = sorted(members.values())
            if at >= 0:
                if len(each) > 1:
                    out += [(o[2], len(each) - 1, *each[o is each[0]]) for o in each]
            elif (whole := wholes.get((key, rest))) is not None:
                out.append((whole[2], len(each), *each[0]))
                out += [(o[2], 1, *whole) for o in each]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=["id", "near", "most", "form", "form_id"])


def near(words: DataFrame) -> DataFrame:
    """id, n_near, and the best near word as best: (-n, form, form_id), of words (id, word, n) that have a near one."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_key = lambda df: df.repartitionById(parts, (F.col("part") * parts / (1 << RADIX)).cast("int")).sortWithinPartitions("key", "at")
    met = by_key(_keyed(words)).mapInArrow(_meeting, "part int, key long, at int, id long")
    rows = by_key(met.join(words, "id")).select("key", "at", "id", "word", "n")
    taken = rows.mapInArrow(_taken, "id long, near long, most long, form string, form_id long")
    return taken.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct("most", "form", "form_id")).alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """id, root_id, root of links (id, form_id, form): each to the end of its chain."""
    at = stored(links.select("id", F.col("form_id").alias("root_id"), F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("id").alias("root_id"), F.col("root_id").alias("to_id"), F.col("root").alias("to"))
        next_ = stored(at.join(further, "root_id", "left").select("id", F.coalesce("to_id", "root_id").alias("root_id"), F.coalesce("to", "root").alias("root"), F.col("to_id").isNotNull().alias("moved")), "spelling-roots")
        remove_stored(at)
        moved, at = next_.where("moved").limit(1).count(), next_
        if not moved:
            return at.drop("moved")


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word."""
    words = stored(counted(docs).withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    best = near(words)
    formed = F.col("best.most") <= -2 * F.col("n")
    rows = words.join(best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.most")).alias("form_n"), F.when(formed, F.col("best.form_id")).alias("form_id"))
    rows = stored(rows, "spelling-near")
    roots = _roots(rows.where("form_id is not null")).select("id", "root")
    return rows.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
