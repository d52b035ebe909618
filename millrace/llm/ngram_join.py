"""Operator 9: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by a forest of MinHash prefix tries.

1. Rows with equal shingle sets are one class (a fingerprint of 128 bits); its least doc_id stands for it.
2. A class has a label in each of TREES tries: the minima of its set under DEPTH random orders, a few bits of each. All labels are range-sorted by (tree, label), so
   each trie lies in the order of its leaves, and a label's longest prefix with company is the longer of those that it shares with its two neighbours.
   Labels without company at the shortest prefix that may be needed go.
3. Two sets of similarity s share the first p levels of some trie with probability 1 - (1 - s^p)^TREES. The first round takes the whole labels: classes below one leaf are
   candidates. Then the least similarity of the pairs found tells how far prefixes must be shortened until pairs like it meet with the target recall; the next round takes
   the pairs that meet at this level and met at none before, and so on until a round finds no pair that asks for a shorter prefix. Where nothing is found, the threshold takes the place of the least similarity.
4. Nodes are parted into blocks by a hash, and each pair of blocks is a cell of bounded size. A cell first tells by labels alone which of its classes have a pair that meets here first;
   the sets of these come to it, and it computes the exact similarities. It returns links per class and a root, so rows grow with the classes and not with their pairs.
5. Roots are joined to connected components.

Nulls: a null text is empty; a row with a null doc_id is compared with nothing (class_id null, n_links 0). A text of one to four words has one shingle, all its words;
a text without words is its own class without links. Very long texts are hashed whole, each alone, and weigh in the size of a block by their shingles. Ties: the least doc_id. Rows of one
doc_id are one vertex. Empty table: no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import hashing
from millrace.llm.common import remove_stored, stored
from millrace.llm.components import components

THRESHOLD, TREES, DEPTH, RECALL = 0.8, 24, 10, 0.999
#: Classes and shingles in a block, about.
BLOCK, BLOCK_SHINGLES = 192, 150_000
#: Bits of the shortest prefix at least, so that unlike sets seldom share one by chance.
PREFIX_BITS = 48
#: Similarities are rounded down to this step before they set the level.
BAND = 0.01


def prefix_depth(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, from depth down to 1, at which pairs of that similarity meet with the wanted probability."""
    return next((p for p in range(depth, 0, -1) if 1 - (1 - similarity**p) ** trees >= recall), 1)


def level_bytes(floor: int) -> int:
    """Bytes of a level, where prefixes are never shorter than floor levels."""
    return -(-PREFIX_BITS // (8 * floor))


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, the sorted distinct shingles of some rows one after another, and where each row's begin (rows + 1)."""
    for first, _, data, offsets in hashing.slices(texts):
        made, at = hashing.shingles(*hashing.words(data, offsets))
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((made, row))
        made, row = made[order], row[order]
        fresh = np.ones(len(made), bool)
        fresh[1:] = (made[1:] != made[:-1]) | (row[1:] != row[:-1])
        made, row = made[fresh], row[fresh]
        yield first, made, np.searchsorted(row, np.arange(len(at)))


def fingerprints(made: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashing.mix(made ^ np.uint64(0x5851F42D4C957F2D)))))
    twos = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashing.mix(made * np.uint64(0xD6E8FEB86659FD93)))))
    return (sums[at[1:]] - sums[at[:-1]]).view(np.int64), (twos[at[1:]] - twos[at[:-1]]).view(np.int64)


def labels(made: np.ndarray, at: np.ndarray, trees: int, depth: int, width: int) -> np.ndarray:
    """The labels of each non-empty set, one after another: sets x (trees * depth * width) bytes."""
    rng = np.random.default_rng(97)
    flips, factors = rng.integers(0, 1 << 32, (trees, depth), dtype=np.uint32), rng.integers(0, 1 << 32, (trees, depth), dtype=np.uint32) | np.uint32(1)
    short, out = (made >> np.uint64(32)).astype(np.uint32), np.empty((len(at) - 1, trees, depth, width), np.uint8)
    for t in range(trees):
        for d in range(depth):
            least = np.minimum.reduceat((short ^ flips[t, d]) * factors[t, d], at[:-1])
            out[:, t, d] = hashing.mix(least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8).reshape(-1, 8)[:, :width]
    return out.reshape(len(at) - 1, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    """Equally long rows of bytes as an Arrow column."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _bytes(column: pa.Array, size: int) -> np.ndarray:
    """A column of byte strings of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def signatures(docs: DataFrame, trees: int, depth: int, width: int) -> DataFrame:
    """doc_id, n (distinct shingles), a, b (fingerprint) and labels of each row with a doc_id and a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, made, at in shingle_sets(batch.column("text")):
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                bounds = np.append(at[:-1][full], len(made))
                a, b = fingerprints(made, bounds)
                found = _binary(labels(made, bounds, trees, depth, width))
                yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(full + first)), "n": np.diff(bounds).astype(np.int64), "a": a, "b": b, "labels": found})

    return docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(sign, "doc_id long, n long, a long, b long, labels binary")


def tries(classes: DataFrame, trees: int, depth: int, width: int, floor: int) -> DataFrame:
    """tree, label, rep and shared of the labels in the order of their tries: shared is the longest prefix that another label of the tree has too, floor or more. The first
    and last labels of a task may have company in the next task and count as if they had."""
    size = depth * width

    def company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, depth

        def told(rows: pa.RecordBatch, shared: np.ndarray) -> pa.RecordBatch:
            kept = np.flatnonzero(shared >= floor)
            return pa.record_batch([*rows.take(pa.array(kept)).columns, pa.array(shared[kept].astype(np.int32))], names=["tree", "label", "rep", "shared"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            label, tree = _bytes(rows.column("label"), size).reshape(-1, depth, width), rows.column("tree").to_numpy()
            same = (label[1:] == label[:-1]).all(axis=2) & (tree[1:] == tree[:-1])[:, None]
            after = np.cumprod(same, axis=1).sum(axis=1)
            yield told(rows.slice(0, rows.num_rows - 1), np.maximum(np.append(before, after)[:-1], after))
            held, before = rows.slice(rows.num_rows - 1), int(after[-1]) if len(after) else before
        if held is not None:
            yield told(held, np.array([depth]))

    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("labels", t * size + 1, F.lit(size)))
    rows = classes.select(F.posexplode(each).alias("tree", "label"), "rep")
    ordered = rows.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")
    return ordered.mapInArrow(company, "tree int, label binary, rep long, shared int")


def sets(docs: DataFrame, classes: DataFrame, company: DataFrame) -> DataFrame:
    """rep, n, w, labels and shingles (sorted, 64 bits each) of the classes with company in some trie. Texts of others go before texts are shuffled, as long as Spark broadcasts the
    ids by their measured size; beyond, they go in the shuffle by rep that the join needs anyway."""
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(company, "rep", "left_semi").join(classes.join(company, "rep", "left_semi"), "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, made, at in shingle_sets(batch.column("text")):
                a, b = fingerprints(made, at)
                rows = batch.slice(first, len(a))
                own = np.flatnonzero((a == rows.column("a").to_numpy()) & (b == rows.column("b").to_numpy()))  # else: another row of the same doc_id
                shingles = pa.array([made[at[k] : at[k + 1]].tobytes() for k in own.tolist()], pa.binary())
                yield pa.record_batch([*rows.take(pa.array(own)).select(["rep", "n", "w", "labels"]).columns, shingles], names=["rep", "n", "w", "labels", "shingles"])

    return rows.select("rep", "n", "w", "labels", "a", "b", "text").mapInArrow(cut, "rep long, n long, w long, labels binary, shingles binary")


CELL = ["node", "p", "q"]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after another, each class once; cells stand together."""
    held: list[pa.RecordBatch] = []

    def one() -> pa.Table:
        cell = pa.Table.from_batches([b.cast(held[0].schema) for b in held]).combine_chunks()
        _, first = np.unique(cell.column("rep").to_numpy(), return_index=True)
        return cell.take(pa.array(first))

    for batch in batches:
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in CELL])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                if held and any(held[0].column(c)[0].as_py() != part.column(c)[0].as_py() for c in CELL):
                    yield one()
                    held = []
                held.append(part)
    if held:
        yield one()


def _wanted(cell: pa.Table, trees: int, depth: int, width: int, level: int, above: int) -> np.ndarray:
    """Which pairs of a cell (above the diagonal) are to be judged there: those that share no prefix of `above` levels in any tree, and one of `level` levels in this tree as the first."""
    own = _bytes(cell.column("labels"), trees * depth * width).reshape(-1, trees, depth * width)

    def alike(t: int, levels: int) -> np.ndarray:
        names = np.ascontiguousarray(own[:, t, : levels * width]).view(np.dtype((np.void, levels * width))).ravel()
        number = np.unique(names, return_inverse=True)[1]
        return number[:, None] == number[None, :]

    tree = cell.column("tree")[0].as_py()
    wanted = np.triu(alike(tree, level), 1)
    block = cell.column("block").to_numpy()
    if (block != block[0]).any():
        wanted &= block[:, None] != block[None, :]
    for t in range(trees):
        if not wanted.any():
            break
        if above <= depth:
            wanted &= ~alike(t, above)
        if t < tree:
            wanted &= ~alike(t, level)
    return wanted


def _similar(own: list[np.ndarray], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """The similarities of the wanted pairs (a boolean matrix above its diagonal) that reach the threshold; 0 elsewhere."""
    sizes = np.array([len(s) for s in own])
    wanted = wanted & (np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-9)
    left, right = np.nonzero(wanted)
    out = np.zeros(wanted.shape)
    if len(left) <= 2 * len(own):
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            found = np.searchsorted(own[j], own[i])
            common = np.count_nonzero(own[j][np.minimum(found, len(own[j]) - 1)] == own[i])
            union = sizes[i] + sizes[j] - common
            out[i, j] = common / union if common >= threshold * union - 1e-9 else 0
        return out
    used = np.union1d(left, right)
    _, column, times = np.unique(np.concatenate([own[k] for k in used]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), sizes[used])
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common, width = np.zeros((len(used), len(used)), np.float64), 8192
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        m = np.zeros((len(used), width), np.float32)
        m[row[a:b], column[a:b] - start] = 1
        common += m @ m.T
    union = np.add.outer(sizes[used], sizes[used]) - common
    out[np.ix_(used, used)] = np.where(common >= threshold * union - 1e-9, common / union, 0)
    return np.where(wanted, out, 0)


def _linked(cell: pa.Table, similar: np.ndarray) -> pa.RecordBatch | None:
    """rep, root, links (weight of its partners) and least similarity of each class with a link in this cell."""
    similar = np.maximum(similar, similar.T)
    linked = similar > 0
    kept = np.flatnonzero(linked.any(axis=1))
    if not len(kept):
        return None
    linked, similar = linked[np.ix_(kept, kept)], similar[np.ix_(kept, kept)]
    rep, root = cell.column("rep").to_numpy()[kept], cell.column("rep").to_numpy()[kept]
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            break
        root = new
    weight = linked @ cell.column("w").to_numpy()[kept]
    return pa.record_batch([pa.array(rep), pa.array(root), pa.array(weight.astype(np.int64)), pa.array(np.where(linked, similar, 2).min(axis=1))], names=["rep", "root", "links", "least"])


def links(found: DataFrame, own: DataFrame, threshold: float, trees: int, depth: int, width: int, level: int, above: int) -> DataFrame:
    """rep, root, links and least of each class in each cell of the nodes at that level, of the pairs that share no prefix of `above` levels anywhere."""
    at = lambda p: F.substring("label", F.lit(1), F.lit(p * width))
    rows = found.where(F.col("shared") >= level).select("rep", "tree", F.xxhash64("tree", at(level)).alias("node"), at(min(above, depth)).alias("child"))
    sized = rows.join(own.select("rep", "n"), "rep")
    met = sized.groupBy("node").agg(F.min("tree").alias("tree"), F.count("*").alias("m"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("lead"), F.min("child").alias("one"), F.max("child").alias("other")).where("m > 1")
    if above <= depth:  # a node with one child has no pair that meets here first
        met = met.where("one <> other")
    # nodes of several tries with the same members count once, in the first trie
    kept = met.groupBy("m", "x", "lead").agg(F.min(F.struct("tree", "node", "total")).alias("k"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("k.total") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    kept = kept.select("k.tree", "k.node", parts.alias("parts"))
    dealt = stored(rows.select("rep", "node").join(kept, "node").withColumn("block", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("parts")).cast("int")), "blocks")
    # a node's rows are dealt over all tasks before they are repeated for each other block
    many = dealt.where("parts > 1").repartition("rep", "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.where("parts = 1").withColumn("other", F.lit(0)).unionByName(many).select("rep", "node", "tree", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            wanted = _wanted(cell, trees, depth, width, level, above)
            yield from cell.select(["rep", "node", "tree", "block", "p", "q"]).filter(pa.array((wanted | wanted.T).any(axis=1))).to_batches()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            wanted = _wanted(cell, trees, depth, width, level, above)
            shingles = [np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist()]
            out = _linked(cell, _similar(shingles, wanted, threshold))
            if out is not None:
                yield out

    together = lambda df: df.repartition(*CELL).sortWithinPartitions(*CELL)
    asked = together(cells.join(own.select("rep", "labels"), "rep")).mapInArrow(ask, "rep long, node long, tree int, block int, p int, q int")
    asked = stored(asked, "asked")
    return together(asked.join(own, "rep")).mapInArrow(judge, "rep long, root long, links long, least double")


def forest(docs: DataFrame, classes: DataFrame, threshold: float, recall: float, trees: int, depth: int) -> DataFrame:
    """rep, root and links of all rounds."""
    floor = prefix_depth(threshold, trees, depth, recall)
    width = level_bytes(floor)
    found = stored(tries(classes, trees, depth, width, floor), "tries")
    own = stored(sets(docs, classes, stored(found.select("rep").distinct(), "company")), "sets")
    level, above, least, out = depth, depth + 1, threshold, None
    while True:
        made = stored(links(found, own, threshold, trees, depth, width, level, above), "links")
        out = made if out is None else out.unionByName(made)
        lowest = out.agg(F.min("least")).first()[0]
        least = threshold if lowest is None else max(threshold, int(lowest / BAND + 1e-6) * BAND)
        wanted = max(floor, prefix_depth(least, trees, depth, recall))
        if wanted >= level:
            remove_stored(found, own)
            return out
        level, above = wanted, level


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id (the least doc_id of all that links connect) and n_links (other rows at the threshold or above) of each row."""
    width = level_bytes(prefix_depth(threshold, trees, depth, recall))
    signed = stored(signatures(docs, trees, depth, width), "signatures")
    classes = stored(signed.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("w"), F.first("n").alias("n"), F.first("labels").alias("labels")), "classes")
    linked = forest(docs, classes, threshold, recall, trees, depth)
    roots = components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("a", "b", "rep", "w").join(counts, "rep", "left").join(roots.withColumnRenamed("u", "rep"), "rep", "left")
    known = known.select("a", "b", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    found = signed.select("doc_id", "a", "b").join(known, ["a", "b"]).select("doc_id", "class_id", "n_links")
    wordless = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return found.unionByName(wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those of which a class keeps another."""
    gone = stored(join(docs, threshold).where("doc_id <> class_id").select("doc_id"), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
