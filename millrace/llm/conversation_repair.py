"""Operator 13: repair of a conversation's structure by shortest paths with small integer costs.

Rows are range-sorted by conversation and turn and cut into segments of at most SEGMENT rows or so, so a conversation of any length is dealt over tasks. A segment's graph has a node for each row and state of the
pattern `(s?(ua)+)?`; Dial's buckets give the distance of every node to the end, and a walk along tight arcs takes the ASCII-least letter. A conversation that lies whole in one segment is done in that one pass. Of
the others (the first and last of each range, and those longer than a segment), every segment first gives its costs from state to state (4 x 4), from which the distances to the end behind each segment follow; then
each segment is walked from all four states, and a stream over the segments picks the walks that join.

Faults and edits are those of damage-free tables too: `repair` takes any table of conv_id, turn, role and text. Nulls: role and text read as one space; null turns come first and count in no gap; null conv_ids are
one conversation. Ties of the turn are ordered by role and text; equal rows are counted before they are shuffled, and the second of them is a duplicate. Empty texts are blank. Very long texts are never cut. A
conversation without rows is not in the result of `repair`; `repaired` gives it zeros. Empty table: no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WHITE, stored

SEGMENT, SEGMENT_BYTES = 4096, 4 << 20
#: Characters of a text by which rows of one turn and role are parted.
HEAD = 256
DELETE, REROLE, INSERT, UNENDED = 3, 2, 2, 1
#: State -> (role's initial -> next state): start, after system, after user, after assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a state can be given, and what is inserted behind the last row.
WANTED = ("user", "user", "assistant", "user")
TAIL = ((), ("user", "assistant"), ("assistant",), ())
BEHIND = tuple(float(INSERT * len(t)) for t in TAIL)
LEGAL = {"su", "ua", "au"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(conv_id:turn) % 20 chooses: dropped, emptied, without end marks, repeated, or said by the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("_copies"), kind.alias("_kind")).where("_kind <> 0")
    return out.select("conv_id", "turn", "role", "text", F.explode("_copies")).drop("col")


def _ordered(rows: DataFrame, segment: int) -> DataFrame:
    """conv_id, turn, role, text, copies and later (the same role and text stood in an earlier turn), range-sorted."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *texts).withColumn("_said", F.sha2(F.to_json(F.struct("role", "text")), 256))
    place: Column = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("conv_id", "_said").agg(F.min(place).alias("_first")).select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_says"), "_first")
    equal = rows.groupBy("conv_id", "turn", "role", "text", "_said").agg(F.count(F.lit(1)).alias("n"))
    found = equal.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_says")))
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / segment))).alias("part")
    rows = found.select("conv_id", "turn", "role", "text", (place > F.col("_first")).alias("later"), "n", parts)
    rows = rows.select("conv_id", "turn", "role", "text", (F.col("later") | (F.col("part") > 0)).alias("later"), F.least(F.lit(segment), F.col("n") - F.col("part") * segment).cast("int").alias("copies"), "part")
    return rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(HEAD)), "part").sortWithinPartitions("conv_id", "turn", "role", "text", "part")


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """conv_id, seg, whole, and the segment's rows as arrays."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, first, own, size, held, cut_before = TaskContext.get().partitionId() << 32, True, [], 0, 0, False
        conv, conv_type = None, None

        def made(whole: bool) -> pa.RecordBatch:
            columns = list(zip(*own, strict=True))
            lists = [pa.array([list(c)], t) for c, t in zip(columns, map(pa.list_, (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32())), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([seg], pa.int64()), pa.array([whole]), *lists], names=["conv_id", "seg", "whole", *ROWS])

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and (row[0] != conv or size >= segment or held >= SEGMENT_BYTES):
                    ends = row[0] != conv
                    yield made(ends and not first and not cut_before)
                    seg, own, size, held = seg + 1, [], 0, 0
                    first, cut_before = first and not ends, not ends
                conv = row[0]
                own.append(row[1:])
                size, held = size + row[5], held + len(row[3])
        if own:
            yield made(False)

    schema = f"conv_id {kind}, seg long, whole boolean, turns array<long>, roles array<string>, texts array<string>, later array<boolean>, copies array<int>"
    return rows.select("conv_id", "turn", "role", "text", "later", "copies").mapInArrow(cut, schema)


ROWS = ["turns", "roles", "texts", "later", "copies"]


class Segment:
    """Rows of one conversation, one after another, as a graph."""

    def __init__(self, row: dict):
        self.roles, self.texts, self.copies = row["roles"], row["texts"], row["copies"]
        self.initials = [r[:1] for r in self.roles]
        trimmed = [t.rstrip(WHITE) for t in self.texts]
        self.blank = [not t for t in trimmed]
        self.later = row["later"]
        self.unended = [bool(t) and t[-1] not in ".!?" for t in trimmed]
        turns = [t for t in row["turns"] if t is not None]
        self.turns = (turns[0], turns[-1], sum(a != b for a, b in zip(turns, turns[1:], strict=False)) + 1) if turns else None

    def __len__(self) -> int:
        return len(self.roles)

    def faults(self) -> list[int]:
        """blank, duplicate, truncated and illegal, within the segment."""
        blank = sum(n for b, n in zip(self.blank, self.copies, strict=True) if b)
        duplicate = sum(n - (not again) for b, again, n in zip(self.blank, self.later, self.copies, strict=True) if not b)
        truncated = sum(u and not again for u, again in zip(self.unended, self.later, strict=True))
        pairs = sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:], strict=False))
        return [blank, duplicate, truncated, pairs + sum(self.copies) - len(self)]

    def arcs(self, i: int, q: int) -> list[tuple[str, int, int, int]]:
        """Letter, cost, and the node reached, in the order of letters; copies of a row but the first go with it, as they are always deleted."""
        more = self.copies[i] - 1
        out = [("D" * (more + 1), DELETE * (more + 1), i + 1, q)]
        to = NEXT[q][WANTED[q][0]]
        out.append(("I", INSERT, i, to))
        if not (self.blank[i] or self.later[i]):
            extra = UNENDED * self.unended[i] + DELETE * more
            if (kept := NEXT[q].get(self.initials[i])) is not None:
                out.append(("K" + "D" * more, extra, i + 1, kept))
            out.append(("R" + "D" * more, REROLE + extra, i + 1, to))
        return out

    def distances(self, behind: tuple | list) -> list[list[float]]:
        """Of each node (row, state) to the end, where what lies behind the segment costs so much from each state: Dial's bucket queue, from the end backwards."""
        back: list[list[list[tuple[int, int, int]]]] = [[[] for _ in NEXT] for _ in range(len(self) + 1)]
        for i in range(len(self)):
            for q in range(len(NEXT)):
                for _, cost, j, p in self.arcs(i, q):
                    back[j][p].append((cost, i, q))
        far = [[float("inf")] * len(NEXT) for _ in back]
        buckets: list[list[tuple[int, int]]] = []

        def put(d: int, i: int, q: int) -> None:
            if d < far[i][q]:
                far[i][q] = d
                buckets.extend([] for _ in range(d + 1 - len(buckets)))
                buckets[d].append((i, q))

        least = min(behind)
        for q, d in enumerate(behind):
            if d < float("inf"):
                put(int(d - least), len(self), q)
        at = 0
        while at < len(buckets):
            for i, q in buckets[at]:  # no arc costs nothing but a kept row's, whose node comes into this bucket while it is read
                if far[i][q] == at:
                    for cost, j, p in back[i][q]:
                        put(at + cost, j, p)
            at += 1
        return [[d + least for d in row] for row in far]

    def walk(self, far: list[list[float]], q: int) -> tuple[str, list[str], int]:
        """Letters, repaired rows and the state behind the last row, along tight arcs from a state before the first."""
        i, letters, out = 0, [], []
        while i < len(self):
            letter, cost, j, p = next(a for a in self.arcs(i, q) if a[1] + far[a[2]][a[3]] == far[i][q])
            if letter[0] == "K":
                out.append(f"{self.roles[i]}:{self.texts[i]}")
            elif letter[0] == "R":
                out.append(f"{WANTED[q]}:{self.texts[i]}")
            elif letter[0] == "I":
                out.append(f"{WANTED[q]}:")
            letters.append(letter)
            i, q = j, p
        return "".join(letters), out, q


def _summary(seg: Segment) -> dict:
    blank, duplicate, truncated, illegal = seg.faults()
    first, last, distinct = seg.turns or (None, None, 0)
    return {"blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "head": seg.initials[0], "tail": seg.initials[-1], "first_turn": first, "last_turn": last, "turns": distinct}


def _joined(segments: Iterator[dict]) -> dict:
    """The row of a conversation from its segments' summaries and walks, one after another."""
    q, audit, digest, begun, last, low, distinct, out = 0, [], hashlib.sha256(), False, None, None, 0, dict.fromkeys(COUNTS, 0)

    def say(lines: str) -> None:
        nonlocal begun
        digest.update((("\n" if begun else "") + lines).encode())
        begun = True

    for s in segments:
        out = {k: out[k] + s.get(k, 0) for k in COUNTS}
        out["illegal"] += last is not None and last["tail"] + s["head"] not in LEGAL
        if s["first_turn"] is not None:
            low = s["first_turn"] if low is None else low
            distinct += s["turns"] - (last is not None and last["last_turn"] == s["first_turn"])
            out["gaps"] = s["last_turn"] - low + 1 - distinct
        if last is None:
            out["cost"] = int(s["far"])
        walk = s["walks"][q]
        audit.append(walk["audit"])
        if walk["text"] is not None:
            say(walk["text"])
        q, last = walk["to"], s
    for role in TAIL[q]:
        audit.append("I")
        say(f"{role}:")
    return {**out, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def _walked(seg: Segment, behind: tuple | list, entries: tuple[int, ...]) -> dict:
    far = seg.distances(behind)
    walks = [None] * len(NEXT)
    for q in entries:
        letters, rows, to = seg.walk(far, q)
        walks[q] = {"audit": letters, "text": "\n".join(rows) if rows else None, "to": to}
    return {**_summary(seg), "far": far[0][0], "walks": walks}


RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
WALKS = "blank long, duplicate long, truncated long, illegal long, head string, tail string, first_turn long, last_turn long, turns long, far double, walks array<struct<audit: string, text: string, to: int>>"


def _out(convs: list, kind: pa.DataType, rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64()] * len(COUNTS) + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), *(pa.array([r[c] for r in rows], t) for c, t in zip([*COUNTS, "audit", "repaired_sha256"], kinds, strict=True))], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation that has rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    segments = stored(_segments(_ordered(rows, segment), segment), "segments")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_joined(iter([_walked(Segment(r), BEHIND, (0,))])) for r in batch.select(ROWS).to_pylist()]
            yield _out(batch.column("conv_id").to_pylist(), batch.schema.field("conv_id").type, done)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(ROWS).to_pylist():
                seg = Segment(r)
                ends = [seg.distances([0.0 if p == q else float("inf") for p in range(len(NEXT))])[0] for q in range(len(NEXT))]
                out.append([ends[q][p] for p in range(len(NEXT)) for q in range(len(NEXT))])
            yield pa.record_batch({"conv_id": batch.column("conv_id"), "seg": batch.column("seg"), "costs": pa.array(out, pa.list_(pa.float64()))})

    def behind(group: pa.Table) -> pa.Table:
        n, order = len(NEXT), group.sort_by([("seg", "descending")])
        value, out = list(BEHIND), []
        for c in order.column("costs").to_pylist():
            out.append(value)
            value = [min(c[p * n + q] + value[q] for q in range(n)) for p in range(n)]
        return order.select(["conv_id", "seg"]).append_column("behind", pa.array(out, pa.list_(pa.float64())))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, r in enumerate(batch.to_pylist()):
                got = _walked(Segment(r), r["behind"], (0, 1, 2, 3))
                names = [c.split()[0] for c in WALKS.split(", ")][:10]
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.float64()]
                walks = pa.array([got["walks"]], pa.list_(pa.struct([("audit", pa.string()), ("text", pa.string()), ("to", pa.int32())])))
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").slice(k, 1), batch.column("seg").slice(k, 1), *(pa.array([got[c]], t) for c, t in zip(names, kinds, strict=True)), walks], names=["conv_id", "seg", *names, "walks"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.schema.field("conv_id").type, r) for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
        for conv, own in groupby(rows, key=lambda x: (x[0], x[1]["conv_id"])):
            yield _out([conv[1]], conv[0], [_joined(r for _, r in own)])

    whole = segments.where("whole").mapInArrow(alone, f"conv_id {kind}, {RESULT}")
    split = segments.where("not whole")
    ahead = split.mapInArrow(costs, f"conv_id {kind}, seg long, costs array<double>").groupBy("conv_id").applyInArrow(behind, f"conv_id {kind}, seg long, behind array<double>")
    walks = split.join(ahead.drop("conv_id"), "seg").select("conv_id", "seg", *ROWS, "behind").mapInArrow(walked, f"conv_id {kind}, seg long, {WALKS}")
    return whole.unionByName(walks.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(joined, f"conv_id {kind}, {RESULT}"))


def repaired(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The result of `repair` for the damaged rows, with a row for every conversation of the table before the damage."""
    all_ = rows.select("conv_id").distinct().withColumnRenamed("conv_id", "_conv")
    found = all_.join(repair(damaged(rows), segment), F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return found.select(F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
