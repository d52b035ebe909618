"""Images for the query and the tests of operator 7: the test tables hold none, so one is drawn from each vector."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.image_copies import encode

SIZE, SHAPES = 96, 150
EDITS = ("none", "half", "gamma", "noise", "turn", "resize")
#: Sides of the windows in which shapes are drawn, from below; the last holds the largest. What a window may reach beyond the image; images that are drawn together.
WINDOWS, ROOM, STACK = (14, 18, 26, 40, 71), 80, 100
#: Rows of one vector that one task draws, about.
LOT = 4096


def drawn(vectors: DataFrame) -> DataFrame:
    """A media table: vec_id and image (PGM). Ids that end in 9 show an edit of the image that the id nine before shows."""
    own = vectors.select("vec_id", "embedding", F.xxhash64("embedding").alias("_key"))
    edit = (1 + (F.col("vec_id") / 10).cast("long") % 5).cast("int").alias("edit")
    # only edits need another's vector
    edits = vectors.where("vec_id % 10 = 9").select("vec_id", (F.col("vec_id") - 9).alias("source"), edit)
    edits = edits.join(own.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "source"), "source").drop("source")
    table = own.where("vec_id % 10 <> 9").withColumn("edit", F.lit(0)).unionByName(edits)
    # drawing is heavy, so equal vectors are laid side by side and drawn once; those of more than LOT rows (so at most a row for each LOT rows) are dealt over several tasks
    hot = own.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > LOT).select("_key", F.ceil(F.col("n") / LOT).alias("lots"))
    table = table.join(F.broadcast(hot), "_key", "left").withColumn("_lot", F.pmod(F.xxhash64("vec_id"), F.coalesce("lots", F.lit(1))))
    table = table.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key", "_lot").sortWithinPartitions("_key", "edit", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made = {}, {}  # the last vector's picture and its edits
        for batch in batches:
            for start in range(0, batch.num_rows, STACK):
                rows = batch.slice(start, STACK)
                asked = [(np.asarray(e or [], np.float32).tobytes(), EDITS[k]) for e, k in zip(rows.column("embedding").to_pylist(), rows.column("edit").to_pylist(), strict=True)]
                if new := [v for v in dict.fromkeys(v for v, _ in asked) if v not in held]:
                    held |= zip(new, draw_all([np.frombuffer(v, np.float32) for v in new]), strict=True)
                for x in dict.fromkeys(asked):
                    if x not in made:
                        made[x] = encode(edited(held[x[0]], x[1]))
                yield pa.record_batch({"vec_id": rows.column("vec_id"), "image": pa.array([made[x] for x in asked], pa.binary())})
                last = asked[-1][0]
                held, made = {last: held[last]}, {x: y for x, y in made.items() if x[0] == last}

    return table.select("vec_id", "edit", "embedding").mapInArrow(run, "vec_id long, image binary")


def draw_all(vectors: list[list[float]]) -> np.ndarray:
    """Of each vector: turned ellipses and boxes of many sizes that hide one another, all set by the vector. The shapes of one number are drawn together, by the size of their windows."""
    radius, tone, cy, cx, thin, turn = (np.empty((len(vectors), SHAPES)) for _ in range(6))
    for k, vector in enumerate(vectors):
        g = np.random.default_rng(zlib.crc32(np.asarray(vector, np.float32).tobytes()))
        radius[k], tone[k] = np.clip(3 / np.sqrt(g.random(SHAPES)), 3, 22), g.uniform(10, 245, SHAPES)
        cy[k], cx[k] = g.uniform(-5, SIZE + 5, (2, SHAPES))
        thin[k], turn[k] = g.uniform(0.5, 1, SHAPES), g.uniform(0, np.pi, SHAPES)
    cos, sin, reach = np.cos(turn), np.sin(turn), 1.5 * radius + 1
    top, left = np.floor(cy - reach).astype(np.int64), np.floor(cx - reach).astype(np.int64)
    window = np.searchsorted(WINDOWS, 2 * reach + 2)
    # the number of the shape that is seen, on a canvas with room for whole windows
    width = SIZE + 2 * ROOM
    seen = np.full((len(vectors), width, width), -1, np.int16)
    base = (np.arange(len(vectors))[:, None] * width + ROOM + top) * width + ROOM + left
    for k in range(SHAPES):
        for c, side in enumerate(WINDOWS):
            m = np.flatnonzero(window[:, k] == c)
            if not len(m):
                continue
            span = np.arange(side)
            dy, dx = (top[m, k, None] + span - cy[m, k, None])[:, :, None], (left[m, k, None] + span - cx[m, k, None])[:, None, :]
            cosine, sine, edge = (x[m, k, None, None] for x in (cos, sin, radius))
            u, v = cosine * dx + sine * dy, cosine * dy - sine * dx
            v /= thin[m, k, None, None]
            inside = np.flatnonzero((np.maximum(np.abs(u, out=u), np.abs(v, out=v), out=u) <= edge) if k % 2 else (np.add(np.square(u, out=u), np.square(v, out=v), out=u) <= edge**2))
            at, place = np.divmod(inside, side * side)
            seen.ravel()[base[m, k][at] + (span[:, None] * width + span).ravel()[place]] = k
    seen = seen[:, ROOM:-ROOM, ROOM:-ROOM]
    return np.where(seen < 0, 128.0, tone[np.arange(len(vectors))[:, None, None], seen])


def draw(vector: list[float]) -> np.ndarray:
    return draw_all([vector])[0]


def _sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Between pixels, by straight lines; 128 outside."""
    y0, x0 = np.clip(np.floor(y).astype(int), 0, a.shape[0] - 2), np.clip(np.floor(x).astype(int), 0, a.shape[1] - 2)
    fy, fx = np.clip(y - y0, 0, 1), np.clip(x - x0, 0, 1)
    out = (a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx) * (1 - fy) + (a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx) * fy
    return np.where((y >= -0.5) & (y <= a.shape[0] - 0.5) & (x >= -0.5) & (x <= a.shape[1] - 0.5), out, 128.0)


def edited(a: np.ndarray, edit: str, amount: float | None = None) -> np.ndarray:
    """An edit of EDITS; amount: of a turn the degrees (15), of a resize the factor (0.8)."""
    h, w = a.shape
    if edit == "half":
        return a[:, w // 2 :]
    if edit == "gamma":
        return 255 * (a / 255) ** 0.7
    if edit == "noise":
        return a[: h - 12, 4:] + np.random.default_rng(int(a.sum())).normal(0, 6, (h - 12, w - 4))
    if edit == "turn":
        t = np.radians(amount or 15)
        y, x = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
        return _sampled(a, np.cos(t) * y - np.sin(t) * x + (h - 1) / 2, np.cos(t) * x + np.sin(t) * y + (w - 1) / 2)
    if edit == "resize":
        f = amount or 0.8
        y, x = np.mgrid[0 : round(h * f), 0 : round(w * f)]
        return _sampled(a, (y + 0.5) / f - 0.5, (x + 0.5) / f - 0.5)
    return a
