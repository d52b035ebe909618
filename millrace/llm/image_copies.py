"""Operator 7: cropped and edited copies of images, by local descriptors.

Each image (PGM or PPM bytes) gives corners on scales a sixth of an octave apart (the least eigenvalue of the structure tensor, its local maxima, the strongest for each AREA pixels, so their
number grows with the image). A corner has an orientation (the centroid of its patch) and 256 binary brightness tests turned by it; the mean slope of the patch is taken off before
they compare, so that they do not all tell of the one edge that every corner has. Neighbouring corners of one scale make pairs, and pairs of
two images meet by KEY bits of either corner, their directions and their length, in PAIR_TABLES tables; they must differ in at most NEAR of 64 bits that are in no table. A corner alone is met by
chance by one in 45 images, such a pair by one in 15,000 (drawn images), so that chance does not fill the disk. Large buckets are parted into blocks, and each pair of blocks is a cell of bounded
size in which all pairs of different images are compared. Of two images that meet, all corners are compared: those that differ in at most FAR of all 256 bits vote for a similarity transform
(turn, scale, shift). Images are linked if VOTES distinct corners agree, lie on a transform fitted to them, take PLACES distinct places, and are a SHARE of the corners that the transform brings into
the other image. Links are joined to connected components.

Nulls: a null, empty or unreadable image has no corner and is its own class. A null id takes no part (class_id null, n_links 0). Equal bytes are one image from the start, and a task looks for their corners once. Ties: the least id.
Empty table: no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import remove_stored, stored
from millrace.llm.components import components
from millrace.llm.hashing import mix

SCALES, AREA, RADIUS, VOTES = tuple(2 ** (-k / 6) for k in range(6)), 256, 11, 4
TABLES, NEAR, FAR = 6, 8, 32
CORNER = np.dtype([("x", "f4"), ("y", "f4"), ("scale", "f4"), ("turn", "f4"), ("keys", "i4", TABLES), ("rest", "i8")])
#: Pairs of neighbouring corners meet in so many tables, by so many bits of each corner; tables laid out at once; widths of a pair's directions (degrees) and of its length (octaves).
NEIGHBOURS, PAIR_TABLES, KEY, ROUND, PAIR_TURN, PAIR_OCTAVE = 6, 4, 17, 2, 60, 0.5
#: Descriptors in a block of a bucket, and rows judged together, about; what tells cells apart.
CELL, READ, CELL_OF = 512, 100_000, ("bucket", "p", "q")
BINS = 1 << 16
#: Width of a vote: degrees, octaves, pixels of the unscaled image.
TURN, OCTAVE, SHIFT = 30, 0.5, 6
#: What lies on a fitted transform: pixels, degrees, octaves. It holds if its corners take PLACES places more than PLACE pixels apart and are such a SHARE of those that should meet.
FIT, FIT_TURN, FIT_OCTAVE, PLACES, PLACE, SHARE = 2, 15, 0.25, 3, 6, 0.25
#: Distances that stand in memory at once; pairs of images that are laid out with their corners at once, about.
ROOM, LAID = 1 << 19, 1 << 21

_rng = np.random.default_rng(11)
_TESTS = np.clip(np.round(_rng.normal(0, RADIUS / 1.6, (256, 4))), -RADIUS + 2, RADIUS - 2)
_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])
_SPREAD = float((_DISC[:, 0] ** 2).sum())
#: The different points of the tests, and which of them each test compares.
_POINTS, _AT = np.unique(_TESTS.reshape(-1, 2), axis=0, return_inverse=True)
_ONE, _TWO = _AT.reshape(-1, 2).T
#: Pixels that a turned test may reach beyond an image's edge, at most; pixels of images that are searched together; digests that a task keeps at most, and then begins anew.
EDGE, STACK, MET = 2, 1 << 17, 1 << 17


def decode(data: bytes | None) -> np.ndarray | None:
    """The grey levels of a binary PGM (P5) or PPM (P6) image of one byte a sample; None if it is none."""
    try:
        head, at = [], 0
        while len(head) < 4:
            while data[at : at + 1].isspace():
                at += 1
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
                continue
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            if end in (at, len(data)):
                return None
            head.append(data[at:end])
            at = end
        width, height, most = map(int, head[1:])
        depth = {b"P5": 1, b"P6": 3}[head[0]]
        if most > 255:
            return None
        pixels = np.frombuffer(data, np.uint8, width * height * depth, at + 1).reshape(height, width, depth)
        return pixels.mean(axis=2)
    except (TypeError, ValueError, KeyError, IndexError):
        return None


def encode(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % pixels.shape[::-1] + np.clip(np.round(pixels), 0, 255).astype(np.uint8).tobytes()


def _edged(a: np.ndarray, r: int) -> np.ndarray:
    """Images with r rows and columns more on each side, edges repeated."""
    h, w = a.shape[-2:]
    return a.take(np.clip(np.arange(-r, h + r), 0, h - 1), axis=-2).take(np.clip(np.arange(-r, w + r), 0, w - 1), axis=-1)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r + 1 of each image, edges repeated."""
    p, k = _edged(a, r + 1), 2 * r + 1
    np.cumsum(p, axis=-2, out=p)
    np.cumsum(p, axis=-1, out=p)
    p = p[..., :-1, :-1]
    s = p[..., k:, k:] - p[..., :-k, k:]
    s -= p[..., k:, :-k]
    s += p[..., :-k, :-k]
    s /= k * k
    return s


def _resized(a: np.ndarray, scale: float, smooth: np.ndarray) -> np.ndarray:
    """Images of a smaller scale; smooth: their means over squares of three."""
    if scale == 1:
        return a
    height, width = a.shape[-2:]
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    y, x = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, height - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, width - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, height - 2)), np.minimum(x.astype(int), max(0, width - 2))
    fy, fx = (y - y0)[:, None], x - x0
    y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
    across = smooth.take(x0, axis=-1) * (1 - fx) + smooth.take(x1, axis=-1) * fx
    return across.take(y0, axis=-2) * (1 - fy) + across.take(y1, axis=-2) * fy


def _searched(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each corner of images of one shape: its image, x, y (of the whole image), scale, orientation (degrees), the 32-bit keys of the tables and the 64 bits left over. Sorted by image."""
    found, means = [], _box(stack, 1)
    for scale in SCALES:
        a = _resized(stack, scale, means)
        h, w = a.shape[1:]
        if min(h, w) < 2 * RADIUS + 3:
            continue
        smooth = means if scale == 1 else _box(a, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        least = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        inner = least[:, RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1]
        peak = np.full((len(a), h - 2 * RADIUS + 2, w - 2 * RADIUS + 2), -1.0)
        peak[:, 2:-2, 2:-2] = inner
        peak = functools.reduce(np.maximum, [peak[:, i : i + inner.shape[1]] for i in range(5)])
        peak = functools.reduce(np.maximum, [peak[:, :, i : i + inner.shape[2]] for i in range(5)])
        of, y, x = np.nonzero((inner == peak) & (inner > 4))
        if not len(of):
            continue
        order = np.lexsort((x, y, -inner[of, y, x], of))  # nonzero() sorts by image, and so does this
        order = order[np.arange(len(of)) - np.searchsorted(of, of) < max(4, inner[0].size // AREA)]
        of, y, x = of[order], y[order] + RADIUS + 1, x[order] + RADIUS + 1
        patch = smooth.ravel().take(((of * h + y) * w + x)[:, None] + (_DISC[:, 0] * w + _DISC[:, 1]))
        patch -= patch.mean(axis=1, keepdims=True)
        down, right = patch @ _DISC[:, 0], patch @ _DISC[:, 1]
        turn, slope = np.arctan2(down, right), np.hypot(down, right)[:, None] / _SPREAD
        c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]
        soft = _edged(_box(smooth, 2), EDGE)
        dx, dy = _POINTS[:, 0], _POINTS[:, 1]
        row, column = np.rint(y[:, None] + s * dx + c * dy), np.rint(x[:, None] + c * dx - s * dy)
        at = soft.ravel().take(((of[:, None] * (h + 2 * EDGE) + EDGE + row) * (w + 2 * EDGE) + EDGE + column).astype(np.int64))
        bits = at[:, _ONE] - at[:, _TWO] < slope * (_TESTS[:, 0] - _TESTS[:, 2])
        packed = np.packbits(bits, axis=1)
        keys, rest = packed[:, : 4 * TABLES].copy().view(">i4"), packed[:, 4 * TABLES :].copy().view(">i8")[:, 0]
        found.append((of, x / scale, y / scale, np.full(len(of), scale), np.degrees(turn), keys, rest))
    if not found:
        return tuple(np.empty((0, TABLES) if k == 5 else 0, int) for k in range(7))
    out = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(out[0], kind="stable")
    return tuple(x[order] for x in out)


def corners(pixels: np.ndarray) -> list[tuple[float, float, float, float, list[int], int]]:
    """x, y (of the whole image), scale, orientation (degrees), the 32-bit keys of the tables and the 64 bits left over, of each corner."""
    _, *own = _searched(pixels[None])
    return list(zip(*(x.tolist() for x in own), strict=True))


def packed_corners(images: Iterable[np.ndarray | None]) -> list[bytes]:
    """packed(corners()) of each image, b"" of None. Images of one shape are searched together; no more stand in memory than STACK pixels hold, or one larger image."""
    out: list[bytes] = []
    shapes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    held = 0

    def search() -> None:
        for part in shapes.values():
            of, *own = _searched(np.stack([pixels for _, pixels in part]))
            made = np.empty(len(of), CORNER)
            for name, x in zip(CORNER.names, own, strict=True):
                made[name] = x
            ends = np.searchsorted(of, np.arange(len(part) + 1))
            for (k, _), at, end in zip(part, ends, ends[1:], strict=False):
                out[k] = made[at:end].tobytes()
        shapes.clear()

    for k, pixels in enumerate(images):
        out.append(b"")
        if pixels is None or not pixels.size:
            continue
        if held and held + pixels.size > STACK:
            search()
            held = 0
        shapes.setdefault(pixels.shape, []).append((k, pixels))
        held += pixels.size
    search()
    return out


def packed(found: list[tuple[float, float, float, float, list[int], int]]) -> bytes:
    return np.array([tuple(c) for c in found], CORNER).tobytes()


def described(media: DataFrame, id_column: str, image: str, pack: bool = False) -> DataFrame:
    """id, sha, full (the image has bytes) and corners of each row: x, y, scale, turn, keys and rest, see corners(), or their packed() bytes. Images are read once and never shuffled.
    Packed corners are null where the id is null, and where a task has met equal bytes under another id before: one row of those, at least, has them."""
    names = ("x", "y", "scale", "turn", "keys", "rest")
    corner = pa.struct(list(zip(names, [pa.float32()] * 4 + [pa.list_(pa.int32()), pa.int64()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                images = [x.as_py() for x in rows.column(1)]
                shas = [hashlib.sha256(d or b"").digest() for d in images]
                if pack:
                    if len(met) > MET:
                        met.clear()
                    fresh = [k for k, (i, sha) in enumerate(zip(rows.column(0), shas, strict=True)) if i.is_valid and sha not in met and not met.add(sha)]
                    own = dict(zip(fresh, packed_corners(decode(images[k]) for k in fresh), strict=True))
                    made = pa.array([own.get(k) for k in range(len(images))], pa.binary())
                else:
                    pixels = [decode(data) for data in images]
                    made = pa.array([[dict(zip(names, c, strict=True)) for c in (corners(p) if p is not None and p.size else [])] for p in pixels], pa.list_(corner))
                yield pa.record_batch({"id": rows.column(0), "sha": shas, "full": pa.array([bool(d) for d in images]), "corners": made})

    kind = "binary" if pack else "array<struct<x: float, y: float, scale: float, turn: float, keys: array<int>, rest: long>>"
    return media.select(F.col(id_column).cast("long").alias("id"), F.col(image).alias("image")).mapInArrow(run, f"id long, sha binary, full boolean, corners {kind}")


def _neighbours(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of corners of one scale of which one is among the NEIGHBOURS nearest of the other."""
    codes = [np.empty(0, np.int64)]
    for scale in np.unique(c["scale"]):
        own = np.flatnonzero(c["scale"] == scale)
        k = min(NEIGHBOURS, len(own) - 1)
        at = c["x"][own] + 1j * c["y"][own]
        for start in range(0, len(own) if k else 0, step := max(1, ROOM // len(own))):
            part = np.arange(start, min(start + step, len(own)))
            apart = np.abs(at[part][:, None] - at)
            apart[part - start, part] = np.inf
            i, j = own[np.repeat(part, k)], own[np.argpartition(apart, k - 1, axis=1)[:, :k].ravel()]
            codes.append(np.minimum(i, j) * len(c) + np.maximum(i, j))
    return np.divmod(np.unique(np.concatenate(codes)), max(1, len(c)))


def _keyed(tables: range) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, bucket and rest of each pair of neighbouring corners of an image, in each of the tables."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                rows = batch.slice(start, 200)
                images = [np.frombuffer(x.as_py(), CORNER) for x in rows.column("corners")]
                pairs = [_neighbours(c) for c in images]
                before = np.cumsum([0, *map(len, images)])
                c, n = np.concatenate(images), [len(i) for i, _ in pairs]
                i, j = (np.concatenate([p[k] + at for p, at in zip(pairs, before, strict=False)]) for k in (0, 1))
                ids = np.repeat(rows.column("id").to_numpy(), n)
                ids, i, j = np.tile(ids, 2), np.concatenate([i, j]), np.concatenate([j, i])  # the lesser key is first, or each of two equal ones
                for table in tables:
                    key = c["keys"][:, table].astype(np.uint64) & np.uint64((1 << KEY) - 1)
                    first = np.flatnonzero(key[i] <= key[j])
                    one, two = c[i[first]], c[j[first]]
                    dx, dy = two["x"] - one["x"], two["y"] - one["y"]
                    toward, turned = ((a % 360) // PAIR_TURN for a in (np.degrees(np.arctan2(dy, dx)) - one["turn"], two["turn"] - one["turn"]))
                    far = np.log2(np.maximum(np.hypot(dx, dy) * one["scale"], 1)) // PAIR_OCTAVE
                    lie = ((toward * 64 + turned) * 64 + far).astype(np.uint64) * np.uint64(TABLES) + np.uint64(table)
                    bucket = mix(mix(key[i[first]] << np.uint64(32) | key[j[first]]) ^ lie)
                    rest = one["rest"] & 0xFFFFFFFF | two["rest"] << 32
                    yield pa.record_batch({"id": ids[first], "bucket": bucket.view(np.int64), "rest": rest})

    return keyed


def _met(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows of one cell that are of different images and differ in at most NEAR bits of the rest, in parts no longer than the rows. Rows are sorted by cell."""
    cell = [rows[c] for c in CELL_OF]
    start = np.ones(len(cell[0]), bool)
    start[1:] = np.any([c[1:] != c[:-1] for c in cell], axis=0)
    end = np.append(np.flatnonzero(start)[1:], len(start))[np.cumsum(start) - 1]
    at, step = np.arange(len(start)), 1
    while len(at := at[at + step < end[at]]):
        near = at[rows["id"][at] != rows["id"][at + step]]
        near = near[np.bitwise_count(rows["rest"][near] ^ rows["rest"][near + step]) <= NEAR]
        near = near[(rows["p"][near] == rows["q"][near]) | (rows["block"][near] != rows["block"][near + step])]
        yield near, near + step
        step += 1


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a and b of the pairs in each cell; cells stand one after another."""
    held: list[dict[str, np.ndarray]] = []

    def judged(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, j in _met(rows):
            one, two = rows["id"][i], rows["id"][j]
            yield pa.record_batch({"a": np.minimum(one, two), "b": np.maximum(one, two)})

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([x[c] for x in held]) for c in held[0]}

    for batch in batches:
        held.append({c: batch.column(c).to_numpy() for c in batch.schema.names})
        if sum(len(x["id"]) for x in held) < READ:
            continue
        rows = joined()
        last = np.flatnonzero(np.any([rows[c] != rows[c][-1] for c in CELL_OF], axis=0))
        if not len(last):
            continue
        cut = int(last[-1]) + 1
        yield from judged({c: x[:cut] for c, x in rows.items()})
        held = [{c: x[cut:] for c, x in rows.items()}]
    if held:
        yield from judged(joined())


def _large(keyed: DataFrame) -> DataFrame:
    """bucket and blocks of the buckets above a cell's size. Buckets are counted by BINS coarse bins first, so that only those in a full bin are counted one by one."""
    bin_of = F.pmod("bucket", F.lit(BINS))
    full = keyed.groupBy(bin_of.alias("_bin")).agg(F.count("*").alias("m")).where(F.col("m") > CELL).select("_bin")
    near = keyed.select("bucket").withColumn("_bin", bin_of).join(F.broadcast(full), "_bin", "left_semi")  # at most BINS rows
    return near.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > CELL).select("bucket", F.ceil(F.col("m") / CELL).cast("int").alias("blocks"))


def candidates(images: DataFrame) -> DataFrame:
    """Pairs (a, b) of images with a pair of neighbouring corners in common. Tables are laid out ROUND at a time, so that their rows never lie on disk all together."""
    found = []
    for start in range(0, PAIR_TABLES, ROUND):
        keyed = images.mapInArrow(_keyed(range(start, min(start + ROUND, PAIR_TABLES))), "id long, bucket long, rest long")
        # only buckets above a cell's size are parted, into pairs of blocks; all others are one cell
        # stored first, so that Spark knows their size: few large buckets are broadcast and all others stay where they are
        large = stored(_large(keyed), "large")
        cells = keyed.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id", "rest"), F.col("blocks")).cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "rest")
        met = cells.repartition(*CELL_OF).sortWithinPartitions(*CELL_OF).mapInArrow(_paired, "a long, b long")
        found.append(stored(met.distinct(), "met"))
        remove_stored(large)
    out = stored(functools.reduce(DataFrame.unionByName, found).distinct(), "candidates")
    remove_stored(*found)
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of corners of two images that differ in at most FAR of all bits."""
    one, two = ([*np.ascontiguousarray(c["keys"]).view(np.uint64).T, c["rest"].view(np.uint64)] for c in (a, b))
    found, step = [], max(1, ROOM // max(1, len(b)))
    for start in range(0, len(a), step):
        differ = [np.bitwise_count(x[start : start + step, None] ^ y) for x, y in zip(one, two, strict=True)]
        i, j = np.nonzero(np.add(differ[0] + differ[1], differ[2] + differ[3], dtype=np.uint16) <= FAR)
        found.append((i + start, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int),) * 2


def _distinct(c: np.ndarray) -> int:
    """Places that corners take, no two of them within PLACE pixels: the same point is a corner on several scales."""
    kept = np.empty(0, complex)
    for z in np.unique(c["x"] + 1j * c["y"]):
        if not len(kept) or np.abs(kept - z).min() > PLACE:
            kept = np.append(kept, z)
    return len(kept)


def _expected(a: np.ndarray, b: np.ndarray, w: complex, t: complex) -> int:
    """Corners of a that a transform brings among those of b, on a scale that b has."""
    z, scale = w * (a["x"] + 1j * a["y"]) + t, a["scale"] / abs(w)
    inside = [(v >= b[c].min() - 1) & (v <= b[c].max() + 1) for v, c in ((z.real, "x"), (z.imag, "y"))]
    return int((inside[0] & inside[1] & (scale >= 0.94 * b["scale"].min()) & (scale <= 1.06 * b["scale"].max())).sum())


def agreeing(a: np.ndarray, b: np.ndarray, votes: int = VOTES) -> int:
    """Corners of two images that agree on a transform; 0 if they are too few, too close or too small a part of those that the transform brings to lie on each other."""
    i, j = _alike(a, b)
    if len(i) < votes:
        return 0
    p, q = a[i], b[j]
    turn, size = (q["turn"].astype(float) - p["turn"]) % 360, p["scale"].astype(float) / q["scale"]
    here, there = p["x"].astype(float) + 1j * p["y"], q["x"].astype(float) + 1j * q["y"]
    shift = there - size * np.exp(1j * np.radians(turn)) * here
    octave = np.round(np.log2(size) / OCTAVE)
    # each grid of votes stands twice, half a cell apart
    cells = np.concatenate([np.stack([np.full(len(i), k), np.floor(turn / TURN + k // 4 / 2), np.floor(shift.real / (2 * SHIFT) + k // 2 % 2 / 2), np.floor(shift.imag / (2 * SHIFT) + k % 2 / 2), octave]) for k in range(8)], axis=1).astype(np.int64)
    code = mix(cells[0].view(np.uint64))
    for row in cells[1:]:
        code = mix(code ^ row.view(np.uint64))
    order = np.lexsort((np.tile(j, 8), code))
    code, corner = code[order], np.tile(j, 8)[order]
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    fresh = np.append(True, (code[1:] != code[:-1]) | (corner[1:] != corner[:-1]))
    agree, ends = np.add.reduceat(fresh.astype(int), start), np.append(start[1:], len(code))
    tried = set()
    for k in np.argsort(-agree, kind="stable"):
        if agree[k] < votes:
            break
        m = np.sort(order[start[k] : ends[k]] % len(i))
        if m.tobytes() in tried:
            continue
        tried.add(m.tobytes())
        centre = here[m].mean(), there[m].mean()
        spread = (np.abs(here[m] - centre[0]) ** 2).sum()
        if spread == 0:
            continue
        w = ((here[m] - centre[0]).conj() * (there[m] - centre[1])).sum() / spread
        t = centre[1] - w * centre[0]
        if not w:
            continue
        off = np.abs((turn - np.degrees(np.angle(w)) + 180) % 360 - 180)
        fit = (np.abs(w * here + t - there) <= FIT) & (off <= FIT_TURN) & (np.abs(np.log2(size / abs(w))) <= FIT_OCTAVE)
        one, two = np.unique(i[fit]), np.unique(j[fit])
        n = min(len(one), len(two))
        if n < votes or min(_distinct(a[one]), _distinct(b[two])) < PLACES:
            continue
        if n >= SHARE * max(_expected(a, b, w, t), _expected(b, a, 1 / w, -t / w)):
            return n
    return 0


def linked_images(images: DataFrame, votes: int = VOTES) -> DataFrame:
    """Pairs (a, b) of images, id and packed corners, that agree on a transform, and the number of corners that agree."""
    place = lambda x: images.select(F.col("id").alias(x), F.col("corners").alias(f"corners_{x}"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [agreeing(*(np.frombuffer(x.as_py(), CORNER) for x in both), votes) for both in zip(batch.column("corners_a"), batch.column("corners_b"), strict=True)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "agree": pa.array(found, pa.int32())})

    def of(pairs: DataFrame) -> DataFrame:
        both = pairs.join(place("a"), "a").join(place("b"), "b").select("a", "b", "corners_a", "corners_b")
        return both.mapInArrow(judged, "a long, b long, agree int").where("agree > 0")

    met = candidates(images)
    rounds = -(-met.count() // LAID)
    if rounds < 2:
        return of(met)
    # pairs of strangers grow with the square of the images: part after part, so that their corners never lie on disk all together
    return functools.reduce(DataFrame.unionByName, [stored(of(met.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)), "judged") for k in range(rounds)])


def matched(corners_of: DataFrame, votes: int = VOTES) -> DataFrame:
    """linked_images() of a row for each corner: id, corner, x, y, scale, turn, keys and rest."""
    names = ("x", "y", "scale", "turn", "keys", "rest")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [packed([[c[x] for x in names] for c in row.as_py()]) for row in batch.column("corners")]
            yield pa.record_batch({"id": batch.column("id"), "corners": pa.array(own, pa.binary())})

    grouped = corners_of.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("corner", *names))).alias("corners"))
    return linked_images(stored(grouped.mapInArrow(pack, "id long, corners binary"), "packed"), votes)


def copies(media: DataFrame, id_column: str = "id", image: str = "image", votes: int = VOTES) -> DataFrame:
    """id, class_id (the least id of all that links connect) and n_links (linked images, and others of equal bytes) of each row."""
    rows = stored(described(media, id_column, image, pack=True).withColumn("held", F.col("corners").isNotNull()), "images")
    same = rows.where("id is not null and full").groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.min(F.when(F.col("held"), F.col("id"))).alias("holder"), F.count_if("held").alias("n_held"))
    # of images of equal bytes one that has corners stands for all; the others with corners, few in most tables, leave before corners are read
    others = stored(rows.where("id is not null and full and held").select("id", "sha").join(same.where("n_held > 1").select("sha", "holder"), "sha").where("id <> holder").select("id").distinct(), "others")
    images = rows.where(F.col("id").isNotNull() & (F.octet_length("corners") > 0)).join(others, "id", "left_anti").select("id", "corners")
    moved = same.where("holder <> rep")
    named = linked_images(images, votes)
    for x in ("a", "b"):
        named = named.join(moved.select(F.col("holder").alias(x), F.col("rep").alias("_rep")), x, "left").withColumn(x, F.coalesce("_rep", x)).drop("_rep")
    linked = stored(named, "pairs")
    both = linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(linked.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    weight = both.join(same.select(F.col("rep").alias("v"), F.col("w").alias("_w")), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("_w").alias("links"))
    roots = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("u", "rep")
    known = same.join(weight, "rep", "left").join(roots, "rep", "left").select("sha", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    found = rows.select("id", "sha", "full").join(known, "sha", "left")
    seen = F.col("id").isNotNull() & F.col("full")
    return found.select("id", F.when(seen, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.when(seen, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))
