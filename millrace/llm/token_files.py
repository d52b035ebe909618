"""Operator 3: token ids in Arrow files of fixed-size lists.

write() puts documents into files of a folder in ascending order of doc_id, each of about FILE_TOKENS tokens at most (a longer document has a file of its own). Each file is an Arrow IPC file of record batches
with two columns of fixed-size lists, ids (uint16 or uint32) and mask (bool): the file's token stream, cut into sequences of
equal length, the last one padded. A reader maps the file and has sequence k of a batch, or all ids as one numpy array, without
a copy. Beside it lies an index file: doc_id, start (in the file) and n_tokens of each document. Files are read batch by batch: neither writer nor reader holds more than
a batch of ids and one file's index.

Nulls: a null text is empty and gives the end id alone; null doc_ids come first. Ties: rows of one doc_id are ordered by their text.
Very long texts are encoded alone. Empty table: no file, no row. Other columns are ignored, whatever their names.

A task writes under a name of its own and renames at its end, so a repeated or a second attempt leaves the same files.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import hashing
from millrace.llm.common import stored
from millrace.llm.tokens import TOGETHER, encoder

SEQUENCES = 256
#: Tokens of a file, about, and bytes of text that one task writes, about.
FILE_TOKENS, TASK_BYTES = 32 << 20, 256 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Writer:
    """A token stream on its way into one file."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out, self.held, self.n, self.total = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= SEQUENCES * self.length:
            self._flush(self.n // self.length)

    def _flush(self, sequences: int) -> None:
        ids = np.concatenate([*self.held, np.zeros(max(0, sequences * self.length - self.n), self.dtype)])
        whole = sequences * self.length
        mask = pa.array(np.arange(whole) < self.n)
        for k in range(0, sequences, SEQUENCES):
            at, to = k * self.length, min(whole, (k + SEQUENCES) * self.length)
            columns = [pa.array(ids[at:to]), mask[at:to]]
            self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns], schema=self.schema))
        self.held, self.n = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.n:
            self._flush(-(-self.n // self.length))
        self.out.close()


class _File:
    """One file and its index on their way into the folder, under names of their own until they are whole."""

    def __init__(self, fs, folder: str, name: str, length: int, dtype: np.dtype):
        self.fs, self.folder, self.name = fs, folder, name
        self.own = f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.sink = fs.open_output_stream(self.own)
        self.writer, self.docs, self.sizes = _Writer(self.sink, length, dtype), [], []

    def close(self) -> dict:
        self.writer.close()
        self.sink.close()
        n = np.array(self.sizes, np.int64)
        index = pa.table({"doc_id": pa.chunked_array(self.docs), "start": np.cumsum(n) - n, "n_tokens": n})
        with self.fs.open_output_stream(f"{self.own}-docs") as out, pa.ipc.new_file(out, index.schema) as file:
            file.write_table(index, max_chunksize=10_000)
        self.fs.move(f"{self.own}-docs", f"{self.folder}/{self.name}.docs.arrow")
        self.fs.move(self.own, f"{self.folder}/{self.name}.arrow")
        return {"file": self.name, "n_docs": len(n), "n_tokens": int(n.sum())}


def write(docs: DataFrame, path: str, vocabulary: str, length: int = 2048, end_id: int = 0, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files under path (a URI that the executors share) and returns a row for each: part, number (in its part), file, n_docs, n_tokens."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        part, coder = TaskContext.get().partitionId(), encoder(vocabulary)
        end, file, number = np.array([end_id], coder.dtype), None, 0

        def closed() -> pa.RecordBatch:
            return pa.record_batch({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), **{k: [v] for k, v in file.close().items()}})

        for batch in batches:
            for row, to, _, _ in hashing.slices(batch.column("text"), TOGETHER):
                rows, first = batch.slice(row, to - row), 0
                for k, ids in enumerate(coder.encode(rows.column("text").to_pylist())):
                    if file is not None and file.sizes and sum_of(file) + len(ids) + 1 > file_tokens:
                        file.docs.append(rows.column("doc_id").slice(first, k - first))
                        yield closed()
                        file, number, first = None, number + 1, k
                    if file is None:
                        file = _File(fs, folder, f"part-{part:06d}-{number:06d}", length, coder.dtype)
                    file.writer.add(ids)
                    file.writer.add(end)
                    file.sizes.append(len(ids) + 1)
                file.docs.append(rows.column("doc_id").slice(first))
        if file is not None:
            yield closed()

    def sum_of(file: _File) -> int:
        return file.writer.total

    tie = F.xxhash64("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    ordered = docs.select("doc_id", "text").repartitionByRange(tasks, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return stored(ordered.mapInArrow(save, "part int, number int, file string, n_docs long, n_tokens long"), "token-manifest")


def sequences(path: str, file: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batches of one file: ids (sequences x length), a view of the mapped file where it is local, and their mask."""
    fs, folder = _open(path)
    where = posixpath.join(folder, f"{file}.arrow")
    source = pa.memory_map(where) if fs.type_name == "local" else fs.open_input_file(where)
    with pa.ipc.open_file(source) as reader:
        for k in range(reader.num_record_batches):
            batch = reader.get_batch(k)
            length = batch.schema.field("ids").type.list_size
            yield batch.column("ids").flatten().to_numpy().reshape(-1, length), batch.column("mask").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def read(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(path)
        for row in (r for b in batches for r in b.to_pylist()):
            with fs.open_input_file(f"{folder}/{row['file']}.docs.arrow") as f, pa.ipc.open_file(f) as reader:
                index = reader.read_all()
            sizes = index.column("n_tokens").to_numpy()
            crcs, doc, left, crc = np.zeros(len(sizes), np.int64), 0, int(sizes[0]), 0
            for ids, _ in sequences(path, row["file"]):
                wide, at = ids.reshape(-1).astype("<u4"), 0
                while doc < len(sizes) and at < len(wide):
                    take = min(left, len(wide) - at)
                    crc, at, left = zlib.crc32(wide[at : at + take].tobytes(), crc), at + take, left - take
                    if not left:
                        crcs[doc], doc, crc = crc, doc + 1, 0
                        left = int(sizes[doc]) if doc < len(sizes) else 0
            yield from pa.table({"doc_id": index.column("doc_id"), "start": index.column("start").to_numpy() + row["before"], "n_tokens": sizes, "ids_crc32": crcs}).to_batches(10_000)

    # a row for each file
    before = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return before.repartition(max(1, manifest.count())).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
