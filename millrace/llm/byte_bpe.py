"""Operator 6: byte-level BPE from a file of ranks, with offsets, and its decoding.

The ranks (base64 bytes and a number on each line) become a model of the tokenizers library: bytes are written as printable characters, and any two
neighbours whose joined bytes have a rank may merge, lower ranks first. Ids are decoded by the reverse of that table of bytes; a token may hold
part of a character, so bytes are joined before they become text.

Nulls: a null text is empty; a null list of ids decodes to no bytes. Ids outside the vocabulary raise KeyError. Repeated rows are encoded alike. Very long texts are encoded whole, alone.
Empty table: no row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from millrace.llm import hashing
from millrace.llm.tokens import TOGETHER, Encoder, vocabulary


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable and no space, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def ranks(name: str) -> dict[bytes, int]:
    with open(vocabulary(name), "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def tokenizer(name: str) -> Tokenizer:
    import public_tokenizers

    own, chars = ranks(name), byte_characters()
    text = lambda token: "".join(chars[b] for b in token)
    merges = [(text(t[:k]), text(t[k:])) for t in sorted(own, key=own.get) for k in range(1, len(t)) if t[:k] in own and t[k:] in own]
    made = Tokenizer(models.BPE({text(t): i for t, i in own.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


class ByteCodec:
    """Encodes texts and decodes ids of one vocabulary."""

    def __init__(self, name: str):
        self.encoder = Encoder(tokenizer(name))
        self.table = {i: t for t, i in ranks(name).items()}
        self.lengths = np.zeros(max(self.table) + 1, np.int64)
        for i, t in self.table.items():
            self.lengths[i] = len(t)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.encoder.encode(texts)

    def offsets(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token of a text begins: bytes, and characters (of a token that begins inside a character, that character)."""
        starts = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        lead = (np.frombuffer((text or "").encode(), np.uint8) & 0xC0) != 0x80
        return starts, np.cumsum(lead)[starts] - 1 if len(starts) else starts

    def decode(self, ids: Iterable[int] | np.ndarray | None) -> bytes:
        own = ids.tolist() if isinstance(ids, np.ndarray) else ids or []
        return b"".join(map(self.table.__getitem__, own))

    def decode_stream(self, runs: Iterable[Iterable[int]]) -> Iterator[str]:
        """The text of runs of ids one after another; a character that is split between runs comes with the later one. Bytes that are no character become U+FFFD."""
        held = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in runs:
            yield held.decode(self.decode(ids))
        if rest := held.decode(b"", True):
            yield rest


@lru_cache(maxsize=2)
def codec(name: str) -> ByteCodec:
    """The worker's codec; its memo lives on from task to task."""
    return ByteCodec(name)


def encode(docs: DataFrame, name: str, offsets: bool = False) -> DataFrame:
    """doc_id and ids of each text; with offsets also byte_starts and char_starts of the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name)
        for rows in _texts(batches):
            texts = rows.column("text").to_pylist()
            ids = own.encode(texts)
            out = {"doc_id": rows.column("doc_id"), "ids": _lists(ids, pa.int32())}
            if offsets:
                starts = [own.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                out |= {"byte_starts": _lists([s[0] for s in starts], pa.int64()), "char_starts": _lists([s[1] for s in starts], pa.int64())}
            yield pa.record_batch(out)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", byte_starts array<long>, char_starts array<long>" * offsets)


def decode(encoded: DataFrame, name: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded (the bytes) of each list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name)
        for rows in _pieces(batches):
            column = rows.column("ids")
            ids = [np.array([], np.int32) if not column[k].is_valid else column[k].values.to_numpy() for k in range(len(column))]
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "n_tokens": np.array([len(i) for i in ids], np.int64), "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], "decoded": pa.array([own.decode(i) for i in ids], pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, to, _, _ in hashing.slices(batch.column("text"), TOGETHER):
            yield batch.slice(row, to - row)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*values, np.empty(0, np.int64)]).astype(np.int64)).cast(kind))
