"""Harmonic packing: pieces of reciprocal-capacity lengths fill bins with a fixed number of pieces each.

Class k takes pieces of floor(capacity / k) tokens, k to a bin, so that a bin is full but for at most capacity mod k
tokens. A document is cut, longest class first, into pieces that each have exactly a class's length. Every task fills
bins of its own, without knowing of the others, so nothing is shuffled. What is left in a task's open bins at its end is
cut once more, into powers of two, and each of those classes' bins is closed at a power of two: such a sequence needs no
padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import small_batches, texts

_encoders: dict[str, object] = {}


def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """The byte-level BPE of a ``tokenizers`` file as a rank table, which gives the same ids in a quarter of the time.

    Its merges are in the order of their ids, so ids are ranks; added tokens are matched inside texts as there. A file
    that is of another kind is refused. Tests hold the ids against ``tokenizers`` for every code point.
    """
    if path not in _encoders:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path) as f:
            named = json.load(f)
        vocabulary, characters = named["model"]["vocab"], byte_characters()
        split = named["pre_tokenizer"]
        if named["model"]["type"] != "BPE" or named["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in named["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        ranks = {bytes(characters[c] for c in token): number for token, number in vocabulary.items()}
        special = {t["content"]: t["id"] for t in named["added_tokens"]}
        _encoders[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def class_lengths(capacity: int) -> np.ndarray:
    """For each length up to ``capacity``, the longest class length floor(capacity / k) that fits into it."""
    best = np.zeros(capacity + 1, dtype=np.int64)
    best[np.unique(capacity // np.arange(1, capacity + 1))] = np.unique(capacity // np.arange(1, capacity + 1))
    return np.maximum.accumulate(best)


class Packer:
    """Assigns pieces to the bins of one task. Holds only the pieces of open bins: under ``capacity`` tokens a class."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next, self.fits = capacity, first_sequence, class_lengths(capacity)
        self.open: dict[int, list[tuple]] = {}

    def cut(self, length: int) -> Iterator[tuple[int, int]]:
        """(start, length) of a document's pieces."""
        start = 0
        while start < length:
            size = int(self.fits[min(length - start, self.capacity)])
            yield start, size
            start += size

    def _bin(self, members: list[tuple], size: int) -> Iterator[tuple]:
        for slot, piece in enumerate(members):
            yield (*piece, self.next, slot * size)
        self.next += 1

    def add(self, size: int, piece: tuple) -> Iterator[tuple]:
        """Put a piece of a class's length into that class's open bin; gives the bin's pieces when it is full."""
        held = self.open.setdefault(size, [])
        held.append(piece)
        if len(held) == self.capacity // size:
            self.open[size] = []
            yield from self._bin(held, size)

    def close(self) -> Iterator[tuple]:
        """The pieces of the open bins, cut into powers of two; each last bin holds a power of two of tokens."""
        binary: dict[int, list[tuple]] = {}
        for held in self.open.values():
            for row, start, ids in held:
                at, left = 0, len(ids) // 4
                while left:
                    size = 1 << (min(left, self.capacity).bit_length() - 1)
                    binary.setdefault(size, []).append((row, start + at, ids[4 * at : 4 * (at + size)]))
                    at, left = at + size, left - size
        self.open = {}
        room = 1 << (self.capacity.bit_length() - 1)
        for size, held in binary.items():
            at = 0
            while at < len(held):
                count = min(room // size, 1 << ((len(held) - at).bit_length() - 1))
                yield from self._bin(held[at : at + count], size)
                at += count


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document, encoded and ended by ``end_id``, into sequences of at most ``capacity`` tokens.

    One row per piece: the key, ``start`` (ids of the document before it), ``length``, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``. Pieces of a sequence stand without gaps from offset 0; each
    id is in exactly one piece. Sequence ids are unique, not consecutive. Null and empty texts are their end id alone; a
    null key or repeated rows are packed like any other row; other columns are left out; an empty table gives no piece. A
    task holds one open bin a class. Tasks are numbered by their partition, so a task run again gives the same pieces
    (the input must be deterministic: a table, or a written frame).
    """
    small_batches(docs.sparkSession)
    frame = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = frame.schema["key"].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        encode, key_type = encoder(path).encode, None

        def emit(found: list[tuple]) -> pa.RecordBatch:
            rows, starts, ids, sequences, offsets = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], key_type), pa.array(starts, pa.int64()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                    pa.array([r[1] for r in rows], pa.int64()), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()),
                ],
                ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            key_type = batch.column(0).type
            found = []
            for k, row_text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.array([*encode(row_text, allowed_special="all"), end_id], dtype="<u4").tobytes()
                row = (k, len(ids) // 4)
                for start, length in packer.cut(row[1]):
                    found += packer.add(length, (row, start, ids[4 * start : 4 * (start + length)]))
            if found:
                yield emit(found)
        if key_type is not None and (found := list(packer.close())):
            yield emit(found)

    return frame.mapInArrow(run, schema).withColumnRenamed("key", key)


def packing_query(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece, its ids as their crc32."""
    packed = pack(docs, path)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
