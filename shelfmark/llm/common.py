"""What several operators share: reading documents, folds, byte-bounded Arrow batches, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch that a task hands to Python. A batch holds whole rows, so one row may exceed it.
BATCH_BYTES = 4 << 20
#: Bytes of text that numpy works on at once within a batch; its temporary arrays are some ten times as large.
SLICE = 1 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, read by Spark, with only the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Lower the bound of Arrow batches from Spark's default of 64 MB; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).removesuffix("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


#: Keys of a semi join that are broadcast; more are shuffled, with the rows that they pick.
BROADCAST_KEYS = 1_000_000


def picked(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """The rows whose ``on`` is among the distinct written ``keys`` (``left_anti``: is not). Few keys go to the rows, so
    that these need not move."""
    keys = keys.select(on)
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``: the learning and held-out folds (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


_KINDS = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def plus(schema: T.StructType, **kinds: str) -> T.StructType:
    """A schema with further columns, named with their types; the given one stays as it is."""
    return T.StructType([*schema.fields, *(T.StructField(name, _KINDS[kind]) for name, kind in kinds.items())])


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Strings of a text column; null counts as empty."""
    return column.fill_null("").to_pylist()


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``size`` bytes, with the number of the first row."""
    ends = np.cumsum(pa.compute.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield first, column.slice(first, last - first)
        first = last


# --- words of many texts at once, as numpy arrays ---------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown by doubling."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE))))
            down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, inverse))))
        _powers.clear()
        _powers[size] = (up, down)
    up, down = _powers[size]
    return up[:n], down[:n]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n+1 offsets of its rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte stays."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (runs outside blanks and 0x09-0x0D, never across rows), and n+1 word offsets by row."""
    solid = ~_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the same word has the same hash in every batch."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX2)
