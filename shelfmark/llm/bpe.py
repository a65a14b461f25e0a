"""Byte-level BPE with a rank queue of hierarchical bitmaps.

All pre-tokens of a batch lie in one linked list with borders between them. A bucket for each merge rank holds the
positions whose pair has that rank; two levels of bitmaps say which buckets hold any, so that find-first-set gives the
next rank. Merging a pair queues its new neighbours' ranks; entries whose pair has since changed are stale and skipped.
Each merge costs a bounded number of steps, so a pre-token of a million bytes takes time in proportion to its length.
Pre-tokens never touch, so the lowest rank of the whole list is also the lowest of its own pre-token.
"""

from __future__ import annotations

import base64
import gc
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import plus, small_batches, texts
from shelfmark.llm.segments import PieceCache

#: Buckets in one word of the lower bitmap level.
WIDTH = 256
CALL_CHARS = 400_000
#: Stands between pre-tokens; no id.
BORDER = 0xFFFFFFFF


class RankQueue:
    """Positions in buckets by rank, with two bitmap levels over the buckets; each bucket gives its lowest position first."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * (ranks // WIDTH + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.low[rank // WIDTH] |= 1 << rank % WIDTH
            self.top |= 1 << rank // WIDTH
        bucket.append(position)

    def fill(self, ranks: np.ndarray) -> None:
        """Queue each position under its rank, if it has one (0 or more)."""
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        for places in np.split(at, np.flatnonzero(np.diff(ranks[at])) + 1):
            if len(places):
                rank = int(ranks[places[0]])
                self.buckets[rank] = places.tolist()
                self.low[rank // WIDTH] |= 1 << rank % WIDTH
                self.top |= 1 << rank // WIDTH

    def first(self) -> int:
        """The lowest rank that has entries, or -1."""
        if not self.top:
            return -1
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        return word * WIDTH + (bits & -bits).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """All positions of a rank; its bucket is empty afterwards."""
        bucket, self.buckets[rank] = self.buckets[rank], []
        word = rank // WIDTH
        self.low[word] &= ~(1 << rank % WIDTH)
        if not self.low[word]:
            self.top &= ~(1 << word)
        return bucket


class Bpe:
    """Encoding and decoding by a table of byte strings and their ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        spellings = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        self.spelled = np.frombuffer(b"".join(spellings), np.uint8)
        self.widths = np.array([len(t) for t in spellings], np.int64)
        self.places = np.cumsum(self.widths) - self.widths
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.queue = RankQueue(max(self.tokens) + 1)
        self.pairs: dict[int, int] = {}
        self.tokens_seen = PieceCache(self._encode_tokens, 800_000)
        self.cache = PieceCache(self._encode_pieces, 500_000)

    def _rank(self, key: int) -> int:
        """The rank of two neighbouring tokens (left << 32 | right) joined, or -1; remembered in ``pairs``."""
        left, right = key >> 32, key & 0xFFFFFFFF
        if len(self.pairs) > 200_000:
            self.pairs.clear()
        known = left != BORDER and right != BORDER
        rank = self.pairs[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1) if known else -1
        return rank

    def merge(self, pre_tokens: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token."""
        pairs, rank_of = self.pairs, self._rank
        plain = np.frombuffer(b"\0".join(pre_tokens) + b"\0", np.uint8)
        borders = np.cumsum([len(t) + 1 for t in pre_tokens]) - 1
        n = len(plain)
        numbers, ranks = self.byte[plain], np.full(n, -1, np.int64)
        ranks[:-1] = self.byte_pairs[(plain[:-1].astype(np.int64) << 8) | plain[1:]]
        numbers[borders], ranks[borders], ranks[borders - 1] = BORDER, -1, -1
        ids: list[int] = numbers.tolist()
        pair: list[int] = ranks.tolist()  # the rank that a live position is queued under
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, push = self.queue, self.queue.push
        queue.fill(ranks)
        while (rank := queue.first()) >= 0:
            entries = queue.take(rank)
            if len(entries) > 1:
                entries.sort()
            for k, i in enumerate(entries):
                if pair[i] != rank:
                    continue  # stale: the pair was merged or changed since
                j = follow[i]
                left, after = before[i], follow[j]
                ids[i], pair[j], follow[i], before[after] = rank, -1, after, i
                key = rank << 32 | ids[after]
                new = pair[i] = pairs[key] if key in pairs else rank_of(key)
                lower = False
                if new >= 0:
                    push(new, i)
                    lower = new <= rank
                if left >= 0:
                    key = ids[left] << 32 | rank
                    new = pair[left] = pairs[key] if key in pairs else rank_of(key)
                    if new >= 0:
                        push(new, left)
                        lower |= new <= rank
                if lower:  # what has just come up goes first: back with the rest of this bucket
                    for rest in entries[k + 1 :]:
                        if pair[rest] == rank:
                            push(rank, rest)
                    break
        out, start = [], 0
        for token in pre_tokens:
            found, i, end = [], start, start + len(token)
            while i < end:
                found.append(ids[i])
                i = follow[i]
            out.append(found)
            start = end + 1
        return out

    def _encode_tokens(self, batch: list[str]) -> list[bytes]:
        """The ids of each pre-token; one that is a token itself has that one id."""
        ranks = self.ranks
        plain = [t.encode() for t in batch]
        parts = self._merged([t for t in plain if t not in ranks])
        return [ranks[t].to_bytes(4, "little") if t in ranks else next(parts) for t in plain]

    def _merged(self, batch: list[bytes]) -> Iterator[bytes]:
        """The ids of pre-tokens that have to be merged, about 100,000 bytes in one list."""
        start = 0
        while start < len(batch):
            last, size = start, 0
            while last < len(batch) and (last == start or size < 100_000):
                size += len(batch[last])
                last += 1
            for found in self.merge(batch[start:last]):
                yield struct.pack(f"<{len(found)}I", *found)
            start = last

    def _encode_pieces(self, batch: list[str]) -> list[bytes]:
        split = self.split
        # A blank and plain letters are one pre-token in any case.
        cut = [[piece] if piece.isascii() and piece[0] == " " and piece[1:].isalpha() else split(piece) for piece in batch]
        known = self.tokens_seen.lookup(set().union(*cut))
        return [b"".join([known[token] for token in found]) for found in cut]

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers.

        Python's cycle collector rests meanwhile: it would walk the remembered pieces again and again, which hold no cycles.
        """
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self.cache.ids(batch)
        finally:
            if collecting:
                gc.enable()

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        found = np.frombuffer(ids, dtype="<u4")
        widths = self.widths[found]
        ends = np.cumsum(widths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.places[found] - (ends - widths), widths)
        return self.spelled[at].tobytes()


_loaded: dict[tuple[str, str], Bpe] = {}


def _bpe(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add each text's ids (binary, little-endian unsigned 32-bit) by the ranks in ``path``, split by ``pattern``.

    With ``decoded``, also a column of that name with the bytes that the ids decode to, made by the same worker, which
    so holds one table of tokens for both ways.

    Null and empty texts have no ids. Special strings are ordinary text. Every row and column is kept (a column called
    ``out`` is replaced); repeated rows are encoded alike. No shuffle; a worker keeps a bounded memory of pieces.
    """
    small_batches(docs.sparkSession)
    added = [out, decoded] if decoded else [out]
    docs = docs.drop(*added)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            rows, found, first = texts(batch.column(names.index(text))), [], 0
            while first < len(rows):
                last, size = first, 0
                while last < len(rows) and (last == first or size + len(rows[last]) <= CALL_CHARS):
                    size += len(rows[last])
                    last += 1
                found += bpe.encode(rows[first:last])
                first = last
            more = [found, [bpe.decode(ids) for ids in found]] if decoded else [found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.binary()) for x in more)], [*names, *added])

    return docs.mapInArrow(run, plus(docs.schema, **dict.fromkeys(added, "binary")))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes (binary) that each row's ids stand for; null ids give none. Rows and columns are kept."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            found = [bpe.decode(x or b"") for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*names, out])

    return docs.mapInArrow(run, plus(docs.schema, **{out: "binary"}))


def bpe_query(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: its number of tokens and the digests of its ids and of the bytes they decode to."""
    both = encode(docs.select("doc_id", "text"), path, pattern, decoded="decoded")
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
