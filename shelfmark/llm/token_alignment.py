"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both libraries tell where a token lies in the text, in characters: ``tokenizers`` by offsets, ``sentencepiece`` by the
spans of its immutable proto, which its present version hands out as an offset mapping. These are coarse cuts. A character of several bytes may be shared by several tokens, and a byte-fallback token
has an empty or a whole character's span; within such a run the ends follow from the decoded bytes of its tokens. A run
whose bytes do not add up to its span, or a token whose bytes are not the text's, makes the text unaligned.

Texts are cut before blanks that no token of either tokenizer crosses (``segments``), and what such a piece comes to
(ids, groups, links) is remembered, so that frequent words are tokenized once a task. Pieces that are met for the first
time are encoded as lines of many, since a call for each would cost more than its tokens, and aligned together, as numpy
arrays. The texts of a slice are put together from their pieces at once, as Arrow columns.

How many documents link a pair of ids is counted over the corpus. Documents lie in blocks of bounded size; each block asks
for the counts of the pairs it holds, once a pair, and gets them back beside its documents. So neither a document's links
nor the table of counts is ever shuffled link by link or sent to every task.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import buffer_of, slices, small_batches
from shelfmark.llm.segments import pieces
from shelfmark.session import checkpoint

#: Links of one block of documents; a longer document is a block of its own.
BLOCK_LINKS = 4_000_000
#: Pieces remembered (twice as many at most), and characters of a piece that is.
PIECES, PIECE_CHARS = 300_000, 64
#: Pieces aligned at once, and characters of a line of them.
BATCH, LINE = 20_000, 1000
_SPACE = "▁"
#: Texts with blanks that are no safe cuts, in RE2's writing: one in front, and those behind white space.
_UNSAFE = r"^ |[\t-\r\x1c-\x1f\x{85}\p{Z}] "
_NEW = object()


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens, one after the other, and the n+1 places where they begin."""
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)


def _byte_level() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write: printable ones stand for themselves, the others for
    the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Pair:
    """Two tokenizers, loaded once a task: a byte-level one (A) and a sentencepiece one with a space in front (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_level()
        written = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        a_size, b_size = max(written) + 1, self.b.get_piece_size()
        self.a_bytes = _table([bytes(byte_of[c] for c in w) if (w := written.get(i)) is not None and all(c in byte_of for c in w) else (w or "").encode() for i in range(a_size)])
        self.b_bytes = _table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i in range(b_size) for p in [self.b.id_to_piece(i)]])
        self.b_size = b_size
        self.blank = self.b.piece_to_id(_SPACE)
        # No piece has a blank behind another character, so none crosses the border before such a blank.
        self.cuts = not any(_SPACE in self.b.id_to_piece(i).lstrip(_SPACE) for i in range(b_size)) and not self.b.is_unknown(self.blank)
        self.width = len(str(max(a_size, b_size)))
        self.digits = np.zeros((max(a_size, b_size), self.width), np.uint8)
        for i in range(len(self.digits)):
            self.digits[i, : len(str(i))] = np.frombuffer(str(i).encode(), np.uint8)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    # --- one batch of lines that begin with a blank -------------------------------------------------------------

    def _tokens_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begin and end of their spans in characters, of all texts; n+1 places of the texts' first tokens."""
        found = self.a.encode_batch(texts, add_special_tokens=False)
        ids = [f.ids for f in found]
        at = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64)
        spans = np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable(f.offsets for f in found)), np.int64, 2 * at[-1]).reshape(-1, 2)
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64, at[-1]), spans[:, 0], spans[:, 1], at

    def _tokens_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same by sentencepiece: its own blank in front stands for the text's first one."""
        found = self.b.encode([t[1:] for t in texts], return_type="offset_mapping", num_threads=1)
        ids = [f["ids"] or [self.blank] for f in found]
        at = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64)
        flat = itertools.chain.from_iterable(itertools.chain.from_iterable(f["offsets"] or [(0, 0)] for f in found))
        spans = np.fromiter(flat, np.int64, 2 * at[-1]).reshape(-1, 2) + 1
        spans[at[:-1], 0] = 0
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64, at[-1]), spans[:, 0], spans[:, 1], at

    @staticmethod
    def _refined(begin: np.ndarray, end: np.ndarray, size: np.ndarray, row: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of tokens in bytes of the whole buffer, and which rows' runs do not add up to their spans.

        A run begins where nothing before reaches into the token's span; in it ends follow from the decoded sizes.
        """
        begin, end = begin + base[row], end + base[row]
        reach = np.maximum.accumulate(end)
        first = np.ones(len(begin), bool)
        first[1:] = (begin[1:] >= reach[:-1]) | (row[1:] != row[:-1])
        # A fallback byte with an empty span in front of its character belongs to the character's run.
        empty = begin == end
        first[1:] &= ~empty[:-1]
        total = np.cumsum(size)
        starts = np.flatnonzero(first)
        before = (total - size)[starts]
        run = np.cumsum(first) - 1
        ends = begin[starts][run] + total - before[run]
        last = np.append(starts[1:], len(begin)) - 1
        wrong = ends[last] != np.maximum.reduceat(end, starts) if len(starts) else np.zeros(0, bool)
        return ends, np.unique(row[last[wrong]])

    @staticmethod
    def _differs(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray], row: np.ndarray, data: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Rows whose tokens' joined bytes are not the row's bytes."""
        flat, at = table
        size = (at[1:] - at[:-1])[ids]
        rows = len(base) - 1
        bad = np.bincount(row, size, rows).astype(np.int64) != np.diff(base)
        keep = ~bad[row]
        ids, size, row = ids[keep], size[keep], row[keep]
        ends = np.cumsum(size)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[ids] - (ends - size), size)
        solid = np.flatnonzero(np.repeat(~bad, np.diff(base)))
        other = flat[source] != data[solid]
        bad[np.searchsorted(base, solid[other], side="right") - 1] = True
        return np.flatnonzero(bad)

    def _lines(self, texts: list[str]) -> np.ndarray:
        """The first text of each line, and the number of texts. Only texts that end in no white space have others behind."""
        first, size = [], LINE
        for k, text in enumerate(texts):
            if size >= LINE:
                first.append(k)
                size = 0
            size += LINE if text[-1].isspace() else len(text)
        return np.array([*first, len(texts)], np.int64)

    def align(self, texts: list[str], alone: bool = False) -> list[tuple[bytes, bytes, int] | None]:
        """For each text that begins with a blank: its groups written out, its links as 64-bit pairs, and the number of A's
        tokens; None where the bytes do not match. Short texts are encoded many to a line, unless ``alone``."""
        first = self._lines(texts) if self.cuts and not alone else np.arange(len(texts) + 1)
        lines = ["".join(texts[i:j]) for i, j in itertools.pairwise(first.tolist())]
        data, text_at = buffer_of(pa.array(texts, pa.large_utf8()))
        base = text_at[first]
        a_id, a_begin, a_end, a_at = self._tokens_a(lines)
        b_id, b_begin, b_end, b_at = self._tokens_b(lines)
        rows = len(lines)
        a_row, b_row = np.repeat(np.arange(rows), np.diff(a_at)), np.repeat(np.arange(rows), np.diff(b_at))
        # Characters' places in bytes; a span of characters becomes one of bytes.
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        lead = np.searchsorted(place, base[:-1])
        a_begin, a_end, b_begin, b_end = (place[lead[row] + x] - base[row] for row, x in ((a_row, a_begin), (a_row, a_end), (b_row, b_begin), (b_row, b_end)))
        a_size, b_size = np.diff(self.a_bytes[1])[a_id], np.diff(self.b_bytes[1])[b_id]
        bad = np.zeros(rows, bool)
        bad[self._differs(a_id, self.a_bytes, a_row, data, base)] = True
        bad[self._differs(b_id, self.b_bytes, b_row, data, base)] = True
        a_stop, wrong = self._refined(a_begin, a_end, a_size, a_row, base)
        bad[wrong] = True
        b_stop, wrong = self._refined(b_begin, b_end, b_size, b_row, base)
        bad[wrong] = True
        keep_a, keep_b = ~bad[a_row], ~bad[b_row]
        a_id, a_stop, b_id, b_stop = a_id[keep_a], a_stop[keep_a], b_id[keep_b], b_stop[keep_b]
        # Every stretch between neighbouring ends, of either side, is one overlapping pair.
        both = np.sort(np.concatenate((a_stop, b_stop)), kind="stable")
        same = both[1:] == both[:-1]
        ends, cuts = both[np.append(~same, np.ones(min(len(both), 1), bool))], both[1:][same]
        link_a, link_b = np.searchsorted(a_stop, ends), np.searchsorted(b_stop, ends)
        links = (a_id[link_a] * self.b_size + b_id[link_b]).astype(np.int64)
        # Within a group first A's ids, then B's: a token's place is its own number and the other side's tokens before it.
        a_group, b_group = np.searchsorted(cuts, a_stop), np.searchsorted(cuts, b_stop)
        a_before = np.concatenate(([0], np.cumsum(np.bincount(a_group, minlength=len(cuts)))))
        b_before = np.concatenate(([0], np.cumsum(np.bincount(b_group, minlength=len(cuts)))))
        a_place, b_place = np.arange(len(a_id)) + b_before[a_group], np.arange(len(b_id)) + a_before[b_group + 1]
        written = np.zeros((len(a_id) + len(b_id), self.width + 1), np.uint8)
        written[a_place, :-1], written[b_place, :-1] = self.digits[a_id], self.digits[b_id]
        written[:, -1] = ord(",")
        written[a_place[a_before[1:] - 1], -1] = ord("|")
        written[b_place[b_before[1:] - 1], -1] = ord(";")
        flat = written.reshape(-1)
        solid = flat != 0
        sizes = np.concatenate(([0], np.cumsum(solid.reshape(written.shape).sum(1))))
        out = flat[solid].tobytes()
        a_cut, link_cut = np.searchsorted(a_stop, text_at, side="right"), np.searchsorted(ends, text_at, side="right")
        token_cut = a_cut + np.searchsorted(b_stop, text_at, side="right")
        raw = links.tobytes()
        char_cut = sizes[token_cut].tolist()
        a_cut, link_cut = a_cut.tolist(), link_cut.tolist()
        lost = np.repeat(bad, np.diff(first)).tolist()
        found = [None if lost[k] else (out[char_cut[k] : char_cut[k + 1] - 1], raw[8 * link_cut[k] : 8 * link_cut[k + 1]], a_cut[k + 1] - a_cut[k]) for k in range(len(texts))]
        # A line that does not match tells nothing of its texts.
        again = np.flatnonzero(np.repeat(bad & (np.diff(first) > 1), np.diff(first))).tolist()
        if again:
            for k, own in zip(again, self.align([texts[k] for k in again], alone=True), strict=True):
                found[k] = own
        return found

    # --- texts of any length ---------------------------------------------------------------------------------------

    def _known(self, wanted: list[str]) -> list[tuple[bytes, bytes, int] | None]:
        """The alignments of all wanted pieces, named without the blank in front; long ones are not remembered."""
        young, old = self.young, self.old
        known = [young.get(piece, _NEW) for piece in wanted]
        missing = []
        for k, found in enumerate(known):
            if found is _NEW:
                piece = wanted[k]
                if piece in old:
                    known[k] = young[piece] = old[piece]
                else:
                    missing.append(k)
        for at in range(0, len(missing), BATCH):
            part = missing[at : at + BATCH]
            for k, found in zip(part, self.align([" " + wanted[k] for k in part]), strict=True):
                known[k] = found
                if len(wanted[k]) < PIECE_CHARS:
                    young[wanted[k]] = found
        if len(young) > PIECES:
            self.young, self.old = {}, young
        return known

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different pieces of all texts with a blank in front, named without it; the texts' pieces by their numbers
        there, and the n+1 places where a text's begin. Empty texts have none."""
        column = pa.array(texts, pa.large_utf8())
        empty = pa.compute.equal(column, "")
        by_hand = pa.compute.or_(empty, pa.compute.match_substring_regex(column, _UNSAFE) if self.cuts else True)
        split = pa.compute.split_pattern(pa.compute.if_else(by_hand, pa.scalar(None, column.type), column), " ")
        plain, at = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        begin, size = at[:-1] - at[0], np.diff(at)
        rest = []
        for k in np.flatnonzero(by_hand.to_numpy(zero_copy_only=False)).tolist():
            own = ([p[1:] for p in pieces(" " + texts[k])] if self.cuts else [texts[k]]) if texts[k] else []
            begin[k], size[k] = len(plain) + len(rest), len(own)
            rest += own
        coded = pa.concat_arrays([plain, pa.array(rest, plain.type)]).dictionary_encode()
        row_at = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(row_at[-1]) + np.repeat(begin - row_at[:-1], size)
        return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)[place], row_at

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, int] | None]:
        """``align`` for texts without the blank in front, by remembered pieces. Empty texts are None."""
        wanted, piece, row_at = self._cut(texts)
        known = self._known(wanted)
        lost = np.array([f is None for f in known], bool)
        known = [f or (b"", b"", 0) for f in known]
        written = pa.array([f[0] for f in known], pa.large_binary()).take(pa.array(piece))
        groups = pa.compute.binary_join(pa.LargeListArray.from_arrays(row_at, written), pa.scalar(b";", pa.large_binary()))
        linked = [f[1] for f in known]
        flat, sizes = np.frombuffer(b"".join(linked), np.int64), np.array([len(f) // 8 for f in linked], np.int64)
        begin, size = (np.cumsum(sizes) - sizes)[piece], sizes[piece]
        link_at = np.concatenate(([0], np.cumsum(size)))
        links = flat[np.arange(link_at[-1]) + np.repeat(begin - link_at[:-1], size)]
        link_at = link_at[row_at].tolist()
        n_a = np.diff(np.concatenate(([0], np.cumsum(np.array([f[2] for f in known], np.int64)[piece])))[row_at]).tolist()
        n_lost = np.diff(np.concatenate(([0], np.cumsum(lost[piece])))[row_at]).tolist()
        for k, text in enumerate(texts):
            if not text:
                yield None
            elif n_lost[k]:
                # A piece does not match; the verdict is that over the whole text.
                yield self.align([" " + text])[0] if row_at[k + 1] - row_at[k] > 1 else None
            else:
                yield groups[k].as_py(), links[link_at[k] : link_at[k + 1]].tobytes(), n_a[k]


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """A document's distinct pairs, ascending, as differences, and how often each occurs."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate((np.diff(pairs, prepend=0), times)).astype(np.int64).tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, the counts of one document, its digest, its block, and its distinct links with their numbers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, filled = Pair(a_path, b_path), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            # Remembered pieces are many small objects without cycles; the collector would only walk them again and again.
            gc.disable()
            for first, part in slices(batch.column(1)):
                texts = part.fill_null("").to_pylist()
                rows = []
                for found in pair.texts(texts):
                    if found is None:
                        rows.append((0, 0, 0, 0, "", None, None))
                        continue
                    groups, raw, n_a = found
                    links = np.frombuffer(raw, np.int64)
                    n_groups, n_links = groups.count(b";") + 1, len(links)
                    if filled and filled + n_links > BLOCK_LINKS:
                        block, filled = block + 1, 0
                    filled += n_links
                    rows.append((n_a, n_links + n_groups - n_a, n_groups, n_links, hashlib.sha256(groups).hexdigest(), block, _packed(*np.unique(links, return_counts=True))))
                columns = list(zip(*rows, strict=True))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "links"],
                )
            gc.enable()

    return docs.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, links binary")


def alignments(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A blank and the text are encoded by the byte-level ``tokenizers`` file ``a_path`` and by the ``sentencepiece`` model
    ``b_path`` (which adds the blank itself), special strings as plain text. Offsets where tokens of both end cut the tokens
    into groups; an A and a B token whose bytes overlap are a link. A pair's count is the number of rows that hold it
    linked; ``n_best`` counts links whose count is the highest of their A id, ``count_sum`` adds up the links' counts.

    Null and empty texts, and texts whose joined token bytes are not the blank and the text (as those with the model's own
    blank U+2581 in them), have zeros and an empty ``groups_sha256``. Every row is kept; repeated rows count as documents of
    their own; keys may be null or repeated; other columns are left out; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = checkpoint(_blocks(docs, a_path, b_path))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def result() -> pa.RecordBatch:
            pairs, docs = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), now)), pa.array(pairs), pa.array(docs)], ["block", "pair", "docs"])

        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and block != now:
                    yield result()
                    held = []
                now = block
                held.append(_unpacked(blob)[0])
        if held:
            yield result()

    used = found.where("block is not null").select("block", "links").mapInArrow(asked, "block long, pair long, docs long")
    used = checkpoint(used.groupBy("block", "pair").agg(F.sum("docs").alias("docs")))
    size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    counts = used.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pair div {size}"))
    counts = checkpoint(counts)
    counts = counts.join(counts.groupBy("a").agg(F.max("count").alias("best")), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    answers = used.select("block", "pair").join(counts, "pair")

    def answered(rows: pa.Table, known: pa.Table) -> pa.Table:
        pairs = known["pair"].to_numpy()
        order = np.argsort(pairs)
        pairs, count, best = pairs[order], known["count"].to_numpy()[order], known["is_best"].to_numpy()[order]
        n_best, total = [], []
        for blob in rows["links"].to_pylist():
            own, times = _unpacked(blob)
            at = np.searchsorted(pairs, own)
            n_best.append(int(times[best[at]].sum()))
            total.append(int((times * count[at]).sum()))
        kept = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", rows["groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    linked = found.where("block is not null").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answered, schema)
    none = found.where("block is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
    return linked.unionByName(none).withColumnRenamed("doc_id", key)


def alignment_query(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: tokens of both sides, groups, links, and how common the links are."""
    return alignments(docs.select("doc_id", "text"), a_path, b_path)
