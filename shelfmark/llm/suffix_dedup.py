"""Removal of repeated byte strings with suffix arrays, dealt out over the cluster by anchors.

Every ``length``-byte string has an anchor: of its GRAM-byte grams the one with the smallest hash, the leftmost of equals.
Equal strings have equal anchors, so strings are compared only where their anchors meet. The strings of one anchor start
side by side; together they are its region, a stretch of under twice ``length`` bytes.

1. Regions whose whole bytes occur twice are repeated from end to end. That takes a digest each and no text.
2. Where one anchor has different regions, one copy of each goes to the task of that anchor, which builds the suffix array
   of all its regions in two stages: suffixes smaller than their successors are sorted directly, the rest is induced by
   scanning the buckets, and common prefixes of neighbours then show which strings occur twice.
3. An anchor with more regions than a task should hold has its strings dealt out again, by how far they start before the
   anchor (STEP at a time) and by the bytes that all strings of such a part have in common; its parts then go through 1
   and 2. A part that is still too large is settled by digests of its single strings.

Spans are then joined to the documents by digest of the text, and cut out.

Passages of words go the same way as strings of word hashes: there a place is a word and a unit has eight bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import _MIX2, _power_tables, buffer_of, mix, picked, slices, small_batches, word_hashes, word_spans
from shelfmark.session import checkpoint, written

#: Bytes of a gram. Must be less than the length of the strings.
GRAM = 32
#: Words of a gram where passages are compared by words.
WORD_GRAM = 4
#: Bytes of regions of which one suffix array is built; an anchor whose regions are larger takes the third way.
ARRAY_BYTES = 1 << 20
#: Bytes of text that a task takes apart at once, and of regions that it gathers for one suffix array. Both bound what a
#: Python worker holds, of which an executor has two for each core where one function follows another.
TASK_BYTES = 1 << 18
#: Bytes of a place: one, or where passages are compared by words those of a word's hash.
WORD = 8
#: Bytes that the starts of a part of a too large anchor span.
STEP = 64
_PLACE = 28
#: Stands between regions; no byte of UTF-8.
_BORDER = b"\xff"


# --- anchors and regions ----------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (or words' hashes) at each place but the last ones."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[gram:] - sums[:-gram]) * down[:n] + _MIX2)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbouring values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def regions(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first start (in the data), number of starts and anchor hash of every region."""
    gram = min(gram, length)
    counts = np.maximum(0, np.diff(offsets) - length + 1)
    total = int(counts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(data, gram)
    low = np.uint64((1 << _PLACE) - 1)
    least = sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    row = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    anchors = (least[starts] & low).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1]))))
    return row[fresh], starts[fresh], np.diff(np.append(fresh, total)), hashes[anchors[fresh]]


# --- suffix arrays ----------------------------------------------------------------------------------------------


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """The suffixes of ``data`` in order of their first ``depth`` bytes, in two stages."""
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    if n < 2:
        return np.arange(n)
    # A suffix is smaller than its successor if the next other byte is larger; the end counts as the smallest.
    turns = np.append(np.flatnonzero(text[:-1] != text[1:]), n - 1)
    rises = np.append(text[turns[:-1] + 1] > text[turns[:-1]], False)
    smaller = rises[np.searchsorted(turns, np.arange(n))]
    direct = np.flatnonzero(smaller)
    pair = (text[direct].astype(np.int32) << 8) | text[direct + 1]
    order = np.argsort(pair, kind="stable")
    cuts = np.flatnonzero(np.diff(pair[order])) + 1
    by_byte: list[list[int]] = [[] for _ in range(256)]
    for bucket in np.split(direct[order], cuts):
        found = bucket.tolist()
        if len(found) > 1:
            found.sort(key=lambda i: data[i : i + depth])
        if found:
            by_byte[data[found[0]]] += found
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))

    def induce(scanned: np.ndarray, byte: int) -> None:
        """Put the predecessors that are not smaller behind what their own buckets already hold."""
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before]]
        firsts = text[before]
        order = np.argsort(firsts, kind="stable")
        for part in np.split(before[order], np.flatnonzero(np.diff(firsts[order])) + 1):
            if len(part):
                induced[text[part[0]]].append(part)

    out = []
    for byte in range(256):
        at = 0
        while at < len(induced[byte]):  # grows by runs of the same byte
            induce(induced[byte][at], byte)
            at += 1
        out += induced[byte]
        sorted_ = np.array(by_byte[byte], dtype=np.int64)
        if len(sorted_):
            induce(sorted_, byte)
            out.append(sorted_)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """The length of the common prefix of each two neighbours, up to ``most`` (rounded up to eights)."""
    padded = np.concatenate((text, np.zeros(most + 16, np.uint8)))
    words = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,))
    left, right = array[:-1], array[1:]
    out = np.zeros(len(left), np.int64)
    live = np.arange(len(left))
    for at in range(0, most, 8):
        differ = words[left[live] + at] ^ words[right[live] + at]
        ends = differ != 0
        if ends.any():
            low = differ[ends] & (~differ[ends] + np.uint64(1))
            out[live[ends]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            live = live[~ends]
        if not len(live):
            break
    out[live] = -(-most // 8) * 8
    return out


def repeated_starts(parts: list[tuple[bytes, int]], length: int, unit: int = 1) -> list[np.ndarray]:
    """For regions (bytes, number of starts): at which starts a string begins that begins at another start, too. ``length``
    and starts count places of ``unit`` bytes. Equal strings have equal hashes, so only what lies under hashes that occur
    twice is sorted."""
    values = _places(b"".join(b for b, _ in parts), unit)
    begins = np.cumsum([0] + [len(b) // unit for b, _ in parts])[:-1]
    counts = np.array([n for _, n in parts])
    part = np.repeat(np.arange(len(parts)), counts)
    start = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = gram_hashes(values, length)[begins[part] + start]
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    none = np.zeros(0, np.int64)
    if not len(twice):
        return [none] * len(parts)
    may = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes)
    part, start = part[may], start[may]
    heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = np.append(heads[1:], len(part))
    some = [parts[p][0][first * unit : (last + length) * unit] for p, first, last in zip(part[heads].tolist(), start[heads].tolist(), start[ends - 1].tolist(), strict=True)]
    border = _BORDER * unit
    data = border.join(some)
    shift = np.cumsum([0] + [len(b) + unit for b in some])[:-1]
    places = np.repeat(shift - start[heads] * unit, ends - heads) + start * unit
    wanted = np.zeros(len(data), bool)
    wanted[places] = True
    if 4 * len(places) < len(data):
        array = np.array(sorted(places.tolist(), key=lambda i: data[i : i + length * unit]))
    else:
        array = suffix_array(data, length)
        array = array[wanted[array]]
    alike = common_prefixes(np.frombuffer(data, np.uint8), array, length * unit) >= length * unit
    hit = np.zeros(len(data), bool)
    hit[array[:-1][alike]] = True
    hit[array[1:][alike]] = True
    hit = hit[places]
    out = [none] * len(parts)
    for p, a, b in zip(part[heads].tolist(), heads.tolist(), ends.tolist(), strict=True):
        out[p] = start[a:b][hit[a:b]]
    return out


def _places(data: bytes, unit: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if unit == 1 else np.uint64)


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cuts + 1)].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist(), strict=True))


# --- the operator -----------------------------------------------------------------------------------------------


def _key(text: Column) -> Column:
    """128 bits of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _data(texts: pa.Array, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, or the hashes of the words, of texts and the n+1 offsets of the rows."""
    data, offsets = buffer_of(texts)
    if unit == 1:
        return data, offsets
    starts, ends, bounds = word_spans(data, offsets)
    return word_hashes(data, starts, ends), bounds


def _spans(docs: DataFrame, length: int, unit: int = 1) -> DataFrame:
    """(key, start, stop): stretches of texts, named by their digest, that repeated strings cover; they may overlap.
    ``length``, ``start`` and ``stop`` are bytes; with ``unit`` WORD, words."""
    gram = GRAM if unit == 1 else WORD_GRAM

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(at, len(part)) for batch in batches for at, part in slices(batch.column(1), TASK_BYTES))
        for batch in parts:
            data, offsets = _data(batch.column(1), unit)
            row, first, starts, hashes = regions(data, offsets, length, gram)
            plain = data.tobytes()
            digests = [hashlib.blake2b(plain[a:b], digest_size=16).digest() for a, b in zip((first * unit).tolist(), ((first + starts - 1 + length) * unit).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(digests, pa.binary()), batch.column(0).take(pa.array(row)), pa.array(first - offsets[row]), pa.array(starts)],
                ["anchor", "digest", "key", "first", "starts"],
            )

    long = docs.where(F.octet_length("text") >= (length if unit == 1 else 2 * length - 1))
    every = checkpoint(long.mapInArrow(anchor, "anchor long, digest binary, key binary, first long, starts long"))
    # Most anchors occur once; their regions need no more than a count.
    shared = checkpoint(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("anchor"))
    found = checkpoint(picked(every, shared, "anchor"))
    kinds = checkpoint(
        found.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("key", "first", "starts")).alias("one"))
        .select("anchor", "digest", "held", "one.*")
    )
    whole = found.join(kinds.where("held > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("key", "first", "starts").distinct()
    whole = whole.select("key", F.col("first").alias("start"), (F.col("first") + F.col("starts") - 1 + length).alias("stop"))

    size = (F.col("starts") + length) * unit
    open_ = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("held").alias("least"), F.sum(size).alias("size")).where("kinds > 1 AND least = 1")
    ask = kinds.join(open_.select("anchor", "size"), "anchor")
    one = docs.groupBy("key").agg(F.min("id").alias("id"))  # of equal texts one row is read
    asked = checkpoint(ask.groupBy("key").agg(F.collect_list(F.struct("anchor", "digest", "held", "first", "starts", "size")).alias("asked")).join(one, "key"))
    texts = picked(docs, asked, "key")
    texts = texts.join(asked, [texts["key"] == asked["key"], texts["id"].eqNullSafe(asked["id"])]).select(texts["key"], texts["text"], "asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(at, len(part)) for batch in batches for at, part in slices(batch.column(1), TASK_BYTES)):
            data, offsets = _data(batch.column(1), unit)
            plain = data.tobytes()
            row = np.repeat(np.arange(len(batch)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            anchors, digests, held, first, starts, sizes = batch.column(2).flatten().flatten()
            begin = offsets[row] + first.to_numpy()
            stop = begin + starts.to_numpy() - 1 + length
            some = [plain[a:b] for a, b in zip((begin * unit).tolist(), (stop * unit).tolist(), strict=True)]
            columns = [anchors, digests, held, batch.column(0).take(pa.array(row)), first, sizes, pa.array(some, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "digest", "held", "key", "first", "size", "bytes"])

    cuts = checkpoint(texts.mapInArrow(cut, "anchor long, digest binary, held long, key binary, first long, size long, bytes binary").dropDuplicates(["anchor", "digest"]))
    fits = F.col("size") <= ARRAY_BYTES
    again = _parts(cuts.where(~fits), length, unit)
    part_fits = F.col("size") <= ARRAY_BYTES
    stop = F.col("first") + (F.octet_length("bytes") / unit).cast("long")
    return (
        whole.unionByName(_by_array(cuts.where(fits), length, unit))
        .unionByName(again.where("held = 1 AND copies > 1").select("key", F.col("first").alias("start"), stop.alias("stop")))
        .unionByName(_by_array(again.where(part_fits & (F.col("turn") == 1)).withColumn("held", F.greatest("held", "copies")), length, unit))
        .unionByName(_by_digest(again.where(~part_fits & (F.col("turn") == 1)).withColumn("held", F.greatest("held", "copies")), length, unit))
    )


def _parts(large: DataFrame, length: int, unit: int) -> DataFrame:
    """The strings of too large anchors in parts: those that start within the same STEP bytes before their anchor and
    have the same bytes from the last of these places to the end of the first string. ``copies``: rows with the same
    bytes; ``turn``: number of a row among them; ``size``: bytes of a part's different rows.
    """
    gram = min(GRAM if unit == 1 else WORD_GRAM, length)
    step = min(max(1, STEP // unit), length - gram + 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for anchor, held, key, first, plain in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = gram_hashes(_places(plain, unit), gram)
                place = int(np.argmax(hashes == np.uint64(anchor & (1 << 64) - 1)))
                for n in range(place // step + 1):
                    last = place - n * step
                    begin, stop = max(0, last - step + 1), min(last, len(plain) // unit - length)
                    if begin > stop:
                        continue
                    core = hashlib.blake2b(plain[last * unit : (last - step + 1 + length) * unit], digest_size=8, key=n.to_bytes(4, "little") + (anchor & (1 << 64) - 1).to_bytes(8, "little"))
                    some = plain[begin * unit : (stop + length) * unit]
                    values = (int.from_bytes(core.digest(), "little", signed=True), hashlib.blake2b(some, digest_size=16).digest(), held, key, first + begin, some)
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "digest", "held", "key", "first", "bytes"])

    parts = checkpoint(large.select("anchor", "held", "key", "first", "bytes").mapInArrow(split, "anchor long, digest binary, held long, key binary, first long, bytes binary"))
    kinds = parts.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "first")).alias("one"), F.first(F.octet_length("bytes")).alias("bytes_of"))
    kinds = checkpoint(kinds.withColumnRenamed("anchor", "_a").withColumnRenamed("digest", "_d"))
    sizes = kinds.groupBy(F.col("_a").alias("_s")).agg(F.sum("bytes_of").alias("size"))
    known = kinds.join(sizes, kinds["_a"] == sizes["_s"]).drop("_s", "bytes_of")
    found = parts.join(known, (parts["anchor"] == known["_a"]) & (parts["digest"] == known["_d"])).drop("_a", "_d")
    return checkpoint(found.withColumn("turn", F.when((F.col("key") == F.col("one.key")) & (F.col("first") == F.col("one.first")), 1).otherwise(2)).drop("one"))


def _by_array(regions_: DataFrame, length: int, unit: int) -> DataFrame:
    """Spans of the rows held once, from suffix arrays over all regions of an anchor."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor. Anchors are gathered until their regions have TASK_BYTES."""
        held: list[tuple] = []
        size, last = 0, None

        def settle() -> pa.RecordBatch:
            keys, begins, ends = [], [], []
            for (_, times, key, first, _plain), starts in zip(held, repeated_starts([(h[4], len(h[4]) // unit - length + 1) for h in held], length, unit), strict=True):
                if times == 1:  # the others are covered already
                    for a, b in runs(starts):
                        keys.append(key), begins.append(first + a), ends.append(first + b + length)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["key", "start", "stop"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size > TASK_BYTES:
                    yield settle()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield settle()

    rows = regions_.select("anchor", "held", "key", "first", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(arrays, "key binary, start long, stop long")


def _by_digest(regions_: DataFrame, length: int, unit: int) -> DataFrame:
    """Spans of the rows held once, from digests of their single strings, counted in each task before they meet."""
    singles = regions_.select("held", "key", "first", "bytes", F.explode(F.sequence(F.lit(1), (F.octet_length("bytes") / unit).cast("int") - length + 1)).alias("at"))
    singles = checkpoint(singles.select("held", "key", (F.col("first") + F.col("at") - 1).alias("start"), F.substring(F.unhex(F.sha2(F.substring("bytes", (F.col("at") - 1) * unit + 1, F.lit(length * unit)), 256)), 1, 16).alias("string")))
    twice = singles.groupBy("string").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("string")
    return singles.where("held = 1").join(twice, "string").select("key", "start", (F.col("start") + length).alias("stop"))


def remove_repeats(
    docs: DataFrame, length: int = 400, text: str = "text", key: str = "doc_id", least_words: int | None = None, apart: bool = False, as_text: bool = False
) -> DataFrame:
    """Add ``spans`` (array of struct start, stop in bytes: maximal, in order) and ``kept`` (the other bytes, binary).

    A byte is covered if a string of ``length`` bytes over it also starts anywhere else, in the same text or another
    row's; all is judged on the input. A text of at least ``length`` bytes that two rows have is covered whole in both;
    shorter, empty and null texts have no spans (kept: their bytes; null: empty). ``key`` may be null or repeated; it only
    spares reading all copies of a text. Rows and other columns stay, columns of the added names are replaced; an empty
    table gives an empty one.

    With ``least_words``, passages of so many words (runs outside blanks and 0x09-0x0D) that also start anywhere else are
    covered as well, from their first word to their last, however few bytes they have and whatever blanks part the words.
    With ``apart`` they are only told, as ``passages`` (like ``spans``, which then has the strings alone), and stay in
    ``kept``. With ``as_text``, ``kept`` is a string, without characters that a cut left in part.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("spans", "kept", *(["passages"] if apart else []))
    base = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).alias("id")).withColumn("key", _key(F.col("text")))
    spans = written(docs.sparkSession, lambda: _spans(base.select("key", "text", "id"), length)).withColumn("by_words", F.lit(False))
    if least_words:
        by_words = written(docs.sparkSession, lambda: _spans(base.select("key", "text", "id"), least_words, WORD))
        spans = spans.unionByName(by_words.withColumn("by_words", F.lit(True)))
    ordered = F.array_sort(F.collect_set(F.struct("start", "stop", "by_words")))
    merged = spans.groupBy(F.col("key").alias("__dedup_key")).agg(ordered.alias("__dedup_found"))
    merged = merged.select("__dedup_key", *(F.col(f"__dedup_found.{a}").alias(f"__dedup_{b}") for a, b in (("start", "starts"), ("stop", "stops"), ("by_words", "by_words"))))
    with_key = docs.withColumn("__dedup_own", _key(F.coalesce(F.col(text), F.lit(""))))
    joined = with_key.join(merged, with_key["__dedup_own"] == merged["__dedup_key"], "left").drop("__dedup_own", "__dedup_key")
    names = joined.columns
    at, starts_at, stops_at, words_at = (names.index(n) for n in (text, "__dedup_starts", "__dedup_stops", "__dedup_by_words"))
    keep = [i for i, n in enumerate(names) if i not in (starts_at, stops_at, words_at)]
    out_names = [*docs.columns, "spans", "kept", *(["passages"] if apart else [])]
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", kind), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    if apart:
        schema = schema.add("passages", kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans stay arrays throughout: a text of one short line over and over has one for every few bytes."""
        for batch in batches:
            found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
            kept = []
            for text_, first, last, by_words in zip(*(batch.column(i) for i in (at, starts_at, stops_at, words_at)), strict=True):
                plain = (text_.as_py() or "").encode()
                spans_ = passages = _NONE
                if first.is_valid:
                    start, stop, words = first.values.to_numpy(), last.values.to_numpy(), by_words.values.to_numpy(zero_copy_only=False)
                    if apart:
                        spans_, passages = (_joined(*_in_bytes(plain, start[some], stop[some], words[some])) for some in (~words, words))
                    else:
                        spans_ = _joined(*_in_bytes(plain, start, stop, words))
                    edges = [0, *np.stack(spans_, axis=1).ravel().tolist(), len(plain)]
                    plain = b"".join([plain[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(plain.decode("utf-8", errors="ignore") if as_text else plain)
                found[0].append(spans_), found[1].append(passages)
            lists = [_as_lists(rows) for rows in found]
            columns = [*(batch.column(i) for i in keep), lists[0], pa.array(kept, pa.string() if as_text else pa.binary()), *(lists[1:] if apart else [])]
            yield pa.RecordBatch.from_arrays(columns, out_names)

    return joined.mapInArrow(cut, schema)


def _in_bytes(plain: bytes, starts: np.ndarray, stops: np.ndarray, by_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of their starts, those of words as bytes of the text."""
    starts, stops = starts.copy(), stops.copy()
    if by_words.any():
        first, last, _ = word_spans(np.frombuffer(plain, np.uint8), np.array([0, len(plain)]))
        starts[by_words], stops[by_words] = first[starts[by_words]], last[stops[by_words] - 1]
    order = np.argsort(starts, kind="stable")
    return starts[order], stops[order]


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _as_lists(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """Starts and stops of each row as a column of arrays of structs."""
    pairs = [pa.array(np.concatenate([_NONE[0], *(r[i] for r in rows)])) for i in (0, 1)]
    ends = np.cumsum([0, *(len(r[0]) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(pairs, ["start", "stop"]))


def _joined(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of their starts, those that touch or overlap as one."""
    if not len(starts):
        return _NONE
    reach = np.maximum.accumulate(stops)
    fresh = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return starts[fresh], np.append(reach[fresh[1:] - 1], reach[-1])


def dedup_query(docs: DataFrame, least_words: int = 51) -> DataFrame:
    """One row per document: bytes, bytes removed, spans removed, the digest of what is left, and the bytes under passages
    of ``least_words`` words that start anywhere else, too, however short these are (they are not removed)."""
    done = remove_repeats(docs, least_words=least_words, apart=True)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["stop"] - p["start"]).alias("n_passage_bytes"),
    )
