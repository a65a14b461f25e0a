"""The persisted search index: where every three-character gram of the chunks stands.

Chunks lie in blocks of about a megabyte of text. A posting row holds all places of one gram in one block; places
are numbers that say both which column of which chunk and where in it, so a needle of any length is found by shifting and
intersecting a few of its grams' places: no text is read. At the end of a column grams are filled up, which makes needles
of one or two characters a range of grams. Places are kept as steps from one to the next, seven bits a byte. Every task sorts
the rows of its blocks by gram and writes them, so a search reads the pages of its own grams in each file; postings and segments
are made by one pass and written once. Nothing is shuffled, and a gram that every block holds lies in all files.

Changes are folded in as generations: the chunks of new and edited documents become blocks of their own, and a removed
document leaves a tombstone for what older generations hold of it. ``compact`` makes one generation of all, from the
postings alone. Every generation is a folder that is written whole before its name is listed, so a search that runs
meanwhile, or a job that fails, sees the old state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.functions import terms as T
from shelfmark.session import checkpoint

WEIGHTS = {"title": 3, "heading": 2, "content": 1}
#: Characters of a block, about; and of one array's places: a place is below 2^31.
BLOCK_CHARS = 1 << 20
PLACES = 1 << 31
#: A code point takes so many bits of a gram; this one stands behind the end of a column.
BITS, END = 21, 0x110000
#: Packed bytes that a task unpacks at once; the numbers made of them take some eighty times as much.
UNPACKED = 1 << 20
#: Up to so many grams are named to the scan, which then skips row groups; more are joined with all postings.
NAMED_GRAMS = 256

POSTING = "gram bigint, block bigint, bits int, places binary"


@dataclass(frozen=True)
class SearchIndex:
    """A folder of generations, oldest first, each with the tombstones of those before it; ``made`` counts all ever made."""

    path: str
    generations: tuple[str, ...] = ()
    made: int = 0

    def _read(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        parts = [spark.read.schema(schema).parquet(f"{self.path}/{g}/{table}").withColumn("gen", F.lit(n)) for n, g in enumerate(self.generations)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _rows(self, spark: SparkSession, part: str, schema: str) -> DataFrame:
        return self._read(spark, "rows", f"{schema}, part string").where(F.col("part") == part).drop("part")

    def postings(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "postings", POSTING)

    def kinds(self, spark: SparkSession) -> tuple[str, str]:
        """Types of chunk and document ids."""
        schema = spark.read.parquet(f"{self.path}/{self.generations[0]}/dead").schema
        return schema["chunk_id"].dataType.simpleString(), schema["doc_id"].dataType.simpleString()

    def _every(self, spark: SparkSession) -> DataFrame:
        chunk, doc = self.kinds(spark)
        return self._rows(spark, "segments", f"block bigint, segment int, chunk_id {chunk}, doc_id {doc}, tokens bigint, weight int")

    def segments(self, spark: SparkSession) -> DataFrame:
        """block, segment, chunk_id, doc_id, tokens, weight of every living chunk's columns."""
        rows = self._every(spark)
        if len(self.generations) == 1:
            return rows.drop("gen")
        dead = self._read(spark, "dead", f"doc_id {self.kinds(spark)[1]}").groupBy("doc_id").agg(F.max("gen").alias("until"))
        return rows.join(dead, "doc_id", "left").where("until is null or gen >= until").drop("until", "gen")

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row: chunk count and mean tokens, as ``keyword.corpus_stats`` of the chunks."""
        each = self.segments(spark).where("weight = 1")
        return each.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("tokens").alias("mean_tokens"))


def _packed(places: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows of rising places as bytes: the first place, then steps, seven bits a byte, the high bit set if more follow.

    ``first``: where each row starts among the places; no row is empty.
    """
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    size = 1 + sum((steps >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[ends[some] - size[some] + k] = (steps[some] >> 7 * k) & 127 | (size[some] > k + 1).astype(np.int64) << 7
    offsets = np.append((ends - size)[first], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _unpacked(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All places of packed rows (no nulls), and where each row starts among them, with the end of the last."""
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64) if len(rows) else np.zeros(1, np.int64)
    data = rows.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(rows) + 1, np.int64)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    at = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    total = np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << 7 * at, starts))
    first = np.append(0, np.cumsum(last))[offsets - offsets[0]]
    before = np.append(0, total)[first[:-1]]
    return total - np.repeat(before, np.diff(first)), first


def _bounded(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with at most ``UNPACKED`` packed bytes, or of one row: a batch of Spark's holds what the rows of
    a common gram have in thousands of blocks. ``sizes``: packed bytes of each row."""
    for batch in batches:
        ends, low = np.cumsum(sizes(batch)), 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + UNPACKED, side="right")))
            yield batch.slice(low, high - low)
            low = high


def _posting_sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Packed bytes of posting rows."""
    return pc.binary_length(batch.column(3)).to_numpy().astype(np.int64)


def _listed_sizes(batch: pa.RecordBatch) -> np.ndarray:
    """Packed bytes of rows that list postings."""
    lists = batch.column(4)
    before = np.append(0, np.cumsum(pc.binary_length(lists.flatten().field(1)).to_numpy().astype(np.int64)))
    return np.diff(before[lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)])


def _postings(chunks: DataFrame, base: int) -> DataFrame:
    """Postings and segments (gram is null) of chunks with lower-case columns; blocks are numbered from ``base`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        about: list[tuple] = []
        chars, longest, number = 0, 0, base + (TaskContext.get().partitionId() << 24)

        def block() -> Iterator[pa.RecordBatch]:
            bits = max(1, int(longest).bit_length())
            # Contents first, empty columns last: the places of a gram then lie closer, and their steps are shorter.
            order = sorted(range(len(held)), key=lambda n: (not len(held[n]), about[n][-1]))
            grams, places = [], []
            for segment, text in enumerate(held[n] for n in order):
                padded = np.concatenate((text, [END, END])).astype(np.int64)
                grams.append((padded[:-2] << (2 * BITS)) | (padded[1:-1] << BITS) | padded[2:])
                places.append((segment << bits) + np.arange(len(text), dtype=np.int64))
            gram, place = np.concatenate(grams), np.concatenate(places)
            by_gram = np.argsort(gram, kind="stable")
            gram, place = gram[by_gram], place[by_gram]
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
            n, m = len(first), len(about)
            columns = [range(m), *zip(*(about[n] for n in order), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(gram[first]), pa.nulls(m, pa.int64())]), pa.array(np.full(n + m, number)), pa.array(np.full(n + m, bits, np.int32)),
                    pa.concat_arrays([_packed(place, first), pa.nulls(m, pa.binary())]), *[pa.concat_arrays([pa.nulls(n, t), pa.array(c, t)]) for c, t in zip(columns, kinds, strict=True)],
                ],
                ["gram", "block", "bits", "places", *names],
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "doc_id", "tokens")), *(batch.column(c).to_pylist() for c in WEIGHTS), strict=True)
            for chunk, doc, tokens, *texts in rows:
                sizes = [len(t) for t in texts]
                if held and (chars + sum(sizes) > BLOCK_CHARS or (len(about) + 3) << max(longest, *sizes).bit_length() >= PLACES):
                    yield from block()
                    held, about, chars, longest, number = [], [], 0, 0, number + 1
                for text, weight in zip(texts, WEIGHTS.values(), strict=True):
                    held.append(np.frombuffer(text.encode("utf-32-le"), np.uint32))
                    about.append((chunk, doc, tokens, weight))
                chars, longest = chars + sum(sizes), max(longest, *sizes)
        if held:
            yield from block()

    names = ["segment", "chunk_id", "doc_id", "tokens", "weight"]
    ids = [chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id")]
    kinds = [pa.int32(), *[pa.string() if t == "string" else pa.int32() if t == "int" else pa.int64() for t in ids], pa.int64(), pa.int32()]
    return chunks.mapInArrow(run, f"{POSTING}, segment int, chunk_id {ids[0]}, doc_id {ids[1]}, tokens bigint, weight int")


def _written(index: SearchIndex, rows: DataFrame, dead: DataFrame) -> str:
    """Write one generation: postings and segments, sorted where they are made, and its tombstones."""
    name = uuid.uuid4().hex
    kind = rows.schema["chunk_id"].dataType
    told = rows.withColumn("part", F.when(F.col("gram").isNull(), "segments").otherwise("postings"))
    told.sortWithinPartitions("part", "gram", "block").write.partitionBy("part").option("compression", "zstd").parquet(f"{index.path}/{name}/rows")
    dead.select("doc_id").distinct().withColumn("chunk_id", F.lit(None).cast(kind)).write.parquet(f"{index.path}/{name}/dead")
    return name


#: Blocks of one generation are numbered below this.
GENERATION = 1 << 46


def build(chunks: DataFrame, path: str) -> SearchIndex:
    """An index of all chunks (chunk_id, doc_id, title, heading, content; nulls are empty) in a new folder."""
    from shelfmark.operators.keyword import lowered

    return SearchIndex(path, (_written(SearchIndex(path), _postings(lowered(chunks), 0), chunks.select("doc_id").limit(0)),), 1)


def update(index: SearchIndex, changed: DataFrame, removed: DataFrame | None = None) -> SearchIndex:
    """The index after a sync: ``changed`` holds all chunks of new and edited documents, ``removed`` the ids (doc_id) of
    deleted ones. What older generations hold of either is dead from now on; a removed id may be unknown."""
    from shelfmark.operators.keyword import lowered

    gone = changed.select("doc_id")
    gone = gone if removed is None else gone.unionByName(removed.select("doc_id"))
    name = _written(index, _postings(lowered(changed), index.made * GENERATION), gone)
    return SearchIndex(index.path, (*index.generations, name), index.made + 1)


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows without the places in dead segments (a bit each, from the lowest of each byte; null: none is dead)."""
    for batch in _bounded(batches, _posting_sizes):
        places, first = _unpacked(batch.column(3))
        count = np.diff(first)
        marks = batch.column(4).dictionary_encode()
        code = marks.indices.to_numpy(zero_copy_only=False)
        bits = [np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little") for m in marks.dictionary.to_pylist()]
        starts = np.append(0, np.cumsum([len(b) for b in bits])).astype(np.int64)
        flat = np.concatenate([*bits, np.zeros(1, np.uint8)])
        row = np.repeat(np.arange(len(count)), count)
        told = ~np.isnan(code) if code.dtype.kind == "f" else np.ones(len(code), bool)
        code = np.where(told, code, 0).astype(np.int64)
        segment = places >> batch.column(2).to_numpy()[row]
        size = np.diff(np.append(starts, starts[-1]))[code]
        at = np.where(told[row] & (segment < size[row]), starts[code[row]] + segment, len(flat) - 1)
        keep = flat[at] == 0
        left = np.bincount(row[keep], minlength=len(count))
        rows = np.flatnonzero(left)
        packed = _packed(places[keep], np.append(0, np.cumsum(left[rows]))[:-1].astype(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.select([0, 1, 2]).take(pa.array(rows)).columns, packed], ["gram", "block", "bits", "places"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segment numbers of a block as bits."""
    for batch in batches:
        out = []
        for numbers in batch.column(1).to_pylist():
            bits = np.zeros(max(numbers) + 1, np.uint8)
            bits[numbers] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "dead"])


def compact(index: SearchIndex, spark: SparkSession) -> SearchIndex:
    """One generation of all: dead places leave the postings, whose blocks stay as they are; no text is read.

    What is dead travels to the tasks as one bit for each segment of a block that has dead ones, some 350 bytes a megabyte
    of text, so the postings are sorted again where they are read, and not shuffled.
    """
    alive = index.segments(spark)
    dead = index._every(spark).select("block", "segment").join(alive.select("block", "segment"), ["block", "segment"], "left_anti")
    dead = dead.groupBy("block").agg(F.collect_set("segment").alias("dead"))  # at most a block's segments
    dead = checkpoint(dead.mapInArrow(_marks, "block bigint, dead binary"))
    rows = index.postings(spark).join(F.broadcast(dead), "block", "left").select("gram", "block", "bits", "places", "dead")
    # Blocks keep their numbers, which no later generation takes.
    both = rows.mapInArrow(_alive, POSTING).unionByName(alive, allowMissingColumns=True)
    return SearchIndex(index.path, (_written(index, both, alive.select("doc_id").limit(0)),), index.made)


def _code(text: Column, at: int | Column) -> Column:
    """Code point of a character (from 1)."""
    return F.ascii(F.substring(text, F.lit(at) if isinstance(at, int) else at, F.lit(1))).cast("bigint")


def _gram(text: Column, at: Column) -> Column:
    return F.shiftleft(_code(text, at), 2 * BITS).bitwiseOR(F.shiftleft(_code(text, at + 1), BITS)).bitwiseOR(_code(text, at + 2))


def _covers(needles: DataFrame) -> DataFrame:
    """needle, parts, off, key, width: grams that cover each needle, and where they stand in it; short needles have the
    first characters of a gram as their key."""
    n = F.length("needle")
    steps = F.array_distinct(F.concat(F.sequence(F.lit(0), n - T.GRAM, F.lit(T.GRAM)), F.array(n - T.GRAM)))
    long = needles.where(n >= T.GRAM).select("needle", steps.alias("steps"))
    long = long.select("needle", F.size("steps").alias("parts"), F.explode("steps").alias("off"))
    long = long.select("needle", "parts", "off", _gram(F.col("needle"), F.col("off") + 1).alias("key"), F.lit(3).alias("width"))
    needle = F.col("needle")
    two = F.shiftleft(_code(needle, 1), BITS).bitwiseOR(_code(needle, 2))
    short = needles.where((n < T.GRAM) & (n > 0)).select("needle", F.lit(1).alias("parts"), F.lit(0).alias("off"), F.when(n == 2, two).otherwise(_code(needle, 1)).alias("key"), n.alias("width"))
    return long.unionByName(short)


def match(index: SearchIndex, needles: DataFrame) -> DataFrame:
    """chunk_id, doc_id, tokens, needle, occ for every living chunk that holds a needle of the column ``needle``.

    ``occ`` counts overlapping occurrences, weighted by column; 0 for needles under three characters. Nulls and empty
    needles match nothing.
    """
    spark = needles.sparkSession
    covers = checkpoint(_covers(needles.select("needle").where("needle is not null").distinct()))
    postings = index.postings(spark)
    named = [(r["key"], r["width"]) for r in covers.select("key", "width").distinct().limit(NAMED_GRAMS + 1).collect()]
    if len(named) <= NAMED_GRAMS:
        # Ranges of grams as literals of the scan.
        kept = F.lit(False)
        for key, width in named:
            span = BITS * (3 - width)
            low, high = key << span, ((key + 1) << span) - 1
            kept = kept | (F.col("gram") == low if width == 3 else F.col("gram").between(low, high))
        postings = postings.where(kept)
    found = postings.limit(0).select(F.lit("").alias("needle"), F.lit(0).alias("parts"), "block", "bits", F.lit(0).alias("off"), "places") if not named else None
    for width in sorted({w for _, w in named}) if len(named) <= NAMED_GRAMS else (1, 2, 3):
        wanted = covers.where(F.col("width") == width)
        keyed = postings.withColumn("key", F.shiftright("gram", BITS * (3 - width)))
        hits = keyed.join(wanted, "key").select("needle", "parts", "block", "bits", "off", "places")
        found = hits if found is None else found.unionByName(hits)
    # A row for each cover of a long needle; a short one's grams of a block stand at different places.
    rows = found.groupBy("needle", "block", "bits", "parts").agg(F.collect_list(F.struct("off", "places")).alias("rows"))
    counted = rows.mapInArrow(_counted, "needle string, block bigint, segment int, times bigint")
    told = counted.join(index.segments(spark), ["block", "segment"])
    occ = F.when(F.length("needle") >= T.GRAM, F.sum(F.col("times") * F.col("weight"))).otherwise(0)
    return told.groupBy("chunk_id", "doc_id", "tokens", "needle").agg(occ.cast("bigint").alias("occ"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a block that hold a needle, and how often: places where all its covers stand, shifted to its start."""
    for batch in _bounded(batches, _listed_sizes):
        lists = batch.column(4)
        flat = lists.flatten()
        offs = flat.field(0).to_numpy()
        places, first = _unpacked(flat.field(1))
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        row, segment, times = [], [], []
        for i, (low, high, bits, parts) in enumerate(zip(ends[:-1], ends[1:], batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            by_off: dict[int, list[np.ndarray]] = {}
            for j in range(low, high):
                by_off.setdefault(int(offs[j]), []).append(places[first[j] : first[j + 1]] - offs[j])
            if len(by_off) < parts:
                continue
            common, *others = sorted((np.concatenate(p) for p in by_off.values()), key=len)
            for other in others:
                common = np.intersect1d(common, other, assume_unique=True)
            seen, n = np.unique(common >> bits, return_counts=True)
            row.append(np.full(len(seen), i))
            segment.append(seen)
            times.append(n)
        at, own, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, segment, times))
        yield pa.RecordBatch.from_arrays(
            [*batch.select([0, 1]).take(pa.array(at, pa.int64())).columns, pa.array(own, pa.int32()), pa.array(n, pa.int64())], ["needle", "block", "segment", "times"]
        )
