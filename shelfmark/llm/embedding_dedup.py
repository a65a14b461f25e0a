"""Near-duplicate vectors by randomised-rotation binary codes.

Every vector is scaled to length one, turned by a fixed random rotation, and kept as the signs of its coordinates: the
corner of a cube. Two numbers are stored with the code, the cosine between vector and corner and the length lost to the
rounding of a query. The inner product of a corner with another vector, whose turned coordinates are rounded to
QUERY_BITS bits, is a few AND and popcount operations; divided by the stored cosine it estimates the vectors' own inner
product without bias over rotations. Two bounds decide which pairs are computed again, exactly and in double precision:

* the angles stored with both sides bound the pair's own angle from below (angles are a metric): never wrong;
* the estimate's confidence bound, SPREADS standard deviations wide. In up to some hundred dimensions it is the wider of
  the two and decides nothing; in more dimensions a link is lost to it once in 10^9.

Which pairs are looked at at all: further random rotations deal every vector to PROBES buckets a table, named by its
largest coordinates and their signs (cross-polytope hashing). The number of coordinates a bucket is named by follows from
the number of vectors, so that a bucket's size does not grow with them, and the number of tables from the share of pairs
that may be missed exactly at the threshold (MISSED; closer pairs are missed far more seldom). Buckets larger than
BLOCK rows are compared block by block. What leaves a task is a count and a root per row, never the pairs. A pair that
meets in several buckets counts in the first of them alone. Equal vectors are one vector from the start.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.session import checkpoint

#: Bits of a rounded coordinate of a query.
QUERY_BITS = 4
#: Width of the confidence bound, in standard deviations of the estimate.
SPREADS = 6.0
#: Share of pairs exactly at the threshold that may meet in no table.
MISSED = 1e-3
#: Buckets a vector goes to in each table.
PROBES = 4
#: Rows a bucket has at most on average, rows of one block, and rows up to which groups are compared by offsets.
BUCKET = 2048
BLOCK = 4096
SMALL = 48
#: Pairs estimated at once, and pairs computed exactly at once.
PAIRS = 1 << 20
EXACT = 1 << 15
SEED = 20_011


_rotations: dict[tuple[int, int], np.ndarray] = {}
_tables: dict[tuple[int, int, float, float], int] = {}


def rotation(dim: int, number: int) -> np.ndarray:
    """The random rotation of this number, the same in every task."""
    if (dim, number) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng((SEED, dim, number)).standard_normal((dim, dim)))
        _rotations[dim, number] = q * np.sign(np.diag(r))
    return _rotations[dim, number]


def levels_for(rows: int, dim: int, bucket: int) -> int:
    """Coordinates that name a bucket, so that buckets hold ``bucket`` rows on average at most."""
    levels = 1
    while rows * PROBES > bucket * (2 * dim) ** levels and levels < 8:
        levels += 1
    return levels


def _names(turned: np.ndarray) -> np.ndarray:
    """The PROBES best buckets of rows of ``levels`` turned vectors (rows, levels, dim): sums of the largest coordinates."""
    rows, levels, dim = turned.shape
    most = min(PROBES, dim)
    size = np.abs(turned)
    top = np.argsort(-size, axis=2, kind="stable")[:, :, :most]
    value = np.take_along_axis(size, top, 2)
    code = top * 2 + (np.take_along_axis(turned, top, 2) < 0)
    total, name = value[:, 0], code[:, 0].astype(np.uint64)
    for level in range(1, levels):
        total = (total[:, :, None] + value[:, level, None, :]).reshape(rows, -1)
        name = (name[:, :, None] * np.uint64(2 * dim) + code[:, level, None, :].astype(np.uint64)).reshape(rows, -1)
        keep = np.argsort(-total, axis=1, kind="stable")[:, :PROBES]
        total, name = np.take_along_axis(total, keep, 1), np.take_along_axis(name, keep, 1)
    return name


def tables_for(dim: int, levels: int, threshold: float) -> int:
    """Tables needed so that a pair at the threshold meets in none with a chance of MISSED: by a trial on random pairs."""
    if (known := _tables.get((dim, levels, threshold, MISSED))) is not None:
        return known
    rng = np.random.default_rng((SEED, dim, levels))
    rows = max(200, min(4000, 2_000_000 // (dim * levels)))
    x = rng.standard_normal((rows, levels, dim))
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * rng.standard_normal((rows, levels, dim))
    meet = float((_names(x)[:, :, None] == _names(y)[:, None, :]).any((1, 2)).mean())
    tables = 1 if meet >= 1 - MISSED else max(1, math.ceil(math.log(MISSED) / math.log(1 - max(meet, 0.01))))
    return _tables.setdefault((dim, levels, threshold, MISSED), tables)


def bucket_names(units: np.ndarray, levels: int, threshold: float) -> np.ndarray:
    """Names of the buckets of unit vectors: (rows, tables, probes)."""
    rows, dim = units.shape
    tables = tables_for(dim, levels, threshold)
    out = np.empty((rows, tables, 0), np.uint64)
    for table in range(tables):
        turned = np.stack([units @ rotation(dim, 1 + table * levels + level) for level in range(levels)], axis=1)
        names = _names(turned)
        if not out.shape[2]:
            out = np.empty((rows, tables, names.shape[1]), np.uint64)
        out[:, table] = names
    return out


def codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary code of each unit vector in 64-bit words, and its cosine with the cube's corner that the code names."""
    rows, dim = units.shape
    turned = units @ rotation(dim, 0)
    bits = np.zeros((rows, -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = turned >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), np.abs(turned).sum(1) / math.sqrt(dim)


class Queries:
    """Turned vectors rounded to QUERY_BITS bits a coordinate, as bit planes, with what the rounding costs."""

    def __init__(self, units: np.ndarray):
        rows, dim = units.shape
        turned = units @ rotation(dim, 0)
        low = turned.min(1, initial=0.0)
        step = np.maximum((turned.max(1, initial=0.0) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
        dither = np.random.default_rng((SEED, dim)).random(dim)  # rounds up as often as down, so the estimate has no bias
        whole = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, (1 << QUERY_BITS) - 1).astype(np.uint8)
        rounded = whole * step[:, None] + low[:, None]
        padded = np.zeros((rows, -(-dim // 64) * 64), np.uint8)
        padded[:, :dim] = whole
        self.planes = [np.packbits((padded >> b) & 1, axis=1, bitorder="little").view(np.uint64) for b in range(QUERY_BITS)]
        self.low, self.step = low, step
        self.rest = step * whole.sum(1) + low * dim
        length = np.maximum(np.linalg.norm(rounded, axis=1), 1e-12)
        self.lost = np.linalg.norm(turned - rounded, axis=1)
        self.length = length
        self.angle = np.arccos(np.clip((turned * rounded).sum(1) / length, -1, 1))


def estimates(code: np.ndarray, queries: Queries, i: np.ndarray, j: np.ndarray, dim: int) -> np.ndarray:
    """Inner products of the corners of rows i with the rounded vectors of rows j; i and j broadcast."""
    count = np.zeros(np.broadcast_shapes(i.shape, j.shape), np.int32)
    ones = np.bitwise_count(code).sum(1, dtype=np.int32)
    for word in range(code.shape[1]):
        own = code[i, word]
        for b, plane in enumerate(queries.planes):
            count += np.bitwise_count(own & plane[j, word]).astype(np.int32) << b
    return (2 * queries.step[j] * count + 2 * queries.low[j] * ones[i] - queries.rest[j]) / math.sqrt(dim)


def open_pairs(dots: np.ndarray, corner: np.ndarray, queries: Queries, i: np.ndarray, j: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """Whether neither bound rules the pair out: the angles' certain one, and the estimate's confidence bound."""
    own = np.clip(corner[i], 1e-9, 1.0)
    beta = queries.angle[j] + math.acos(threshold)
    certain = dots >= queries.length[j] * (own * np.cos(beta) - np.sqrt(1 - own**2) * np.sin(beta)) - 1e-9
    spread = np.sqrt((1 - own**2) / max(dim - 1, 1) + queries.lost[j] ** 2 / dim) / own
    return certain & (dots / own + SPREADS * spread >= threshold)


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Parents of a forest after linking rows i and j: the smallest row of each component."""
    while True:
        while not np.array_equal(higher := parent[parent], parent):
            parent = higher
        x, y = parent[i], parent[j]
        apart = x != y
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of double precision and length one; scaled by their largest component first, so that nothing overflows."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class _Rows:
    """Rows of whole groups of one length, and the links found among them."""

    def __init__(self, table: pa.Table, dim: int, kind: str, levels: int, threshold: float):
        self.dim, self.levels, self.threshold = dim, levels, threshold
        flat = b"".join(table["vec"].to_pylist())
        self.units = _units(np.frombuffer(flat, kind).reshape(-1, dim).astype(np.float64))
        self.code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint64).reshape(len(table), -1)
        self.corner = table["corner"].to_numpy()
        self.queries = Queries(self.units)
        self.table_no, self.name = table["tab"].to_numpy(), table["name"].to_numpy().view(np.uint64)
        self.left = table["block"].to_numpy() == table["p"].to_numpy()
        self.inner = table["p"].to_numpy() == table["q"].to_numpy()
        self.weight = table["weight"].to_numpy()
        self.parent = np.arange(len(table))
        self.links = np.zeros(len(table), np.int64)

    def settle(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compute open pairs exactly; count those that link and meet here first."""
        for at in range(0, len(i), EXACT):
            a, b = i[at : at + EXACT], j[at : at + EXACT]
            near = np.einsum("ij,ij->i", self.units[a], self.units[b]) >= self.threshold
            a, b = a[near], b[near]
            if not len(a):
                continue
            own, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            names = bucket_names(self.units[own], self.levels, self.threshold)
            x, y = names[place[: len(a)]], names[place[len(a) :]]
            first = np.ones(len(a), bool)
            for table in range(int(self.table_no[a].max()) + 1):
                same = x[:, table, :, None] == y[:, table, None, :]
                here = self.table_no[a] == table
                first &= ~(same.any((1, 2)) & (self.table_no[a] > table))
                least = np.where(same.any(2), x[:, table], np.uint64(2**64 - 1)).min(1)
                first &= ~here | (least == self.name[a])
            a, b = a[first], b[first]
            self.links += np.bincount(a, self.weight[b], len(self.links)).astype(np.int64) + np.bincount(b, self.weight[a], len(self.links)).astype(np.int64)
            self.parent = unite(self.parent, a, b)

    def small(self, group: np.ndarray) -> None:
        """Compare rows of small groups: each row with the one d places further on, for all d."""
        d = 1
        while d < len(group) and (i := np.flatnonzero(group[d:] == group[:-d])).size:
            i = i[self.inner[i] | (self.left[i] != self.left[i + d])]
            for at in range(0, len(i), PAIRS):
                a = i[at : at + PAIRS]
                some = open_pairs(estimates(self.code, self.queries, a, a + d, self.dim), self.corner, self.queries, a, a + d, self.dim, self.threshold)
                self.settle(a[some], a[some] + d)
            d += 1

    def large(self, begin: int, end: int) -> None:
        """Compare the rows of one group with each other, or its left block with its right one."""
        rows = np.arange(begin, end)
        left, right = (rows, rows) if self.inner[begin] else (rows[self.left[rows]], rows[~self.left[rows]])
        step = max(1, PAIRS // max(len(right), 1))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            j = right[right > i[0]] if self.inner[begin] else right
            if not len(j):
                continue
            some = open_pairs(estimates(self.code, self.queries, i[:, None], j[None, :], self.dim), self.corner, self.queries, i[:, None], j[None, :], self.dim, self.threshold)
            a, b = np.nonzero(some)
            a, b = i[a], j[b]
            if self.inner[begin]:
                a, b = a[a < b], b[a < b]
            self.settle(a, b)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One row per input row: the key, ``n_links``, ``component_id`` and ``kept``.

    Two vectors are linked when their cosine in double precision is at least ``threshold`` (above 0, at most 1); every
    link is computed exactly. ``n_links`` counts the other rows that a row is linked with, ``component_id`` is the
    smallest key that links lead to, the row's own included, ``kept`` says whether the row has that key.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing; so do vectors of
    different lengths with each other, and rows with a null key (component null, kept). Repeated rows are rows of their
    own, linked with each other; rows that share a key with different vectors count their own links and share the
    component. Other columns are left out. An empty table gives an empty result. A pair exactly at the threshold is
    missed with a chance of MISSED, because no bucket holds both; no size of a bucket or number of links is bounded.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vec].dataType.elementType.simpleString()
    kind = "<f8" if element == "double" else "<f4"
    vectors = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>" if kind == "<f8" else "array<float>").alias("vec"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column(1), batch.column(0).to_pylist()
            flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind)
            gaps = column.flatten().is_null().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.nan_to_num(np.asarray(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), np.float64))).astype(np.int64)
            digests: list[bytes | None] = []
            kept: list[bytes | None] = []
            for own, end, start in zip(ids, ends, np.concatenate(([0], ends[:-1])), strict=True):
                x = flat[start:end] + np.zeros((), kind)  # -0.0 is 0.0
                fine = own is not None and len(x) and not gaps[start:end].any() and np.isfinite(x).all() and x.any()
                kept.append(x.tobytes() if fine else None)
                digests.append(hashlib.blake2b(kept[-1], digest_size=16).digest() if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(kept, pa.binary())], ["id", "digest", "vec"])

    rows = checkpoint(vectors.mapInArrow(described, "id long, digest binary, vec binary"))
    width = int(kind[2])
    whole = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"))
    whole = checkpoint(whole.withColumn("dim", (F.octet_length("vec") / width).cast("int")))
    total, bucket = whole.count(), BUCKET

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                units = _units(np.frombuffer(b"".join(some.column("vec").to_pylist()), kind).reshape(-1, dim).astype(np.float64))
                code, corner = codes(units)
                names = bucket_names(units, levels_for(total, int(dim), bucket), threshold).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(corner), pa.array([n.tolist() for n in names], pa.list_(pa.list_(pa.int64())))],
                    [*some.schema.names, "code", "corner", "names"],
                )

    info = checkpoint(whole.mapInArrow(dealt, "digest binary, id long, weight long, vec binary, dim int, code binary, corner double, names array<array<long>>"))
    places = info.select("digest", "dim", F.posexplode("names").alias("tab", "probes")).select("digest", "dim", "tab", F.explode("probes").alias("name"))
    sizes = checkpoint(places.groupBy("dim", "tab", "name").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    # A vector whose buckets hold nobody else goes nowhere; the others go to the blocks of their buckets.
    own = info.select("digest", "id", "weight", "vec", "dim", "code", "corner", F.posexplode("names").alias("tab", "probes")).withColumn("name", F.explode("probes")).drop("probes")
    blocks = F.ceil(F.col("held") / BLOCK)
    own = own.join(sizes, ["dim", "tab", "name"]).withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("digest", "id", "weight", "vec", "dim", "code", "corner", "tab", "name", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    order = ["dim", "tab", "name", "p", "q"]
    pairs = pairs.repartition(*order).sortWithinPartitions(*order)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result(table: pa.Table) -> Iterator[pa.RecordBatch]:
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims):
                part = table.filter(pa.array(dims == dim)).combine_chunks()
                group = _groups(part)
                begins = np.flatnonzero(np.diff(group, prepend=-1))
                sizes = np.diff(begins, append=len(group))
                found = _Rows(part, int(dim), kind, levels_for(total, int(dim), bucket), threshold)
                few = np.where(np.repeat(sizes, sizes) <= SMALL, group, -1 - np.arange(len(group)))
                found.small(few)
                for k in np.flatnonzero(sizes > SMALL):
                    found.large(int(begins[k]), int(begins[k] + sizes[k]))
                some = np.flatnonzero(found.links)
                ids = part["id"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [part["digest"].combine_chunks().take(pa.array(some)), pa.array(ids[some]), pa.array(ids[found.parent[some]]), pa.array(found.links[some])],
                    ["digest", "id", "root", "links"],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.slice(batch.num_rows - 1)
            ends = _groups(pa.Table.from_batches([batch]))
            cut = int(np.searchsorted(ends, ends[-1]))
            same = bool(held) and cut == 0 and all(held[-1].column(c)[-1] == last.column(c)[0] for c in order)
            if not same:
                if whole_groups := [*held, *([batch.slice(0, cut)] if cut else [])]:
                    yield from result(pa.Table.from_batches(whole_groups))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from result(pa.Table.from_batches(held))

    found = checkpoint(pairs.mapInArrow(compared, "digest binary, id long, root long, links long"))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    # Keys of equal vectors hang on the smallest; a root stands for what its own task saw.
    same = rows.where("digest is not null").join(whole.select("digest", F.col("id").alias("root"), "weight"), "digest")
    edges = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(same.where("weight > 1").select(F.col("id").alias("a"), F.col("root").alias("b")))
    label = components(edges)
    facts = whole.select("digest", "weight").join(links, "digest", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("id", "digest").join(facts, "digest", "left").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("label").alias("component_id"), F.coalesce(F.col("label") == F.col("id"), F.lit(True)).alias("kept")
    )


def _groups(table: pa.Table) -> np.ndarray:
    """Number of each row's group in a table sorted by its bucket and blocks."""
    change = np.zeros(len(table), np.int64)
    for name in ("dim", "tab", "name", "p", "q"):
        values = table[name].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def embedding_query(vectors: DataFrame) -> DataFrame:
    """One row per vector: links and component at a cosine of 0.9."""
    return near_duplicates(vectors.select("vec_id", "embedding"), 0.9)
