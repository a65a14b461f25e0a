"""N-gram Jaccard join by set relations: which texts' shingle sets are alike, and which hang together.

Every set is sorted in one global order, frequent shingles last, and its prefix goes into an inverted index: sets alike to
the wanted degree share a shingle of their prefixes. Two relations keep most of the index lists from being compared.

* By position. A list is split into blocks of equal set size and position. Two blocks whose sizes and positions leave
  room for too small an overlap are skipped as a whole.
* By answers. In each list, sets are first compared with one pivot. Sets that turn out highly similar to it take over
  its answers: they are one component, and pairs within it are not compared again. For pairs that remain, the distances
  to the pivot bound their own distance from below (Jaccard distance is a metric), and most are derived away.

Equal sets are one set from the start, so copies cost nothing, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import picked, small_batches
from shelfmark.llm.components import components
from shelfmark.llm.shingles import shingle_sets
from shelfmark.session import checkpoint, written

#: A shingle is frequent if more than one document in so many has it; there are at most this times the mean set size.
FREQUENT = 2048
#: Most rounds of comparing lists with one pivot, each with other pivots; a round that links nothing is the last.
PIVOT_ROUNDS = 4
#: Bits of the short parity bitmap that bounds the difference of two sets from below; the wide one has 4 a shingle.
BITMAP = 512
WIDE = 4
#: Pairs of ids that are broadcast to what they are joined with; more are shuffled.
FEW_PAIRS = 1 << 15


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have, and how many: counted whole within each task, and added up where a task has
    them often. Only the order of the index depends on it, never a result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            rows += batch.num_rows
            if found := [s for s in shingle_sets(batch.column(0), width) if len(s)]:
                kinds, times = np.unique(np.concatenate(found), return_counts=True)
                held.append((kinds[times > 1], times[times > 1]))
        if held:
            kinds, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            times = np.bincount(place, np.concatenate([t for _, t in held])).astype(np.int64) if len(kinds) else np.zeros(0, np.int64)
            often = times > max(2, rows // FREQUENT)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[often].view(np.int64)), pa.array(times[often])], ["token", "times"])

    total = docs.count()
    counted = docs.select("text").mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    rows = counted.where(F.col("times") > max(2, total // FREQUENT)).toPandas()
    tokens, times = rows["token"].to_numpy(np.int64).view(np.uint64), rows["times"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], times[order]


def _bitmap(tokens: np.ndarray, bits: int) -> bytes:
    """Parity of the tokens dealt to each bit: two sets differ in at least as many tokens as their bitmaps in bits."""
    return np.packbits((np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the longer folded to the length of the shorter."""
    while len(x) > len(y):
        half = len(x) // 2
        x = (int.from_bytes(x[:half]) ^ int.from_bytes(x[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() if len(x) == len(y) else _differing(y, x)


def _described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """id, set size, 128-bit digest of the set, short and wide bitmap, and the prefix in global order."""
    frequent, times = _frequent(docs, width)
    levels = (np.floor(np.log2(np.maximum(times, 1))) + 1).astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, levels))  # FREQUENT * mean set size at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        known, level_of = shared.value
        for batch in batches:
            sizes, digests, bitmaps, wide, prefixes = [], [], [], [], []
            for tokens in shingle_sets(batch.column(1), width):
                n = len(tokens)
                keep = n - (percent * n + 99) // 100 + 1 if n else 0
                level = np.zeros(n, np.uint64)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    level = np.where(known[at] == tokens, level_of[at], np.uint64(0))
                sizes.append(n)
                digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                bitmaps.append(_bitmap(tokens, BITMAP))
                wide.append(_bitmap(tokens, max(BITMAP, 1 << (WIDE * n - 1).bit_length())) if n else b"")
                prefixes.append(tokens[np.argsort(level, kind="stable")[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bitmaps, pa.binary()), pa.array(wide, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["id", "n", "digest", "bitmap", "wide", "prefix"],
            )

    return docs.select("id", "text").mapInArrow(describe, "id long, n long, digest binary, bitmap binary, wide binary, prefix array<long>")


def _need(n1: Column, n2: Column, percent: int) -> Column:
    """Least overlap of two sets that are alike."""
    return F.ceil(percent * (n1 + n2) / F.lit(100 + percent))


def _possible(left: str, right: str, percent: int) -> Column:
    """Sizes and positions (counted from 0) of a common shingle leave room for the overlap that is needed."""
    n1, p1, n2, p2 = (F.col(f"{side}.{c}") for side in (left, right) for c in ("n", "pos"))
    room = 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (room >= _need(n1, n2, percent))


def _near(left: Column, right: Column, n1: Column, n2: Column, percent: int) -> Column:
    """Short bitmaps do not rule the pair out."""
    differ = F.lit(0)
    for k in range(BITMAP // 64):
        word = lambda c: F.conv(F.hex(F.substring(c, 8 * k + 1, 8)), 16, -10).cast("long")  # noqa: E731, B023
        differ += F.bit_count(word(left).bitwiseXOR(word(right)))
    return differ <= n1 + n2 - 2 * _need(n1, n2, percent)


def _likely(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids that neither the short nor the wide bitmaps rule out."""
    short = info.select("id", "n", "bitmap")
    left, right, pairs = short.toDF("a", "na", "ba"), short.toDF("b", "nb", "bb"), checkpoint(pairs)
    if pairs.count() <= FEW_PAIRS:
        sides = checkpoint(left.join(F.broadcast(pairs), "a"))
        sides = right.join(F.broadcast(sides) if sides.count() <= FEW_PAIRS else sides, "b")  # ids may repeat
    else:
        sides = pairs.join(left, "a").join(right, "b")
    some = checkpoint(sides.where(_near(F.col("ba"), F.col("bb"), F.col("na"), F.col("nb"), percent)).select("a", "b").distinct())
    wide = info.select("id", "n", "wide")
    both = some.join(wide.toDF("a", "na", "wa"), "a").join(wide.toDF("b", "nb", "wb"), "b").select("a", "b", "na", "nb", "wa", "wb")

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, na, nb, wa, wb = (c.to_pylist() for c in batch.columns)
            keep = [_differing(x, y) <= m + n - 2 * -(-percent * (m + n) // (100 + percent)) for m, n, x, y in zip(na, nb, wa, wb, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(rule, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Exact sizes of intersection (``shared``) and union (``total``) of written pairs (a, b) of ids.

    Only the texts of these ids are read again, and meet pair by pair.
    """
    texts = docs.select("id", "text")

    def side(of: str) -> DataFrame:
        return picked(texts, checkpoint(pairs.select(F.col(of).alias("id")).distinct()), "id").toDF(of, "t" + of)

    if pairs.count() <= FEW_PAIRS:
        both = texts.toDF("a", "ta").join(F.broadcast(pairs), "a").join(side("b"), "b")
    else:
        both = pairs.join(side("a"), "a").join(side("b"), "b")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width), strict=True)
            sizes = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in sets]
            shared = np.array([s for s, _ in sizes], np.int64)
            total = np.array([t for _, t in sizes], np.int64) - shared
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(total)], ["a", "b", "shared", "total"])

    return both.select("a", "b", "ta", "tb").mapInArrow(overlap, "a long, b long, shared long, total long").distinct()


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, ``n_shingles`` and ``component_id``.

    Two texts are linked when 100 * intersection >= percent * union of their sets of ``width``-word shingles;
    ``component_id`` is the smallest key that links lead to, the row's own included. Every link between different sets is
    found and each is exact: index, bitmaps and distances only rule pairs out that cannot be links. Texts without words
    (null, empty, blank) have size 0 and stay alone. Keys are integers; rows with a null key get a null component and link
    nothing; repeated rows are kept and get the same answer; rows that share a key share its links. Other columns are
    left out. An empty table gives an empty result. Texts are read for sets, for their frequencies and for each check of pairs, and never shuffled, but for those in
    pairs that are verified.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    info = checkpoint(_described(docs, width, percent))
    real = info.where((F.col("n") > 0) & F.col("id").isNotNull())
    same = checkpoint(real.groupBy("digest").agg(F.min("id").alias("rep")))
    member = real.select("id", "digest").join(same, "digest").select("id", "rep").where("id <> rep").distinct()
    reps = real.join(same.withColumnRenamed("rep", "id"), ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"])
    entries = reps.select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    # A list of two is one pair: sizes and positions decide at once whether it can be alike.
    lists = entries.groupBy("token").agg(
        F.count(F.lit(1)).alias("held"), F.min("n").alias("least"), F.max("n").alias("most"), F.min(F.col("n") - F.col("pos")).alias("room")
    )
    pair_fails = (100 * F.col("least") < percent * F.col("most")) | (F.col("room") < _need(F.col("least"), F.col("most"), percent))
    lists = lists.where((F.col("held") > 1) & ~((F.col("held") == 2) & pair_fails)).select("token")
    entries = checkpoint(entries.join(lists, "token"))

    alike = f"100 * shared >= {percent} * total"
    links, distances = None, None
    label = spark.createDataFrame([], "id long, label long")
    for turn in range(PIVOT_ROUNDS):
        known = written(spark, lambda: _to_pivots(entries, label, info, distances, docs, width, percent, turn))  # noqa: B023
        distances = known if distances is None else distances.unionByName(known)
        fresh = known.where(alike).select("a", "b")
        if fresh.isEmpty():
            break
        links = fresh if links is None else links.unionByName(fresh)
        label = components(links)
    rest = written(spark, lambda: _verified(checkpoint(_likely(_remaining(_labelled(entries, label), info, distances, percent), info, percent)), docs, width))
    every = member.toDF("a", "b").unionByName(rest.where(alike).select("a", "b"))
    label = components(every if links is None else every.unionByName(links))
    return info.select("id", "n").join(label, "id", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))


def _to_pivots(entries: DataFrame, label: DataFrame, info: DataFrame, distances: DataFrame | None, docs: DataFrame, width: int, percent: int, turn: int) -> DataFrame:
    """Sets compared with one pivot of a list each, as ``_verified`` has them; pairs of one label or of a known distance are left out."""
    labelled = checkpoint(_labelled(entries, label))
    mixed = labelled.groupBy("token").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)), "id", "n", "pos", "label")).alias("p"), F.min("label").alias("least"), F.max("label").alias("most"))
    pivots = mixed.where("least <> most").select("token", F.col("p.id").alias("id"), F.col("p.n").alias("n"), F.col("p.pos").alias("pos"), F.col("p.label").alias("label"))
    pairs = labelled.alias("e").join(pivots.alias("p"), "token").where((F.col("e.label") != F.col("p.label")) & _possible("e", "p", percent))
    pairs = pairs.select(F.col("e.id").alias("b"), F.col("p.id").alias("a")).distinct()
    if distances is not None:
        done = distances.select("a", "b")
        pairs = pairs.join(done.unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    # Of its pivots a set takes the first in a common order, so that a family gathers around few of them.
    first = F.min(F.struct(F.xxhash64("a", F.lit(turn)), "a"))["a"]
    chosen = _likely(pairs, info, percent).groupBy("b").agg(first.alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _verified(checkpoint(chosen), docs, width)


def _labelled(entries: DataFrame, label: DataFrame) -> DataFrame:
    return entries.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _remaining(entries: DataFrame, info: DataFrame, distances: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share an index list and that neither blocks nor distances rule out."""
    mixed = entries.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min(F.struct(F.xxhash64("id", F.lit(0)), "id"))["id"].alias("pivot")).where("least <> most").drop("least", "most")
    open_ = checkpoint(entries.join(mixed, "token"))
    blocks = open_.select("token", "n", "pos").distinct()
    kept = blocks.alias("x").join(blocks.alias("y"), "token").where(_possible("x", "y", percent) & (F.struct("x.n", "x.pos") <= F.struct("y.n", "y.pos")))
    kept = kept.select("token", F.col("x.n").alias("xn"), F.col("x.pos").alias("xp"), F.col("y.n").alias("yn"), F.col("y.pos").alias("yp"))
    apart = F.lit(1.0) - F.col("shared") / F.col("total")
    to_pivot = distances.select(F.col("a").alias("pivot"), F.col("b").alias("id"), apart.alias("d")).unionByName(distances.select(F.col("b").alias("pivot"), F.col("a").alias("id"), apart.alias("d")))
    seen = open_.join(to_pivot, ["pivot", "id"], "left").join(info.select("id", F.col("n").cast("int").alias("n"), "bitmap").distinct(), ["id", "n"]).select("token", "n", "pos", "id", "label", "d", "bitmap")
    left, right = (seen.select("token", *[F.col(c).alias(side + c) for c in ("n", "pos", "id", "label", "d", "bitmap")]) for side in ("x_", "y_"))
    pairs = left.join(kept, (left["token"] == kept["token"]) & (F.col("x_n") == F.col("xn")) & (F.col("x_pos") == F.col("xp"))).drop(left["token"])
    far = F.coalesce(F.abs(F.col("x_d") - F.col("y_d")) > (100 - percent) / 100 + 1e-9, F.lit(False))
    open_pair = (F.col("x_label") != F.col("y_label")) & ~far & _near(F.col("x_bitmap"), F.col("y_bitmap"), F.col("x_n"), F.col("y_n"), percent)
    pairs = pairs.join(right, (pairs["token"] == right["token"]) & (F.col("y_n") == F.col("yn")) & (F.col("y_pos") == F.col("yp")) & open_pair)
    pairs = pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
    return pairs.join(distances, ["a", "b"], "left_anti")


def jaccard_query(docs: DataFrame) -> DataFrame:
    """One row per document: the size of its set of 3-word shingles and its component at 90 %."""
    return jaccard_components(docs, width=3, percent=90)
