"""Order MinHash fingerprints in DataFrame functions alone.

A text is its words; its k-mers are numbered by occurrence, so that repeats count. One hash deals the numbered k-mers into
``SLOTS`` slots. In each slot the ``TUPLE`` smallest are chosen, put back into the order of the text and hashed as a
tuple: two texts agree in a slot where they share not only the k-mers but their order, so the share of agreeing slots
falls with the edit distance and not only with the set of k-mers. (One hash for all slots instead of one each: a text is
sorted once.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import documents

BLANKS = r"[\x20\x09-\x0D]+"
K = 2
TUPLE = 2
SLOT_BITS = 5
#: Low bits that hold a word's place; the hash keeps the others.
PLACE_BITS = 24
_PLACES = (1 << PLACE_BITS) - 1


def _high(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _joined(high: Column, place: Column) -> Column:
    """The high bits of a hash with a place in the low bits."""
    return F.shiftleft(_high(high), PLACE_BITS).bitwiseOR(F.least(place.cast("long"), F.lit(_PLACES)))


def _slot(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - SLOT_BITS)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add a text's fingerprint: an array of longs, one for each slot that has a k-mer (slot number, tuple hash).

    Null, empty and blank texts have the empty array. Fewer than K words make one k-mer. Equal texts, and texts that
    differ only in the blanks between words, have equal fingerprints. Words beyond the 2^24th share one place.
    """
    name = lambda s: f"_omh_{s}"
    col = lambda s: F.col(name(s))
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANKS), "")
    df = df.withColumn(name("words"), F.transform(words, lambda w: F.xxhash64(w)))
    kmers = F.transform(
        F.slice(col("words"), 1, F.greatest(F.size(col("words")) - (K - 1), F.least(F.size(col("words")), F.lit(1)))),
        lambda w, i: _joined(F.xxhash64(w, *[F.get(col("words"), i + F.lit(j)) for j in range(1, K)]), i),
    )
    df = df.withColumn(name("sorted"), F.sort_array(kmers))
    at = lambda i, k: F.get(col("sorted"), i + F.lit(k))
    starts = F.filter(F.transform(col("sorted"), lambda x, i: F.when(F.coalesce(_high(at(i, -1)) == _high(x), F.lit(False)), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    df = df.withColumn(name("starts"), starts)
    runs = F.transform(col("starts"), lambda b, r: F.sequence(F.lit(0), F.coalesce(F.get(col("starts"), r + F.lit(1)), F.size(col("sorted"))) - b - 1))
    distinct = F.size(col("starts")) == F.size(col("sorted"))
    turns = F.when(distinct, F.array_repeat(F.lit(0), F.size(col("sorted")))).otherwise(F.flatten(runs))
    numbered = F.zip_with(col("sorted"), turns, lambda x, turn: _joined(F.xxhash64(_high(x), turn), x.bitwiseAND(F.lit(_PLACES))))
    df = df.withColumn(name("numbered"), F.sort_array(numbered))
    df = df.withColumn(name("picked"), F.filter(col("numbered"), lambda x, i: F.coalesce(_slot(F.get(col("numbered"), i - F.lit(TUPLE))) != _slot(x), F.lit(True))))
    place = lambda x: x.bitwiseAND(F.lit(_PLACES))

    def tuple_of(x: Column, i: Column) -> Column:
        """For the first pick of a slot, the slot and the hash of its picks in text order; null for the others."""
        after = F.get(col("picked"), i + F.lit(1))
        both = F.coalesce(_slot(after) == _slot(x), F.lit(False))
        ordered = F.when(place(x) < place(after), F.xxhash64(_high(x), _high(after))).otherwise(F.xxhash64(_high(after), _high(x)))
        hashed = F.when(both, ordered).otherwise(F.xxhash64(_high(x)))
        first = F.coalesce(_slot(F.get(col("picked"), i - F.lit(1))) != _slot(x), F.lit(True))
        return F.when(first, F.shiftleft(_slot(x), 32).bitwiseOR(hashed.bitwiseAND(F.lit(0xFFFFFFFF))))

    df = df.withColumn(out, F.filter(F.transform(col("picked"), tuple_of), lambda x: x.isNotNull()))
    return df.drop(*[name(s) for s in ("words", "sorted", "starts", "numbered", "picked")])


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots used by either fingerprint in which both have the same tuple; 1 for two empty ones."""
    slots = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    used = F.size(F.array_union(slots(a), slots(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def as_text(fingerprint: Column) -> Column:
    """Ten hex digits a slot."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def _blocks(ids: DataFrame, count: int) -> tuple[Column, Column, int]:
    """Group of bounds, bounds below within the group, and the width of a group. Bounds are ``count`` quantiles of the ids."""
    found = ids.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / count for i in range(1, count)], 0.1 / count)
    bounds = sorted({int(x) for x in found})
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    count_below = lambda values: F.size(F.filter(values, lambda b: b < F.col("doc_id")))
    literal = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<long>")
    coarse = count_below(literal([g[-1] for g in groups]))
    fine = F.coalesce(count_below(F.get(F.array(*[literal(g) for g in groups]), F.col("_coarse"))), F.lit(0))
    return coarse, fine, width


def with_next(docs: DataFrame, fingerprint: str) -> DataFrame:
    """Add the text and the fingerprint of the next document by descending id, after the last those of the first.

    Rows of one id follow each other by the hash of their text; a null id comes last. Texts are shuffled once, into
    blocks of neighbouring ids that are sorted on their own. Each block also gets a copy of the row that follows it, so
    that no block has to see another.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    coarse, fine, width = _blocks(docs.select("doc_id"), parts)
    placed = docs.withColumn("_coarse", coarse).withColumn("_block", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_coarse") * width + fine)).drop("_coarse")
    placed = placed.withColumn("_order", F.xxhash64("text")).withColumn("_ghost", F.lit(False))
    heads = {r["_block"]: r["top"] for r in placed.groupBy("_block").agg(F.max("doc_id").alias("top")).collect()}
    if not heads:
        return placed.select("*", F.col("text").alias("next_text"), F.col(fingerprint).alias("next_fingerprint")).drop("_block", "_order", "_ghost")
    used = sorted(heads, reverse=True)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # of the highest: the lowest, whose last row comes round to it
    tops = [t for t in heads.values() if t is not None]
    is_top = F.col("doc_id").isin(tops) if None not in heads.values() else F.col("doc_id").isin(tops) | F.col("doc_id").isNull()
    first = Window.partitionBy("_block").orderBy(F.col("doc_id").desc_nulls_last(), F.col("_order").desc())
    ghosts = placed.where(is_top).withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    moves = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    ghosts = ghosts.withColumn("_block", moves[F.col("_block")]).withColumn("_ghost", F.lit(True))
    within = Window.partitionBy("_block").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), F.col("_order").desc())
    after = placed.unionByName(ghosts).withColumn("next_text", F.lead("text").over(within)).withColumn("next_fingerprint", F.lead(fingerprint).over(within))
    return after.where(~F.col("_ghost")).drop("_block", "_order", "_ghost")


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the fingerprints of its text and of its edited text, and their likeness."""
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    both = with_next(with_fingerprint(docs, "text", "_own"), "_own")
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = with_fingerprint(both.withColumn("_edited_text", edited), "_edited_text", "_edited")
    return both.select(
        "doc_id",
        chars.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited_text").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("next_fingerprint")).alias("near_next"),
    )
