"""Source divergence audit: how far the sources of a language use its words differently.

A term's share in a group depends on its count there alone, its level. So what two groups differ by is priced from their
joint table: how many terms have level c in the one and level d in the other. All joint tables at once are a matrix
product: with one indicator column for every (group, level) and one row for every term, the columns' transpose times the
columns counts the terms of every pair of levels. Terms are dealt to blocks of similar frequency, so that a block has few
different levels; groups are dealt to column blocks. A block's product is exact (whole numbers far below 2^24 in single
precision), is priced at once by whole-number arithmetic, and leaves the task as one number for each pair of groups.

Terms that a group lacks have level 0 there. They are most of all, and need no columns: with the level tables of the
single groups, what the product counts is enough (inclusion and exclusion).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import buffer_of, slices, small_batches
from shelfmark.session import checkpoint

#: A language keeps the terms that at least so many of its documents have.
LEAST_DOCS = 10
#: Parts that all shares add up to, about.
PARTS = 1_000_000_000
#: Terms of a block where the most frequent term occurs once in a group, on average over the block's groups, and at least.
BLOCK_TERMS, LEAST_TERMS = 4096, 128
#: Groups of a column block.
BLOCK_GROUPS = 64
#: Columns multiplied at once.
TILE = 2048

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, count and docs (documents of the group that have the term), for every term that occurs.

    Terms are runs of letters A-Z, lower-cased, and of characters outside ASCII. Nulls count as empty strings.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch.select(["lang", "source"]).to_struct_array()
            kinds = pairs.to_pylist()
            known: dict[tuple, int] = {}
            group = np.array([known.setdefault((k["lang"], k["source"]), len(known)) for k in kinds], np.int64)
            tokens, owners = [], []
            for first, part in slices(batch.column(2)):
                data, offsets = buffer_of(part)
                solid = _LETTER[data]
                before = np.concatenate(([False], solid[:-1]))[: len(data)]
                inner = offsets[(offsets > 0) & (offsets < len(data))]
                before[inner] = False
                starts = np.flatnonzero(solid & ~before)
                if not len(starts):
                    continue
                sizes = np.add.reduceat(solid, starts, dtype=np.int64)
                flat = _LOWER[data[solid]].tobytes()
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
                words = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat)])
                tokens.append(words.dictionary_encode())
                owners.append(first + np.searchsorted(offsets, starts, side="right") - 1)
            if not tokens:
                continue
            words = pa.chunked_array(tokens).unify_dictionaries().combine_chunks()
            word = words.indices.to_numpy().astype(np.int64)
            row = np.concatenate(owners)
            in_row, times = np.unique(row * len(words.dictionary) + word, return_counts=True)
            of, word = np.divmod(in_row, len(words.dictionary))
            in_group, place = np.unique(group[of] * len(words.dictionary) + word, return_inverse=True)
            counts = np.bincount(place, times).astype(np.int64)
            held = np.bincount(place).astype(np.int64)
            of, word = np.divmod(in_group, len(words.dictionary))
            names = list(known)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[k][0] for k in range(len(names))], pa.string()).take(pa.array(of)), pa.array([names[k][1] for k in range(len(names))], pa.string()).take(pa.array(of)),
                    words.dictionary.cast(pa.string()).take(pa.array(word)), pa.array(counts), pa.array(held),
                ],
                ["lang", "source", "term", "count", "docs"],
            )

    found = rows.mapInArrow(count, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> Column:
    """p: 1 + floor(PARTS * (count + 2) / total), exact also where the product exceeds 64 bits; 1 where nothing is kept."""
    return F.expr(f"CASE WHEN {total} > 0 THEN 1 + ((CAST({PARTS} AS DECIMAL(20,0)) * CAST({count} + 2 AS DECIMAL(18,0))) DIV CAST({total} AS DECIMAL(20,0))) ELSE 1 END").cast("long")


def distance(p: str, q: str) -> Column:
    """f: floor((p - q)^2 / (p + q)), in 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def _priced(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _products(table: pa.Table) -> pa.RecordBatch:
    """Priced joint tables of one block: (lang, a, b, value) for each pair of its groups, a before b.

    value: sum over pairs of levels of the terms that have them, times f(c, d) - f(c, 0) - f(0, d) + f(0, 0).
    """
    lang = table["lang"][0].as_py()
    sources = table["source"].combine_chunks().dictionary_encode()
    order = np.argsort(np.array(sources.dictionary.to_pylist(), dtype=object), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names = [sources.dictionary[int(k)].as_py() for k in order]
    group = rank[sources.indices.to_numpy()]
    term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    price, zero = table["p"].to_numpy(), table["zero"].to_numpy()
    left, right = table["side"].to_numpy() == table["x"].to_numpy(), table["side"].to_numpy() == table["y"].to_numpy()
    one_block = bool((left & right).all())
    # Columns: (group, level), a level known by its price, which equal counts of a group share.
    column, place = np.unique(np.stack((group, price), axis=1), axis=0, return_inverse=True)
    place = place.reshape(-1)
    of, levels = column[:, 0], column[:, 1]
    base = np.zeros(len(names), np.int64)
    base[group] = zero
    side = np.zeros(len(names), bool)
    side[group[left]] = True
    total = np.zeros((len(names), len(names)), np.int64)
    indicator = np.zeros((int(term.max()) + 1, len(column)), np.float32)
    indicator[term, place] = 1
    mine = np.flatnonzero(side[of]) if not one_block else np.arange(len(column))
    others = np.flatnonzero(~side[of]) if not one_block else mine
    for a in range(0, len(mine), TILE):
        i = mine[a : a + TILE]
        for b in range(0, len(others), TILE):
            j = others[b : b + TILE]
            joint = indicator[:, i].T @ indicator[:, j]
            x, y = np.nonzero(joint)
            times = np.rint(joint[x, y]).astype(np.int64)
            x, y = i[x], j[y]
            keep = of[x] < of[y] if one_block else np.ones(len(x), bool)
            x, y, times = x[keep], y[keep], times[keep]
            p, q, p0, q0 = levels[x], levels[y], base[of[x]], base[of[y]]
            value = times * (_priced(p, q) - _priced(p, q0) - _priced(p0, q) + _priced(p0, q0))
            np.add.at(total, (np.minimum(of[x], of[y]), np.maximum(of[x], of[y])), value)
    x, y = np.nonzero(total)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(x), pa.string()), pa.array([names[k] for k in x], pa.string()), pa.array([names[k] for k in y], pa.string()), pa.array(total[x, y])], ["lang", "a", "b", "value"]
    )


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: every group's distance to each other source of its language (part ``pair``),
    and the ``most_terms`` terms that it uses most beyond its language (part ``term``).

    A language keeps the terms that at least ``least_docs`` of its documents have. Shares are whole parts of PARTS, smoothed
    by two occurrences a term; a distance is the sum over all kept terms of floor((p - q)^2 / (p + q)). Ranks go by value,
    largest first, then by the item's UTF-8 bytes. Null text, lang and source count as ''; a document without terms still
    makes its group occur; repeated rows are documents of their own; other columns are left out; an empty table gives an
    empty result. A language that keeps no term has distances of 0 and no terms.
    """
    counts = checkpoint(term_counts(docs, lang, source, text))
    together = Window.partitionBy("lang", "term")
    kept = counts.select("lang", "source", "term", "count", F.sum("docs").over(together).alias("held"), F.sum("count").over(together).alias("every"), (F.row_number().over(together.orderBy("source")) == 1).cast("long").alias("first"))
    kept = checkpoint(kept.where(F.col("held") >= least_docs).drop("held"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]
    groups = docs.select(*named).distinct().join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("count").alias("all"))
    # One row a group: v terms kept by the language; totals that shares of the group and of the language are taken of.
    groups = groups.join(langs, "lang", "left").select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("total"), (F.coalesce("all", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("whole"))
    groups = checkpoint(groups.withColumn("zero", share("0", "total")))
    entries = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "count", "every", "zero", "v", share("count", "total").alias("p"), share("every", "whole").alias("q"))
    entries = checkpoint(entries)

    value = distance("p", "q")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    terms = terms.withColumn("rank", ranked).where(F.col("rank") <= most_terms)

    pairs = _distances(entries, groups)
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", ranked)
    return both.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def _distances(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value for every two sources a < b of a language."""
    # Terms of like frequency share a bucket; a bucket of many terms is cut into blocks, the smaller the more levels it has.
    bucket = F.floor(F.log2(F.col("every").cast("double")) * 4).cast("int")
    salted = entries.select("lang", "source", "term", "count", "p", "zero", bucket.alias("bucket"))
    size = F.greatest(F.lit(LEAST_TERMS), (F.lit(BLOCK_TERMS) / F.pow(F.lit(2.0), F.col("bucket") / 4 - 4)).cast("int"))
    blocks = entries.select("lang", "term", bucket.alias("bucket")).distinct().groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("terms"))
    blocks = blocks.select("lang", "bucket", F.ceil(F.col("terms") / F.least(size, F.lit(BLOCK_TERMS))).cast("int").alias("blocks"))
    sides = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_GROUPS).cast("int").alias("sides"))
    dealt = salted.join(blocks, ["lang", "bucket"]).join(sides, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).withColumn("side", F.pmod(F.xxhash64("source"), F.col("sides")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    order = ["lang", "bucket", "block", "x", "y"]
    dealt = dealt.select("lang", "bucket", "block", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "source", "term", "p", "zero")
    dealt = dealt.repartition(*order).sortWithinPartitions(*order)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for name in order:
                column = batch.column(name)
                values = column.to_numpy() if name != "lang" else np.array(column.to_pylist(), dtype=object)
                change[1:] |= values[1:] != values[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if held and any(held[-1].column(c)[-1] != batch.column(c)[start] for c in order):
                    yield _products(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield _products(pa.Table.from_batches(held))

    joint = dealt.mapInArrow(multiplied, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("joint"))
    # The terms that only one of two groups has, and those that neither has.
    levels = entries.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("n"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("q0"))
    single = levels.join(other, "lang").where("source <> other")
    single = single.groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")).agg(F.sum(F.expr("n") * (distance("p", "q0") - distance("zero", "q0"))).alias("single"))
    every = groups.select("lang", "v", F.col("source").alias("a"), F.col("zero").alias("p0")).join(groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("q0")), "lang").where("a < b")
    every = every.join(joint, ["lang", "a", "b"], "left").join(single, ["lang", "a", "b"], "left")
    return every.select("lang", "a", "b", (F.expr("v") * distance("p0", "q0") + F.coalesce("joint", F.lit(0)) + F.coalesce("single", F.lit(0))).alias("value"))


def audit_query(docs: DataFrame) -> DataFrame:
    """All groups of the documents: distances to the other sources of the language, and the ten terms used most beyond it."""
    return audit(docs.select("text", "lang", "source"))
