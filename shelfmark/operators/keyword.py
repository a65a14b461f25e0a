"""Keyword search: substring candidates, weighted BM25, term coverage, top hits.

``chunks``: chunk_id, doc_id, page, title, heading, content.  ``docs``: doc_id, collection, plus
whatever a visibility filter needs.  ``queries``: query_id, query.  One job answers all queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib.util import find_spec

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from shelfmark.functions import terms as T
from shelfmark.functions.text import drop_pictures
from shelfmark.operators.index import SearchIndex, match as index_match
from shelfmark.session import checkpoint

# Ranking constants.
CANDIDATES = 200
WEIGHTS = {"title": 3, "heading": 2, "content": 1}
K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
MIN_COVERAGE = 0.5
EPS = 1e-9
# Scores are compared at this many digits: sums may be added in any order.
DIGITS = 9

# How needles are matched depends on how many distinct ones there are: a few as literals of the scan,
# up to a bounded list (some megabytes) by one automaton per task, any number by n-gram postings.
LITERAL_NEEDLES = 4
AUTOMATON_NEEDLES = 50_000


def haystack() -> Column:
    return F.lower(F.concat_ws("\n", "title", "heading", "content"))


def chunk_tokens() -> Column:
    """Trigrams a chunk holds over its indexed columns."""
    return sum((F.greatest(F.length(F.coalesce(c, F.lit(""))) - 2, F.lit(0)) for c in WEIGHTS), F.lit(0)).cast("bigint")


def lowered(chunks: DataFrame) -> DataFrame:
    """Chunks ready for matching: indexed columns in lower case, once per row, and the token count."""
    return chunks.select(
        "chunk_id",
        "doc_id",
        chunk_tokens().alias("tokens"),
        *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in WEIGHTS],
    )


def occurrences(needle: Column) -> Column:
    """Weighted, overlapping occurrences of a needle in lower-case columns; short needles do not count."""
    probe = F.concat(F.lit("(?="), T.quoted(needle), F.lit(")"))
    each = sum((F.regexp_count(F.col(c), probe) * w for c, w in WEIGHTS.items()), F.lit(0))
    return F.when(F.length(needle) >= T.GRAM, each).otherwise(0).cast("bigint")


def has_needle(needle: Column) -> Column:
    """Whether one of the lower-case indexed columns holds the needle; no match runs over two columns."""
    return F.contains("content", needle) | F.contains("title", needle) | F.contains("heading", needle)


def query_plans(queries: DataFrame) -> DataFrame:
    """query_id, terms and one row per needle with its kind (``phrase`` or ``short``)."""
    return queries.select("query_id", T.plan_query("query").alias("plan"))


def query_needles(plans: DataFrame) -> DataFrame:
    kind = "array<struct<needle:string,kind:string,ord:int>>"

    def tagged(items: str, name: str) -> Column:
        return F.transform(
            f"plan.{items}", lambda n, i: F.struct(n.alias("needle"), F.lit(name).alias("kind"), i.alias("ord"))
        ).cast(kind)

    both = F.concat(tagged("phrases", "phrase"), tagged("short", "short"))
    return plans.select("query_id", F.explode(both).alias("n")).select("query_id", "n.*")


def match_literal(chunks: DataFrame, needles: list[str]) -> DataFrame:
    """Matches of a few needles, as literals of one scan."""
    every = F.array(*[F.lit(n) for n in needles]).cast("array<string>")
    hits = F.transform(
        F.filter(every, has_needle), lambda n: F.struct(n.alias("needle"), occurrences(n).alias("occ"))
    )
    return (
        lowered(chunks)
        .select("chunk_id", "doc_id", "tokens", F.explode(hits).alias("h"))
        .select("chunk_id", "doc_id", "tokens", "h.needle", "h.occ")
    )


def match_automaton(chunks: DataFrame, needles: list[str]) -> DataFrame:
    """Matches of a bounded list of needles in one pass over each text, overlaps counted."""
    shared = chunks.sparkSession.sparkContext.broadcast(needles)
    weights = list(WEIGHTS.values())
    counts_from = T.GRAM

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        words = shared.value
        automaton = Automaton()
        for i, word in enumerate(words):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for batch in batches:
            rows: list[int] = []
            found: list[str] = []
            occ: list[int] = []
            for row, texts in enumerate(zip(*(batch.column(c).to_pylist() for c in WEIGHTS))):
                seen: dict[int, int] = {}
                for text, weight in zip(texts, weights):
                    for _, i in automaton.iter(text):
                        seen[i] = seen.get(i, 0) + weight
                rows.extend([row] * len(seen))
                found.extend(words[i] for i in seen)
                occ.extend(n if len(words[i]) >= counts_from else 0 for i, n in seen.items())
            kept = batch.select(["chunk_id", "doc_id", "tokens"]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(found, pa.string()), pa.array(occ, pa.int64())],
                names=["chunk_id", "doc_id", "tokens", "needle", "occ"],
            )

    ids = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("chunk_id", "doc_id"))
    return lowered(chunks).mapInArrow(scan, f"{ids}, tokens bigint, needle string, occ bigint")


def match_postings(chunks: DataFrame, needles: DataFrame) -> DataFrame:
    """Matches of any number of needles (column ``needle``), by n-gram postings.

    Every needle is looked up by its rarest n-gram in these chunks, then verified in the text.
    """
    size = F.least(F.length("needle"), F.lit(T.GRAM))
    wanted = needles.select(
        "needle",
        F.explode(
            F.when(size == 3, F.array_distinct(T.grams(F.col("needle"), 3))).otherwise(F.array("needle"))
        ).alias("gram"),
    )
    low = F.lower(F.concat_ws("\n", "title", "heading", "content"))
    sizes = sorted(r["n"] for r in needles.select(size.alias("n")).distinct().collect())
    every = F.flatten(F.array(*[T.text_grams(low, n) for n in sizes]))
    listed = chunks.select("chunk_id", F.explode(every).alias("gram"))
    postings = checkpoint(listed.join(wanted.select("gram").distinct(), "gram", "left_semi"))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchor = (
        wanted.join(counts, "gram", "left")
        .groupBy("needle")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a"))
        .select("needle", "a.gram")
    )
    maybe = postings.join(anchor, "gram").select("chunk_id", "needle")
    return (
        maybe.join(lowered(chunks), "chunk_id")
        .filter(has_needle(F.col("needle")))
        .select("chunk_id", "doc_id", "tokens", "needle", occurrences(F.col("needle")).alias("occ"))
    )


def match_needles(chunks: DataFrame, needles: DataFrame, how: str | SearchIndex = "auto") -> DataFrame:
    """chunk_id, doc_id, tokens, needle, occ for every chunk that holds a needle.

    ``how``: a ``SearchIndex`` of these chunks, which reads no texts, whatever the number of needles; or, without one,
    literal, automaton, postings, or auto (also called scan) by the number of distinct needles (at most ``AUTOMATON_NEEDLES`` of them are
    looked at here).
    """
    if isinstance(how, SearchIndex):
        return index_match(how, needles)
    distinct = needles.select("needle").distinct()
    if how in ("auto", "scan"):
        listed = [r["needle"] for r in distinct.limit(AUTOMATON_NEEDLES + 1).collect()]
        how = "literal" if len(listed) <= LITERAL_NEEDLES else "automaton"
        if len(listed) > AUTOMATON_NEEDLES or (how == "automaton" and find_spec("ahocorasick") is None):
            how = "postings"
    elif how != "postings":
        listed = [r["needle"] for r in distinct.collect()]
    if how == "postings":
        return match_postings(chunks, distinct)
    return (match_literal if how == "literal" else match_automaton)(chunks, sorted(listed))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunk count and mean tokens. Build it once per corpus and pass it to ``search``."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(chunk_tokens()).alias("mean_tokens"))


def bm25_term(occ: Column, found: Column, total: Column, tokens: Column, mean: Column) -> Column:
    idf = F.greatest(F.log((total - found + 0.5) / (found + 0.5)), F.lit(IDF_FLOOR))
    length = B * tokens / F.greatest(mean, F.lit(1e-9)) + (1 - B)
    return -(idf * occ * (K1 + 1) / (occ + K1 * length))


def one_row(facts: DataFrame, df: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as scalar subqueries."""
    return df.select("*", *[facts.select(c).scalar().alias(c) for c in facts.columns])


#: Numbers held at once where a task adds up the scores of some chunks.
SCORE_CELLS = 1 << 21


def best_in_tasks(seen: DataFrame, asked: list[tuple], kind: DataType, found: list, stats: Row, limit: int) -> DataFrame:
    """query_id, chunk_id, doc_id, bm25: each task's best ``limit`` chunks of every query, so the best of all are among them.

    ``asked``: (query_id, needle), a bounded list, and the ids' type. A common word of many questions is in most chunks; a row for each of
    these pairs would be many times the texts, so matches come together by chunk and only what a task keeps leaves it.
    """
    spark, places = seen.sparkSession, {r["needle"]: n for n, r in enumerate(found)}
    kinds = [seen.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id")]
    by_query: dict[object, list[int]] = {}
    for query, needle in asked:
        if needle in places:
            by_query.setdefault(query, []).append(places[needle])
    total, mean = stats["n_chunks"], max(stats["mean_tokens"] or 0.0, 1e-9)
    hits = np.array([r["found"] for r in found], np.float64)
    idf = np.maximum(np.log((total - hits + 0.5) / (hits + 0.5)), IDF_FLOOR) if total else hits
    shared = spark.sparkContext.broadcast((list(by_query.items()), idf))
    wanted = spark.createDataFrame(list(places.items()), "needle string, place int")
    rows = seen.join(F.broadcast(wanted), "needle").select("chunk_id", "doc_id", F.struct("place", "occ", "tokens").alias("hit"))
    rows = rows.groupBy("chunk_id", "doc_id").agg(F.collect_list("hit").alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, idf = shared.value
        held: list[list] = [[] for _ in queries]
        least = np.full(len(queries), np.inf)

        def cut(n: int) -> pa.Table:
            every = pa.concat_tables(held[n])
            order = pc.sort_indices(every, [("at", "ascending"), ("chunk_id", "ascending")], null_placement="at_start")
            held[n] = [every.take(order[:limit])]
            if len(every) >= limit:
                least[n] = held[n][0].column("at")[limit - 1].as_py()
            return held[n][0]

        step = max(1, SCORE_CELLS // max(1, len(idf)))
        waiting = np.zeros(len(queries), np.int64)
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            lists = batch.column(2)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            place, occ, tokens = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            part = -(idf[place] * occ * (K1 + 1) / (occ + K1 * (B * tokens / mean + (1 - B))))
            table = np.zeros((len(idf), len(lists)))
            np.add.at(table, (place, row), part)
            ids = pa.table(batch.columns[:2], names=["chunk_id", "doc_id"])
            for n, (_, own) in enumerate(queries):
                score = table[own].sum(axis=0)
                at = np.round(score, DIGITS)
                some = np.flatnonzero((score < 0) & (at <= least[n]))
                if len(some):
                    held[n].append(ids.take(pa.array(some)).append_column("bm25", pa.array(score[some])).append_column("at", pa.array(at[some])))
                    waiting[n] += len(some)
                    if waiting[n] >= limit:
                        cut(n)
                        waiting[n] = 0
        for n, (query, _) in enumerate(queries):
            if held[n]:
                top = cut(n).combine_chunks()
                own = pa.array([query] * len(top), to_arrow_type(kind))
                yield pa.RecordBatch.from_arrays([own, *(top.column(c).combine_chunks() for c in ("chunk_id", "doc_id", "bm25"))], ["query_id", "chunk_id", "doc_id", "bm25"])

    return rows.mapInArrow(run, f"query_id {kind.simpleString()}, chunk_id {kinds[0]}, doc_id {kinds[1]}, bm25 double")


def candidates(
    chunks: DataFrame,
    queries_needles: DataFrame,
    visible: DataFrame | None = None,
    stats: DataFrame | None = None,
    how: str | SearchIndex = "auto",
    limit: int = CANDIDATES,
) -> DataFrame:
    """query_id, chunk_id, doc_id, bm25: per query the best phrase matches, then short-term matches.

    ``visible`` (doc_id) restricts the candidates before the cut, not the corpus statistics. ``how``: as for
    ``match_needles``, or ``scan``: what an index of these chunks would give, by one pass over their texts. A few searches
    of a library cost less that way than the index they would need.
    """
    if stats is None:
        stats = how.stats(chunks.sparkSession) if isinstance(how, SearchIndex) else corpus_stats(chunks)
    pairs = match_needles(chunks, queries_needles, how)
    if how == "scan":  # copies of a chunk are one, as in an index
        pairs = pairs.repartition("chunk_id").groupBy("chunk_id", "doc_id", "tokens", "needle").agg(F.sum("occ").alias("occ"))
    pairs = checkpoint(pairs)
    found = pairs.groupBy("needle").agg(F.count(F.lit(1)).alias("found"))
    seen = pairs if visible is None else pairs.join(visible.select("doc_id").distinct(), "doc_id", "left_semi")

    phrase = queries_needles.filter("kind = 'phrase'").select("query_id", "needle")
    asked = phrase.limit(AUTOMATON_NEEDLES + 1).collect()
    if len(asked) <= AUTOMATON_NEEDLES:
        scored = best_in_tasks(seen, [tuple(r) for r in asked], phrase.schema["query_id"].dataType, found.join(phrase, "needle", "left_semi").collect(), stats.first(), limit)
    else:
        weighed = one_row(stats, seen.join(found, "needle")).select(
            "chunk_id",
            "doc_id",
            "needle",
            bm25_term(*map(F.col, ["occ", "found", "n_chunks", "tokens", "mean_tokens"])).alias("part"),
        )
        scored = (
            weighed.join(phrase, "needle")
            .groupBy("query_id", "chunk_id", "doc_id")
            .agg(F.sum("part").alias("bm25"))
        )
    best = Window.partitionBy("query_id").orderBy(F.round("bm25", DIGITS), "chunk_id")
    ranked = (
        scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= limit).select(
            "query_id", "chunk_id", "doc_id", "bm25", F.col("_r").cast("bigint").alias("ord")
        )
    )

    # Short terms: no statistics; the first chunks by id stand for an unordered scan. A needle's first ones serve all queries.
    short = queries_needles.filter("kind = 'short'").select("query_id", "needle", F.col("ord").alias("at"))
    needed = seen.join(short.select("needle").distinct(), "needle", "left_semi").select("needle", "chunk_id", "doc_id")
    lowest = needed.withColumn("_n", F.row_number().over(Window.partitionBy("needle").orderBy("chunk_id"))).filter(F.col("_n") <= limit)
    first = Window.partitionBy("query_id", "needle").orderBy("chunk_id")
    scanned = (
        lowest.join(short, "needle")
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= limit)
        .select(
            "query_id",
            "chunk_id",
            "doc_id",
            F.lit(0.0).alias("bm25"),
            ((F.col("at") + 1) * (limit + 1) + F.col("_r")).cast("bigint").alias("ord"),
        )
    )
    # A chunk found both ways keeps its phrase row, which comes first.
    return (
        ranked.unionByName(scanned)
        .groupBy("query_id", "chunk_id")
        .agg(F.min_by(F.struct("doc_id", "bm25", "ord"), "ord").alias("c"))
        .select("query_id", "chunk_id", "c.*")
    )


#: Up to so many rows (some megabytes) go to the tasks that scan the chunks, whose texts then need not move.
SHARED_ROWS = 1 << 17


def _with_chunks(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` joined with ``facts`` of their chunks by chunk_id."""
    rows = checkpoint(rows)
    return (F.broadcast(rows) if rows.count() <= SHARED_ROWS else rows).join(facts, "chunk_id")


def score_candidates(cands: DataFrame, chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """Term scores and coverage of the candidates; weak ones dropped.

    With two terms or more a chunk must cover more than half of them, or exactly half while the
    document's candidates together cover more. At most a few hundred rows per query come here.
    """
    texts = chunks.select("chunk_id", "page", "title", "heading", "content")
    rows = (
        _with_chunks(cands, texts)
        .join(plans.select("query_id", F.col("plan.terms").alias("terms")), "query_id")
        .withColumn("_text", haystack())
        .withColumn("scores", T.term_scores(F.col("_text"), F.col("terms")))
        .drop("_text")
    )
    # Candidates are few per query by now, so a document's scores fit one row.
    together = F.collect_list("scores").over(Window.partitionBy("query_id", "doc_id"))
    zero = F.transform("scores", lambda s: F.lit(0.0))
    best = F.aggregate("_together", zero, lambda acc, s: F.zip_with(acc, s, lambda x, y: F.greatest(x, y)))
    rows = (
        rows.withColumn("_together", together)
        .withColumn("coverage", T.coverage(F.col("scores")))
        .withColumn("doc_coverage", T.coverage(best))
        .drop("_together")
        .withColumn("score", F.col("coverage") * 10 + F.least(F.lit(5.0), -F.col("bm25")) / 5)
    )
    over = F.col("coverage") > MIN_COVERAGE + EPS
    half = (F.col("coverage") >= MIN_COVERAGE - EPS) & (F.col("doc_coverage") > MIN_COVERAGE + EPS)
    return rows.filter((F.col("score") > 0) & ((F.size("terms") < 2) | over | half))


def search(
    chunks: DataFrame,
    queries: DataFrame,
    visible: DataFrame | None = None,
    limit: int = 8,
    stats: DataFrame | None = None,
    how: str | SearchIndex = "auto",
) -> DataFrame:
    """Ranked keyword hits: query_id, rank (from 1), chunk_id, doc_id, page, title, heading, snippet, score."""
    plans = checkpoint(query_plans(queries))
    cands = candidates(chunks, query_needles(plans), visible, stats, how)
    scored = score_candidates(cands, chunks, plans)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "ord", "chunk_id")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        "chunk_id",
        "doc_id",
        "page",
        "title",
        "heading",
        T.snippet(drop_pictures("content"), F.col("terms")).alias("snippet"),
        "score",
        "coverage",
        "bm25",
    )


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits known by chunk only, with their texts and a snippet from the start."""
    found = _with_chunks(hits, chunks.select("chunk_id", "doc_id", "page", "title", "heading", F.col("content").alias("_content")))
    return found.withColumn("snippet", T.lead(drop_pictures("_content"))).drop("_content")


def unmentioned_parts(questions: DataFrame, chunks: DataFrame, how: str | SearchIndex = "auto") -> DataFrame:
    """Part numbers in questions that no chunk mentions in any spelling: query_id, part, ord.

    Shelves and collections do not matter here.
    """
    parts = questions.select("query_id", F.posexplode(T.part_numbers("query")).alias("ord", "part"))
    spelled = parts.select("part").distinct().select(
        "part", F.explode(F.transform(T.part_spellings("part"), lambda s: F.lower(s))).alias("needle")
    )
    mentioned = spelled.join(match_needles(chunks, spelled, how), "needle", "left_semi")
    return parts.join(mentioned, "part", "left_anti").select("query_id", "part", "ord")
