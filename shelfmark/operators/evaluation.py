"""Retrieval evaluation: questions, relevance, ranks and metrics. One job serves every question and mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import strip
from shelfmark.session import checkpoint

DEPTH = 8


def parse_questions(lines: DataFrame) -> DataFrame:
    """line, question, expected (array of doc, page; empty: unanswerable) and ``bad`` for unreadable lines.

    ``lines``: line, text as "question | answer". The last bar divides; answers part at semicolons.
    """
    text = strip("text")
    rows = lines.withColumn("text", text).filter((F.col("text") != "") & ~F.startswith("text", F.lit("#")))
    question = strip(F.regexp_extract("text", r"^(.*)\|", 1))
    answer = F.when(F.contains("text", F.lit("|")), strip(F.substring_index("text", "|", -1))).otherwise("")
    parts = F.filter(F.transform(F.split("answer", "[;；]"), strip), lambda p: p != "")
    page = r"(?i)^(.*?)\s+p\.?\s*(\d+)$"

    def expect(part: Column) -> Column:
        number = F.regexp_extract(part, page, 2)
        doc = F.when(number != "", strip(F.regexp_extract(part, page, 1))).otherwise(part)
        return F.struct(doc.alias("doc"), F.when(number != "", number).cast("int").alias("page"))

    none = F.array().cast("array<struct<doc:string,page:int>>")
    return rows.select("line", question.alias("question"), answer.alias("answer")).select(
        "line",
        "question",
        F.when(F.col("answer") == "-", none).otherwise(F.transform(parts, expect)).alias("expected"),
        ((F.col("question") == "") | (F.col("answer") == "")).alias("bad"),
    )


def expected_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed lines in long form: questions (query_id, question) and their answers, one a row (query_id, doc, page)."""
    good = parsed.filter("not bad")
    gold = good.select(F.col("line").alias("query_id"), F.explode("expected").alias("e")).select("query_id", "e.doc", "e.page")
    return good.select(F.col("line").alias("query_id"), "question"), gold


def ranks(questions: DataFrame, gold: DataFrame, hits: DataFrame, modes: list[str]) -> DataFrame:
    """Per question and mode: rank of the first relevant hit (0: none), hits, what came on top, whether it has an answer.

    ``questions``: query_id. ``gold``: query_id, doc (an id or part of a title), page (null: any); any number of rows a
    question. ``hits``: mode, query_id, rank, doc_id, title, page. A question has a few hits, so answers meet them by
    question and are counted in parts; no list of answers is gathered.
    """
    asked = questions.select("query_id", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    near = hits.filter(F.col("rank") <= DEPTH).select("mode", "query_id", "rank", F.col("doc_id").cast("string").alias("doc_id"), "title", F.col("page").alias("at"))
    named = (F.col("doc_id") == F.col("doc")) | F.contains(F.lower("title"), F.lower("doc"))
    right = gold.join(near, "query_id").filter(named & (F.col("page").isNull() | F.col("page").eqNullSafe(F.col("at"))))
    first = right.groupBy("mode", "query_id").agg(F.min("rank").alias("first"))
    top = F.concat("title", F.when(F.col("at") > 0, F.concat(F.lit(" p."), F.col("at").cast("string"))).otherwise(""))
    seen = near.groupBy("mode", "query_id").agg(F.count(F.lit(1)).alias("hits"), F.min_by(top, "rank").alias("top"))
    answered = gold.select("query_id", F.lit(True).alias("has")).distinct()
    whole = asked.join(seen, ["mode", "query_id"], "left").join(first, ["mode", "query_id"], "left").join(answered, "query_id", "left")
    return whole.select("mode", "query_id", F.coalesce("first", F.lit(0)).alias("rank"), F.coalesce("hits", F.lit(0)).alias("count"), "top", F.coalesce("has", F.lit(False)).alias("answerable"))


MODES = {"keyword": "search", "hybrid": "find", "semantic": "find_semantic"}


def run_eval(library, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """``ranks`` of every question in every mode that the library (or a knowledge base) can answer.

    Each mode answers all questions in one job; while there are no vectors, words are the only mode. ``metrics``,
    ``summary`` and ``detail_rows`` make the report of it.
    """
    modes = list(MODES) if library.semantic_ready() else ["keyword"]
    asked = questions.select("query_id", F.col("question").alias("query"))
    found = [getattr(library, MODES[m])(asked, DEPTH).select(F.lit(m).alias("mode"), "query_id", "rank", "doc_id", "title", "page") for m in modes]
    return ranks(questions, gold, checkpoint(reduce(DataFrame.unionByName, found)), modes)


def metrics(ranked: DataFrame) -> DataFrame:
    """One row per mode: answerable, hit1, hit3, hit8, mrr, unanswerable, quiet."""
    yes = F.col("answerable")

    def within(k: int) -> Column:
        return F.count_if(yes & (F.col("rank") > 0) & (F.col("rank") <= k)).alias(f"hit{k}")

    gain = F.when(F.col("rank") > 0, 1.0 / F.greatest(F.col("rank"), F.lit(1))).otherwise(0.0)
    return ranked.groupBy("mode").agg(
        F.count_if(yes).alias("answerable"),
        within(1),
        within(3),
        within(8),
        F.coalesce(F.avg(F.when(yes, gain)), F.lit(0.0)).alias("mrr"),
        F.count_if(~yes).alias("unanswerable"),
        F.count_if(~yes & (F.col("count") == 0)).alias("quiet"),
    )


def percent(part: Column, whole: Column) -> Column:
    share = F.floor(part * 100.0 / F.greatest(whole, F.lit(1)) + 0.5).cast("bigint").cast("string")
    return F.when(whole > 0, F.concat(share, F.lit("%"))).otherwise("–")


def summary(measured: DataFrame) -> DataFrame:
    """The metrics as shown: whole percentages, MRR with two decimals, a dash for no questions."""
    answerable = F.col("answerable")
    return measured.select(
        "mode",
        *[percent(F.col(c), answerable).alias(c) for c in ("hit1", "hit3", "hit8")],
        F.when(answerable > 0, F.format_string("%.2f", F.round("mrr", 2))).otherwise("–").alias("mrr"),
        percent(F.col("quiet"), F.col("unanswerable")).alias("quiet"),
    )


def detail_rows(ranked: DataFrame) -> DataFrame:
    """What a report says per question and mode: the rank, or what came instead."""
    top = F.replace(F.coalesce("top", F.lit("")), F.lit("|"), F.lit("\\|"))
    missed = F.concat(F.lit("not found"), F.when(top != "", F.concat(F.lit(" · "), top)).otherwise(""))
    answer = F.when(F.col("rank") > 0, F.concat(F.lit("#"), F.col("rank").cast("string"))).otherwise(missed)
    noise = F.when(F.col("count") > 0, F.concat(F.col("count").cast("string"), F.lit(" · "), top)).otherwise("empty")
    return ranked.select("mode", "query_id", F.when(F.col("answerable"), answer).otherwise(noise).alias("said"))
