"""Rank fusion: keyword with semantic, knowledge bases with each other, several searches for one question.

All lists are short (at most 40 rows per query and list), so ranks are plain windows per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Reciprocal-rank constant, list lengths, and how many meaning-only hits are let in.
RRF_K = 60
LIST_LENGTH = 40
SEMANTIC_ONLY_WITH_KEYWORDS = 3
SEMANTIC_ONLY_ALONE = 5
PROJECT_EDGE = 1e-9
# Sums of reciprocal ranks are compared at this many digits, so equal sums tie however they were added.
DIGITS = 12


def rrf(keyword: DataFrame, semantic: DataFrame, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Fuse two ranked lists (query_id, key, rank from 1): query_id, key, score, match, pos.

    Ties keep the order in which the lists first name a row, keyword list first.
    """
    both = keyword.select("query_id", key, "rank", F.lit("keyword").alias("kind"), F.lit(0).alias("list")).unionByName(
        semantic.select("query_id", key, "rank", F.lit("semantic").alias("kind"), F.lit(1).alias("list"))
    )
    fused = both.groupBy("query_id", key).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.when(F.count(F.lit(1)) > 1, "both").otherwise(F.min("kind")).alias("match"),
        F.min(F.struct("list", "rank")).alias("first"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "first.list", "first.rank")
    return fused.select("query_id", key, "score", "match", F.row_number().over(order).cast("bigint").alias("pos"))


def hybrid(keyword: DataFrame, semantic: DataFrame, limit: int = 8, key: str = "chunk_id") -> DataFrame:
    """Keyword and semantic lists fused: query_id, key, score, match, rank.

    Rows found by meaning alone are capped while walking the fused order, before the limit; a few
    more are let in for queries that keywords find nothing for.
    """
    fused = rrf(keyword.filter(F.col("rank") <= LIST_LENGTH), semantic.filter(F.col("rank") <= LIST_LENGTH), key)
    by_pos = Window.partitionBy("query_id").orderBy("pos")
    whole = Window.partitionBy("query_id")
    alone = (F.col("match") == "semantic").cast("int")
    cap = F.when(F.max(1 - alone).over(whole) > 0, SEMANTIC_ONLY_WITH_KEYWORDS).otherwise(SEMANTIC_ONLY_ALONE)
    kept = (
        fused.withColumn("_alone", F.sum(alone).over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_cap", cap)
        .filter((F.col("match") != "semantic") | (F.col("_alone") <= F.col("_cap")))
    )
    return (
        kept.withColumn("rank", F.row_number().over(by_pos))
        .filter(F.col("rank") <= limit)
        .select("query_id", key, "score", "match", F.col("rank").cast("bigint").alias("rank"))
    )


def merge_scopes(project: DataFrame, everywhere: DataFrame, limit: int = 8, key: str = "chunk_id") -> DataFrame:
    """Two knowledge bases' ranked hits in one list, by rank; the project's win ties.

    Adds scope and the merged rank; a hit keeps the score its own search gave it.
    """
    both = project.withColumn("scope", F.lit("project")).unionByName(everywhere.withColumn("scope", F.lit("global")))
    edge = F.when(F.col("scope") == "project", PROJECT_EDGE).otherwise(0.0)
    merged = 1.0 / (RRF_K + F.col("rank") - 1) + edge
    order = Window.partitionBy("query_id").orderBy(F.desc(merged), F.desc("scope"), "rank", key)
    return (
        both.withColumn("_m", F.row_number().over(order))
        .filter(F.col("_m") <= limit)
        .withColumn("rank", F.col("_m").cast("bigint"))
        .drop("_m")
    )


def merge_searches(hits: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    """Several searches' hits for one question: question_id, scope, key, score, pos (from 1).

    ``hits``: question_id, search (order of the search), scope, key, rank (from 1, per search and
    question). Sums reciprocal ranks; ties keep the order in which hits were first seen.
    """
    summed = hits.groupBy("question_id", "scope", key).agg(
        F.sum(1.0 / (RRF_K + F.col("rank") - 1)).alias("score"), F.min(F.struct("search", "rank")).alias("first")
    )
    order = Window.partitionBy("question_id").orderBy(
        F.desc(F.round("score", DIGITS)), "first.search", "first.rank", F.desc("scope"), key
    )
    return (
        summed.withColumn("pos", F.row_number().over(order).cast("bigint"))
        .filter(F.col("pos") <= limit)
        .select("question_id", "scope", key, "score", "pos")
    )


def with_fallback(found: DataFrame, fallback: DataFrame, key: str = "question_id") -> DataFrame:
    """``found``, plus the fallback's rows for questions that found nothing."""
    return found.unionByName(fallback.join(found.select(key).distinct(), key, "left_anti"))
