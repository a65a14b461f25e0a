"""From raw documents to packed training sequences, stage by stage.

Each stage reads the documents its predecessor kept and returns documents (doc_id, text, lang, source, n_chars), the last
one the pieces of the packed sequences. Between stages documents are Parquet in the shared folder.

* language_id: texts whose language cannot be told (no letter, or too narrow a margin between the best two) go.
* quality_rules: texts that fail a rule go, and all texts of hosts whose drawn-in failure rate is too high.
* near_duplicates: of the documents that 5-word shingles link at 80 % or more, the one with the smallest id stays.
* repeated_passages: bytes covered by repeated 400-byte strings or by repeated passages of over 50 words, however short
  these are, go; a character cut in two goes whole, a document of which nothing but blanks is left goes too.
* packing: what is left, in sequences of 2048 tokens.

Nulls: a null text has no language and goes in the first stage. Rows that share an id are told apart by their texts: of
equal rows one stays, of others that with the smallest hash of its text. A null id is its own group in the third stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm import jaccard_join, language, packing, quality, suffix_dedup
from shelfmark.llm.common import picked
from shelfmark.session import checkpoint, written

#: A repeated passage of so many words goes (over 50), also if it has fewer than 400 bytes.
PASSAGE_WORDS = 51
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language. Learns from the labelled documents of the stage's own input."""
    found = language.classify(docs.select(*COLUMNS), language.train(language.training_rows(docs)))
    return found.where(~F.col("rejected")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects, of hosts that are not blocked."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity 0.8 or more."""

    def copies() -> DataFrame:
        groups = jaccard_join.jaccard_components(docs, width=5, percent=80)
        return groups.where("component_id <> doc_id").select("doc_id").distinct()

    others = written(spark, copies)
    stay = picked(docs.select(*COLUMNS), others, "doc_id", "left_anti")
    # Of rows that share an id: equal texts are one; the smallest digest stays.
    known = docs.where(F.col("doc_id").isNotNull())
    shared = checkpoint(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "source", "lang", "n_chars"))
    once = picked(stay, shared, "doc_id").withColumn("_n", first).where("_n = 1").drop("_n")
    return picked(stay, shared, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages (400 bytes, or PASSAGE_WORDS words); ``n_chars`` follows the text."""
    done = suffix_dedup.remove_repeats(docs.select(*COLUMNS), least_words=PASSAGE_WORDS, as_text=True)
    clean = done.select("doc_id", "lang", "source", "n_chars", F.col("kept").alias("text"))
    return clean.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.packing_query(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack_sequences),
]

#: No SQL: compression, suffix arrays and tokenizers are not SQL's. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again before the next; what a stage wrote on its
    way is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)
