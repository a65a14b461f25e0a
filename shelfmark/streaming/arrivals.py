"""Documents whose manifest and text arrive apart: whichever comes first waits for the other.

Cloud folders hand files over in any order. A manifest without its text is no document yet, and a text without its
manifest is none either. Both are streams of files; they meet by id within a given wait, and what has waited longer than
that, by the files' own times, is forgotten, so the state holds a bounded span of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.sources.files import MANIFEST


def arrived_documents(spark: SparkSession, manifests: str, texts: str, wait: str = "7 days", **options) -> DataFrame:
    """A stream of the manifests' fields and ``text`` for every document of which both files are there.

    ``manifests`` holds one JSON file a document, ``texts`` one Markdown file, both named after its id. Broken JSON, ids that
    are not the file's name and manifests without a path are left out. ``options`` go to both file sources.
    """
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1)
    seen = F.col("_metadata.file_modification_time")
    told = spark.readStream.options(**options).schema(MANIFEST).option("mode", "DROPMALFORMED").option("multiLine", "true").option("pathGlobFilter", "*.json").json(manifests)
    told = told.select("*", name.alias("_name"), seen.alias("_told")).filter("id is not null and path is not null and _name = id").drop("_name").withWatermark("_told", wait)
    read = spark.readStream.options(**options).format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").load(texts)
    read = read.select(name.alias("_id"), F.col("value").alias("text"), seen.alias("_read")).withWatermark("_read", wait)
    span = F.expr(f"_read BETWEEN _told - INTERVAL {wait} AND _told + INTERVAL {wait}")
    return told.join(read, (F.col("id") == F.col("_id")) & span).drop("_told", "_read", "_id")


def follow_documents(spark: SparkSession, manifests: str, texts: str, table: str, state: str, wait: str = "7 days", **options) -> None:
    """Take in what has become whole and stop; run it again, or on a schedule. What is half there waits in ``state``."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    whole = arrived_documents(spark, manifests, texts, wait, **options)
    query = whole.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
