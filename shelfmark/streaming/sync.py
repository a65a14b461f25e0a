"""Incremental sync as a stream of manifest files.

A folder that manifests arrive in is followed with a file-source stream. Every micro-batch is
appended, stamped with its batch number, so a batch that is run again after a lost executor or
driver writes the same partition once more and changes nothing; the newest record per document counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.sources.files import MANIFEST


def follow_manifests(spark: SparkSession, inbox: str, table: str, state: str) -> None:
    """Take in what is new in ``inbox`` (JSON lines) and stop; run it again, or on a schedule."""
    arriving = spark.readStream.schema(MANIFEST).option("mode", "DROPMALFORMED").json(inbox)

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.filter("id is not null and path is not null")
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = (
        arriving.writeStream.foreachBatch(take)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_manifests(spark: SparkSession, table: str) -> DataFrame:
    """The newest record per document over all batches: of the last batch that has it, the one added last; of records
    added at the same time the one that reads greater, so that the answer never depends on the order of rows."""
    rows = spark.read.option("basePath", table).parquet(table)
    fields = F.struct(*[f.name for f in MANIFEST.fields if f.name != "id"])
    order = F.struct("batch", *(["added_at"] if "added_at" in MANIFEST.fieldNames() else []), F.to_json(fields))
    return rows.groupBy("id").agg(F.max_by(fields, order).alias("m")).select("id", "m.*")
