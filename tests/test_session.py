import os
import pathlib

import pytest
from pyspark.sql import functions as F

from shelfmark.session import checkpoint, passing, shared_folder, written


def _frames(spark) -> set:
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    return set(folder.iterdir()) if folder.exists() else set()


def test_written_keeps_its_result_alone(spark):
    before = _frames(spark)

    def inner():
        return checkpoint(spark.range(10)).selectExpr("id * 2 AS id")

    def outer():
        half = written(spark, inner)
        assert len(_frames(spark) - before) == 1  # the inner result; its frame is gone
        return checkpoint(half.where("id < 10")).unionByName(half)

    found = written(spark, outer)
    assert len(_frames(spark) - before) == 1
    assert sorted(r["id"] for r in found.collect()) == sorted([*range(0, 10, 2), *range(0, 20, 2)])
    assert checkpoint(spark.range(3)).count() == 3 and len(_frames(spark) - before) == 2  # outside a scope frames stay


def test_written_clears_up_after_a_failure(spark):
    before, mine = _frames(spark), checkpoint(spark.range(4))

    def fails():
        checkpoint(spark.range(5))
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        written(spark, fails)
    assert len(_frames(spark) - before) == 1 and mine.count() == 4


def _shuffled(spark) -> int:
    """Shuffle files of this session, wherever its block managers keep them."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(name.startswith("shuffle_") for folder in manager.localDirs() for _, _, names in os.walk(folder.getPath()) for name in names)


def test_shuffle_files_go_with_their_execution(spark):
    """Not when the driver happens to collect its garbage: many steps would hold all of theirs on disk at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), _shuffled(spark)
    found = checkpoint(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert _shuffled(spark) <= before and found.count() == 7 and spark.conf.get(key) == setting


def test_passing_frames_go(spark):
    before = _frames(spark)
    with passing(spark):
        assert checkpoint(spark.range(6)).count() == 6
    assert _frames(spark) == before
