"""Session settings, and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
#: Paths that ``checkpoint`` wrote within the innermost running ``written``.
_scope: ContextVar[list[str] | None] = ContextVar("_scope", default=None)
_kept: dict[tuple[str, str], str] = {}


def build_session(app: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir``, as the cluster sets it.

    Only a local master without that setting (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return f"{named.rstrip('/')}/shelfmark-{context.applicationId}"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _folders:
        _folders[context.applicationId] = tempfile.mkdtemp(prefix="shelfmark-")
    return _folders[context.applicationId]


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes an execution's shuffle files when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read to the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read; being a columnar table, later steps
    prune its columns and know its size when they choose a join. What was shuffled for it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with _swept(spark):
        df.write.parquet(path, compression="zstd")
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` returns, as ``checkpoint`` writes it; frames that were written on the way are deleted then.

    Only what this very call wrote goes, and only once the result is whole in the shared folder, so nothing that
    is left has its lineage there and a lost executor costs a re-read of the result. ``make`` must not hand out
    frames of its own by other ways. If it fails, its frames go too. Calls nest: the result belongs to the outer call.
    """
    own: list[str] = []
    token = _scope.set(own)
    try:
        with _swept(spark):
            result = make()
        _scope.reset(token)
        token = None
        return checkpoint(result)
    finally:
        if token:
            _scope.reset(token)
        _delete(spark, own)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Frames that ``checkpoint`` writes within are deleted at the end; nothing of them may be read later."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        with _swept(spark):
            yield
    finally:
        _scope.reset(token)
        _delete(spark, own)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def kept(df_of, spark: SparkSession, name: str) -> DataFrame:
    """A derived table (an index) made once per application and read by many queries."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        df_of().write.parquet(path, compression="zstd")
        _kept[key] = path
    return spark.read.parquet(_kept[key])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan that comes as fewer splits than cores one shuffle; a large scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
