"""Session defaults, the shared working folder and stage tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "ripplemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution re-plans joins from real shuffle sizes and splits
    skewed partitions; time zone UTC keeps epoch arithmetic stable; the
    RocksDB provider is what the stateful stream needs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    ``spark.checkpoint.dir`` wins; a folder of our own is made only for a
    local master, where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="ripplemark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Sub-folder of the stage tables that are being made.
_within: ContextVar[str] = ContextVar("within", default="")


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{_within.get()}{label}-{uuid.uuid4().hex}"


@contextmanager
def passing_stages(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the stage tables made inside at its end; the function it gives stages what is to stay."""
    outer = _within.get()
    inner = f"{outer}passing-{uuid.uuid4().hex}/"

    def keep(df: DataFrame, label: str) -> DataFrame:
        _within.set(outer)
        try:
            return stage(df, label)
        finally:
            _within.set(inner)

    _within.set(inner)
    try:
        yield keep
    finally:
        _within.set(outer)
        delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{inner}")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where several consumers need the same intermediate, or where the
    planner should know its true size: a file scan carries byte counts, so
    a join against it is broadcast only when it fits
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise. The
    written table also survives the loss of executors.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder wherever Spark's file systems reach it; an absent one is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stages(spark: SparkSession) -> None:
    """Deletes the stage tables of this session, for a run whose frames are no longer read."""
    delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
