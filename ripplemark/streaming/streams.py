"""Continuous versions of the folds; each ends in the table of its batch twin.

A stream is given the folder of its table and of its checkpoint, and its
trigger. Called again with the same folders it goes on where it stopped, so
new files are read once. Every micro-batch writes what it contributes to a
sub-folder of its own, overwritten if the batch runs again; now and then
the folders so far are folded into one, and readers take the last folded
folder and the batches after it. What a batch contributes does not depend
on other batches, so commands may arrive in any order. A fold deletes what
the fold before it had covered; so a reader may go on for as many batches as
lie between two folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ripplemark.operators import folds
from ripplemark.session import delete, stage_path

# Batches between two folds of a table.
COMPACT_EVERY = 16


class Updates:
    """A table of contributions: ``kind=batch|folded/id=n/`` below one folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str, reduce: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.reduce = spark, path.rstrip("/"), schema, reduce

    def rows(self) -> DataFrame:
        """The contributions that count, without the folders that were folded."""
        try:
            every = self.spark.read.schema(f"{self.schema}, kind string, id bigint").parquet(self.path)
        except AnalysisException as missing:  # no batch has come yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)
        folded = self._folded(every)
        if folded is not None:
            kept = (F.col("kind") == "folded") & (F.col("id") == folded) | (F.col("kind") == "batch") & (F.col("id") > folded)
            every = every.filter(kept)
        return every.drop("kind", "id")

    def _folded(self, every: DataFrame) -> int | None:
        """Number of the last fold."""
        return every.filter("kind = 'folded'").agg(F.max("id")).first()[0]

    def _folders(self, kind: str, until: int) -> list[str]:
        """Folders of one kind up to a number; there are a few more than batches between two folds."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/kind={kind}/id=*")
        listed = found.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(found) or []
        paths = [entry.getPath().toString() for entry in listed]
        return [path for path in paths if int(path.rsplit("=", 1)[1]) <= until]

    def save(self, batch: DataFrame, number: int, every: int) -> None:
        self.reduce(batch).write.mode("overwrite").parquet(f"{self.path}/kind=batch/id={number}")
        if number % every != every - 1:
            return
        before = number - every
        self.reduce(self.rows()).write.mode("overwrite").parquet(f"{self.path}/kind=folded/id={number}")
        for covered in [*self._folders("batch", before), *self._folders("folded", before - 1)]:
            delete(self.spark, covered)


def _run(stream: DataFrame, updates: Updates | CommandResults, checkpoint: str, trigger: dict | None, every: int):
    writer = stream.writeStream.outputMode("update").foreachBatch(lambda batch, number: updates.save(batch, number, every))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _finish(query: StreamingQuery, trigger: dict | None) -> None:
    """Waits for a query whose trigger ends."""
    if not trigger or trigger.get("availableNow") or trigger.get("once"):
        query.awaitTermination()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _kept(
    stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], label: str, path: str | None, checkpoint: str | None,
    trigger: dict | None, compact_every: int,
) -> Updates:
    """Runs a stream of contributions. A trigger that ends is waited for; any other query goes on beside the caller."""
    spark = stream.sparkSession
    base = stage_path(spark, label) if path is None or checkpoint is None else ""
    updates = Updates(spark, path or f"{base}/table", _ddl(stream), reduce)
    _finish(_run(stream, updates, checkpoint or f"{base}/checkpoint", trigger, compact_every), trigger)
    return updates


# ------------------------------------------------- ST1 subscriptions --


def subscription_stream(
    commands: DataFrame, path: str | None = None, checkpoint: str | None = None, trigger: dict | None = None,
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Subscriptions from a command stream, equal to :func:`folds.subscriptions`.

    ``commands`` streams ``(seq, ts, user_id, op, plan)`` in any order. Each
    batch keeps the commands that can still count; the batch twin folds what
    the batches kept.
    """
    chosen = commands.select("seq", F.col("ts").cast("timestamp").alias("ts"), "user_id", "op", "plan")
    updates = _kept(chosen, folds.subscription_relevant, "subscription_stream", path, checkpoint, trigger, compact_every)
    return folds.subscriptions(updates.rows())


class CommandResults:
    """Results of a command stream so far: the last word on most commands, and those that a late create may still change.

    A create of smaller ``seq`` that arrives late turns "no subscription"
    into an accepted command, never the other way round. So accepted and
    unknown plans are written once, for good; commands without a
    subscription yet are kept beside the first valid create of each user
    and judged when they are read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        def first(rows: DataFrame) -> DataFrame:
            return rows.groupBy("user_id").agg(F.min("first_create").alias("first_create"))

        types = {f.split()[0].strip("`"): f.split()[1] for f in schema.split(", ")}
        final = f"{schema}, reason string"
        self.creates = Updates(spark, f"{path}/creates", f"user_id {types['user_id']}, first_create {types['seq']}", first)
        self.open = Updates(spark, f"{path}/open", schema, lambda rows: rows)
        self.final = Updates(spark, f"{path}/final", final, lambda rows: rows)

    def save(self, batch: DataFrame, number: int, every: int) -> None:
        """A batch's part of the three tables. Run again, it overwrites what it wrote; results are never folded away."""
        self.creates.save(folds.first_creates(batch), number, every)
        judged = folds.judged(batch, self.creates.rows().groupBy("user_id").agg(F.min("first_create").alias("first_create")))
        judged.persist()
        try:
            waits = F.coalesce(F.col("reason").startswith(folds.NO_SUBSCRIPTION), F.lit(False))
            judged.filter(~waits).write.mode("overwrite").parquet(f"{self.final.path}/kind=batch/id={number}")
            judged.filter(waits).drop("reason").write.mode("overwrite").parquet(f"{self.open.path}/kind=batch/id={number}")
        finally:
            judged.unpersist()

    def rows(self) -> DataFrame:
        creates = self.creates.reduce(self.creates.rows())
        return self.final.rows().unionByName(folds.judged(self.open.rows(), creates))


def command_result_stream(
    commands: DataFrame, path: str | None = None, checkpoint: str | None = None, trigger: dict | None = None,
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Each command of a stream with its rejection reason, equal to :func:`folds.command_results`.

    Commands come in any order, each once. The only state is one number per
    user, the first valid create, aggregated within tasks before it is
    shuffled: a user with a third of all commands is no single task's work,
    as a state object per user would be.
    """
    spark = commands.sparkSession
    chosen = commands.select("seq", "user_id", "op", "plan")
    base = stage_path(spark, "command_results") if path is None or checkpoint is None else ""
    results = CommandResults(spark, (path or f"{base}/table").rstrip("/"), _ddl(chosen))
    _finish(_run(chosen, results, checkpoint or f"{base}/checkpoint", trigger, compact_every), trigger)
    return results.rows()


# ---------------------------------------------- ST2 dependency edges --


def dependency_edge_stream(
    access: DataFrame, path: str | None = None, checkpoint: str | None = None, trigger: dict | None = None,
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Distinct (test_id, config_key) of an access stream; no late access is lost."""
    edges = access.select("test_id", "config_key")
    updates = _kept(edges, lambda rows: rows.distinct(), "edge_stream", path, checkpoint, trigger, compact_every)
    return updates.rows().distinct()


# --------------------------------------------------- ST3 last writes --


def last_write_stream(
    events: DataFrame, key: str, value: str, default: str | None = None, path: str | None = None,
    checkpoint: str | None = None, trigger: dict | None = None, compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Last write per key of a stream, equal to :func:`folds.latest_value`.

    A streaming aggregation: the state store holds one write per key, merged
    within tasks before the shuffle, and a batch hands on only the keys it
    changed.
    """
    updates = _kept(
        folds.last_writes(events, key, value), lambda rows: folds.last_writes(rows, key, value), f"last_{value}_stream",
        path, checkpoint, trigger, compact_every,
    )
    return folds.latest_value(updates.rows(), key, value, default)
