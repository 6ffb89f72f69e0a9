import random
from datetime import datetime

from ripplemark.operators import folds
from ripplemark.streaming import streams
from tests.conftest import rows
from tests.test_folds import COMMANDS, random_commands


def as_stream(spark, tmp_path, data, schema, batches=4):
    """A stream that delivers the rows, in order, in several micro-batches."""
    step = -(-len(data) // batches)
    for i in range(batches):
        part = data[i * step : (i + 1) * step]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    return (
        spark.readStream.schema(source.schema)
        .option("maxFilesPerTrigger", 1)
        .option("latestFirst", "false")
        .parquet(str(tmp_path / "in"))
    )


def test_subscription_stream_equals_batch(spark, tmp_path):
    """Commands come in any order, and the table is folded on the way."""
    commands = random_commands(400)
    random.Random(7).shuffle(commands)
    stream = as_stream(spark, tmp_path, commands, COMMANDS, batches=6)
    got = streams.subscription_stream(stream, compact_every=2)
    want = folds.subscriptions(spark.createDataFrame(commands, COMMANDS))
    assert rows(got) == rows(want) and len(rows(want)) == 8


def test_late_create_and_older_plan(spark, tmp_path):
    at = datetime(2024, 1, 1)
    late = [(5, at, 1, "cancel", None), (3, at, 1, "create", "Basic"), (9, at, 1, "upgrade", "Premium"), (7, at, 1, "upgrade", "Basic")]
    got = streams.subscription_stream(as_stream(spark, tmp_path, late, COMMANDS, batches=4))
    assert [(r.plan_name, r.is_active) for r in got.collect()] == [("Premium", False)]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    commands = random_commands(300)
    kept = {"path": str(tmp_path / "table"), "checkpoint": str(tmp_path / "checkpoint"), "compact_every": 2}
    for part in (commands[200:], commands[:100], commands[100:200]):
        stream = as_stream(spark, tmp_path, part, COMMANDS, batches=2)
        got = streams.subscription_stream(stream, **kept)
    assert rows(got) == rows(folds.subscriptions(spark.createDataFrame(commands, COMMANDS)))
    # Every file was read once: six batches, numbered on through the calls.
    assert sorted(p.name for p in (tmp_path / "checkpoint" / "commits").glob("[0-9]*")) == [str(i) for i in range(6)]
    # The last fold has deleted what the one before it had covered.
    assert sorted(p.name for p in (tmp_path / "table" / "kind=batch").glob("id=*")) == ["id=4", "id=5"]
    assert sorted(p.name for p in (tmp_path / "table" / "kind=folded").glob("id=*")) == ["id=3", "id=5"]


def test_command_result_stream_equals_batch(spark, tmp_path):
    """Late creates change what earlier batches had to reject."""
    commands = random_commands(400)
    random.Random(8).shuffle(commands)
    kept = {"path": str(tmp_path / "table"), "checkpoint": str(tmp_path / "checkpoint"), "compact_every": 2}
    for part in (commands[300:], commands[:300]):
        got = streams.command_result_stream(as_stream(spark, tmp_path, part, COMMANDS, batches=3), **kept)
    want = rows(folds.command_results(spark.createDataFrame(commands, COMMANDS)))
    assert rows(got) == want and {None, "Unknown plan: "} < {r[4] and r[4][:14] for r in want}


def test_late_create_accepts_a_rejected_command(spark, tmp_path):
    at = datetime(2024, 1, 1)
    kept = {"path": str(tmp_path / "table"), "checkpoint": str(tmp_path / "checkpoint")}
    reasons = []
    for command in ((5, at, 1, "cancel", None), (7, at, 1, "create", "Basic"), (3, at, 1, "create", "Basic")):
        got = streams.command_result_stream(as_stream(spark, tmp_path, [command], COMMANDS, batches=1), **kept)
        reasons.append({r.seq: r.reason for r in got.collect()})
    rejected = "No subscription found for user: 1"
    assert reasons == [{5: rejected}, {5: rejected, 7: None}, {3: None, 5: None, 7: None}]


def test_edge_stream_equals_distinct(spark, tmp_path):
    access = [(f"T{i % 7}", f"k{i % 11}") for i in range(300)]
    stream = as_stream(spark, tmp_path, access, "test_id string, config_key string")
    got = rows(streams.dependency_edge_stream(stream))
    assert got == sorted(set(access))


def test_last_write_stream_equals_batch(spark, tmp_path):
    writes = [(i, f"u{i * i % 9}", None if i % 5 == 0 else f"p{i}") for i in range(200)]
    schema = "seq long, user_id string, plan string"
    stream = as_stream(spark, tmp_path, writes, schema)
    got = streams.last_write_stream(stream, "user_id", "plan", folds.DEFAULT_PLAN)
    assert rows(got) == rows(folds.plan_preferences(spark.createDataFrame(writes, schema)))


def test_last_writes_come_late_and_twice(spark, tmp_path):
    """State goes on through calls; an older write that comes late changes nothing, a NULL is a write."""
    schema = "seq long, user_id string, plan string"
    kept = {"path": str(tmp_path / "table"), "checkpoint": str(tmp_path / "checkpoint"), "compact_every": 2}
    for part in ([(5, "a", "p5"), (4, "b", "p4")], [(3, "a", "p3"), (6, "b", None)], [(5, "a", "p5")]):
        stream = as_stream(spark, tmp_path, part, schema, batches=1)
        got = streams.last_write_stream(stream, "user_id", "plan", "basic", **kept)
    assert rows(got) == [("a", "p5"), ("b", "basic")]
