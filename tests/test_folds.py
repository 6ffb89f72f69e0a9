import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from ripplemark.operators import folds
from tests.conftest import rows

START = datetime(2024, 1, 1)
COMMANDS = "seq long, ts timestamp, user_id long, op string, plan string"


def at(seq):
    return START + timedelta(seconds=seq)


def random_commands(n=600, users=8, seed=1):
    """Commands of few users; one of them holds about half."""
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        user = 0 if rng.random() < 0.5 else rng.randrange(1, users)
        op = rng.choice(["create", "upgrade", "cancel", "cancel"])
        out.append((seq, at(seq), user, op, rng.choice([*folds.PLANS, "Unknown"])))
    return out


def replay(commands):
    """The state and the rejections, one command after the other."""
    state, rejected = {}, {}
    for seq, ts, user, op, plan in sorted(commands):
        if op in ("create", "upgrade") and plan not in folds.PLANS:
            rejected[seq] = f"Unknown plan: {plan}"
        elif op == "create":
            state[user] = [plan, ts, None]
        elif user not in state:
            rejected[seq] = f"No subscription found for user: {user}"
        elif op == "upgrade":
            state[user][0] = plan
        elif state[user][2] is None:
            state[user][2] = ts
    return state, rejected


@pytest.mark.parametrize("step", [1, 1 << 22])
def test_subscriptions_equal_replay(spark, step):
    commands = random_commands()
    got = folds.subscriptions(spark.createDataFrame([(r[0] * step, *r[1:]) for r in commands], COMMANDS))
    state, _ = replay(commands)
    assert {r.user_id: [r.plan_name, r.started_at, r.cancelled_at] for r in got.collect()} == state
    assert all(r.is_active == (r.cancelled_at is None) for r in got.collect())


def test_rejections_equal_replay(spark):
    commands = random_commands(seed=5, n=300, users=40)
    got = folds.command_results(spark.createDataFrame(commands, COMMANDS))
    _, rejected = replay(commands)
    assert {r.seq: r.reason for r in got.collect() if r.reason} == rejected
    assert got.count() == len(commands)


def test_subscription_examples(spark):
    def run(*ops):
        cmds = [(i, at(i), 1, op, plan) for i, (op, plan) in enumerate(ops)]
        found = folds.subscriptions(spark.createDataFrame(cmds, COMMANDS)).collect()
        return found[0] if found else None

    assert run(("create", "Basic")).is_active
    cancelled = run(("create", "Basic"), ("cancel", None), ("cancel", None))
    assert not cancelled.is_active and cancelled.cancelled_at == at(1)
    upgraded = run(("create", "Basic"), ("cancel", None), ("upgrade", "Premium"))
    assert (upgraded.plan_name, upgraded.is_active) == ("Premium", False)
    again = run(("create", "Basic"), ("cancel", None), ("create", "Enterprise"))
    assert (again.plan_name, again.started_at, again.is_active) == ("Enterprise", at(2), True)
    assert run(("create", "premium"), ("cancel", None)) is None


def test_unknown_user_has_no_subscription(spark, frame):
    current = folds.subscriptions(spark.createDataFrame(random_commands(50), COMMANDS))
    found = folds.subscription_of(current, frame("user_id long", 99)).collect()
    assert [(r.user_id, r.plan_name) for r in found] == [(99, None)]


@pytest.mark.parametrize("step", [1, 1 << 22])
def test_lists_keep_arrival_order(spark, step):
    rng = random.Random(2)
    events = [(s, f"u{0 if rng.random() < 0.6 else rng.randrange(4)}", f"m{rng.randrange(5)}") for s in range(200)]
    want = {}
    for _, user, media in events:
        want.setdefault(user, []).append(media)
    shuffled = rng.sample(events, len(events))
    entries = folds.media_entries(spark.createDataFrame(shuffled, "seq long, user_id string, media_id string").withColumn("seq", F.col("seq") * step))
    got = {}
    for r in sorted(entries.collect(), key=lambda r: (r.user_id, r.pos)):
        assert r.pos == len(got.get(r.user_id, [])) + 1
        got.setdefault(r.user_id, []).append(r.media_id)
    assert got == want

    asked = spark.createDataFrame([("u0",), ("u0",), ("nobody",)], "user_id string")
    pages = folds.media_pages(entries, asked, page=7).orderBy("user_id", "page").collect()
    listed = [m for r in pages if r.user_id == "u0" for m in r.media_ids]
    assert listed == want["u0"]
    assert all(len(r.media_ids) <= 7 for r in pages)
    assert [(r.page, r.media_ids) for r in pages if r.user_id == "nobody"] == [(0, [])]


def test_last_write_wins(frame):
    writes = frame("seq long, user_id string, plan string", (1, "a", "x"), (3, "a", None), (2, "a", "y"), (1, "b", "z"))
    plans = folds.plan_preferences(writes)
    assert rows(plans) == [("a", "basic"), ("b", "z")]
    assert rows(folds.preference_of(plans, frame("user_id string", "a", "c"))) == [("a", "basic"), ("c", None)]


REQUESTS = "seq long, ts timestamp, user_id string, channel string, subject string, body string"


def sent(spark, *requests):
    data = [(i, at(i), user, channel, "s", "b") for i, (user, channel) in enumerate(requests)]
    return folds.send_results(spark.createDataFrame(data, REQUESTS))


def test_send_checks_user_before_channel(spark):
    results = sent(spark, ("u", "email"), (" \t\u00a0", "pigeon"), (None, "sms"), ("u", "carrier_pigeon"), ("u", "Email"), ("u", None))
    assert [r.reason for r in results.orderBy("seq").collect()] == [
        None, "userId is required", "userId is required", "Unsupported channel: carrier_pigeon",
        "Unsupported channel: Email", "Unsupported channel: ",
    ]
    first = results.orderBy("seq").first()
    assert first.is_sent and first.sent_at == at(0) and len(first.notification_id) == 64


def test_notifications_newest_first(spark, frame):
    saved = folds.notifications(sent(spark, *[("u", c) for c in ("email", "sms", "push")], ("v", "sms")))
    ranked = folds.newest_first(saved, frame("user_id string", "u", "w", "u")).collect()
    assert [r.channel for r in ranked] == ["push", "sms", "email"]
    assert [r.user_id for r in folds.newest_first(saved).collect()] == ["u", "u", "u", "v"]


def test_order_holds_across_partitions_and_ties(spark):
    # one user with most rows, most of them of one instant
    rng = random.Random(4)
    data = [(i, at(rng.choice([0, 0, 0, i])), "u" if i % 10 else f"v{i % 3}", "sms", "s", "b") for i in range(500)]
    saved = folds.notifications(folds.send_results(spark.createDataFrame(rng.sample(data, 500), REQUESTS)))
    ranked = folds.newest_first(saved)
    assert [(r.user_id, r.seq) for r in ranked.collect()] == [
        (d[2], d[0]) for d in sorted(data, key=lambda d: (d[2], -d[1].timestamp(), d[0]))
    ]
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Window" not in plan


def test_lookup_by_id_takes_the_latest_save(spark, frame):
    saved = folds.notifications(sent(spark, ("u", "email"), ("v", "sms"))).withColumn("notification_id", F.lit("n1"))
    found = folds.notifications_by_id(saved, frame("notification_id string", "n1", "n2"))
    assert rows(found, "notification_id", "user_id") == [("n1", "v"), ("n2", None)]
    assert folds.notifications_by_id(saved).count() == 1
