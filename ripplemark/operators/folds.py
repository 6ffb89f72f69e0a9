"""State of the media platform folded from its event tables.

One user may hold a large share of all events, so no operator gathers a
user's events in one task. Events carry a unique, growing ``seq``, dense
or sparse; work that needs order is done per range of (user, seq), and
ranges are then combined from one small row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from ripplemark.functions.facts import WHITE_SPACE
from ripplemark.session import stage

PAGE = 1000

# ---- fixed values ----
PLANS = ["Basic", "Premium", "Enterprise"]
CHANNELS = ["email", "sms", "push"]
DEFAULT_PLAN = "basic"
DEFAULT_CHANNEL = "email"
NO_SUBSCRIPTION = "No subscription found for user: "
# ---- end of fixed values ----


def positions(events: DataFrame, key: str) -> DataFrame:
    """Append ``pos``, the 1-based rank of each row by ``seq`` within its key.

    Rows are cut into ranges of (key, seq) of about equal size, whatever the
    values of ``seq`` are, and written once. Ranks are taken inside
    (key, range) and shifted by the number of rows in the key's earlier
    ranges, so the rows of a very active key are ranked by many tasks.
    """
    ranged = stage(events.repartitionByRange(F.col(key), F.col("seq")).withColumn("_range", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("_rank", F.row_number().over(Wd.partitionBy(key, "_range").orderBy("seq")))
    before = Wd.partitionBy(key).orderBy("_range").rowsBetween(Wd.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(key, "_range")
        .agg(F.count("*").alias("_n"))
        .select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        local.join(offsets, [key, "_range"])
        .withColumn("pos", F.col("_before") + F.col("_rank"))
        .drop("_range", "_rank", "_before")
    )


# ------------------------------------------------- watchlist and history --


def media_entries(events: DataFrame) -> DataFrame:
    """Added items in arrival order, duplicates kept: ``(user_id, pos, media_id)``."""
    ranked = positions(events.select("user_id", "seq", "media_id"), "user_id")
    return ranked.select("user_id", "pos", "media_id")


def media_pages(entries: DataFrame, users: DataFrame, page: int = PAGE) -> DataFrame:
    """Lists per asked user, in pages of bounded length.

    An unknown user has one empty page 0. The whole list of a user is its
    pages in order, however long. Pages are the left side of a semi join, so
    those of one very active user can be split over tasks.
    """
    asked = users.select("user_id").distinct()
    pages = (
        entries.join(asked, "user_id", "left_semi")
        .withColumn("page", F.floor((F.col("pos") - 1) / page))
        .groupBy("user_id", "page")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "media_id"))).alias("items"))
        .select("user_id", "page", F.col("items.media_id").alias("media_ids"))
    )
    empty = asked.join(entries.select("user_id").distinct(), "user_id", "left_anti").select(
        "user_id", F.lit(0).cast("bigint").alias("page"), F.array().cast("array<string>").alias("media_ids")
    )
    return pages.unionByName(empty)


# ---------------------------------------------------------- subscriptions --


def is_known_plan() -> Column:
    return F.coalesce(F.col("plan").isin(PLANS), F.lit(False))


def _is_create() -> Column:
    return (F.col("op") == "create") & is_known_plan()


def _sets_plan() -> Column:
    return F.col("op").isin("create", "upgrade") & is_known_plan()


def _marks(commands: DataFrame) -> DataFrame:
    """Per user the ``seq`` of the last valid create and of the last valid plan."""
    return commands.groupBy("user_id").agg(
        F.max(F.when(_is_create(), F.col("seq"))).alias("create_seq"),
        F.max(F.when(_sets_plan(), F.col("seq"))).alias("plan_seq"),
    )


def subscription_relevant(commands: DataFrame) -> DataFrame:
    """The commands that can still count, whatever commands arrive later.

    Those are the last valid create and the last valid plan, and every
    cancel after that create: smaller cancels are void for good, and a
    larger create that is yet to come can only void more of them.
    """
    marks = _marks(commands)
    cancels = (F.col("op") == "cancel") & (F.col("create_seq").isNull() | (F.col("seq") > F.col("create_seq")))
    counts = _is_create() & (F.col("seq") == F.col("create_seq")) | _sets_plan() & (F.col("seq") == F.col("plan_seq")) | cancels
    return commands.join(marks, "user_id").filter(counts).select("seq", "ts", "user_id", "op", "plan")


def subscriptions(commands: DataFrame) -> DataFrame:
    """Subscription per user after all commands in ``seq`` order, given in any order.

    A valid create replaces the record, a valid upgrade changes its plan,
    the first cancel after the create is kept. Two hash aggregations of
    numbers, merged within tasks first; a plan is carried as its place in
    the list of plans.
    """
    cancel = F.when((F.col("op") == "cancel") & (F.col("seq") > F.col("create_seq")), F.col("seq"))
    plans = F.array(*[F.lit(p) for p in PLANS])
    place = F.array_position(plans, F.col("plan"))
    return (
        commands.join(_marks(commands).filter("create_seq is not null"), "user_id")
        .groupBy("user_id")
        .agg(
            F.max(F.when(_sets_plan() & (F.col("seq") == F.col("plan_seq")), place)).alias("place"),
            F.max(F.when(_is_create() & (F.col("seq") == F.col("create_seq")), F.col("ts"))).alias("started_at"),
            F.min_by("ts", cancel).alias("cancelled_at"),
            F.min(cancel).alias("cancel_seq"),
        )
        .select(
            "user_id",
            F.element_at(plans, F.col("place").cast("int")).alias("plan_name"),
            "started_at",
            "cancelled_at",
            F.col("cancel_seq").isNull().alias("is_active"),
        )
    )


def subscription_of(current: DataFrame, users: DataFrame) -> DataFrame:
    """Subscriptions of the asked users, NULL where there is none."""
    return users.select("user_id").distinct().join(current, "user_id", "left")


def first_creates(commands: DataFrame) -> DataFrame:
    """First valid create per user: ``(user_id, first_create)``."""
    creates = commands.filter(_is_create())
    return creates.groupBy("user_id").agg(F.min("seq").alias("first_create"))


def judged(commands: DataFrame, creates: DataFrame) -> DataFrame:
    """Each command with its rejection reason, given the first valid create of each user."""
    missing = F.col("first_create").isNull() | (F.col("first_create") > F.col("seq"))
    reason = F.when(
        F.col("op").isin("create", "upgrade") & ~is_known_plan(), F.concat(F.lit("Unknown plan: "), F.coalesce("plan", F.lit("")))
    ).when(
        F.col("op").isin("cancel", "upgrade") & missing,
        F.concat(F.lit(NO_SUBSCRIPTION), F.col("user_id").cast("string")),
    )
    return commands.join(creates, "user_id", "left").select("seq", "user_id", "op", "plan", reason.alias("reason"))


def command_results(commands: DataFrame) -> DataFrame:
    """Each command with its rejection reason, NULL when accepted.

    Whether a subscription exists at a command depends only on the user's
    first valid create, one small row per user.
    """
    return judged(commands, first_creates(commands))


def last_writes(events: DataFrame, key: str, value: str) -> DataFrame:
    """Last write per key by ``seq``, with its number: ``(key, seq, value)``. One aggregation, merged within tasks first."""
    last = events.groupBy(key).agg(F.max("seq").alias("seq"), F.max_by(value, "seq").alias(value))
    return last.select(key, "seq", value)


def latest_value(events: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """Last write per key by ``seq``; a missing value takes the default."""
    written = F.col(value) if default is None else F.coalesce(F.col(value), F.lit(default))
    return last_writes(events, key, value).select(key, written.alias(value))


def plan_preferences(events: DataFrame) -> DataFrame:
    """Unvalidated plan per user, last write wins."""
    return latest_value(events, "user_id", "plan", DEFAULT_PLAN)


def channel_preferences(events: DataFrame) -> DataFrame:
    """Channel per user, last write wins."""
    return latest_value(events, "user_id", "channel", DEFAULT_CHANNEL)


def preference_of(preferences: DataFrame, users: DataFrame) -> DataFrame:
    """Preference of the asked users, NULL when unknown."""
    return users.select("user_id").distinct().join(preferences, "user_id", "left")


# ---------------------------------------------------------- notifications --


def send_results(requests: DataFrame) -> DataFrame:
    """Each request with id and sent flag, or the reason it is rejected."""
    blank = F.coalesce(F.regexp_replace("user_id", f"{WHITE_SPACE}+", ""), F.lit("")) == ""
    supported = F.coalesce(F.col("channel").isin(CHANNELS), F.lit(False))
    reason = F.when(blank, F.lit("userId is required")).when(
        ~supported, F.concat(F.lit("Unsupported channel: "), F.coalesce("channel", F.lit("")))
    )
    identity = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "user_id", "channel"), 256)
    return (
        requests.withColumn("reason", reason)
        .withColumn("notification_id", F.when(F.col("reason").isNull(), identity))
        .withColumn("sent_at", F.when(F.col("reason").isNull(), F.col("ts")))
        .withColumn("is_sent", F.col("sent_at").isNotNull())
    )


def notifications(results: DataFrame) -> DataFrame:
    """Accepted notifications."""
    return results.filter(F.col("reason").isNull()).select(
        "notification_id", "seq", "user_id", "channel", "subject", "body",
        F.col("ts").alias("created_at"), "sent_at", "is_sent",
    )


def notifications_by_id(saved: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Latest save of each id; with ``ids``, a lookup with NULLs for misses."""
    last = saved.groupBy("notification_id").agg(F.max_by(F.struct(*saved.columns), "seq").alias("last"))
    latest = last.select("last.*").select("notification_id", "seq", *[c for c in saved.columns if c not in ("notification_id", "seq")])
    if ids is None:
        return latest
    return ids.select("notification_id").distinct().join(latest, "notification_id", "left")


def newest_first(saved: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Notifications, of the asked users if given, newest first, ties by ``seq``.

    One sort over (user, time, seq). Its ranges are cut between rows, not
    between users, so the list of a very active user, or of one instant,
    spreads over as many tasks as it needs.
    """
    wanted = saved if users is None else saved.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return wanted.orderBy("user_id", F.desc("created_at"), "seq")
