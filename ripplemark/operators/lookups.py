"""Lookups and audits: event rows joined to tables unique by key.

A key that holds many event rows skews the shuffle of these joins; nothing
after them needs that distribution, so adaptive execution may split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----
DEFAULT_RECOMMENDATIONS = ["m1", "m2"]
# ---- end of fixed values ----


def login_audit(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Token and status of each login attempt; passwords are digests."""
    known = users.select("email", F.col("password_digest").alias("_digest"), F.col("user_id").alias("_user"))
    granted = F.coalesce(F.col("_digest") == F.col("password_digest"), F.lit(False))
    return attempts.join(known, "email", "left").select(
        "seq",
        "email",
        F.when(granted, F.col("_user")).alias("user_id"),
        F.when(granted, F.concat(F.lit("token-"), F.col("_user"))).alias("token"),
        F.when(granted, 200).otherwise(401).alias("status"),
    )


def recommendations(recs: DataFrame, users: DataFrame) -> DataFrame:
    """Recommended media per asked user in order, defaults for unknown users.

    ``recs`` is ``(user_id, pos, media_id)``; so is the result.
    """
    asked = users.select("user_id").distinct()
    own = recs.select("user_id", "pos", "media_id").join(asked, "user_id", "left_semi")
    default = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(m).alias("media_id"))
            for i, m in enumerate(DEFAULT_RECOMMENDATIONS)
        ]
    )
    unknown = asked.join(recs.select("user_id").distinct(), "user_id", "left_anti")
    return own.unionByName(unknown.select("user_id", F.inline(default)))


def catalogue(movies: DataFrame) -> DataFrame:
    """The whole catalogue."""
    return movies.select("id", "title", "genre", "year")


def movie_lookup(requests: DataFrame, movies: DataFrame) -> DataFrame:
    """Catalogue row per request, status 404 and NULLs for a miss."""
    return requests.join(movies.withColumn("_hit", F.lit(True)), "id", "left").select(
        *requests.columns, "title", "genre", "year", F.when(F.col("_hit"), 200).otherwise(404).alias("status")
    )


def has_been_notified(users: DataFrame, saved: DataFrame) -> DataFrame:
    """Whether each asked user has at least one notification."""
    notified = saved.select("user_id").distinct().withColumn("_hit", F.lit(True))
    return users.select("user_id").distinct().join(notified, "user_id", "left").select(
        "user_id", F.col("_hit").isNotNull().alias("notified")
    )


def failing_services(expected: DataFrame, probes: DataFrame) -> DataFrame:
    """Expected services without a successful probe.

    One aggregation over both inputs: probes collapse to one row per task
    and service before the shuffle, however often a service is probed.
    """
    asked = expected.select("service", F.lit(True).alias("asked"), F.lit(False).alias("healthy"))
    seen = probes.select("service", F.lit(False).alias("asked"), (F.col("status") == 200).alias("healthy"))
    return (
        asked.unionByName(seen)
        .groupBy("service")
        .agg(F.bool_or("asked").alias("asked"), F.bool_or("healthy").alias("healthy"))
        .filter(F.col("asked") & ~F.col("healthy"))
        .select("service")
    )
