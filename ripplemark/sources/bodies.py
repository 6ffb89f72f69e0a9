"""Request bodies: JSON text to fields with per-route defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.facts import is_object
from ripplemark.functions.http import BODY_SCHEMA


def read_bodies(requests: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Fields of the ``body`` column and whether it could be read.

    An empty body counts as an empty object; a missing field takes its
    default; a body that is not a JSON object is flagged as rejected, not
    dropped.
    """
    text = F.when(F.coalesce("body", F.lit("")) == "", "{}").otherwise(F.col("body"))
    shape = F.try_parse_json(text)
    parsed = requests.withColumn("_text", text).withColumn("rejected", ~is_object(shape))
    parsed = parsed.withColumn("_f", F.when(~F.col("rejected"), F.from_json("_text", BODY_SCHEMA)))
    fields = [
        F.when(~F.col("rejected"), F.coalesce(F.col(f"_f.{name}"), F.lit(default))).alias(name)
        for name, default in defaults.items()
    ]
    return parsed.select(*requests.columns, "rejected", *fields)
