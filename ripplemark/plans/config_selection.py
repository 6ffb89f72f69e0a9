"""From two configuration revisions and an access log to the tests to run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ripplemark.operators import configs, selection
from ripplemark.session import stage


def tests_of_config_change(old: DataFrame, new: DataFrame, access: DataFrame) -> DataFrame:
    """Tests that read a setting whose value changed: ``(test, setting)``.

    ``old`` and ``new`` are ``(path, content)``, ``access`` is
    ``(test_id, config_key)``. The changed keys are staged, so the access
    log is shuffled by key only when they are too many to broadcast.
    """
    keys = stage(configs.distinct_changes(old, new).selectExpr("key as config_key").distinct(), "changed_keys")
    return selection.select_by_config(selection.dependency_edges(access), keys)
