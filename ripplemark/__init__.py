"""Change-impact and media-platform analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from ripplemark.session import build_session, drop_stages, shared_dir, stage, stage_path

__all__ = ["build_session", "drop_stages", "shared_dir", "stage", "stage_path"]

# Executors need not have this package: what runs there is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
