"""Time the queries: one JSON line with seconds per query.

BENCH_SF_DIR names the input (default sf0.1), BENCH_CPUS the cores. One
untimed run of the flagship starts the JVM and writes the stored corpora;
then every query runs once, to the end, into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from checks.queries import QUERIES
from ripplemark import build_session, drop_stages


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or list(QUERIES)
    spark = build_session(
        app_name="bench",
        master=f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for key in ("r2_combined_ranking", "c8_config_facts", "u3_key_union", "s3_changed_lines"):
        run(key)
    seconds = {key: run(key) for key in wanted}
    drop_stages(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
