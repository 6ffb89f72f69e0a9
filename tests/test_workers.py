"""Code sent to executors must run where this package is not installed."""

import subprocess
import sys

from pyspark import cloudpickle

from ripplemark.operators import configs

LOAD = """
import pickle, sys
import pandas as pd
read, leaves = pickle.loads(open(sys.argv[1], "rb").read())
batch = pd.DataFrame({"path": ["a"], "format": ["xml"], "content": ["<r><v>1</v></r>"]})
print(next(read(iter([batch]))).values.tolist(), leaves.__name__, "ripplemark" in sys.modules)
"""


def test_worker_code_needs_no_package(tmp_path):
    payload = tmp_path / "code.pkl"
    payload.write_bytes(cloudpickle.dumps((configs._read_batches, configs._leaves)))
    done = subprocess.run(
        [sys.executable, "-c", LOAD, str(payload)], cwd=tmp_path, capture_output=True, text=True, timeout=60
    )
    assert done.stdout.strip() == "[['a', 'r.v', '1', 'string']] _leaves False", done.stderr
