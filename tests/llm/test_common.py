"""What a worker holds between steps."""

import subprocess
import sys

HOLES = """
from pathlib import Path
from ripplemark.llm.common import kept_by_worker

def mb():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6

kept_by_worker("model", "a", lambda: [bytearray(100_000) for _ in range(3000)])
pin = bytearray(100_000)  # the last of the heap, so that what lies below is not at its end
full = mb()
kept_by_worker("model", "b", list)
print(full - mb())
"""


def test_what_a_worker_has_freed_goes_back_to_the_system():
    done = subprocess.run([sys.executable, "-c", HOLES], capture_output=True, text=True, timeout=60)
    assert float(done.stdout) > 250, done.stderr
