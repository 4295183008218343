"""The bench runs from end to end and prints its line."""

import json
import os
import subprocess
import sys

from tests.conftest import SF_DIRS
from verification.queries import QUERIES

# Of the feed, the stored archive, the layers and a whole view.
SOME = {"typed_inventory", "unparsed_text", "rejected_rows", "trend_daily", "by_line",
        "bitmap_trend_daily", "layer_utilization", "freshness_view"}

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_line():
    done = subprocess.run(
        [sys.executable, f"{ROOT}/bench.py"],
        env={**os.environ, "BENCH_LAZY": "1", "BENCH_SF_DIR": SF_DIRS["small"], "BENCH_CPUS": "4", "BENCH_ONLY": ",".join(SOME)},
        capture_output=True,
        text=True,
        timeout=900,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    (line,) = done.stdout.strip().splitlines()
    result = json.loads(line)
    assert set(result["queries"]) == set(result["lazy"]) == SOME < set(QUERIES)
    assert result["unit"] == "sec" and result["value"] > 0
