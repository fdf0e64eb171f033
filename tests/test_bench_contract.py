"""bench.py prints one JSON line with the fields the driver records."""

import json
import os
import subprocess
import sys
from pathlib import Path


def test_bench_prints_one_json_line():
    root = Path(__file__).resolve().parents[1]
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_RUNS="1", BENCH_QUERY_RUNS="0")
    out = subprocess.run(
        [sys.executable, str(root / "bench.py")], capture_output=True, text=True, timeout=600, env=env
    )
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1, out.stdout[-2000:] + out.stderr[-2000:]
    result = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(result)
    assert result["unit"] == "sec" and result["sf"] == "0.001" and result["failed"] == []
    assert all(k.startswith("h_") for k in result["queries"]) and result["value"] > 0
