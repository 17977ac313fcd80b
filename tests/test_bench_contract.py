"""bench.py prints exactly one JSON line with the agreed keys."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2",
               BENCH_QUERIES="context_last_n,usage_by_api")
    res = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], capture_output=True, text=True,
                         env=env, timeout=600, cwd="/tmp")
    lines = [ln for ln in res.stdout.splitlines() if ln.strip()]
    assert res.returncode == 0 and len(lines) == 1, res.stderr[-2000:]
    out = json.loads(lines[0])
    assert out["unit"] == "sec" and out["sf"] == 0.001 and set(out["queries"]) == {"context_last_n", "usage_by_api"}
    assert out["value"] == round(sum(out["queries"].values()), 3) and "errors" not in out
