"""Plan report: for every registered query (or the ones named), the
physical-plan facts that matter at scale, read from ``explain``: shuffle
exchanges, broadcasts, join and aggregate strategies, window limits, Python
nodes, and the columns each scan reads.

    python scripts/plan_report.py [--sf /root/testdata/sf0.01] [query ...]
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chatlake.plans import registry  # noqa: E402
from chatlake.plans.planinfo import plan_text  # noqa: E402
from chatlake.session import get_session  # noqa: E402

NODES = ["WindowGroupLimit", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "BroadcastHashJoin",
         "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "ArrowEvalPython",
         "BatchEvalPython", "MapInPandas", "Generate", "Window"]


def _node(name: str):
    """An operator line of the plan overview (``* `` marks whole-stage
    code generation)."""
    return re.compile(r"(?:^|[-+] )(?:\* )?" + re.escape(name) + r" \(", re.M)


def report(df) -> dict:
    text = plan_text(df)
    overview = text.split("\n\n\n")[0]
    return {
        "exchanges": len(re.findall(r"[-+] Exchange \(", overview)),
        "broadcasts": overview.count("BroadcastExchange"),
        "nodes": {n: len(_node(n).findall(overview)) for n in NODES if _node(n).search(overview)},
        "read_schemas": re.findall(r"ReadSchema: (struct<[^\n]*>)", text),
    }


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("queries", nargs="*")
    args = ap.parse_args()
    spark = get_session("local[4]", 4, app_name="plan-report")
    queries = registry.queries()
    for name in args.queries or sorted(queries):
        if name.startswith("stream_"):
            continue                      # streaming runs execute; their plans are in the sinks
        print(json.dumps({"query": name, **report(queries[name](spark, args.sf))}))
    spark.stop()


if __name__ == "__main__":
    main()
