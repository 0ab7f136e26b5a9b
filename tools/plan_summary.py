"""Summarize the physical plan of every registered query (markdown table on stdout).

Usage: python tools/plan_summary.py [sf_dir]

Counts shuffle exchanges, broadcast exchanges, joins by kind, window and
aggregate operators, and Python operators in the executed plan (the query part;
derived inputs built once per session are scans here).
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def _key(exchange: str) -> str:
    body = exchange[len("Exchange "):]
    body = re.sub(r", ENSURE_REQUIREMENTS.*|, REPARTITION.*|, \[plan_id.*", "", body)
    body = re.sub(r", \d+\)$", ")", body)
    body = re.sub(r"#\d+L?", "", body)
    return body.replace(" ASC NULLS FIRST", "").replace(" DESC NULLS LAST", " DESC")


def summarize(plan: str) -> dict:
    lines = [ln.strip().lstrip("+-: ") for ln in plan.splitlines()]
    shuffles = [ln for ln in lines if ln.startswith("Exchange ")]
    return {
        "shuffles": len(shuffles),
        "shuffle keys": "; ".join(sorted({_key(s) for s in shuffles})),
        "broadcasts": sum(ln.startswith("BroadcastExchange") for ln in lines),
        "joins": ", ".join(sorted({ln.split(" ")[0] for ln in lines if "Join" in ln.split(" ")[0]})),
        "python": ", ".join(sorted({ln.split(" ")[0] for ln in lines
                                    if ln.split(" ")[0] in ("MapInArrow", "MapInPandas", "BatchEvalPython",
                                                            "ArrowEvalPython", "PythonMapInArrow")})),
        "window": sum(ln.startswith("Window ") for ln in lines),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from tyscope.plans.registry import REGISTRY
    from tyscope.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    print("| query | shuffles | shuffle keys | broadcasts | joins | windows | python |")
    print("|---|---|---|---|---|---|---|")
    for name, q in REGISTRY.items():
        df = q.build(spark, sf)
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | {s['shuffles']} | {s['shuffle keys']} | {s['broadcasts']} | {s['joins']} | "
              f"{s['window']} | {s['python']} |")


if __name__ == "__main__":
    main()
