"""Per-stage task balance and shuffle volume of registered queries, from Spark's event log.

Usage: python tools/stage_report.py <sf_dir> <query> [<query> ...]

The event log is written to a fresh scratch folder (no UI, no server). For each
stage: tasks, median / max task time, max/median ratio (skew), shuffle bytes
written and read.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main():
    sf = sys.argv[1]
    names = sys.argv[2:]
    log_dir = tempfile.mkdtemp(prefix="tyscope-eventlog-")
    from tyscope.plans.registry import REGISTRY
    from tyscope.session import get_session
    spark = get_session("local[8]", shuffle_partitions=16,
                        extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                               "spark.eventLog.compress": "false"})
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        REGISTRY[name].build(spark, sf).write.format("noop").mode("overwrite").save()
    spark.stop()
    stages: dict = {}
    names_by_stage: dict = {}
    for path in [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]:
        with open(path, encoding="utf-8") as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    names_by_stage[info["Stage ID"]] = info["Stage Name"]
                if kind != "SparkListenerTaskEnd":
                    continue
                t = ev["Task Info"]
                m = ev.get("Task Metrics") or {}
                s = stages.setdefault(ev["Stage ID"], {"times": [], "sw": 0, "sr": 0})
                s["times"].append(t["Finish Time"] - t["Launch Time"])
                s["sw"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                sr = m.get("Shuffle Read Metrics") or {}
                s["sr"] += sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0)
    print(f"{'stage':>5} {'tasks':>5} {'med ms':>7} {'max ms':>7} {'skew':>5} {'shuf w KB':>9} {'shuf r KB':>9}  name")
    for sid in sorted(stages):
        s = stages[sid]
        med = statistics.median(s["times"])
        mx = max(s["times"])
        skew = mx / med if med else 0
        print(f"{sid:>5} {len(s['times']):>5} {med:>7.0f} {mx:>7.0f} {skew:>5.1f} {s['sw'] / 1024:>9.0f} "
              f"{s['sr'] / 1024:>9.0f}  {names_by_stage.get(sid, '')[:60]}")


if __name__ == "__main__":
    main()
