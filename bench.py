"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all
cores), BENCH_REPS (default 3), BENCH_QUERIES (comma list, default headline set).
Each query is planned and written to the ``noop`` sink (so nothing is pruned
away) once as a warm-up, then BENCH_REPS times; the median is reported.
Prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from refinery.plans.registry import QUERIES  # noqa: E402
from refinery.session import build_session  # noqa: E402

HEADLINE = ["query_topk", "sql_join_agg", "clean_date", "clean_currency", "pii_redact_text", "dedup_full",
            "search_topk_batch", "context_pack", "credit_admission", "curate_records"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    log_dir = tempfile.mkdtemp(prefix="refinery-bench-events-")
    try:  # local mode: the driver heap is the whole cluster; stay within the box
        total_gb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    except (ValueError, OSError):
        total_gb = 16
    heap = f"{max(1, min(8, int(total_gb * 0.6)))}g"
    spark = build_session(f"local[{cpus}]", app_name="refinery-bench", shuffle_partitions=max(8, cpus * 2),
                          extra={"spark.driver.memory": heap, "spark.eventLog.enabled": "true",
                                 "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
                                 "spark.eventLog.rolling.enabled": "false"})
    results, errors = {}, {}
    for name in names:
        fn = QUERIES[name]
        times = []
        try:
            for i in range(reps + 1):
                # job group tags the measured runs so the event log can be attributed
                spark.sparkContext.setJobGroup(f"{name}#{i}" if i else f"warmup:{name}", name)
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                if i:  # first run is the warm-up
                    times.append(time.perf_counter() - t0)
            results[name] = round(statistics.median(times), 3)
        except Exception as e:  # noqa: BLE001 - report and keep benchmarking the rest
            errors[name] = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
    spark.stop()
    names = [n for n in names if n in results]
    shuffle = shuffle_bytes(log_dir, names, reps)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "reps": reps, "shuffle_write_bytes_per_run": shuffle,
                      **({"errors": errors} if errors else {})}))


def shuffle_bytes(log_dir: str, names: list[str], reps: int) -> dict[str, int]:
    """Shuffle bytes written per query run, from the Spark event log."""
    stage_query: dict[int, str] = {}
    written: dict[str, int] = {n: 0 for n in names}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path, encoding="utf-8") as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id", "")
                    if "#" in group:
                        for sid in ev.get("Stage IDs", []):
                            stage_query[sid] = group.split("#")[0]
                elif kind == "SparkListenerTaskEnd" and ev.get("Stage ID") in stage_query:
                    metrics = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    written[stage_query[ev["Stage ID"]]] += int(metrics.get("Shuffle Bytes Written", 0))
    return {n: written[n] // max(reps, 1) for n in names}


if __name__ == "__main__":
    main()
