"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Times appear on stderr as they come. A query that fails is named in ``failed``, the others
still run, and the line is printed in any case.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from rankforge.plans import queries as q
from rankforge.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


HEADLINE = {
    "pairs_orders": q.pairs_orders, "pairs_events": q.pairs_events,
    "difficulty_report": q.difficulty_report, "phases_progressive": q.phases_progressive,
    "dup_average": q.dup_average, "split_assign": q.split_assign, "pair_sample": q.pair_sample,
    "leakage_report": q.leakage_report, "classification_summary": q.classification_summary,
    "running_metrics": q.running_metrics, "pass_summary": q.pass_summary,
    "majority_vote": q.majority_vote, "elo_sync_3rounds": q.elo_sync_3rounds,
    "elo_rounds": q.elo_rounds, "elo_random_rounds": q.elo_random_rounds, "elo_sweep_2d": q.elo_sweep_2d,
    "elo_sweep_4d": q.elo_sweep_4d,
    "checkpoint_summary": q.checkpoint_summary, "stream_metrics": q.stream_metrics,
}


def main() -> None:
    # the full grid takes minutes; name it to run it
    wanted = sys.argv[1:] or [n for n in HEADLINE if n != "elo_sweep_4d"]
    spark = local_session(CPUS, shuffle_partitions=max(8, int(CPUS)))
    spark.sparkContext.setLogLevel("ERROR")
    q.winner_report(spark, SF).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    try:
        for name in wanted:
            spent = []
            try:
                for _ in range(RUNS):
                    spark.catalog.clearCache()
                    start = time.perf_counter()
                    HEADLINE[name](spark, SF).write.format("noop").mode("overwrite").save()
                    spent.append(time.perf_counter() - start)
            except Exception as e:
                failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
                print(name, failed[name], file=sys.stderr, flush=True)
                continue
            times[name] = round(statistics.median(spent), 3)
            print(name, times[name], file=sys.stderr, flush=True)
    finally:
        total = round(sum(times.values()), 3)
        line = {"metric": "headline queries, total", "value": total, "unit": "sec", "queries": times,
                "sf": os.path.basename(os.path.normpath(SF))}
        print(json.dumps(line | ({"failed": failed} if failed else {})), flush=True)


if __name__ == "__main__":
    main()
