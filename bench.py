"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "merge_events", "merge_events_lineitem", "event_counts_by_action", "confusion_matrix", "strict_eval",
    "manifest_summary", "manifest_errors", "split_leakage", "window_winner", "evidence_parts", "sliding_windows",
    "frame_times", "forward_fill", "review_queue", "apply_review", "confirmation_errors", "segment_cover",
    "overlap_witness", "duplicate_windows", "event_tracks", "version_diff", "revision_faults", "table_hash",
    "action_rollup", "playing_time", "ocr_vote", "track_relink", "identity_metrics",
)


def main() -> None:
    from actiongrid.session import local_session
    from workload import load

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"))
    queries, _ = load()
    run = lambda name: queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("event_counts_by_action")  # start the JVM and the code generator
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
