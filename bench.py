"""Wall time of the registered queries; prints one JSON line.

    BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated names (default: the headline list)
"""

from __future__ import annotations

import json
import os
import sys
import time

from mootlake.plans import QUERIES
from mootlake.session import build_session

HEADLINE = [
    "series_stats", "pulse_kpis", "pulse", "weekly_rhythm", "inbox_meetings", "open_tasks_for_series", "due_drift",
    "overdue_cards", "meeting_search", "extraction_profile", "speaker_turns", "turn_offsets", "parse_turns",
    "build_chunks", "word_timings", "anchor_quotes", "quote_t_sec", "asof_turn_time", "extraction_decode",
    "merge_chunks", "meeting_type_vote", "participants", "dedup_items", "near_dup_pairs", "merge_section_status",
    "trim_compact", "summary_payload", "pii_spans", "pii_tokens", "pii_masked", "deanonymize", "pii_dictionary",
    "normalize_owner", "sync_proposals", "upsert_meetings", "assign_speakers", "apply_patches", "dispatch_gate",
    "card_text", "dates_from_names", "next_occurrence", "archive_list", "meeting_files", "stream_upsert_proposals",
    "stream_updates_dedup", "stream_rhythm", "stream_turns", "stream_updates_late", "render_transcript", "enrich_actions",
    "sync_whole_proposals", "merged_fields",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus, {
        "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["series_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not measured
    spent: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
