"""Wall time of the headline queries. Prints one JSON line.

    BENCH_SF_DIR   test data folder        (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores             (default 8)
    BENCH_QUERIES  names, comma separated  (default: the headline queries; "all" for every one)
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plateflow import plans  # noqa: E402
from plateflow.session import local_session  # noqa: E402

HEADLINE = (
    "accepted_plates_by_status", "classify_reads", "rank_reads", "decide_plate", "rendering_wins", "correct_reads",
    "region_consensus", "assemble_lines", "decode_boxes", "tile_grid", "suppress_vehicles", "suppress_plates",
    "assign_plates", "combine_scans", "primary_plate", "image_telemetry", "cosine_candidates", "knn_vote",
    "abstention_tally", "match_brands", "pick_brand", "resolve_type", "image_results", "export_nested", "export_flat",
    "search_detections", "review_lists", "apply_corrections", "model_vs_truth", "plate_eval_summary",
    "audit_constraints", "scan_text_for_plates", "parse_recognition_json", "quad_quality", "glyph_row_quads", "select_quads",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    registered = plans.queries()
    names = list(registered) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, "bench")
    # One small run starts the JVM's compilers; it is not timed.
    registered[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
