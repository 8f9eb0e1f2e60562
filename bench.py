"""Time headline queries and print one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores; BENCH_QUERIES (comma separated, or
``all``) the queries.
"""

from __future__ import annotations

import json
import logging
import os
import time

HEADLINE = [
    "w1_kyoku_epoch", "w2_seat_scalars", "w3_river_visible_index", "w6_hero_hand", "w8_owed_discard", "w11_debounce",
    "w14_spread_sample", "w19_river_rows", "w21_hand_row", "w23_best_path", "j1_frame_state", "j3_latest_record",
    "j5_nearest_zone", "j6_overlap_dedup", "j7_holdout_split", "j12_multiset_match", "j15_positional_pairs", "j16_align_crops",
    "a1_sync_report", "a6_tally", "a11_round_consensus", "a17_group_background", "a20_average_precision", "f7_observed_rules",
    "f20_build_funnel", "s10_label_text", "p22_flatten_boxes", "v8_box_mean", "g1_live_replay",
]


def main() -> None:
    logging.disable(logging.CRITICAL)
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from boardlake.plans import all_queries
    from boardlake.session import build_session

    spark = build_session(cpus, "boardlake-bench")
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = all_queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the engine
    seconds = {}
    for name in names:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t0, 3)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {f"events_per_sec_{k.split('_')[0]}": round(n / seconds[k]) for k in ("w1_kyoku_epoch", "w2_seat_scalars", "g1_live_replay") if k in seconds}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), **rates}))


if __name__ == "__main__":
    main()
