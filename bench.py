"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from plumbline.plans import spark_queries
from plumbline.session import local_session

HEADLINE = (
    "rpt_entity_report", "win_rank_view", "win_deviations", "top_n_ties_in_tier", "evl_judge", "agg_alarm_rates", "agg_stability",
    "val_unique", "cln_build_chunks", "ext_numbers", "ver_groups", "ret_phrase_search", "ret_vector_search", "ret_fusion", "lab_answers",
    "aud_diagnose", "sta_last_slots",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "plumbline-bench")
    plans = spark_queries()
    plans["win_deviations"](spark, sf).write.format("noop").mode("overwrite").save()  # loads classes, compiles code and reads the files once
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        plans[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
