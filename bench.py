"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "ts_flagship", "ts_clean", "ts_resample_hourly", "ts_fill_calendar", "ts_interpolate_isolated", "ts_harmonize", "ts_quality_report", "ts_step_histogram", "ts_localize_nat", "feature_table",
    "year_expand_hourly", "year_fractions", "normalize_by_group_mean", "percentiles_5_95", "combine_two_sources_coalesce", "level_occurrence_cube", "denormalize_projection", "union_clean_sources", "melt_wide",
    "rowwise_sum", "group_sum_by_timestamp", "coarsen_grid", "bbox_slice", "regex_extract_series", "json_keypath", "validation_split", "mae_by_group",
)


def main() -> None:
    from gridloom.plans import catalogue
    from gridloom.session import session

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    queries, seconds = catalogue.queries(), {}
    queries["ts_flagship"](spark, folder).write.format("noop").mode("overwrite").save()  # compiles code, starts executors
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
