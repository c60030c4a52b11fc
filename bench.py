"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: threads (default 8).
Every query is written to Spark's noop sink, once to warm up and three times on the
clock; the median counts, and `spread` is the distance of the fastest and slowest run.
`calibration` is a fixed sort beside them, to tell a slow machine from slow code.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from tidewell import catalog

HEADLINE = [
    "map_solve_tqu",
    "to_map_tqu",
    "map_bilinear",
    "from_map_tqu",
    "to_weights_tqu",
    "pixels_healpix_nest",
    "block_mean",
    "block_var_central",
    "matched_jumps",
    "detrend_median",
    "detrend_linear",
    "interp1d_linear",
    "gap_fill_poly2",
    "cuts_extract_poly",
    "nmat_apply",
    "ranges_merge",
    "ranges_intersect",
    "ranges_complement",
    "intervals_union",
    "hk_load_range",
    "hk_catalog",
    "det_status_of_each",
    "butterworth",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make) -> list[float]:
        times = []
        for _ in range(4):
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        return times[1:]

    took, spread = {}, {}
    calibration = timed(lambda: spark.range(2_000_000).selectExpr("id", "xxhash64(id) h").sort("h"))
    for name in HEADLINE:
        times = timed(lambda: catalog.QUERIES[name](spark, sf_dir))
        took[name], spread[name] = round(median(times), 3), round(max(times) - min(times), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf"), "spread": spread, "calibration": round(median(calibration), 3)}))


if __name__ == "__main__":
    main()
