"""Times the headline queries once each, after a warm-up, and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from skyquad.plans import registry

HEADLINE = ("cone_search", "catalog_stats", "sky_to_pixel", "tangent_plane", "quad_keys", "key_band_join", "nearest_neighbours", "one_to_one_matches", "affine_fits", "blurred_pixels", "candidate_patterns", "plate_solve")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map={"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["cone_search"](spark, sf_dir).count()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
