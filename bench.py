"""Time the headline queries; one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from shapelake import catalog

HEADLINE = ["standardize_vector", "histogram_density", "tail_mean_q95", "representatives", "votes_merge", "consensus_table", "intersection_ratios_normalized", "dist_l2", "dist_js", "silhouette", "knn_elbow", "mesh_volume", "mesh_areas", "mesh_lengths", "open_angle", "expand", "local_threshold", "surface_voxels", "kmeans"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took, run = {}, catalog.queries()
    for name in HEADLINE:
        t = time.time()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
