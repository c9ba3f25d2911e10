"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lidarloom.plans import registry
from lidarloom.session import local_session

HEADLINE = (
    "crop_nan", "voxel_grid", "median_range", "imu_dt", "trailing_rate", "imu_calibration", "imu_lever_arm", "asof_pose", "imu_range",
    "knn_3d", "radius_3d", "nn_within", "local_cov_plane", "normal_eq_sums", "topk_ties", "nearest_keyframe", "trajectory_length", "observe", "map_merge",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().count()  # starts the JVM's machinery
    seconds = {}
    queries = registry.queries()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
