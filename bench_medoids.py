"""Work of the fits by size: prints one JSON line per table of points, with the candidates
that were scored in full at each step; without bounds it would be all sites every time.

python bench_medoids.py [N ...]      standard normal points in five columns (default 5000 20000 60000)
BENCH_SF_DIR                         also the scaled features of this folder
BENCH_CPUS                           local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from bench import session
from paysegments.operators import medoids
from paysegments.plans.features import FEATURES
from paysegments.plans.segmentation import scaled_features
from paysegments.sources.star import STAR, payments, segments

K = 4


def measure(name: str, df) -> None:
    df = df.cache()
    n = df.count()
    with medoids.PointSpace(df, FEATURES) as space:
        line = {"points": name, "rows": n, "sites": space.n_sites, "cells": len(space.pivots)}

        def timed(step: str, work):
            space.asked, began = 0, time.perf_counter()
            found = work()
            line[step] = {"scored": space.asked, "seconds": round(time.perf_counter() - began, 2)}
            return found

        start = timed("start", lambda: tuple(m for _, m in medoids.ranked_by_total(space, K)))
        swaps = 0
        while True:
            after = timed(f"swap {swaps}", lambda: medoids.swapped(space, start))
            if after is None:
                break
            start, swaps = after, swaps + 1
        timed("alternate", lambda: medoids.alternate(space, {K: start}))
    print(json.dumps(line), flush=True)
    df.unpersist()


def main() -> None:
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    for n in [int(a) for a in sys.argv[1:]] or [5000, 20_000, 60_000]:
        normal = [F.randn(seed).alias(c) for seed, c in enumerate(FEATURES)]
        measure(f"normal {n}", spark.range(n).select(F.col("id").alias("company_id"), *normal))
    if folder := os.environ.get("BENCH_SF_DIR"):
        measure(folder, scaled_features(payments(spark, folder), segments(spark, folder), STAR))
    spark.stop()


if __name__ == "__main__":
    main()
