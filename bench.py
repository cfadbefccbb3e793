"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vertexloom import plans
from vertexloom.operators import generators as gen
from vertexloom.operators import stats, transforms

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
M = 4_000_000


def generators(spark):
    return {
        "gnm_directed_4m": gen.gnm(spark, 1 << 20, M, directed=True).edges, "gnm_undirected_4m": gen.gnm(spark, 1 << 20, M).edges, "gnp_directed_4m": gen.gnp(spark, 1 << 20, M / (1 << 40), directed=True).edges,
        "grid2d_4m": gen.lattice(spark, (1400, 1400), 0.9).edges, "rmat_raw_4m": gen.rmat_edges(spark, 18, M, 0.5, 0.2, 0.2), "path_permuted_4m": gen.path(spark, M, permute_seed=1).edges,
        "ba_4m": gen.ba(spark, M // 8, 8).edges, "rgg2d_300k": gen.rgg(spark, 300_000, 0.002).edges, "rhg_30k": gen.rhg(spark, 30_000, 3.0, 20.0).edges,
        "csr_4m": transforms.csr(gen.gnm(spark, 1 << 20, M, directed=True).edges), "degree_bins_4m": stats.degree_bins(gen.gnm(spark, 1 << 20, M).edges),
    }


def main():
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    frames = {k: (lambda k=k: plans.QUERIES[k](spark, SF_DIR)) for k in ("degree_bins", "symmetrize", "csr_explode", "edge_balanced_ranges_4", "ghosts", "missing_reverse", "netd_clique")}
    frames |= {k: (lambda v=v: v) for k, v in generators(spark).items()}
    seconds, edges = {}, {}
    spark.range(1000).groupBy(F.col("id") % 7).count().collect()
    for name, make in frames.items():
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        if name.endswith("_4m") and name not in ("csr_4m", "degree_bins_4m"):
            edges[name] = round(M / seconds[name] / int(CPUS))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "edges_per_second_per_core": edges, "sf": SF_DIR.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
