"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

For the searches it also reports recall@10, ratio and mean cost against the
exact answer, the measures that the baseline names.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from innerscan import queries as core
from innerscan.functions.vectors import norm
from innerscan.operators import metrics, search, topk
from innerscan.plans import index
from innerscan.storage import clear, session_dir

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Rows of the table that is grown from the vectors at hand.
LARGE = 20_000
# The configuration of the published measurements.
SWEEP_K, SWEEP_EF = 50, (0, 10, 20, 30, 40, 50, 75, 100, 150, 200, 250, 300)
CORE = ["exact_topk_ip", "exact_topk_sql", "norm_pruned_topk", "norm_chunks", "srp_tables", "srp_seeds", "lsh_only_topk", "lsh_window_graph", "norm_band_graph", "cross_chunk_join"]


def seconds(make) -> float:
    began = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def measured(ix, q, truth, k: int, **options) -> tuple[float, dict]:
    """Seconds of a search; its recall, ratio, mean products and mean groups entered for a query."""
    began = time.perf_counter()
    got = search.search(ix, q, k, search_min=50, with_cost=True, **options).persist()
    got.count()
    took = round(time.perf_counter() - began, 3)
    row = metrics.recall_ratio(got, truth, k).first()
    cost = got.groupBy("qid").agg(F.first("cost").alias("cost"), F.first("groups").alias("groups")).agg(F.avg("cost").alias("cost"), F.avg("groups").alias("groups")).first()
    got.unpersist()
    return took, {"recall": round(row["recall"], 4), "ratio": round(row["ratio"], 4), "cost": cost["cost"], "groups": cost["groups"]}


def grown(base, copies: int):
    """Sums of each vector and ``copies`` others, chosen by a hash, at the first one's length: for sizes at which a graph decides something."""
    rows = base.select("vec_id", "embedding")
    low, n = rows.agg(F.min("vec_id"), F.count("*")).first()
    pairs = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("other", low + F.pmod(F.xxhash64("vec_id", "c"), F.lit(n)))
    met = pairs.join(rows.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e2")), "other")
    total = F.zip_with("embedding", "e2", lambda a, b: a + b)
    met = met.withColumn("by", norm(F.col("embedding")) / norm(total)).withColumn("embedding", F.transform(total, lambda x: x * F.col("by")))
    return met.select((F.col("vec_id") * copies + F.col("c")).alias("vec_id"), "embedding")


def searches(spark: SparkSession) -> tuple[dict, dict, dict]:
    """Build time, search times and quality on one saved index; the sweep of ef at k = 50; a larger table."""
    base, q = core.fixture(spark, SF)
    truth = topk.exact_topk(base, q, SWEEP_K).persist()
    path = f"{session_dir(spark)}/bench"
    times, quality, sweep, indexes = {}, {}, {}, {}
    for name, normal in (("build_index", False), ("build_index_normal_edges", True)):
        began = time.perf_counter()
        indexes[normal] = index.build_index(base, index.IndexParams(build_min=32, normal_edges=normal), f"{path}-{normal}", core.DIM)
        times[name] = round(time.perf_counter() - began, 3)
    for name, normal, options in (
        ("pruned_beam_ef0", False, dict(ef=0)),
        ("pruned_beam_ef50", False, dict(ef=50)),
        ("pruned_beam_ef50_normal_edges", True, dict(ef=50, normal_edges=True)),
        ("norm_pruned_beam_ef50", False, dict(ef=50, z=None)),
        ("unpruned_beam_ef50", False, dict(ef=50, z=None, norm_prune=False)),
        ("unpruned_beam_top_ef50", False, dict(ef=50, entry="top", z=None, norm_prune=False)),
        ("few_seeds_ef50", False, dict(ef=50, ub=20)),
        ("few_seeds_ef50_normal_edges", True, dict(ef=50, ub=20, normal_edges=True)),
        ("lsh_only", False, dict(entry="lsh")),
    ):
        times[name], quality[name] = measured(indexes[normal], q, truth, core.K, **options)
    for ef in SWEEP_EF:
        took, row = measured(indexes[False], q, truth, SWEEP_K, ef=ef)
        sweep[f"ef{ef}"] = {"seconds": took} | row
    large = f"{path}-large-base"
    grown(base, LARGE // max(1, base.count())).write.parquet(large)
    more = spark.read.parquet(large)
    began = time.perf_counter()
    ix = index.build_index(more, index.IndexParams(), f"{path}-large", core.DIM)
    times["large_build_index"] = round(time.perf_counter() - began, 3)
    times["large_exact_topk"] = seconds(lambda: topk.exact_topk(more, q, core.K))
    times["large_norm_pruned_topk"] = seconds(lambda: topk.exact_topk(more, q, core.K, prune=True))
    truth = topk.exact_topk(more, q, core.K).persist()
    for name, options in (("large_pruned_beam_ef50", dict(ef=50)), ("large_norm_pruned_beam_ef50", dict(ef=50, z=None)), ("large_pruned_beam_ef200", dict(ef=200)), ("large_pruned_beam_few_seeds", dict(ef=50, ub=20))):
        times[name], quality[name] = measured(ix, q, truth, core.K, **options)
    return times, quality, sweep


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = core.queries()
    queries["exact_topk_ip"](spark, SF).count()  # starts the JVM code and the Python workers
    times = {name: seconds(lambda n=name: queries[n](spark, SF)) for name in CORE}
    more, quality, sweep = searches(spark)
    clear(spark)
    times |= more
    print(json.dumps({"metric": "inner product search, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "quality": quality, "sweep_k50": sweep, "sf": os.path.basename(SF.rstrip("/"))}), flush=True)


if __name__ == "__main__":
    main()
