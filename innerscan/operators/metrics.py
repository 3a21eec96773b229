"""Recall, ratio, cost and the report tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_ratio(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row (hits, queries, recall, ratio, k_ratio).

    ``recall`` is hits / (queries k); ``ratio`` the mean of |product / exact
    product at the same rank|; ``k_ratio`` its mean at the last rank.  Missing
    results are not padded; an exact product of 0 has no ratio.
    """
    t = truth.where(F.col("rank") <= k)
    hits = results.join(t.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").agg(F.count("*").alias("hits"))
    n = t.agg(F.countDistinct("qid").alias("queries"))
    by_rank = results.join(t.select("qid", "rank", F.col("ip").alias("exact")), ["qid", "rank"])
    rate = F.abs(F.try_divide(F.col("ip"), F.col("exact")))
    ratios = by_rank.agg(F.avg(rate).alias("ratio"), F.avg(F.when(F.col("rank") == k, rate)).alias("k_ratio"))
    return hits.crossJoin(n).crossJoin(ratios).withColumn("recall", F.col("hits") / (F.col("queries") * k)).select("hits", "queries", "recall", "ratio", "k_ratio")


def timed(make, label: str, truth: DataFrame, k: int, queries: int) -> dict:
    """Run a search and report seconds, queries a second, recall and ratio."""
    began = time.perf_counter()
    out = make().persist()
    out.count()
    took = time.perf_counter() - began
    row = recall_ratio(out, truth, k).first()
    out.unpersist()
    return {"algorithm": label, "k": k, "seconds": took, "qps": queries / took, "ms": 1000 * took / queries, "recall": row["recall"], "ratio": row["ratio"], "k_ratio": row["k_ratio"]}


def save_report(spark, rows: list[dict], path: str) -> DataFrame:
    """Append the report rows to a table and return them."""
    df = spark.createDataFrame(rows)
    df.write.mode("append").parquet(path)
    return df


def peak_memory(spark) -> float:
    """MB: the largest peak of memory that Spark's status store has of an executor, heap and beyond; before the first report, its storage and this process's peak."""
    import resource

    peaks = [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024]
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    for i in range(executors.size()):
        e = executors.apply(i)
        peaks.append(e.memoryUsed())
        if e.peakMemoryMetrics().isDefined():
            peak = e.peakMemoryMetrics().get()
            peaks.append(peak.getMetricValue("JVMHeapMemory") + peak.getMetricValue("JVMOffHeapMemory"))
    return max(peaks) / 2**20
