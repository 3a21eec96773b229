"""Registered queries of the engine over the ``embeddings`` table.

Queries are the vectors of the first 20 ids; the base is the rest, each
vector scaled by 1 + (id mod 16) / 8, for norms that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import oracle
from .functions import vectors as V
from .operators import frontier, graph, metrics, partition, search, srp, topk
from .oracle import BUILD_MIN, DEGREE, EF, K, LINKS, MAX_DEGREE, REACH, SEARCH_MIN, UB, WIDTH
from .plans import by_norm, index
from .sources import hold_out, prefix_sample as prefix
from .storage import new_path, written

DIM = 64


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(base, queries)."""
    q, base = hold_out(embeddings(spark, sf_dir), 20)
    queries = q.select(F.col("vec_id").alias("qid"), V.as_double(F.col("embedding")).alias("qv"))
    by = F.lit(1) + (F.col("vec_id") % 16) / F.lit(8.0)
    return base.select("vec_id", V.scale(F.col("embedding"), by).alias("embedding")), queries


def meeting(q: DataFrame, limit: int = 1_000) -> DataFrame:
    """The held-out queries, marked for broadcasting once their number is checked; a larger set goes out in blocks, see ``exact_topk``."""
    if q.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} queries to meet every row")
    return F.broadcast(q)


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def hashed(spark, sf_dir):
    base, q = fixture(spark, sf_dir)
    hashes = srp.srp_hash(base, DIM)
    chunks = partition.norm_chunks(base)
    return base, q, hashes, chunks, srp.hash_tables(hashes, chunks)


def query_hashes(q: DataFrame) -> DataFrame:
    return srp.srp_hash(q, DIM, "qid", "qv")


def exact_topk_ip(spark, d):
    base, q = fixture(spark, d)
    return r6(topk.exact_topk(base, q, K), "ip")


def exact_topk_sql(spark, d):
    """The same by DataFrame functions only: a nested-loop join with the queries, then a limited rank."""
    base, q = fixture(spark, d)
    scored = base.join(meeting(q), F.lit(True)).select("qid", "vec_id", V.inner_product(F.col("embedding"), F.col("qv")).alias("ip"))
    return r6(topk.rank_by_ip(scored, K).select("qid", "rank", "vec_id", "ip"), "ip")


def norm_pruned_topk(spark, d):
    base, q = fixture(spark, d)
    return r6(search.norm_pruned_topk(base, q, K), "ip")


def norms(spark, d):
    base, _ = fixture(spark, d)
    return r6(partition.with_norms(base).select("vec_id", "sq_norm", "norm"), "sq_norm", "norm")


def norm_range(spark, d):
    return r6(partition.norm_range(fixture(spark, d)[0]), "max_sq_norm", "min_sq_norm", "norm_range")


def query_normalize(spark, d):
    u = fixture(spark, d)[0].select(F.col("vec_id").alias("qid"), V.normalize(F.col("embedding")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x)
    return r6(u.select("qid", total.alias("total"), V.squared_norm(F.col("u")).alias("unit")), "total", "unit")


def distance(f):
    def run(spark, d):
        base, q = fixture(spark, d)
        met = base.join(meeting(q), F.lit(True))
        return met.select("qid", "vec_id", F.round(f(F.col("embedding"), F.col("qv")), 6).alias("dist"))

    return run


def prefix_sample(spark, d):
    return prefix(embeddings(spark, d), 1).select("vec_id", "label")


def query_holdout(spark, d):
    q, base = hold_out(embeddings(spark, d), 20)
    return q.select("vec_id", F.lit("query").alias("side")).union(base.select("vec_id", F.lit("base").alias("side")))


def norm_chunks(spark, d):
    return r6(partition.norm_chunks(fixture(spark, d)[0]), "sq_norm")


def chunk_stats(spark, d):
    return r6(partition.chunk_stats(partition.norm_chunks(fixture(spark, d)[0])), "max_sq_norm")


def chunk_pairs(spark, d):
    return partition.chunk_pairs(partition.chunk_stats(partition.norm_chunks(fixture(spark, d)[0])), LINKS)


def srp_hash(spark, d):
    return srp.srp_hash(fixture(spark, d)[0], DIM)


def srp_tables(spark, d):
    return hashed(spark, d)[4].select("chunk", "tbl", "h", "pos", "vec_id", "slot")


def srp_tables_single(spark, d):
    base, _ = fixture(spark, d)
    one = partition.positions(base.select("vec_id", F.lit(0).alias("chunk")), [], [F.col("vec_id")], "pos").withColumn("pos", F.col("pos").cast("int"))
    return srp.hash_tables(srp.srp_hash(base, DIM), one).select("tbl", "h", "pos", "vec_id", "slot")


def met_hashes(spark, d):
    """(a_id, a, b_id, b): the words of the held-out queries and of every base row."""
    base, q = fixture(spark, d)
    words = lambda df, key, p: df.select(F.col(key).alias(f"{p}_id"), F.array("h0", "h1", "h2", "h3").alias(p))
    return words(srp.srp_hash(base, DIM), "vec_id", "b").join(meeting(words(query_hashes(q), "qid", "a")), F.lit(True))


def hamming(spark, d):
    a, b = F.col("a"), F.col("b")
    return met_hashes(spark, d).select("a_id", "b_id", V.hamming(a, b).alias("diff"), V.hash_distance(a, b, 2).alias("diff_low"))


def bit_sets(spark, d):
    a, b = F.col("a"), F.col("b")
    return met_hashes(spark, d).select("a_id", "b_id", V.union_bits(a, b).alias("union_bits"), V.common_bits(a, b).alias("common_bits"), V.bit_count_of(a).alias("a_bits"))


def jaccard_bits(spark, d):
    return r6(met_hashes(spark, d).select("a_id", "b_id", V.jaccard_distance(F.col("a"), F.col("b")).alias("dist")), "dist")


def est_ip(spark, d):
    base, q = fixture(spark, d)
    words = lambda p: F.array(*[F.col(f"h{i}") for i in range(4)]).alias(p)
    h = srp.srp_hash(base, DIM).select("vec_id", words("b")).join(partition.with_norms(base).select("vec_id", "norm"), "vec_id")
    met = h.join(meeting(query_hashes(q).select("qid", words("a"))), F.lit(True))
    return met.select("qid", "vec_id", F.round(V.estimated_ip(V.hamming(F.col("a"), F.col("b")), F.col("norm")), 6).alias("est"))


def norm_predicate(spark, d):
    """Rows that the norm bound of each query's k-th best product leaves."""
    base, q = fixture(spark, d)
    kth = topk.exact_topk(base, q, K).where(F.col("rank") == K).select("qid", F.col("ip").alias("kth"))
    return partition.with_norms(base).select("norm").join(meeting(kth), V.may_reach(F.col("norm"), F.col("kth"))).groupBy("qid").agg(F.count("*").alias("kept"))


def lsh_window_graph(spark, d, directed=True):
    base, _, _, _, tables = hashed(spark, d)
    return r6(graph.hash_band_join(tables, base, WIDTH, MAX_DEGREE, directed), "ip")


def norm_band_graph(spark, d):
    base, _ = fixture(spark, d)
    return r6(graph.norm_band_join(partition.norm_chunks(base), base, MAX_DEGREE), "ip")


def cross_chunk_join(spark, d):
    base, _, _, chunks, tables = hashed(spark, d)
    pairs = partition.chunk_pairs(partition.chunk_stats(chunks), LINKS)
    return r6(graph.cross_chunk_join(tables, pairs, base, WIDTH).select("src", "dst", "block1", "block2", "ip"), "ip")


def cross_chunk_edges(spark, d):
    base, _, _, chunks, tables = hashed(spark, d)
    pairs = partition.chunk_pairs(partition.chunk_stats(chunks), LINKS)
    edges = graph.hash_band_join(tables, base, WIDTH, MAX_DEGREE)
    return r6(graph.expand_cross_edges(graph.cross_chunk_join(tables, pairs, base, WIDTH), edges, chunks, base, LINKS), "ip")


def graph_refine(spark, d):
    base, _, _, chunks, tables = hashed(spark, d)
    return r6(graph.refine(graph.hash_band_join(tables, base, WIDTH, MAX_DEGREE), base, DEGREE, MAX_DEGREE, chunks=chunks), "ip")


def srp_seeds(spark, d):
    _, q, _, _, tables = hashed(spark, d)
    return srp.srp_seeds(tables, query_hashes(q), UB)


def srp_seeds_saved(spark, d):
    """The same from hash tables that were saved."""
    _, q, _, _, tables = hashed(spark, d)
    path = new_path(spark, "hashes")
    srp.save_tables(tables, path)
    saved, blocks = srp.load_tables(spark, path)
    return srp.srp_seeds(saved, query_hashes(q), UB, blocks)


def sorted_scan_topk(spark, d):
    """Exact, from files in order of norms, of which only those are read that can matter."""
    base, q = fixture(spark, d)
    path = new_path(spark, "by_norm")
    by_norm.save_by_norm(base, path)
    return r6(by_norm.sorted_topk(spark, path, q, K), "ip")


def seed_levels(spark, d):
    _, q, _, _, tables = hashed(spark, d)
    return srp.window_counts(srp.block_counts(tables), query_hashes(q)).select("qid", "chunk", "level", "upto")


def entry_point(spark, d):
    _, q, _, _, tables = hashed(spark, d)
    return srp.entry_point(tables, query_hashes(q))


def lsh_only_topk(spark, d):
    base, q, _, _, tables = hashed(spark, d)
    return r6(search.lsh_topk(srp.srp_seeds(tables, query_hashes(q), UB), base, q, K), "ip")


def recall_ratio(spark, d):
    base, q, _, _, tables = hashed(spark, d)
    got = search.lsh_topk(srp.srp_seeds(tables, query_hashes(q), UB), base, q, K)
    return r6(metrics.recall_ratio(got, topk.exact_topk(base, q, K), K), "recall", "ratio", "k_ratio")


def built(spark, d, **params) -> index.Index:
    """The index with the engine's defaults, but for the size below which chunks are bands by norm: these tables' chunks are smaller."""
    return index.build_index(fixture(spark, d)[0], index.IndexParams(**({"build_min": BUILD_MIN} | params)), dim=DIM)


def searched(params: dict | None = None, **options):
    """Search with the engine's defaults, but for the sizes below which chunks are scanned."""

    def run(spark, d):
        return r6(search.search(built(spark, d, **(params or {})), fixture(spark, d)[1], K, **({"search_min": SEARCH_MIN, "ef": EF} | options)), "ip")

    return run


def built_graph(spark, d):
    """The edges of an index: bands, refined by a search from every vector."""
    return r6(built(spark, d).scored_edges(), "ip")


def search_cost(spark, d):
    """Products computed for each query and groups entered."""
    found = search.search(built(spark, d), fixture(spark, d)[1], K, ub=REACH, ef=0, search_min=SEARCH_MIN, with_cost=True)
    return found.groupBy("qid").agg(F.first("cost").alias("cost"), F.first("groups").alias("groups"))


def search_waves(spark, d):
    """The chunks that each query is still alive in."""
    trace = search.Trace()
    search.search(built(spark, d), fixture(spark, d)[1], K, ub=REACH, ef=0, search_min=SEARCH_MIN, trace=trace)
    return trace.entered.select("qid", "chunk").distinct()


def walked(spark, d):
    """A walk by joins over the edges within and between chunks, from seeds of the first chunk only."""
    base, q = fixture(spark, d)
    ix = built(spark, d, normal_edges=True)
    records = written(ix.records().select("chunk", "vec_id", "norm", "words", "nbrs"))
    edges = records.select(F.col("vec_id").alias("src"), F.explode("nbrs").alias("dst")).union(ix.links.select("src", "dst")).distinct()
    units = search.unit_queries(q)
    words = query_hashes(q).select("qid", F.array("h0", "h1", "h2", "h3").alias("words"))
    hashes = records.select("vec_id", *[F.col("words")[t].alias(f"h{t}") for t in range(4)])
    first = records.where("chunk = 0").select("chunk", "vec_id", F.row_number().over(Window.partitionBy("chunk").orderBy(F.col("norm").desc(), "vec_id")).alias("pos"))
    starts = srp.srp_seeds(srp.hash_tables(hashes, first), query_hashes(q), REACH)
    return frontier.frontier_walk(written(edges), records, base, units.join(words, "qid"), starts, K, EF), units


def frontier_topk(spark, d):
    got, units = walked(spark, d)
    found = got.pool.where(F.col("rank") <= K).join(units.select("qid", "length"), "qid")
    return found.select("qid", "rank", "vec_id", F.round(F.col("ip") * F.col("length"), 6).alias("ip"))


def frontier_fetched(spark, d):
    """Vertices that each query meets, and of how many the vector is fetched."""
    return walked(spark, d)[0].met.groupBy("qid").agg(F.count("*").alias("met"), F.sum(F.col("fetched").cast("long")).alias("fetched"))


def hash_words(spark, d):
    h = srp.srp_hash(fixture(spark, d)[0], DIM)
    return h.select("vec_id", V.to_binary(F.col("h0")).alias("word"), V.same_elements(F.array("h0", "h1", "h2", "h3")).alias("all_differ"))


def stream_topk(spark, d):
    """Queries that arrive as a stream, answered batch by batch."""
    import uuid

    from .storage import shared_dir
    from .streaming.search import stream_topk as start

    base, q = fixture(spark, d)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q.write.parquet(f"{root}/in")
    arriving = spark.readStream.schema("qid bigint, qv array<double>").option("maxFilesPerTrigger", 8).parquet(f"{root}/in")
    running = start(arriving, base, K, f"{root}/out", f"{root}/offsets")
    running.processAllAvailable()
    running.stop()
    return r6(spark.read.parquet(f"{root}/out").select("qid", "rank", "vec_id", "ip"), "ip")


def queries() -> dict:
    return {
        "exact_topk_ip": exact_topk_ip,
        "exact_topk_sql": exact_topk_sql,
        "norm_pruned_topk": norm_pruned_topk,
        "sorted_scan_topk": sorted_scan_topk,
        "norms": norms,
        "norm_range": norm_range,
        "query_normalize": query_normalize,
        "neg_inner_product": distance(V.negative_inner_product),
        "dist_l2": distance(V.l2_squared),
        "dist_l1": distance(V.l1),
        "dist_linf": distance(V.linf),
        "prefix_sample": prefix_sample,
        "query_holdout": query_holdout,
        "norm_chunks": norm_chunks,
        "chunk_stats": chunk_stats,
        "chunk_pairs": chunk_pairs,
        "srp_hash": srp_hash,
        "srp_tables": srp_tables,
        "srp_tables_single": srp_tables_single,
        "hamming": hamming,
        "bit_sets": bit_sets,
        "jaccard_bits": jaccard_bits,
        "est_ip": est_ip,
        "norm_predicate": norm_predicate,
        "lsh_window_graph": lsh_window_graph,
        "lsh_window_graph_both": lambda s, d: lsh_window_graph(s, d, False),
        "norm_band_graph": norm_band_graph,
        "cross_chunk_join": cross_chunk_join,
        "cross_chunk_edges": cross_chunk_edges,
        "graph_refine": graph_refine,
        "srp_seeds": srp_seeds,
        "srp_seeds_saved": srp_seeds_saved,
        "seed_levels": seed_levels,
        "entry_point": entry_point,
        "lsh_only_topk": lsh_only_topk,
        "recall_ratio": recall_ratio,
        "built_graph": built_graph,
        "beam_reach_topk": searched({"build_min": 1, "rounds": 0}, search_min=0, ub=REACH, ef=10**6, norm_prune=False, z=None, stop_by_norm=False),
        "pruned_beam_topk": searched(),
        "norm_pruned_beam_topk": searched(z=None),
        "beam_topk": searched(entry="top", norm_prune=False, z=None),
        "wide_beam_topk": searched(ub=REACH, ef=0, step=4),
        "lsh_graphless_topk": searched(entry="lsh"),
        "search_cost": search_cost,
        "search_waves": search_waves,
        "frontier_topk": frontier_topk,
        "frontier_fetched": frontier_fetched,
        "hash_words": hash_words,
        "stream_topk": stream_topk,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
