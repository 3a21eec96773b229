"""Edge cases, invariants and recall of the search engine, and round trips of its files."""

import math
import re
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from innerscan import queries as core
from innerscan.functions import vectors as V
from innerscan.operators import frontier, graph, metrics, partition, search, srp, topk, walk
from innerscan.plans import by_norm, index
from innerscan.sources import binary, read_truth, read_vectors, write_truth, write_vectors

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<double>"
QUERIES = "qid bigint, qv array<double>"


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], VECTORS)


@pytest.fixture(scope="module")
def fixture(spark):
    base, q = core.fixture(spark, SF)
    truth = topk.exact_topk(base, q, core.K).persist()
    return base, q, truth


PARAMS = index.IndexParams(build_min=32, width=core.WIDTH, degree=8, max_degree=16)


@pytest.fixture(scope="module")
def built(spark, fixture, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index")) + "/i"
    first = index.build_or_load(spark, fixture[0], path, PARAMS, info=path + "-info")
    again = index.build_or_load(spark, fixture[0], path, PARAMS, info=path + "-info")
    assert again.params == PARAMS and again.records().count() == first.records().count() == 480
    made = spark.read.parquet(path + "-info").collect()
    assert len(made) == 1 and made[0]["bytes"] > 0 and made[0]["memory_mb"] > 0
    return first


def test_ties_zero_queries_and_large_k(spark):
    base = table(spark, [[1, 0], [1, 0], [-2, 0], [0, 0]])
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.0])], QUERIES)
    got = {(r["qid"], r["rank"]): (r["vec_id"], r["ip"]) for r in topk.exact_topk(base, q, 3).collect()}
    assert [got[0, i] for i in (1, 2, 3)] == [(0, 1.0), (1, 1.0), (3, 0.0)]
    assert [got[1, i][0] for i in (1, 2, 3)] == [0, 1, 2]
    assert [got[2, i][0] for i in (1, 2, 3)] == [2, 3, 0]
    assert topk.exact_topk(base, q, 10).count() == 12
    assert topk.exact_topk(base, q.where("false"), 3).count() == 0
    assert topk.exact_topk(base.where("false"), q, 3).count() == 0


def test_blocks_of_queries_give_the_same(spark, fixture, monkeypatch):
    base, q, truth = fixture
    monkeypatch.setattr(topk.query_blocks, "__defaults__", (64 * 8 * 3,))
    rows = lambda df: sorted((*r[:3], round(r[3], 9)) for r in df.collect())
    assert rows(topk.exact_topk(base, q, core.K)) == rows(truth)


def test_bit_sets_without_a_bit_are_far(spark):
    r = spark.range(1).select(V.jaccard_distance(F.array(F.lit(0)), F.array(F.lit(0))).alias("a"), V.hamming(F.array(F.lit(65535)), F.array(F.lit(0))).alias("b")).first()
    assert (r["a"], r["b"]) == (1.0, 16)


def test_normalizing_zero_gives_zero(spark):
    r = spark.range(1).select(V.normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("u"), V.linf(F.array(F.lit(1.0)), F.array(F.lit(-3.0))).alias("d")).first()
    assert list(r["u"]) == [0.0, 0.0] and r["d"] == 4.0


def test_cosine_bounds_fall_with_the_distance():
    for z in (None, 1.96, 3.0):
        t = V.cosine_table(64, z)
        assert len(t) == 65 and t[0] == 1.0 and all(a >= b for a, b in zip(t, t[1:])) and t[64] == pytest.approx(-1)
    assert all(a >= b for a, b in zip(V.cosine_table(64, 3.0), V.cosine_table(64, None)))


@pytest.mark.parametrize("n", [0, 1, 31, 65, 500])
def test_chunks_follow_the_greedy_rule(spark, n):
    rng = np.random.default_rng(n)
    base = table(spark, rng.normal(size=(n, 3)) * rng.uniform(0.2, 3, size=(n, 1)))
    rows = sorted(partition.norm_chunks(base).collect(), key=lambda r: (-r["sq_norm"], r["vec_id"]))
    sq = [r["sq_norm"] for r in rows]
    chunk, start, m, want = 0, 0, 32, []
    for j in range(n):
        if j - start >= m and sq[j] < 0.85 * sq[start] and n - j > m:
            chunk, start, m = chunk + 1, j, 2 * m
        want.append((chunk, j - start))
    assert [(r["chunk"], r["pos"]) for r in rows] == want


def test_equal_norms_are_one_chunk(spark):
    base = table(spark, [[math.cos(i), math.sin(i)] for i in range(200)])
    assert {r["chunk"] for r in partition.norm_chunks(base).collect()} == {0}


def test_norm_pruning_is_exact_with_negative_products(spark):
    rng = np.random.default_rng(3)
    base = table(spark, np.abs(rng.normal(size=(300, 4))) * rng.uniform(0.1, 3, size=(300, 1)))
    q = spark.createDataFrame([(0, [-0.5] * 4), (1, [0.5] * 4)], QUERIES)
    want = topk.exact_topk(base, q, 5).collect()
    assert search.norm_pruned_topk(base, q, 5).orderBy("qid", "rank").collect() == sorted(want, key=lambda r: (r["qid"], r["rank"]))


def test_window_levels_match_the_widening_walk(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(h), int(q)) for h, q in rng.integers(0, 65536, (300, 2))] + [(0, 65535), (65535, 0), (5, 5), (65535, 65535)]

    def walk(h, hq):
        if h == hq:
            return -1
        for t in range(17):
            low = hq >> t << t
            if low <= h <= min(low + (1 << t), 65535):
                return t

    got = spark.createDataFrame(pairs, "h int, q int").select("h", "q", srp.window_level(F.col("h"), F.col("q")).alias("l")).collect()
    assert all(r["l"] == walk(r["h"], r["q"]) for r in got)


def test_hash_parameters_are_checked():
    with pytest.raises(ValueError):
        srp.projections(4, 5, 16)
    assert (srp.projections(4, 2, 3) == srp.projections(4, 2, 3)).all()


def test_graph_invariants(built):
    rows = built.records().collect()
    chunk = {r["vec_id"]: (r["chunk"], r["shard"]) for r in rows}
    for r in rows:
        nbrs = list(r["nbrs"])
        assert len(nbrs) <= 16 and r["vec_id"] not in nbrs and len(set(nbrs)) == len(nbrs)
        assert all(chunk[v] == chunk[r["vec_id"]] for v in nbrs)
    assert sum(s["n"] for s in built.stats.collect()) == 480


def test_directed_bands_point_to_larger_norms(spark, fixture):
    base, *_ = fixture
    chunks = partition.norm_chunks(base)
    tables = srp.hash_tables(srp.srp_hash(base, core.DIM), chunks)
    pos = {r["vec_id"]: r["pos"] for r in chunks.collect()}
    assert all(pos[r["src"]] > pos[r["dst"]] for r in graph.hash_band_pairs(tables, 3).collect())


def test_bands_of_norms_refuse_large_chunks(spark, fixture):
    chunks = partition.norm_chunks(fixture[0])
    assert graph.norm_band_pairs(chunks).count() > 0
    with pytest.raises(ValueError):
        graph.norm_band_pairs(chunks, largest=100)


def test_refinement_keeps_or_raises_products(spark, fixture):
    base, *_ = fixture
    chunks = partition.norm_chunks(base)
    tables = srp.hash_tables(srp.srp_hash(base, core.DIM), chunks)
    edges = graph.hash_band_join(tables, base, 3, 8).persist()
    refined = graph.refine(edges, base, 8, 16).persist()
    best = lambda e: {r["src"]: r["m"] for r in e.groupBy("src").agg(F.max("ip").alias("m")).collect()}
    a, b = best(edges), best(refined)
    assert all(b[s] >= a[s] for s in a)
    assert refined.groupBy("src").count().where("count > 16").count() == 0
    assert refined.where("src = dst").count() == 0


def recall(got, truth):
    return metrics.recall_ratio(got, truth, core.K).first()["recall"]


def rows_of(df):
    return sorted((r["qid"], r["rank"], r["vec_id"], round(r["ip"], 9)) for r in df.collect())


def test_search_recall(built, fixture):
    _, q, truth = fixture
    options = dict(search_min=50, ub=core.UB)
    full = search.search(built, q, core.K, search_min=50, ub=10**9, norm_prune=False, z=None, stop_by_norm=False)
    assert recall(full, truth) == 1.0
    r0, r50 = (recall(search.search(built, q, core.K, ef=ef, **options), truth) for ef in (0, 50))
    assert r50 >= r0 - 0.02 and r50 >= 0.9
    assert recall(search.search(built, q, core.K, ef=50, z=None, **options), truth) >= r50 - 0.02


def plain_walk(x, norms, nbrs, q, start, k, ef, floor):
    """The members of a best-first walk and the products computed, by sets."""
    ips, done, met = {i: float(x[i] @ q) for i in start}, set(), set(start)
    while True:
        pool = sorted(ips, key=lambda i: (-ips[i], i))[: k + ef]
        todo = [i for i in pool if i not in done]
        if not todo:
            return pool, len(ips)
        done.add(todo[0])
        bound = max(floor, ips[pool[k - 1]] if len(pool) >= k else -np.inf)
        for j in nbrs[todo[0]]:
            if j not in met:
                met.add(j)
                if norms[j] >= bound:
                    ips[j] = float(x[j] @ q)


def test_costs_are_the_products_of_all_groups(spark, tmp_path):
    """Groups of one size and cost, counted by hand; scans, walks and groups that give no result."""
    rng = np.random.default_rng(2)
    base = table(spark, rng.normal(size=(90, 8)))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(5, 8)))], QUERIES)
    ix = index.build_index(base, index.IndexParams(build_min=10, min_size=90, shard_rows=30), str(tmp_path / "i"))
    sizes = [s["n"] for s in ix.stats.collect()]
    trace = search.Trace()
    got = search.search(ix, q, 3, search_min=10**6, with_cost=True, trace=trace)
    assert {(r["cost"], r["groups"]) for r in got.collect()} == {(90, len(sizes))} and len(sizes) > 1
    assert [(w.queries, w.groups, w.products) for w in trace.waves] == [(5, 5 * len(sizes), 450)]
    shards = ix.shards.collect()
    options = dict(ef=2, search_min=0, entry="top", z=None, with_cost=True)
    want = dict.fromkeys(range(5), 0)
    for s in shards:
        x = np.array(s["x"]).reshape(s["n"], s["dim"])
        nbrs = [s["nbrs"][s["offsets"][i] : s["offsets"][i + 1]] for i in range(s["n"])]
        for r in q.collect():
            v = np.array(r["qv"])
            want[r["qid"]] += plain_walk(x, s["norms"], nbrs, v / np.linalg.norm(v), [0], 3, 2, -np.inf)[1]
    assert {r["qid"]: r["cost"] for r in search.search(ix, q, 3, **options).collect()} == want
    again = search.search(ix, q, 3, block_bytes=64, **options).collect()
    assert {r["qid"]: r["cost"] for r in again} == want


@pytest.mark.parametrize("length", [0.0, 0.01, 10.0])
def test_queries_of_any_length_find_the_same(built, fixture, spark, length):
    base, q, _ = fixture
    scaled = q.select("qid", F.transform("qv", lambda x: x * length).alias("qv"))
    got = search.search(built, scaled, core.K, search_min=50)
    assert recall(got, topk.exact_topk(base, scaled, core.K)) >= (0.9 if length else 0) and got.count() == 200
    unit = rows_of(search.search(built, q, core.K, search_min=50))
    if length:
        assert [r[:3] for r in rows_of(got)] == [r[:3] for r in unit]
        assert np.allclose([r[3] for r in rows_of(got)], [length * r[3] for r in unit], atol=1e-6)


def test_a_wave_moves_queries_and_no_vectors_of_the_base(built, fixture):
    units = search.unit_queries(fixture[1])
    kernel = search.searcher(10, 50, 50, 200, "srp", True, 3.0, 1, built.params)
    wave = search.wave(built, search.alive(units, None, 10, None), None, 1, kernel, False)
    plan = wave._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "hashpartitioning" not in plan and re.search(r"PartitionFilters: \[isnotnull\(chunk#\d+\), \(chunk#\d+ = 1\)\]", plan), plan
    folders = built.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{built.path}/shards").where("path like '%.parquet'")
    assert folders.count() == built.stats.count()  # a file a shard


def test_waves_save_products_that_two_waves_compute(built, fixture, spark):
    """Against floors of the first chunk only: the same results for no more products, in no more groups."""
    _, q, truth = fixture
    long = dict(search_min=50, ub=20, ef=0, z=None)
    trace = search.Trace()
    got = search.search(built, q, core.K, trace=trace, **long)
    first, rest = trace.waves[0], trace.waves[1:]
    units = search.unit_queries(q)
    kernel = search.searcher(core.K, 0, 50, 20, "srp", True, None, 1, built.params)
    one = search.wave(built, search.alive(units, None, core.K, None), None, 0, kernel, False)
    pairs = lambda df: df.select("qid", F.explode(F.arrays_zip("ids", "ips")).alias("r")).select("qid", F.col("r.ids").alias("vec_id"), F.col("r.ips").alias("ip"))
    best = topk.rank_by_ip(pairs(one), core.K)
    cost = groups = 0
    for s in built.chunks()[1:]:
        row = search.wave(built, search.alive(units, best, core.K, s["max_norm"]), best, s["chunk"], kernel, False).agg(F.sum("cost").alias("c"), F.count("*").alias("g")).first()
        cost, groups = cost + row["c"], groups + row["g"]
    assert first.groups == 20 and sum(w.products for w in rest) <= cost and sum(w.groups for w in rest) <= groups
    assert recall(got, truth) >= 0.85


def test_a_query_leaves_when_no_later_chunk_can_reach_it(spark, tmp_path):
    x = np.concatenate([np.eye(8)[np.arange(40) % 8] * 10, np.eye(8)[np.arange(80) % 8] * 5, np.eye(8)[np.arange(200) % 8]])
    base = table(spark, x)
    q = spark.createDataFrame([(0, [3.0] + [0.0] * 7), (1, [0.0] * 8), (2, [-1.0] + [0.0] * 7)], QUERIES)
    trace = search.Trace()
    ix = index.build_index(base, index.IndexParams(build_min=16), str(tmp_path / "i"))
    got = search.search(ix, q, 3, search_min=16, trace=trace)
    assert [(w.chunk, w.queries) for w in trace.waves][:1] == [(0, 3)] and trace.waves[-1].queries < 3
    assert {(r["qid"], r["chunk"]) for r in trace.entered.collect()} >= {(1, 0), (1, 1), (1, 2)}
    assert [r[3] for r in rows_of(got) if r[0] == 0] == [30.0] * 3
    only = search.Trace()
    search.search(ix, q.where("qid = 0"), 3, search_min=16, trace=only)
    assert [w.chunk for w in only.waves] == [0]


def test_shards_and_normal_edges(spark, fixture, tmp_path):
    base, q, truth = fixture
    p = index.IndexParams(build_min=32, shard_rows=100, normal_edges=True)
    built = index.build_index(base, p, str(tmp_path / "i"))
    assert built.stats.count() > 4
    chunk = {r["vec_id"]: r["chunk"] for r in built.records().collect()}
    links = built.links.collect()
    assert links and all(chunk[r["src"]] == r["src_chunk"] != r["dst_chunk"] == chunk[r["dst"]] for r in links)
    assert {(r["dst"], r["src"]) for r in links} == {(r["src"], r["dst"]) for r in links}
    options = dict(search_min=20, ub=3, ef=0, z=None)
    traces = search.Trace(), search.Trace()
    without, through = (search.search(built, q, core.K, normal_edges=n, with_cost=True, trace=t, **options) for n, t in zip((False, True), traces))
    assert recall(through, truth) >= recall(without, truth)
    assert through.agg(F.sum("cost")).first()[0] > without.agg(F.sum("cost")).first()[0]
    assert recall(search.search(built, q, core.K, search_min=20, normal_edges=True), truth) >= 0.9


def test_starts_come_from_links_of_every_chunk_before(spark, fixture, tmp_path):
    """A chunk that hash seeds don't enter is entered through a link of the second chunk."""
    base, q, _ = fixture
    built = index.build_index(base, index.IndexParams(build_min=32, normal_edges=True), str(tmp_path / "i"))
    units = search.unit_queries(q)
    kernel = search.searcher(core.K, 0, 50, 1, "srp", True, None, 1, built.params)
    second = built.records().where("chunk = 1").select("vec_id", "norm")
    best = units.select("qid").join(second, F.lit(True)).select("qid", "vec_id", F.lit(0.0).alias("ip"), F.lit(1).alias("rank"))
    to = {r["dst"] for r in built.links.where("src_chunk = 1 and dst_chunk = 2").collect()}
    asked = search.alive(units, best.where("rank > 1"), core.K, None)
    with_links, bare = (search.wave(built, asked, best, 2, kernel, n).agg(F.min("cost")).first()[0] for n in (True, False))
    assert to and with_links >= len(to) > bare


def test_an_index_does_not_depend_on_how_rows_are_dealt(spark, fixture, tmp_path):
    edges = lambda df, name: sorted(map(tuple, index.build_index(df, PARAMS, str(tmp_path / name)).edges().collect()))
    assert edges(fixture[0].repartition(7), "a") == edges(fixture[0].coalesce(1).orderBy(F.rand(3)), "b")


def test_refining_by_search_finds_more_than_neighbours_of_neighbours(spark, fixture):
    """At one degree: how much of each vector's true nearest in its chunk is linked."""
    base, *_ = fixture
    ix = index.build_index(base, index.IndexParams(build_min=32, degree=8, max_degree=8))
    chunks = partition.norm_chunks(base).persist()
    bands = graph.hash_band_join(srp.hash_tables(srp.srp_hash(base, core.DIM), chunks), base, 10, 8)
    other = {(r["src"], r["dst"]) for r in graph.refine(bands, base, 8, 8).collect()}
    mine = {(r["src"], r["dst"]) for r in ix.edges().collect()}
    x, of = {r["vec_id"]: np.array(r["embedding"]) for r in base.collect()}, {r["vec_id"]: r["chunk"] for r in chunks.collect()}
    true = {(a, b) for a in x for b in sorted((b for b in x if b != a and of[b] == of[a]), key=lambda b: -x[a] @ x[b])[:4]}
    assert len(mine & true) > len(other & true) and len(mine) <= 8 * 480


def test_an_index_of_other_rows_or_parameters_is_built_anew(spark, fixture, tmp_path):
    base, path, p = fixture[0], str(tmp_path / "index"), index.IndexParams(build_min=32)
    assert index.build_or_load(spark, base, path, p, info=path + "-info").records().count() == 480
    assert index.build_or_load(spark, base.where("vec_id < 300"), path, p, info=path + "-info").records().count() == 280
    index.build_or_load(spark, base.where("vec_id < 300"), path, index.IndexParams(build_min=64), info=path + "-info")
    index.build_or_load(spark, base.where("vec_id < 300"), path, index.IndexParams(build_min=64), info=path + "-info")
    made = spark.read.parquet(path + "-info").collect()
    assert len(made) == 3 and all(r["bytes"] > 0 for r in made)


def test_files_name_a_table_without_reading_it(spark, fixture, tmp_path):
    path = str(tmp_path / "base")
    fixture[0].write.parquet(path)
    read = lambda: spark.read.parquet(path)
    assert index.version(read()) == index.version(read()) != index.version(read().where("vec_id < 100"))
    at = str(tmp_path / "index")
    for _ in range(2):
        index.build_or_load(spark, read(), at, PARAMS, info=at + "-info", by="files")
    assert spark.read.parquet(at + "-info").count() == 1
    before = index.version(read())
    fixture[0].limit(3).write.mode("append").parquet(path)
    assert index.version(read()) != before


def test_an_empty_base_has_an_index(spark, fixture, tmp_path):
    ix = index.build_index(fixture[0].where("false"), PARAMS, str(tmp_path / "i"), dim=core.DIM)
    assert search.search(ix, fixture[1], 3).count() == 0 and ix.stats.count() == 0


def test_tables_of_a_build_are_deleted(spark, fixture):
    from innerscan import storage

    with storage.temporary(spark):
        t = storage.written(fixture[0])
        path = t.inputFiles()[0].removeprefix("file://")
        assert Path(path).exists()
    assert not Path(path).exists()


def test_frontier_and_kernel_find_the_same(spark, fixture):
    """A walk by joins and one in a kernel, all of the pool a round, over one chunk."""
    base, q, _ = fixture
    ix = index.build_index(base, index.IndexParams(build_min=32, min_size=480))
    records = ix.records().persist()
    units = search.unit_queries(q)
    words = srp.srp_hash(q, core.DIM, "qid", "qv").select("qid", F.array("h0", "h1", "h2", "h3").alias("words"))
    top = records.where("pos = 0").select("vec_id").join(units.select("qid"), F.lit(True))
    edges = records.select(F.col("vec_id").alias("src"), F.explode("nbrs").alias("dst"))
    for z in (3.0, None):
        got = frontier.frontier_walk(edges, records, base, units.join(words, "qid"), top, 5, 5, z=z)
        want = search.search(ix, q, 5, ef=5, entry="top", z=z, step=10**6, search_min=0, with_cost=True).collect()
        mine = got.pool.where("rank <= 5").collect()
        assert sorted((r["qid"], r["rank"], r["vec_id"]) for r in mine) == sorted((r["qid"], r["rank"], r["vec_id"]) for r in want)
        fetched = got.met.where("fetched").groupBy("qid").count().collect()
        assert {(r["qid"], r["count"]) for r in fetched} == {(r["qid"], r["cost"]) for r in want}
        assert sum(r.fetched for r in got.rounds) == sum(r["count"] for r in fetched)


def test_saved_projections_and_tables_come_back(spark, fixture, tmp_path):
    proj = srp.projections(core.DIM)
    srp.save_projections(spark, proj, str(tmp_path / "p"))
    assert (srp.load_projections(spark, str(tmp_path / "p")) == proj).all()
    tables = srp.hash_tables(srp.srp_hash(fixture[0], core.DIM), partition.norm_chunks(fixture[0])).select("chunk", "tbl", "h", "pos", "vec_id", "slot").persist()
    srp.save_tables(tables, str(tmp_path / "t"))
    saved, blocks = srp.load_tables(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, saved.select(*tables.columns).collect())) == sorted(map(tuple, tables.collect()))
    hashes = core.query_hashes(fixture[1])
    seeds = srp.srp_seeds(saved, hashes, 5, blocks)
    assert sorted(map(tuple, seeds.collect())) == sorted(map(tuple, srp.srp_seeds(tables, hashes, 5).collect()))
    plan = seeds._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in plan and "IN (" in seeds._jdf.queryExecution().executedPlan().toString().replace("INSET", "IN (")


def scanned(df):
    """Rows that a plan's scans gave after it was run."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.mark.parametrize("length", [1.0, 30.0])
def test_files_in_order_of_norms_are_read_only_where_they_matter(spark, tmp_path, length):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4)) * rng.exponential(size=(3000, 1))
    x[2000:2010] = x[7]
    base, path = table(spark, x).repartition(5), str(tmp_path / "v")
    by_norm.save_by_norm(base, path, file_rows=200, group_bytes=2000)
    q = spark.createDataFrame([(i, (v * length).tolist()) for i, v in enumerate(np.abs(rng.normal(size=(3, 4))))], QUERIES)
    trace = []
    got = by_norm.sorted_topk(spark, path, q, 5, first_rows=100, trace=trace)
    key = lambda df: sorted((r["qid"], r["rank"], r["vec_id"]) for r in df.collect())
    assert key(got) == key(topk.exact_topk(base, q, 5))
    assert sum(t.rows for t in trace) < 3000 and trace[-1].low > 0
    rows = by_norm.open_by_norm(spark, path)
    assert scanned(by_norm.between(rows, trace[0].low, trace[0].high)) < 1500 < scanned(rows) == 3000
    # what can't be bounded reads everything: a zero query, one whose products are all negative
    odd = spark.createDataFrame([(0, [0.0] * 4), (1, [-1e-3] * 4)], QUERIES)
    assert key(by_norm.sorted_topk(spark, path, odd, 3000, first_rows=100)) == key(topk.exact_topk(base, odd, 3000))
    assert by_norm.sorted_topk(spark, path, q.where("false"), 5).count() == 0


def test_bands_reach_over_buckets(spark):
    df = spark.range(100).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("pos"))
    got = partition.with_earlier(df, ["k"], "pos", 3, F.col("pos"), "near", bucket=12).collect()
    assert {r["pos"]: list(r["near"]) for r in got} == {i: list(range(max(0, i - 3), i)) for i in range(100)}


def test_norm_pruning_is_exact_for_any_query_length_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5)) * rng.exponential(size=(3000, 1))
    x[1000:1010] = x[5]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).repartition(3)
    q = spark.createDataFrame([(i, (v * 10**i).tolist()) for i, v in enumerate(rng.normal(size=(4, 5)))], "qid bigint, qv array<double>")
    key = lambda df: sorted((r["qid"], r["rank"], r["vec_id"]) for r in df.collect())
    assert key(search.norm_pruned_topk(base, q, 7)) == key(topk.exact_topk(base, q, 7))


def test_uneven_dimensions_are_refused(spark):
    bad = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], VECTORS)
    with pytest.raises(ValueError):
        index.build_index(bad)


def test_report_and_cached_truth(spark, fixture, tmp_path):
    base, q, truth = fixture
    row = metrics.timed(lambda: truth, "exact", truth, core.K, 20)
    assert row["recall"] == 1.0 and row["ratio"] == pytest.approx(1.0) and row["qps"] > 0
    metrics.save_report(spark, [row], str(tmp_path / "r"))
    assert metrics.save_report(spark, [row], str(tmp_path / "r")).count() == 1 and spark.read.parquet(str(tmp_path / "r")).count() == 2
    once = index.cached_truth(spark, base, q, 5, str(tmp_path / "t"))
    assert index.cached_truth(spark, base, q, 5, str(tmp_path / "t")).count() == once.count() == 100


def test_recall_counts_missing_results(spark):
    truth = spark.createDataFrame([(0, 1, 5, 2.0), (0, 2, 6, 1.0)], "qid bigint, rank int, vec_id bigint, ip double")
    got = truth.where("rank = 1").withColumn("ip", F.lit(1.0))
    r = metrics.recall_ratio(got, truth, 2).first()
    assert (r["hits"], r["recall"], r["ratio"], r["k_ratio"]) == (1, 0.5, 0.5, None)


@pytest.mark.parametrize("kind", ["dense", "fbin", "vecs", "ragged"])
def test_binary_round_trip(spark, tmp_path, kind, monkeypatch):
    x = np.random.default_rng(0).normal(size=(50, 7)).astype(np.float32)
    path = str(tmp_path / f"v.{kind}")
    write_vectors(table(spark, x).repartition(3), path, kind)
    got = sorted(read_vectors(spark, path, kind).collect())
    assert [r[0] for r in got] == list(range(50)) and np.allclose(np.array([r[1] for r in got]), x)
    if kind != "ragged":
        assert read_vectors(spark, path, kind, limit="10").count() == 10
        assert len(binary.VectorReader(path, kind, "float", None).partitions()) == 1


@pytest.mark.parametrize("kind", ["dense", "fbin", "vecs"])
def test_blocks_are_written_at_their_offsets_and_to_any_store(spark, tmp_path, kind, monkeypatch):
    """Small blocks: the bytes of the one file are those of the format; a store that only Hadoop opens gets a folder."""
    x = np.random.default_rng(1).normal(size=(53, 3)).astype(np.float32)
    df = table(spark, x).repartition(4)
    path = str(tmp_path / "v")
    write_vectors(df, path, kind, block_bytes=100)
    head = {"dense": struct.pack("<3I", 4, 53, 3), "fbin": struct.pack("<2I", 53, 3), "vecs": b""}[kind]
    rows = b"".join((struct.pack("<I", 3) if kind == "vecs" else b"") + r.astype("<f4").tobytes() for r in x)
    assert Path(path).read_bytes() == head + rows and [p.name for p in tmp_path.iterdir()] == ["v"]
    monkeypatch.setattr(binary, "is_mount", lambda p: False)
    store = f"file://{tmp_path}/store"
    write_vectors(df, store, kind, block_bytes=100)
    assert len(list((tmp_path / "store" / "blocks").glob("block=*/part-*"))) > 3
    got = sorted(map(tuple, read_vectors(spark, store, kind).collect()))
    assert [g[0] for g in got] == list(range(53)) and np.array_equal(np.array([g[1] for g in got], np.float32), x)
    assert read_vectors(spark, store, kind, limit="10").count() == 10


def test_no_rows_are_a_file_with_its_header(spark, tmp_path):
    write_vectors(table(spark, np.zeros((0, 2))), str(tmp_path / "e.fbin"), "fbin")
    assert (tmp_path / "e.fbin").read_bytes() == struct.pack("<2I", 0, 0) and read_vectors(spark, str(tmp_path / "e.fbin"), "fbin").count() == 0


def test_a_short_file_is_refused(spark, tmp_path):
    path = tmp_path / "short.bin"
    path.write_bytes(struct.pack("<3I", 4, 100, 8) + b"\0" * 64)
    with pytest.raises(ValueError):
        binary.layout(str(path), "dense")


def test_ragged_rows_keep_their_lengths(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, [])], VECTORS)
    write_vectors(df, str(tmp_path / "r.fvecs"), "ragged")
    assert [list(r[1]) for r in sorted(read_vectors(spark, str(tmp_path / "r.fvecs"), "ragged").collect())] == [[1.0, 2.0], [3.0], []]
    assert [binary.detect_kind(n) for n in ("a.fbin", "b.fvecs", "c.data")] == ["fbin", "vecs", "dense"]


def test_truth_round_trip(spark, fixture, tmp_path):
    *_, truth = fixture
    write_truth(truth, str(tmp_path / "t"), core.K)
    got = sorted(map(tuple, read_truth(spark, str(tmp_path / "t")).collect()))
    want = sorted(map(tuple, truth.collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_records_are_taken_apart_by_a_kernel_and_edges_scored_in_their_shards(built, fixture, monkeypatch):
    """No row of a member carries its shard's arrays, and no vector is joined to score an edge."""
    base = fixture[0]
    assert "Generate" not in built.records()._jdf.queryExecution().optimizedPlan().toString()
    plan = built.scored_edges()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    want = sorted(map(tuple, graph.score(built.edges(), base).select("src", "dst", "ip").collect()))
    monkeypatch.setattr(index, "RECORDS", 7)
    assert sorted(map(tuple, built.scored_edges().collect())) == want and len(want) > 480
    assert sorted(map(tuple, built.edges().collect())) == [w[:2] for w in want]


def test_a_pool_of_everything_is_expanded_at_once(monkeypatch):
    """Rounds follow the graph's depth, not its size, and what is found is the same as by single steps."""
    rng = np.random.default_rng(5)
    x, proj = rng.standard_normal((600, 8)), srp.projections(8)
    g = walk.build_shard(np.arange(600), x, proj, 4, 16, walk.GraphParams(rounds=0, width=2, max_degree=6))
    q, starts = x[:3] / 2, [np.array([500]), np.array([500, 10]), np.array([599])]
    rounds, spread = [], walk.spread
    monkeypatch.setattr(walk, "spread", lambda *a: rounds.append(1) or spread(*a))
    found = g.walk(q, None, starts, 10, 10**6)
    assert len(rounds) < 60
    one = g.walk(q, None, starts, 10, 580)  # a pool of 590: what is reached is fewer
    assert len(one.member) < 3 * 590 and len(rounds) > 200
    for name in ("query", "member", "cost"):
        assert getattr(found, name).tolist() == getattr(one, name).tolist()
    assert np.allclose(found.ip, one.ip, rtol=1e-12)


def test_bands_are_scored_where_vectors_meet_and_match_pairs_joined_with_vectors(spark, fixture, monkeypatch):
    """What is shuffled follows the rows: no vector is joined to a pair."""
    base, q, _ = fixture
    chunks = partition.norm_chunks(base)
    tables = srp.hash_tables(srp.srp_hash(base, core.DIM), chunks)
    monkeypatch.setattr(graph, "BUCKET", 16)
    monkeypatch.setattr(graph, "ROWS", 7)
    rows = lambda df: sorted(map(tuple, df.select("src", "dst", "ip").collect()))
    for directed in (True, False):
        got = graph.hash_band_join(tables, base, 3, 8, directed)
        assert rows(got) == rows(topk.trim(graph.score(graph.hash_band_pairs(tables, 3, directed), base), 8))
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # positions, vectors
    got = graph.norm_band_join(chunks, base, 8)
    assert rows(got) == rows(topk.trim(graph.score(graph.norm_band_pairs(chunks), base), 8))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [src" not in plan and "Window" not in plan


def test_products_with_null_and_uneven_vectors_are_null():
    import pyarrow as pa

    v = graph.Vectors(pa.array([[1.0, 2.0], None, [1.0, None], [3.0], [0.5, 4.0]], pa.list_(pa.float64())))
    every = np.arange(5)
    assert v.products(np.zeros(5, int), v, every).tolist() == [5.0, -np.inf, -np.inf, -np.inf, 8.5]
    assert v.products(every[1:4], v, every[1:4]).tolist()[2] == 9.0
    assert graph.edges_of(every, every, v.products(np.zeros(5, int), v, every)).column("ip").null_count == 3


def test_crossing_edges_and_refinement_over_buckets_match_joined_pairs(spark, fixture, monkeypatch):
    """Parts and buckets lose nothing, and no pair is joined with vectors."""
    base = fixture[0].where("vec_id < 260").persist()
    chunks = partition.norm_chunks(base)
    tables = srp.hash_tables(srp.srp_hash(base, core.DIM), chunks)
    pairs = partition.chunk_pairs(partition.chunk_stats(chunks), 4)
    for name, n in (("BUCKET", 8), ("ROWS", 5), ("PART", 16), ("TARGETS", 24), ("SOURCES", 5)):
        monkeypatch.setattr(graph, name, n)
    rows = lambda df: sorted(map(tuple, df.select("src", "dst", "block1", "block2", "ip").collect()))
    best = lambda got, n: sorted(x[:2] + x[2:] for g in {(x[0], x[2], x[3]) for x in got} for x in sorted((y for y in got if (y[0], y[2], y[3]) == g), key=lambda y: (-y[4], y[1]))[:n])
    joined = graph.score(graph.cross_chunk_pairs(tables, pairs, 2), base).select("src", "dst", "block1", "block2", "ip", "s").collect()
    want = sorted(x for s in {r["s"] for r in joined} for x in best([tuple(r)[:5] for r in joined if r["s"] == s], s))
    cross = graph.cross_chunk_join(tables, pairs, base, 2).persist()
    assert rows(cross) == want
    edges = graph.hash_band_join(tables, base, 2, 6).persist()
    near = {}
    for r in edges.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    x = {r["vec_id"]: r["embedding"] for r in base.collect()}
    hops = {(a, d, i, j) for a, b, i, j, _ in want for d in {b, *near.get(b, ())} if d != a}
    ip = lambda a, b: sum(p * q for p, q in zip(x[a], x[b]))
    exact = best([(a, d, i, j, ip(a, d)) for a, d, i, j in hops], 3)
    got = graph.expand_cross_edges(cross, edges, chunks, base, 3)
    assert [g[:4] for g in rows(got)] == [e[:4] for e in exact]
    refined = lambda **more: sorted(map(tuple, graph.refine(edges, base, 4, 8, **more).collect()))
    assert refined(chunks=chunks) == refined() and len(refined()) > 260


def test_a_walk_sorts_only_what_a_full_pool_can_take(monkeypatch):
    from innerscan.operators import walk

    rng = np.random.default_rng(5)
    n, b, k, ef, step = 400, 6, 4, 6, 4
    x, q = rng.standard_normal((n, 8)), rng.standard_normal((b, 8))
    nbrs = np.concatenate([rng.choice(n, 12, replace=False) for _ in range(n)])
    g = walk.Shard(np.arange(n) * 7, np.linalg.norm(x, axis=1), np.zeros((n, 0), np.int64), np.arange(0, 12 * n + 1, 12), nbrs, x)
    starts = [rng.choice(n, k + ef, replace=False) for _ in range(b)]
    sizes, lexsort = [], np.lexsort

    def counted(keys):
        sizes.append(len(keys[0]))
        return lexsort(keys)

    monkeypatch.setattr(walk.np, "lexsort", counted)
    found = g.walk(q, None, starts, k, ef, step=step)
    monkeypatch.undo()
    for i in range(b):
        ips, seen, pool, done = x @ q[i], set(starts[i].tolist()), starts[i].tolist(), set()
        while True:
            pool = sorted(pool, key=lambda m: (-ips[m], m))[: k + ef]
            todo = [m for m in pool if m not in done][:step]
            if not todo:
                break
            done |= set(todo)
            new = {int(m) for t in todo for m in nbrs[12 * t : 12 * t + 12]} - seen
            seen |= new
            pool += sorted(new)
        assert found.member[found.query == i].tolist() == pool
        assert found.cost[i] == len(seen)
    assert sum(sizes) - (len(sizes) - 1) * b * (k + ef) < 0.8 * found.cost.sum()
