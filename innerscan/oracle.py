"""DuckDB SQL for the engine's deterministic queries, from shared CTEs."""

from __future__ import annotations

from .functions.vectors import cosine_table
from .operators.srp import BITS, LEVELS, TABLES, TOP, projections

#: The engine's defaults; ``REACH`` is what the graph check begins with.
K, UB, WIDTH, LINKS, DEGREE, MAX_DEGREE, REACH = 10, 200, 10, 32, 24, 48, 5

FIXTURE = """
raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT vec_id AS qid, e AS qv FROM raw WHERE vec_id < 20),
base AS (SELECT vec_id, list_transform(e, lambda x: x * (1 + (vec_id % 16) / 8.0::DOUBLE)) AS e FROM raw WHERE vec_id >= 20),
sq AS (SELECT vec_id, list_inner_product(e, e) AS sq_norm FROM base)"""

TRUTH = f"""
scored AS (SELECT qid, vec_id, list_inner_product(e, qv) AS ip FROM base, q),
truth AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ip DESC, vec_id) AS rank FROM scored QUALIFY rank <= {K})"""

SORTED = """
sorted AS (SELECT vec_id, sq_norm, row_number() OVER (ORDER BY sq_norm DESC, vec_id) - 1 AS gpos FROM sq),
size AS (SELECT count(*) AS n FROM sorted),
low AS (SELECT a.gpos AS s, min(b.gpos) AS j FROM sorted a LEFT JOIN sorted b ON b.gpos > a.gpos AND b.sq_norm < 0.85 * a.sq_norm GROUP BY a.gpos),
bounds AS (
  SELECT 0 AS chunk, CAST(0 AS BIGINT) AS s, CAST(32 AS BIGINT) AS m
  UNION ALL
  SELECT chunk + 1, greatest(bounds.s + m, j), 2 * m FROM bounds JOIN low ON low.s = bounds.s, size
  WHERE j IS NOT NULL AND greatest(bounds.s + m, j) < n AND n - greatest(bounds.s + m, j) > m
),
chunks AS (
  SELECT vec_id, sq_norm, CAST(chunk AS INT) AS chunk, CAST(gpos - s AS INT) AS pos
  FROM sorted ASOF JOIN bounds ON sorted.gpos >= bounds.s
)"""


def _matrix() -> str:
    rows = ", ".join(f"({i}, [{', '.join(repr(float(x)) + '::DOUBLE' for x in r)}])" for i, r in enumerate(projections(64)))
    return f"proj AS (SELECT * FROM (VALUES {rows}) t(p, a))"


def _hash(name: str, rows: str, key: str, vec: str) -> str:
    words = ", ".join(
        f"CAST(sum(CASE WHEN p // {BITS} = {t} AND list_inner_product({vec}, a) > 0 THEN 1 << (p % {BITS}) ELSE 0 END) AS INT) AS h{t}"
        for t in range(TABLES)
    )
    return f"{name} AS (SELECT {key}, {words} FROM {rows}, proj GROUP BY {key})"


HASHES = lambda: f"{_matrix()}, {_hash('hashes', 'base', 'vec_id', 'e')}"
QHASHES = lambda: _hash("qhashes", "q", "qid", "qv")

LONG = """
long AS (
  SELECT chunk, tbl, pos, vec_id, CASE tbl WHEN 0 THEN h0 WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END AS h
  FROM hashes JOIN chunks USING (vec_id), (VALUES (0), (1), (2), (3)) t(tbl)
),
tables AS (SELECT *, row_number() OVER (PARTITION BY chunk, tbl ORDER BY h, pos) - 1 AS slot FROM long)"""


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + "\n" + select


LEVEL = "CASE WHEN h = hq THEN -1 " + " ".join(
    f"WHEN h BETWEEN (hq >> {t}) * {1 << t} AND least((hq >> {t}) * {1 << t} + {1 << t}, {TOP}) THEN {t}" for t in range(LEVELS)
) + " END"

SEEDS = lambda ub=UB: f"""
qlong AS (SELECT qid, tbl, CASE tbl WHEN 0 THEN h0 WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END AS hq FROM qhashes, (VALUES (0), (1), (2), (3)) t(tbl)),
met AS (SELECT qid, chunk, tbl, h, pos, vec_id, {LEVEL} AS level FROM tables JOIN qlong USING (tbl)),
cum AS (SELECT qid, chunk, level, sum(count(*)) OVER (PARTITION BY qid, chunk ORDER BY level) AS upto FROM met GROUP BY qid, chunk, level),
stops AS (SELECT qid, chunk, coalesce(min(level) FILTER (upto >= {ub}), max(level)) AS stop FROM cum GROUP BY qid, chunk),
near AS (
  SELECT qid, chunk, vec_id, min((tbl, h, pos)) AS place FROM met JOIN stops USING (qid, chunk) WHERE level <= stop GROUP BY qid, chunk, vec_id
),
seeds AS (SELECT qid, chunk, vec_id FROM near QUALIFY row_number() OVER (PARTITION BY qid, chunk ORDER BY place) <= {ub + 1})"""  # noqa: E731


#: Pool of a build's searches and how many members their rounds expand; what a search's pool has beyond k; sizes below which chunks are scanned and bands.
EF_BUILD, STEP_BUILD, EF, SEARCH_MIN, BUILD_MIN = 80, 8, 50, 50, 32
COSINES = lambda z: "[" + ", ".join(repr(x) + "::DOUBLE" for x in cosine_table(64, z)) + "]"
UNIT = "uq AS (SELECT qid, list_transform(qv, lambda x: x / (sqrt(list_inner_product(qv, qv)) + 1e-30::DOUBLE)) AS u, sqrt(list_inner_product(qv, qv)) AS len FROM q)"
WAVES = "waves AS (SELECT chunk, count(*) AS n, sqrt(max(sq_norm)) AS max_norm FROM chunks GROUP BY chunk)"

#: A shard's graph: bands both ways, then each member searches it best first and keeps its best, and these both ways.
BUILT = f"""
sym AS (
  SELECT * FROM (SELECT src, dst, max(ip) AS ip FROM (SELECT src, dst, ip FROM linked UNION ALL SELECT dst, src, ip FROM linked) GROUP BY src, dst)
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY ip DESC, dst) <= {MAX_DEGREE}),
bw AS (
  SELECT src, dst AS vec_id, ip, false AS done, 0 AS it FROM sym
  UNION ALL (
  WITH ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ip DESC, vec_id) AS r FROM bw) WHERE r <= {EF_BUILD}),
  front AS (SELECT src, vec_id FROM ranked WHERE NOT done QUALIFY row_number() OVER (PARTITION BY src ORDER BY r) <= {STEP_BUILD}),
  new AS (SELECT DISTINCT f.src, s.dst AS vec_id FROM front f JOIN sym s ON s.src = f.vec_id WHERE s.dst <> f.src)
  SELECT k.src, k.vec_id, k.ip, k.done OR f.vec_id IS NOT NULL, k.it + 1 FROM ranked k LEFT JOIN front f USING (src, vec_id) WHERE k.src IN (SELECT src FROM front)
  UNION ALL
  SELECT n.src, n.vec_id, list_inner_product(a.e, b.e), false, (SELECT max(it) FROM bw) + 1
  FROM (SELECT * FROM new ANTI JOIN ranked USING (src, vec_id)) n JOIN base a ON a.vec_id = n.src JOIN base b ON b.vec_id = n.vec_id)),
chosen AS (
  SELECT src, vec_id AS dst, ip FROM (SELECT * FROM bw QUALIFY it = max(it) OVER (PARTITION BY src))
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY ip DESC, vec_id) <= {DEGREE}),
built AS (
  SELECT * FROM (SELECT src, dst, max(ip) AS ip FROM (SELECT src, dst, ip FROM chosen UNION ALL SELECT dst, src, ip FROM chosen) GROUP BY src, dst)
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY ip DESC, dst) <= {MAX_DEGREE})"""


def _search(edges: str = "built", ef: int = EF, norm_prune: bool = True, z: float | None = 3.0, step: int = 1, stop: bool = True) -> str:
    """``st``: best-first searches, chunk after chunk, a round each time; ``last`` is what each query has met at its end.

    ``start`` (qid, chunk, vec_id, done) is what a chunk begins with, ``member``
    (vec_id, chunk, norm), ``waves`` (chunk, max_norm).  A product that bounds
    ruled out is null.
    """
    keep = " AND ".join((["norm >= bound"] if norm_prune else []) + ([f"norm * ({COSINES(z)})[1 + d] >= bound"] if z is not None else [])) or "true"
    diff = " + ".join(f"bit_count(CAST(xor(h.h{t}, g.h{t}) AS BIGINT))" for t in range(TABLES))
    go_on = "kth.ip IS NULL OR kth.ip <= w.max_norm" if stop else "true"
    return f"""
st AS (
  SELECT s.qid, 0 AS c, s.vec_id, 0 AS vc, list_inner_product(e, u) AS ip, s.done, 0 AS it FROM start s JOIN base USING (vec_id) JOIN uq USING (qid) WHERE s.chunk = 0
  UNION ALL (
  WITH ranked AS (
    SELECT *, row_number() OVER (PARTITION BY qid, vc ORDER BY ip DESC NULLS LAST, vec_id) AS r, row_number() OVER (PARTITION BY qid ORDER BY ip DESC NULLS LAST, vec_id) AS ra FROM st),
  front AS (
    SELECT qid, c, vec_id FROM ranked WHERE vc = c AND NOT done AND ip IS NOT NULL AND r <= {K + ef}
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r) <= {step}),
  prior AS (SELECT qid, ip FROM st WHERE vc < c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ip DESC NULLS LAST, vec_id) = {K}),
  own AS (SELECT qid, ip FROM ranked WHERE vc = c AND r = {K}),
  bounds2 AS (
    SELECT f.qid, greatest(coalesce(prior.ip, '-inf'::DOUBLE), coalesce(own.ip, '-inf'::DOUBLE)) AS bound
    FROM (SELECT DISTINCT qid FROM front) f LEFT JOIN prior USING (qid) LEFT JOIN own USING (qid)),
  new AS (SELECT DISTINCT f.qid, f.c, x.dst AS vec_id FROM front f JOIN {edges} x ON x.src = f.vec_id),
  judged AS (
    SELECT n.qid, n.c, n.vec_id, m.norm, bound, {diff} AS d
    FROM (SELECT * FROM new ANTI JOIN st USING (qid, vec_id)) n JOIN member m USING (vec_id) JOIN hashes h USING (vec_id) JOIN qhashes g USING (qid) JOIN bounds2 USING (qid)),
  onward AS (
    SELECT a.qid, a.c + 1 AS c FROM (SELECT DISTINCT qid, c FROM st) a ANTI JOIN front USING (qid)
    JOIN waves w ON w.chunk = a.c + 1 LEFT JOIN (SELECT qid, ip FROM ranked WHERE ra = {K}) kth USING (qid) WHERE {go_on}),
  now AS (SELECT max(it) + 1 AS it FROM st)
  SELECT k.qid, k.c, k.vec_id, k.vc, k.ip, k.done OR f.vec_id IS NOT NULL, now.it FROM now, ranked k LEFT JOIN front f USING (qid, vec_id) WHERE k.qid IN (SELECT qid FROM front)
  UNION ALL
  SELECT qid, c, vec_id, c, CASE WHEN {keep} THEN list_inner_product(e, u) END, false, now.it FROM now, judged JOIN base USING (vec_id) JOIN uq USING (qid)
  UNION ALL
  SELECT k.qid, o.c, k.vec_id, k.vc, k.ip, true, now.it FROM now, ranked k JOIN onward o USING (qid)
  UNION ALL
  SELECT o.qid, o.c, s.vec_id, o.c, list_inner_product(e, u), s.done, now.it FROM now, onward o JOIN start s ON s.qid = o.qid AND s.chunk = o.c JOIN base USING (vec_id) JOIN uq ON uq.qid = o.qid)),
last AS (SELECT * FROM st QUALIFY it = max(it) OVER (PARTITION BY qid))"""


START = f"""
member AS (SELECT vec_id, chunk, sqrt(sq_norm) AS norm FROM chunks),
start AS (
  SELECT qid, chunk, vec_id, n < {SEARCH_MIN} AS done FROM chunks JOIN waves USING (chunk), q WHERE n < {SEARCH_MIN}
  UNION ALL SELECT qid, chunk, vec_id, false FROM seeds JOIN waves USING (chunk) WHERE n >= {SEARCH_MIN})"""
#: As START, from the member of the largest norm of each chunk.
TOPS = START.replace("FROM seeds JOIN waves USING (chunk) WHERE", "FROM chunks JOIN waves USING (chunk), q WHERE pos = 0 AND")
FROM_LAST = f"""SELECT qid, CAST(r AS INT) AS rank, vec_id, round(ip * len, 6) AS ip FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ip DESC, vec_id) AS r FROM last WHERE ip IS NOT NULL) JOIN uq USING (qid) WHERE r <= {K}"""


def _distance(expr: str) -> str:
    return _with(FIXTURE, select=f"SELECT qid, vec_id, round({expr}, 6) AS dist FROM base, q")


def oracle_sql() -> dict[str, str]:
    pairs64 = "qhashes a, hashes b"
    bits = lambda op: " + ".join(f"bit_count(CAST({f'xor(a.h{t}, b.h{t})' if op == '^' else f'(a.h{t} {op} b.h{t})'} AS BIGINT))" for t in range(4))
    table = ", ".join(repr(x) + "::DOUBLE" for x in cosine_table(64, 3.0))
    topk = "SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(ip, 6) AS ip FROM truth"
    scored_pairs = "list_inner_product(a.e, b.e)"
    edges = lambda pairs, n: f"""
      SELECT src, dst, round(ip, 6) AS ip FROM (
        SELECT src, dst, {scored_pairs} AS ip FROM {pairs} p JOIN base a ON a.vec_id = src JOIN base b ON b.vec_id = dst)
      QUALIFY row_number() OVER (PARTITION BY src ORDER BY ip DESC, dst) <= {n}"""  # noqa: E731
    band = f"""bandpairs AS (
      SELECT DISTINCT CASE WHEN a.pos > b.pos THEN a.vec_id ELSE b.vec_id END AS src, CASE WHEN a.pos > b.pos THEN b.vec_id ELSE a.vec_id END AS dst
      FROM tables a JOIN tables b ON a.chunk = b.chunk AND a.tbl = b.tbl AND b.slot BETWEEN a.slot - {WIDTH} AND a.slot - 1)"""
    both = f"""bothpairs AS (
      SELECT DISTINCT a.vec_id AS src, b.vec_id AS dst
      FROM tables a JOIN tables b ON a.chunk = b.chunk AND a.tbl = b.tbl AND a.slot <> b.slot AND b.slot BETWEEN a.slot - {WIDTH} AND a.slot + {WIDTH})"""
    norm = """normpairs AS (
      SELECT a.vec_id AS src, b.vec_id AS dst FROM chunks a JOIN chunks b ON a.chunk = b.chunk AND a.pos <> b.pos
      JOIN (SELECT chunk, CAST(floor(sqrt(count(*))) AS INT) AS w FROM chunks GROUP BY chunk) c ON c.chunk = a.chunk AND abs(a.pos - b.pos) <= w)"""
    pairs = f"""stats AS (SELECT chunk, count(*) AS n FROM chunks GROUP BY chunk),
      pairs AS (SELECT CAST(a.chunk AS INT) AS block1, CAST(b.chunk AS INT) AS block2, CAST(greatest(1, {LINKS} >> i) AS INT) AS s
                FROM stats a, range(20) r(i), stats b WHERE b.chunk = a.chunk + (1 << i))"""
    cross = f"""placed AS (
        SELECT block1, block2, s, t.tbl, t.vec_id AS src, (SELECT count(*) FROM tables o WHERE o.chunk = block1 AND o.tbl = t.tbl AND o.h < t.h) AS place
        FROM pairs JOIN tables t ON t.chunk = block2),
      crosspairs AS (
        SELECT DISTINCT src, o.vec_id AS dst, block1, block2, s FROM placed p
        JOIN tables o ON o.chunk = block1 AND o.tbl = p.tbl AND o.slot BETWEEN place - {WIDTH} AND place + {WIDTH})"""
    lsh = f"""ranked AS (
      SELECT qid, vec_id, list_inner_product(e, qv) AS ip FROM (SELECT DISTINCT qid, vec_id FROM seeds) JOIN base USING (vec_id) JOIN q USING (qid)),
      got AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ip DESC, vec_id) AS rank FROM ranked QUALIFY rank <= {K})"""
    best = lambda rows, n, keys="src": f"SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ip DESC, dst) <= {n}"
    scored = lambda rows, more="": f"SELECT src, dst{more}, {scored_pairs} AS ip FROM {rows} JOIN base a ON a.vec_id = src JOIN base b ON b.vec_id = dst"
    linked = f"linked AS ({best(scored('bandpairs'), MAX_DEGREE)})"
    refined = f"""two AS (SELECT DISTINCT x.src, y.dst FROM linked x JOIN linked y ON x.dst = y.src WHERE x.src <> y.dst),
      kept AS ({best(f"SELECT src, dst, ip FROM linked UNION ALL {scored('(SELECT * FROM two ANTI JOIN linked USING (src, dst))')}", DEGREE)}),
      ways AS (SELECT src, dst, max(ip) AS ip FROM (SELECT src, dst, ip FROM kept UNION ALL SELECT dst, src, ip FROM kept) GROUP BY src, dst)"""
    crossed = f"""crossed AS (
        SELECT * FROM ({scored('crosspairs', ', block1, block2, s')}) QUALIFY row_number() OVER (PARTITION BY src, block1, block2 ORDER BY ip DESC, dst) <= s),
      hops AS (
        SELECT src, dst, block1, block2 FROM crossed
        UNION SELECT c.src, l.dst, block1, block2 FROM crossed c JOIN linked l ON c.dst = l.src)"""
    reach = f"""reach AS (SELECT qid, vec_id FROM seeds UNION SELECT qid, dst FROM reach JOIN linked ON src = vec_id),
      got AS (
        SELECT qid, vec_id, list_inner_product(e, qv) AS ip FROM reach JOIN base USING (vec_id) JOIN q USING (qid)
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY ip DESC, vec_id) <= {K})"""
    chain = (FIXTURE, SORTED, HASHES(), LONG)
    walked = (*chain, band, linked, BUILT, QHASHES(), UNIT)
    graph = (*walked, WAVES)
    links = f"""crosslinks AS ({best(scored('(SELECT * FROM hops WHERE src <> dst)', ', block1, block2'), LINKS, 'src, block1, block2')}),
      linked_all AS (SELECT src, dst FROM built UNION SELECT src, dst FROM crosslinks UNION SELECT dst, src FROM crosslinks),
      waves AS (SELECT 0 AS chunk, 0::DOUBLE AS max_norm),
      member AS (SELECT vec_id, sqrt(sq_norm) AS norm FROM sq),
      start AS (SELECT qid, chunk, vec_id, false AS done FROM seeds WHERE chunk = 0)"""
    crossing = (*walked, SEEDS(REACH), pairs, cross, crossed.replace("JOIN linked l", "JOIN built l"), links)
    return {
        "exact_topk_ip": _with(FIXTURE, TRUTH, select=topk),
        "exact_topk_sql": _with(FIXTURE, TRUTH, select=topk),
        "norm_pruned_topk": _with(FIXTURE, TRUTH, select=topk),
        "sorted_scan_topk": _with(FIXTURE, TRUTH, select=topk),
        "beam_reach_topk": _with(
            *chain, band, linked, QHASHES(), SEEDS(REACH), reach,
            select="SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY ip DESC, vec_id) AS INT) AS rank, vec_id, round(ip, 6) AS ip FROM got",
        ),
        "graph_refine": _with(*chain, band, linked, refined, select=f"SELECT src, dst, round(ip, 6) AS ip FROM ({best('SELECT * FROM ways', MAX_DEGREE)})"),
        "cross_chunk_edges": _with(
            *chain, pairs, cross, band, linked, crossed,
            select=f"SELECT src, dst, block1, block2, round(ip, 6) AS ip FROM ({best(scored('(SELECT * FROM hops WHERE src <> dst)', ', block1, block2'), LINKS, 'src, block1, block2')})",
        ),
        "built_graph": _with(*chain, band, linked, BUILT, select="SELECT src, dst, round(ip, 6) AS ip FROM built"),
        "pruned_beam_topk": _with(*graph, SEEDS(), START, _search(), select=FROM_LAST),
        "norm_pruned_beam_topk": _with(*graph, SEEDS(), START, _search(z=None), select=FROM_LAST),
        "beam_topk": _with(*graph, TOPS, _search(norm_prune=False, z=None), select=FROM_LAST),
        "wide_beam_topk": _with(*graph, SEEDS(REACH), START, _search(ef=0, step=4), select=FROM_LAST),
        "search_cost": _with(*graph, SEEDS(REACH), START, _search(ef=0), select="SELECT qid, CAST(count(ip) AS BIGINT) AS cost, CAST(max(c) + 1 AS BIGINT) AS groups FROM last GROUP BY qid"),
        "search_waves": _with(*graph, SEEDS(REACH), START, _search(ef=0), select="SELECT DISTINCT qid, CAST(c AS INT) AS chunk FROM st"),
        "lsh_graphless_topk": _with(*chain, QHASHES(), SEEDS(), WAVES, UNIT, START, "last AS (SELECT qid, vec_id, list_inner_product(e, u) AS ip FROM start JOIN base USING (vec_id) JOIN uq USING (qid))", select=FROM_LAST),
        "frontier_topk": _with(*crossing, _search("linked_all", step=10**6), select=FROM_LAST),
        "frontier_fetched": _with(*crossing, _search("linked_all", step=10**6), select="SELECT qid, CAST(count(*) AS BIGINT) AS met, CAST(count(ip) AS BIGINT) AS fetched FROM last GROUP BY qid"),
        "hash_words": _with(FIXTURE, HASHES(), select="SELECT vec_id, right(bin(h0 + 65536), 16) AS word, len(list_distinct([h0, h1, h2, h3])) = 4 AS all_differ FROM hashes"),
        "stream_topk": _with(FIXTURE, TRUTH, select=topk),
        "norms": _with(FIXTURE, select="SELECT vec_id, round(sq_norm, 6) AS sq_norm, round(sqrt(sq_norm), 6) AS norm FROM sq"),
        "norm_range": _with(FIXTURE, select="SELECT round(max(sq_norm), 6) AS max_sq_norm, round(min(sq_norm), 6) AS min_sq_norm, round(max(sq_norm) / min(sq_norm), 6) AS norm_range FROM sq"),
        "query_normalize": _with(
            FIXTURE,
            select="SELECT vec_id AS qid, round(list_sum(u), 6) AS total, round(list_inner_product(u, u), 6) AS unit FROM (SELECT vec_id, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-30::DOUBLE)) AS u FROM base)",
        ),
        "neg_inner_product": _distance("-list_inner_product(e, qv)"),
        "dist_l2": _distance("list_sum(list_transform(list_zip(e, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"),
        "dist_l1": _distance("list_sum(list_transform(list_zip(e, qv), lambda p: abs(p[1] - p[2])))"),
        "dist_linf": _distance("list_max(list_transform(list_zip(e, qv), lambda p: abs(p[1] - p[2])))"),
        "prefix_sample": "SELECT vec_id, label FROM embeddings WHERE vec_id < (SELECT count(*) // 10 FROM embeddings)",
        "query_holdout": "SELECT vec_id, CASE WHEN vec_id < 20 THEN 'query' ELSE 'base' END AS side FROM embeddings",
        "norm_chunks": _with(FIXTURE, SORTED, select="SELECT vec_id, round(sq_norm, 6) AS sq_norm, chunk, pos FROM chunks"),
        "chunk_stats": _with(FIXTURE, SORTED, select="SELECT chunk, count(*) AS n, round(max(sq_norm), 6) AS max_sq_norm FROM chunks GROUP BY chunk"),
        "chunk_pairs": _with(FIXTURE, SORTED, pairs, select="SELECT * FROM pairs"),
        "srp_hash": _with(FIXTURE, HASHES(), select="SELECT * FROM hashes"),
        "srp_tables": _with(*chain, select="SELECT chunk, CAST(tbl AS INT) AS tbl, h, pos, vec_id, CAST(slot AS INT) AS slot FROM tables"),
        "srp_tables_single": _with(
            FIXTURE, HASHES(), "chunks AS (SELECT vec_id, 0 AS chunk, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS pos FROM base)", LONG,
            select="SELECT CAST(tbl AS INT) AS tbl, h, pos, vec_id, CAST(slot AS INT) AS slot FROM tables",
        ),
        "hamming": _with(FIXTURE, HASHES(), QHASHES(), select=f"SELECT a.qid AS a_id, b.vec_id AS b_id, CAST({bits('^')} AS INT) AS diff, CAST(bit_count(CAST(xor(a.h0, b.h0) AS BIGINT)) + bit_count(CAST(xor(a.h1, b.h1) AS BIGINT)) AS INT) AS diff_low FROM {pairs64}"),
        "bit_sets": _with(FIXTURE, HASHES(), QHASHES(), select=f"SELECT a.qid AS a_id, b.vec_id AS b_id, CAST({bits('|')} AS INT) AS union_bits, CAST({bits('&')} AS INT) AS common_bits, CAST({' + '.join(f'bit_count(CAST(a.h{t} AS BIGINT))' for t in range(4))} AS INT) AS a_bits FROM {pairs64}"),
        "jaccard_bits": _with(FIXTURE, HASHES(), QHASHES(), select=f"SELECT a.qid AS a_id, b.vec_id AS b_id, round(CASE WHEN {bits('|')} = 0 THEN 1.0::DOUBLE ELSE (({bits('|')}) - ({bits('&')})) / CAST({bits('|')} AS DOUBLE) END, 6) AS dist FROM {pairs64}"),
        "est_ip": _with(
            FIXTURE, HASHES(), QHASHES(),
            select=f"SELECT qid, vec_id, round(sqrt(sq_norm) * ([{table}])[1 + d], 6) AS est FROM (SELECT a.qid, b.vec_id, {bits('^')} AS d FROM qhashes a, hashes b) JOIN sq USING (vec_id)",
        ),
        "norm_predicate": _with(FIXTURE, TRUTH, select=f"SELECT qid, CAST(count(*) AS BIGINT) AS kept FROM sq, (SELECT qid, ip FROM truth WHERE rank = {K}) WHERE sqrt(sq_norm) >= ip GROUP BY qid"),
        "lsh_window_graph": _with(*chain, band, select=edges("bandpairs", MAX_DEGREE)),
        "lsh_window_graph_both": _with(*chain, both, select=edges("bothpairs", MAX_DEGREE)),
        "norm_band_graph": _with(FIXTURE, SORTED, norm, select=edges("normpairs", MAX_DEGREE)),
        "cross_chunk_join": _with(
            *chain, pairs, cross,
            select=f"""SELECT src, dst, block1, block2, round(ip, 6) AS ip FROM (
              SELECT src, dst, block1, block2, s, {scored_pairs} AS ip FROM crosspairs JOIN base a ON a.vec_id = src JOIN base b ON b.vec_id = dst)
              QUALIFY row_number() OVER (PARTITION BY src, block1, block2 ORDER BY ip DESC, dst) <= s""",
        ),
        "srp_seeds": _with(*chain, QHASHES(), SEEDS(), select="SELECT qid, chunk, vec_id FROM seeds"),
        "srp_seeds_saved": _with(*chain, QHASHES(), SEEDS(), select="SELECT qid, chunk, vec_id FROM seeds"),
        "seed_levels": _with(*chain, QHASHES(), SEEDS(), select="SELECT qid, chunk, CAST(level AS INT) AS level, CAST(upto AS BIGINT) AS upto FROM cum"),
        "entry_point": _with(*chain, QHASHES(), select="SELECT qid, coalesce(arg_max(vec_id, slot) FILTER (h <= h0), arg_min(vec_id, slot)) AS vec_id FROM qhashes, tables WHERE chunk = 0 AND tbl = 0 GROUP BY qid"),
        "lsh_only_topk": _with(*chain, QHASHES(), SEEDS(), lsh, select="SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(ip, 6) AS ip FROM got"),
        "recall_ratio": _with(
            *chain, QHASHES(), SEEDS(), lsh, TRUTH,
            select=f"""SELECT hits, queries, round(hits / CAST(queries * {K} AS DOUBLE), 6) AS recall, round(ratio, 6) AS ratio, round(k_ratio, 6) AS k_ratio FROM
              (SELECT count(*) AS hits FROM got JOIN truth USING (qid, vec_id)), (SELECT count(DISTINCT qid) AS queries FROM truth),
              (SELECT avg(abs(g.ip / t.ip)) AS ratio, avg(abs(g.ip / t.ip)) FILTER (g.rank = {K}) AS k_ratio FROM got g JOIN truth t USING (qid, rank))""",
        ),
    }
