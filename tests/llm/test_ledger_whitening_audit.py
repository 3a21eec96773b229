"""Secret ledger, whitening and filter audit against brute force, on tables with the awkward cases and on empty ones."""

import itertools
import re
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from innerscan.llm import filter_audit, queries, secrets, whitening

HEX = "0123456789abcdef" * 2
TEXTS = [
    None,
    "",
    "plain words only",
    f"password: hunter22 and PASSWD='short' api-key=abcdefg ApiKey = \"{HEX}\" x",
    f"token=secret=abcdef, Token:abc; AKIA{'A1' * 8} AKIA123 xAKIA{'Z' * 30}",
    f"{HEX}g{HEX[:23]}",
    f"é😀 secret : 'päss' token :\"{'q' * 9}\"" * 40,
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij",
    "see https://user:pa55@example.org/x and Bearer abcdefghijklmnop ghp_" + "a" * 36,
    "w " * 100_000 + "token=abcdefghij",
]
CLASH = ["blob", "rules", "doc", "found", "place", "kind", "part", "mask", "n", "good", "toxic", "x", "component", "__text", "__key", "__first", "__own", "__id"]
PLAIN = {
    "assign": (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}


def base_spans(text):
    out = [(m.start(), k, m.end(), kind) for k, (kind, (p, g, n)) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return sorted(out)


def joined(spans):
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(TEXTS)] + [(100 + i, t, "en") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en"), (None, TEXTS[4], "en"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(4).cache()


def test_secrets_by_brute_force(spark, docs, tmp_path):
    found = secrets.find_secrets(docs, str(tmp_path / "ledger")).collect()
    assert len(found) == docs.count()
    want = sorted((r["doc_id"] is None, r["doc_id"], base_spans(r["text"])) for r in docs.where("doc_id is not null").collect())
    kinds = [*PLAIN]
    got = sorted((r["doc_id"] is None, r["doc_id"], [(f["start"], kinds.index(f["kind"]), f["end"], f["kind"]) for f in r["found"] if f["kind"] in kinds]) for r in found if r["doc_id"] is not None)
    assert got == want
    by_id = {r["doc_id"]: {f["kind"] for f in r["found"]} for r in found}
    assert by_id[7] >= {"private_key", "jwt"} and by_id[8] >= {"url_login", "bearer", "prefixed"} and not by_id[2]
    assert {f["kind"] for f in next(r for r in found if r["doc_id"] is None and r["found"])["found"]} >= {"assign"}
    assert secrets.find_secrets(docs.where("false"), str(tmp_path / "none")).count() == 0


def test_only_unseen_contents_and_rule_versions_are_scanned(spark, docs, tmp_path, monkeypatch):
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    pairs = lambda l, df: sorted((r["doc"], len(r["rules"])) for r in l.unseen(secrets.addressed(df, "doc_id", "text").select("doc", "blob")).collect())
    first, rest = docs.where("doc_id < 5"), docs.where("doc_id between 5 and 150")
    n = len(secrets.RULES)
    assert pairs(ledger, first) == [(0, n), (2, n), (3, n), (4, n)]  # null is empty
    ledger.update(first)
    assert pairs(ledger, first) == [] and pairs(ledger, rest) == [(i, n) for i in range(5, 10)]
    before = ledger.found().count()
    ledger.update(docs)
    ledger.update(docs)
    assert ledger.seen().count() == len(TEXTS) - 1 and ledger.found().count() > before
    # a rule's next version scans every content again, the other rules none; what the former version found doesn't count
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{32,}"), *secrets.RULES[3:])
    again = secrets.Ledger(spark, str(tmp_path / "ledger"), newer)
    assert {m for _, m in pairs(again, docs)} == {1} and len(pairs(again, docs)) == len(TEXTS) - 1
    again.update(docs)
    got = {r["doc_id"]: [f["start"] for f in r["found"] if f["kind"] == "hex"] for r in again.findings(docs).collect()}
    assert got[5] == [0] == got[105]
    assert {r["rule"] for r in again.found().where("kind = 'hex'").collect()} == {"hex@1", "hex@2"}


def test_an_update_that_was_cut_off_is_done_again_and_counts_once(spark, docs, tmp_path):
    import shutil

    path = str(tmp_path / "ledger")
    once = sorted(map(repr, secrets.find_secrets(docs, path).collect()))
    shutil.rmtree(f"{path}/blobs")
    assert sorted(map(repr, secrets.find_secrets(docs, path).collect())) == once


def test_secret_digests(spark):
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.queries()["op11_secrets"](spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        spans, g = base_spans(r["text"]), got[r["doc_id"]]
        assert [g[f"n_{k}"] for k in PLAIN] == [sum(s[3] == k for s in spans) for k in PLAIN] and g["base_sha256"] == brute.sha(joined(spans))
        assert set(filter(None, joined(spans).split(","))) <= set(filter(None, g["spans"].split(",")))


def plain_whitening(rows):
    """{vec_id: (deviation, coordinates)}, n and shares, from rational sums."""
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    mean = [Fraction(t, n) for t in total]
    centred = np.array([[float(a - m) for a, m in zip(x, mean)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, int((values > 1e-12 * values[0]).sum()))
    at = {x: c for x, c in zip(fit, centred)}
    out = [(i, sum((n * a - t) ** 2 for a, t in zip(x, total)), at[tuple(x)] @ vectors[:, :k] / np.sqrt(values[:k])) for i, x in kept]
    return out, n, values[:k] / values.sum()


def compared(df, rows):
    want, n, explained = plain_whitening(rows)
    got = df.collect()
    k = len(explained)
    assert len(got) == k * len(want) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    assert sorted({(r["vec_id"], r["deviation"]) for r in got}) == sorted({(i, d) for i, d, _ in want})
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    for r in got:
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    y = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    for c in range(1, k + 1):
        a, b = np.array([y[i, c] for i, *_ in want]), np.array([v[c - 1] for *_, v in want])
        assert np.allclose(a if a @ b > 0 else -a, b, atol=1e-8)


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(120, 20)) @ rng.normal(size=(20, 20))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200 + i, rows[0][1]) for i in range(50)] + [rows[3], (300, None), (301, [float("nan")] * 20), (302, [None] + rows[1][1][1:]), (303, [float("inf")] + rows[1][1][1:])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("clash") for c in CLASH}).repartition(7)
    compared(whitening.whitened(df), rows)
    schema = whitening.whitened(df).schema
    assert whitening.whitened(df.where("false")).schema == schema and whitening.whitened(df.where("false")).count() == 0
    assert whitening.whitened(df.where("vec_id >= 200")).count() == 0  # copies of one vector


def test_whitening_of_fewer_vectors_than_dimensions(spark):
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(6).normal(size=(6, 20)).tolist())]
    compared(whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)), rows)


def test_whitening_query(spark):
    d = "/root/testdata/sf0.001"
    compared(queries.queries()["op12_whitening"](spark, d), [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()])


def test_moments_merge_to_those_of_all_and_large_offsets_cost_no_digits():
    rng = np.random.default_rng(7)
    x = rng.integers(-500, 500, (3000, 6)) + 10**11
    parts = [whitening.moments_of(x[a:b]) for a, b in ((0, 1), (1, 40), (40, 41), (41, 3000))]
    merged = parts[0].merge(parts[1]).merge(parts[2].merge(parts[3])).merge(whitening.Moments(0, [], np.zeros((0, 0))))
    y = (x - 10**11).astype(float)
    assert merged.n == 3000 and merged.total == x.sum(axis=0).tolist()
    assert np.allclose(merged.covariance(), np.cov(y.T, bias=True), rtol=1e-12)


def test_deviations_beyond_64_bits_of_intermediate_sums_are_exact():
    x = np.array([[10**9, 5], [7, 10**9]])
    w = whitening.Whitening(2, [10**9 + 7, 10**9 + 5], np.eye(2), np.ones(2), np.ones(2))
    assert w.deviation(x) == [sum((2 * int(a) - s) ** 2 for a, s in zip(r, w.total)) for r in x]


def plain_masks(rows):
    out = []
    for i, text, lang in rows:
        t = text or ""
        w = brute.WORD.findall(t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))]
        low = lambda d: -(2**63) if d is None else d
        fails.append(any((b or "") == t and low(a) < low(i) for a, b, _ in rows))
        out.append((i, lang or "", fails))
    return out


def plain_audit(rows, labels):
    masks, out = plain_masks(rows), []
    for part in {p for _, p, _ in masks}:
        mine = [(i, f) for i, p, f in masks if p == part]
        total = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order):
                at = "ABCDE".index(name)
                gone = [(i, f) for i, f in left if f[at]]
                all_fails = [(i, f) for i, f in mine if f[at]]
                left = [(i, f) for i, f in left if not f[at]]
                total[name] += len(gone)
                good, toxic = (sum((i, k) in labels for i, _ in gone) for k in ("quality", "toxic"))
                steps.append((part, "".join(order), step + 1, len(left), len(gone), len(all_fails) - len(gone), sum(sum(f) == 1 for _, f in all_fails), good, toxic, name))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def test_filter_audit_by_brute_force(spark, docs):
    more = [(500, " ".join(f"w{i}" for i in range(120)), "en"), (501, "A b " * 60, "en"), (502, "AB cd EF", "de"), (503, "#" + "ü" * 300, "de"), (504, "A b " * 60, "de")]
    table = docs.select("doc_id", "text", "lang", *CLASH).unionByName(spark.createDataFrame(more, "doc_id bigint, text string, lang string").withColumns({c: F.lit("clash") for c in CLASH}))
    labels = [(1, 1, 0), (501, 1, 0), (501, 0, 1), (102, 0, 1), (None, 1, 1), (3, None, None), (9999, 1, 1)]
    known = {(i, k) for i, q, t in labels for k, v in (("quality", q), ("toxic", t)) if v == 1 and i is not None}
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()]
    masks = filter_audit.failure_masks(table)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(key, ((r["doc_id"], r["part"], r["mask"]) for r in masks.collect()))) == sorted(map(key, ((i, p, sum(1 << k for k, f in enumerate(fails) if f)) for i, p, fails in plain_masks(rows))))
    got = filter_audit.audit(filter_audit.mask_cells(masks, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, known)
    assert got.count() == 3 * 600
    none = filter_audit.failure_masks(table.where("false"))
    assert filter_audit.audit(filter_audit.mask_cells(none, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))).count() == 0
