"""The registered queries on a small table, against SQL where there is some, else against brute force."""

import brute
import duckdb
import pytest

from innerscan.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_matches_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_pii_digests(spark, rows):
    got = {r["doc_id"]: r for r in queries.queries()["op2_pii"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        counts, spans = brute.spans(text)
        assert {k: got[i][f"n_{k}"] for k in counts} == counts and got[i]["base_sha256"] == brute.sha(spans)
        assert set(filter(None, spans.split(","))) <= set(filter(None, got[i]["spans"].split(",")))


def test_substring_digests(spark, rows):
    got = queries.queries()["op3_substring_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute.repeats(rows)


def test_fingerprint_digests(spark, rows):
    got = {r["doc_id"]: r for r in queries.queries()["op10_fingerprints"](spark, SF).collect()}
    edited = brute.edited(rows)
    assert {i: r["edited_sha256"] for i, r in got.items()} == {i: brute.sha(t) for i, t in edited.items()}
    sets, ids = {i: brute.shingles(t) for i, t in rows}, sorted(i for i, _ in rows)
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for n, i in enumerate(ids):
        assert got[i]["n_chars"] == len(dict(rows)[i] or "")
        assert got[i]["near_edited"] == pytest.approx(likeness(sets[i], brute.shingles(edited[i])), abs=0.2)
        assert got[i]["near_next"] == pytest.approx(likeness(sets[i], sets[ids[(n + 1) % len(ids)]]), abs=0.2)
