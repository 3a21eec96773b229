"""The pipeline's stages on a small table against what each keeps by brute force."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from innerscan.llm import toxicity as severity
from innerscan.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("start", docs)]
    for name, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, SF), name)
        out.append((name, docs))
    return out


def test_columns_stay_until_the_last(stages):
    for _, df in stages[:-1]:
        assert df.columns == stages[0][1].columns


def test_each_stage_on_its_own_input(stages):
    table = {n: df for n, df in stages}
    rows = lambda n: {r["doc_id"]: r["text"] for r in table[n].collect()}
    start, clean, lines, near = (rows(n) for n in ("start", "toxicity", "line_dedup", "near_dedup"))
    assert set(clean) <= set(start) and len(clean) > 0.7 * len(start)
    assert set(lines) == set(clean)
    want = brute.near(list(lines.items()), percent=80)
    assert set(near) == {i for i, (_, c) in want.items() if i == c}
    assert all(near[i] == lines[i] for i in near)


def test_the_mixing_stage_by_brute_force(stages):
    table = {n: df for n, df in stages}
    key = lambda rows: sorted((i, " ".join(t if isinstance(t, list) else brute.WORD.findall(t or ""))) for i, t in rows)
    want = brute.mixed([(r["doc_id"], r["text"], r["source"]) for r in table["near_dedup"].collect()])
    got = table["mixing"].collect()
    assert key((r["doc_id"], r["text"]) for r in got) == key(want)
    near = {r["doc_id"]: r["text"] for r in table["near_dedup"].collect()}
    assert all((near[r["doc_id"]] or "").startswith(r["text"] or "") for r in got)
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_the_packing_stage_by_brute_force(stages):
    """Every row of the mix, cut into the tokenizer's ids by plain slices, and sequences without gaps near the bound."""
    import collections
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table = {n: df for n, df in stages}
    packed = table["packing"].collect()
    pieces = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    want = collections.Counter()
    for r in table["mixing"].collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = next(x for x in packed if x["doc_id"] == r["doc_id"] and x["piece"] == 0 and (len(ids) - x["length"]) % 2048 == 0)["length"] if len(ids) > 2048 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((r["doc_id"], n, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert pieces == want
    at = collections.defaultdict(list)
    for r in packed:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0 and sum(n for _, n in parts) <= 2048
    assert len(at) <= 1.02 * -(-sum(r["length"] for r in packed) // 2048) + 1


def test_the_toxicity_stage_drops_what_the_model_finds(spark, stages):
    docs = stages[0][1]
    scores = severity.score(docs, severity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r["doc_id"] for r in stages[1][1].collect()} == {r["doc_id"] for r in scores.where("p_toxic < 0.5").collect()}
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").join(docs, "doc_id", "left_semi")
    assert clean.join(stages[1][1], "doc_id", "left_semi").count() >= 0.95 * clean.count()


def test_stages_take_odd_rows_and_empty_tables(spark, stages):
    """Null ids, texts and sources, empty texts, repeated rows and clashing columns pass every stage; empty tables stay empty."""
    some = stages[0][1].limit(12)
    null = F.lit(None)
    docs = some.unionByName(some).unionByName(some.withColumns({"doc_id": null.cast("bigint")})).unionByName(some.withColumns({"text": null.cast("string"), "doc_id": F.col("doc_id") + 10**6}))
    docs = docs.unionByName(some.withColumns({"text": F.lit(""), "source": null.cast("string"), "doc_id": F.col("doc_id") + 2 * 10**6}))
    docs = materialize(docs.withColumns({c: F.lit("clash") for c in ("size", "top", "digest", "length", "n_lines", "kept", "__id", "row", "piece")}), "odd")
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, SF), stage(spark, docs.where("false"), SF)
        assert none.count() == 0
        if name != "packing":
            assert out.columns == docs.columns == none.columns
        if name in ("line_dedup", "mixing"):
            assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "line_dedup":
            assert out.count() == docs.count()
        if name == "packing":
            assert out.where("piece = 0").count() == docs.count()
        docs = materialize(out, name)


def test_near_dedup_drops_copies_from_an_index_of_0_8(stages):
    table = {n: df for n, df in stages}
    rows = [(r["doc_id"], r["text"]) for r in table["line_dedup"].collect()]
    want, higher = brute.near(rows, percent=80), brute.near(rows)
    assert want != higher
    assert {r["doc_id"] for r in table["near_dedup"].collect()} == {i for i, (_, c) in want.items() if i == c}


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1][1])
