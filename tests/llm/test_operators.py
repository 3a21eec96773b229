"""Each operator against brute force on a small table with the awkward cases, and on an empty one."""

import collections
import hashlib
import re
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from innerscan.llm import bm25, chat, fingerprints, line_dedup, mixing, near_dedup, packing, pii, substring_dedup, toxicity

LONG_LINE = "This license line is repeated in very many documents of the table"
P = " ".join(f"w{i}" for i in range(60))
CLASH = ["bucket", "key", "size", "n", "cid", "digest", "base", "row", "length", "wrap", "h1", "top", "term", "shard", "block", "score", "rank", "target", "n_lines", "piece", "spans", "th", "__id", "__b"]

TEXTS = [
    P,
    P,
    P + " end",
    "x " + P.replace("w30", "v30"),
    None,
    "",
    "   \n\t ",
    "one",
    "one two three",
    "a\n" + LONG_LINE + "\nb",
    LONG_LINE.upper() + "\nc\n\n",
    "  " + LONG_LINE + " \nd",
    LONG_LINE,
    "e\n" + LONG_LINE + "\n" + LONG_LINE,
    "mail a.b+c@d-e.co.uk and x@y.z_q@r.st, ip 1.2.3.4.5.6.7.8 or 300.1.1.1 or 010.0.0.255",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, tel +1 (988) 555-2485 and +12 34 +1 ((((",
    "ÉÀ ünï 😀 cödé \x0b x\x0cy  z " * 9,
    "😀" * 130 + P,
    "ab" * 200,
    "aaaa" * 60,
    " ".join(f"t{i % 97} u{i % 89}" for i in range(30_000)),
]


def rows_of(extra=0):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    return rows + [(100 + i, t) for i, t in enumerate(TEXTS[:4] * extra)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in rows_of(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def odd(docs):
    """Repeated rows and null ids."""
    return docs.unionByName(docs).unionByName(docs.limit(4).withColumn("doc_id", F.lit(None).cast("bigint")))


def test_mixing(docs, empty, odd):
    out = mixing.mix(docs).collect()
    sizes = {i: len(brute.WORD.findall(t or "")) for i, t in rows_of(2)}
    assert {r["doc_id"]: r["size"] for r in out} == sizes
    by = collections.defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    total = sum(sizes.values())
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    level, cap = 0, {s: 3 * sum(r["size"] for r in by[s]) for s in order}
    for _ in order:
        full = [s for s in order if weight[s] * level > cap[s]]
        level = (total - sum(cap[s] for s in full)) / sum(weight[s] for s in order if s not in full)
    for s in order:
        target = min(cap[s], weight[s] * level)
        assert by[s][0]["target"] == pytest.approx(target)
        assert sum(r["taken"] for r in by[s]) == round(target)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in by[s])
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, out))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("w"))
    assert {r["doc_id"]: r["w"] for r in words.collect() if r["w"]} == {r["doc_id"]: r["taken"] for r in out if r["taken"]}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mix(odd).count() == odd.count()


def test_line_dedup(docs, empty, odd):
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    keys = collections.defaultdict(set)
    key = lambda x: brute.lower(x.strip(" \t\n\x0b\f\r"))
    for i, t in rows_of(2):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                keys[key(x)].add(i)
    for i, t in rows_of(2):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(keys[key(x)]) >= 5 and max(keys[key(x)]) != i)]
        assert (out[i]["n_lines"], out[i]["n_dropped"], out[i]["text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert sum(r["n_dropped"] for r in out.values()) > 5
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(odd).count() == odd.count()


def test_runs_merge_by_levels(spark):
    index = line_dedup.LineRuns(spark, 4)
    for b in range(5):
        index.add(spark.createDataFrame([(h, h, 100 - 10 * b) for h in range(b, b + 6)], "h1 bigint, h2 bigint, top bigint"), known=3)
    assert [len(x) for x in index.levels] == [1, 0, 1]
    got = {r["h1"]: (r["n"], r["top"]) for r in index.compact().collect()}
    assert got[0] == (1, 100) and got[9] == (1, 60) and got[4][0] >= 3 and got[4][1] == 100


def test_near_duplicates(docs, empty, odd):
    want = brute.near(rows_of(2))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert got[4]["component_id"] == 4 and got[5]["component_id"] == 5
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(odd).count() == odd.count()
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_MEMBERS", 7)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(words)
        for j in range(i % 9):
            w[(i * 17 + j * 31) % 200] = f"e{i}.{j}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near(rows)


def test_sketch_is_full_and_estimates(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    for n in (1, 2, 50, 300):
        s = near_dedup.sketch(np.unique(pool[:n]), 180)
        assert (s != np.iinfo(np.uint64).max).all()
    a, b = near_dedup.sketch(np.unique(pool[:300]), 180), near_dedup.sketch(np.unique(pool[100:]), 180)
    assert abs((a == b).mean() - 0.5) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def test_pii(docs, empty, odd):
    out = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for i, t in rows_of(2):
        counts, spans = brute.spans(t)
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in out[i]["base"]) == spans
        assert {s["start"] for s in out[i]["base"]} <= {s["start"] for s in out[i]["spans"]}
    assert pii.find_pii(empty).count() == 0
    assert pii.find_pii(odd).count() == odd.count()


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"please contact: user{i}@mail.example.com today") for i in range(12)]
    rows += [(50, "please contact: user77(at)mail today"), (51, "room number: 12a today"), (52, "see page 7@home now")]
    out = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(s["kind"], s["value"]) for s in out[50]["spans"]] == [("email", "user77(at)mail")]
    assert not out[50]["base"] and not out[51]["spans"] and not out[52]["spans"]
    assert rows[12][1][out[50]["spans"][0]["start"] : out[50]["spans"][0]["end"]] == "user77(at)mail"


def test_right_contexts_and_number_slots_find_identifiers_too(spark):
    rows = [(i, f"w{chr(97 + i)}x q{chr(97 + i)}y user{i}@mail.example.com wrote on Monday") for i in range(12)]
    rows += [(20 + i, f"ticket {i} from: user{i}@post.example.com x{i}") for i in range(12)]
    rows += [(50, "zz yy user77(at)mail wrote on Monday"), (51, "ticket 4711 from: user99(at)mail"), (52, "room 12a has walls"), (53, "on 5th of may")]
    out = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [[s["value"] for s in out[i]] for i in range(50, 54)] == [["user77(at)mail"], ["user99(at)mail"], [], []]


def test_planted_identifiers_are_found_and_others_left(spark):
    """Recall and precision on a corpus with planted identifiers of unseen forms in contexts to the left, to the right and around."""
    import random

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    frames = ["please mail to {} {}", "{} {} replied to us", "account holder: {} {}", "sender {} signed {}"]
    rows, planted, others = [], {}, {}
    for i in range(800):
        frame, noise = rnd.choice(frames), [word() for _ in range(12)]
        if i % 4:
            value = f"{word()}{i}@{word()}.example.org"
        else:
            value = planted[i] = f"{word()}{i}[at]{word()}"
        others[i] = f"{word()}{rnd.randint(1, 999)}"
        said = frame.format(*((value, word()) if frame[0] != "{" else (value, ""))).replace("  ", " ")
        rows.append((i, " ".join([*noise[:6], said, *noise[6:9], others[i], *noise[9:]])))
    out = {r["doc_id"]: {s["value"] for s in r["spans"]} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found, wrong = sum(v in out[i] for i, v in planted.items()), sum(others[i] in out[i] for i in others)
    assert found >= 0.9 * len(planted) and wrong <= 0.01 * len(others)


def test_found_identifiers_are_marked_wherever_they_occur(spark):
    new, other = "user77(at)mail", "user88(at)mail"
    rows = [(i, f"please contact: user{i}@mail.example.com today") for i in range(12)]
    rows += [(20 + i, f"room 7 mail user{i}@mail.example.com") for i in range(12)]
    rows += [(50, f"please contact: {new}"), (51, f"{new} opens"), (52, f"Call {new}"), (53, f"é a1 {new} or {new}, x@y.org {new}"), (54, f"room 7 mail {other}"), (55, f"{other}")]
    out = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    marked = {i: [s["start"] for s in out[i] if s["value"] in (new, other)] for i in range(50, 56)}
    assert marked == {i: [m.start() for m in re.finditer(r"user[78]{2}\(at\)mail", texts[i])] for i in range(50, 56)}


def test_found_identifiers_induce_patterns_that_find_others(spark):
    """Six values that no base pattern knows are found beside seeds; a pattern that only they share finds a seventh."""
    new = [f"user9{i}(at)mail" for i in range(6)]
    rows = [(i, f"please contact: user{i}@mail.example.com today") for i in range(60)]
    rows += [(100 + i, f"please contact: {v} today") for i, v in enumerate(new)]
    rows += [(200 + i, f"now forward to: {v} soon") for i, v in enumerate([*new, "another7(at)post"])]
    rows += [(300 + i, f"at room number {i}b") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert [(s["kind"], s["value"]) for s in out[206]] == [("email", "another7(at)post")]
    assert all(len(out[i]) == 1 for i in [*range(60), *range(100, 106), *range(200, 207)]) and not any(out[i] for i in range(300, 320))
    assert not {r["doc_id"]: r["spans"] for r in pii.find_pii(df, rounds=1).collect()}[206]


def test_long_words_and_many_numbers(spark):
    """A context is whole words, however long; very many matches are found in seconds."""
    import time

    word = "w" * 500
    rows = [(i, f"{word} sent{i} x{i}9") for i in range(3)] + [(10, " ".join(f"{i % 250}.{i // 250 % 250}.0.1" for i in range(60_000)))]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    got = pii.with_candidates(df.withColumnRenamed("text", "__text").where("doc_id < 3")).collect()
    assert [[c["pattern"] for c in r["candidates"]][-1] for r in got] == [f"{word} sent{i}" for i in range(3)]
    start = time.time()
    r = pii.find_pii(df.where("doc_id = 10"), rounds=1).first()
    assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]) == brute.spans(rows[3][1])[1] and len(r["base"]) == 60_000
    assert time.time() - start < 60


def test_substring_dedup(docs, empty, odd):
    want = brute.repeats([r for r in rows_of(2) if len(r[1] or "") < 10_000])
    small = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(small).collect()}
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 1000
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert substring_dedup.dedup_substrings(odd).count() == odd.count()


@pytest.mark.parametrize("contexts", [1, 4])
def test_collections_that_are_cut_lose_no_string(spark, monkeypatch, contexts):
    import random

    monkeypatch.setattr(substring_dedup, "INDEX_CONTEXTS", contexts)
    rnd = random.Random(1)
    parts = ["".join(rnd.choice("abcd \0") for _ in range(n)) for n in (26, 40, 60, 90)]
    rows = [(i, "".join(rnd.choice(parts) if rnd.random() < 0.7 else "".join(rnd.choice("abcd") for _ in range(9)) for _ in range(8))) for i in range(60)]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for i, r in got.items()} == brute.repeats(rows)


def test_run_length_index():
    texts = [b"abcabcabc" * 12, b"xyz" + b"abcabcabc" * 9, b"q" * 80, b"q" * 70 + b"\xff\0"]
    index = substring_dedup.RunLengthIndex(texts)
    assert len(index.starts) < index.rows / 4
    at = index.end_rows
    for _ in range(60):
        at = index.lf(at)
    assert len(set(at.tolist())) == len(texts)
    import numpy as np

    masks = substring_dedup.earlier_windows(texts, np.array([1, 2, 3, 4]))
    for i, t in enumerate(texts):
        for o in range(len(t) - 49):
            assert bool(int(masks[i]) >> o & 1) == any(t[o : o + 50] in s for s in texts[:i]) or o > 60


def test_fingerprints(docs, empty, odd):
    pairs = fingerprints.edited_pairs(docs)
    got = {r["doc_id"]: r for r in pairs.where("wrap = 0").collect()}
    want = brute.edited(rows_of(2))
    assert {i: r["edited"] for i, r in got.items()} == want
    sk = fingerprints.with_sketch(docs.select("doc_id", "text"), "text", "fp")
    by = {r["doc_id"]: r["fp"] for r in sk.collect()}
    assert by[0] == by[1] == by[100] and by[4] == by[5] == by[6] == []
    sets = {i: brute.shingles(t) for i, t in rows_of(2)}
    small = [i for i in (0, 2, 3, 7, 8, 9, 14) if len(sets[i]) <= fingerprints.K]
    a, b = sk.select(F.col("doc_id").alias("i"), F.col("fp").alias("a")), sk.select(F.col("doc_id").alias("j"), F.col("fp").alias("b"))
    met = a.join(b, F.col("i").isin(small) & F.col("j").isin(small))
    one, two = F.col("a"), F.col("b")
    for r in met.select("i", "j", fingerprints.resemblance(one, two).alias("r"), fingerprints.containment(one, two).alias("c"), fingerprints.distinct_shingles(one).alias("n")).collect():
        x, y = sets[r["i"]], sets[r["j"]]
        assert r["n"] == len(x)
        assert r["r"] == pytest.approx(len(x & y) / len(x | y))
        assert r["c"] == pytest.approx(len(x & y) / len(x), abs=0.02)
    back = sk.select(fingerprints.decode(fingerprints.encode(F.col("fp"))).alias("d"), "fp").collect()
    assert all(list(r["d"]) == list(r["fp"]) for r in back)
    assert fingerprints.edited_pairs(empty).count() == 0
    assert fingerprints.edited_pairs(odd).where("wrap = 0").count() == odd.count()


def test_merged_sketch_is_the_sketch_of_both(spark):
    texts = [" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(296, 700))]
    df = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, " ".join(f"w{i}" for i in range(700)))], "doc_id bigint, text string")
    fp = {r["doc_id"]: r["fp"] for r in fingerprints.with_sketch(df, "text", "fp").collect()}
    one = spark.createDataFrame([(fp[0], fp[1], fp[2])], "a array<bigint>, b array<bigint>, c array<bigint>")
    assert one.select(fingerprints.resemblance(fingerprints.merge_sketches(F.col("a"), F.col("b")), F.col("c")).alias("r")).first()["r"] > 0.95


def test_packing(docs, empty, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack(docs).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for i, t in rows_of(2):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        at = 0
        for n, r in enumerate(parts):
            assert r["start"] == at and (n == 0 or r["length"] == 2048)
            at += r["length"]
            data = b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : at])
            assert r["ids_crc32"] == zlib.crc32(data)
        assert at == len(ids) and (len(ids) > 2048 or len(parts) == 1)
    check_sequences(out)
    assert packing.pack(empty).count() == 0
    again = packing.pack(odd).collect()
    assert len(again) >= odd.count()
    check_sequences(again)


def check_sequences(rows, capacity=2048):
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seq)


def test_special_and_strange_texts_have_the_tokenizer_s_ids():
    import numpy as np

    enc = packing.Encoder(packing.default_vocabulary())
    for t in ["<|endoftext|> a", "  two  spaces ", "\n\n x\t\ty ", "it's we'll 12345 ½   é́", "a" * 5000, " " * 3000 + "b", "\0\x85"]:
        assert np.frombuffer(enc(t), "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_near_the_bound(seed):
    import random

    rnd = random.Random(seed)
    counts = collections.Counter(min(2048, max(1, int(rnd.lognormvariate(6 + seed / 4, 1)))) for _ in range(20_000))
    slots = packing.plan_slots(counts)
    used = collections.defaultdict(int)
    seq = collections.defaultdict(list)
    for length, first, n, sequence, offset in slots:
        assert first == used[length]
        used[length] += n
        for i in range(n):
            seq[sequence + i].append((offset, length))
    assert used == counts
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seq) <= 1.01 * sum(k * v for k, v in counts.items()) / 2048 + 1


def test_configurations_meet_a_known_optimum():
    got = packing.best_configurations([6, 4, 3], [10, 10, 10], 10)
    assert sum(v for _, v in got) == pytest.approx(10 + 10 / 3)


def test_toxicity(spark):
    import random

    rnd = random.Random(5)
    common = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(common) for _ in range(80)]
        bad = i % 4 == 0
        for _ in range(rnd.randint(1, 6) if bad else 0):
            w[rnd.randrange(80)] = rnd.choice(["nasty", "awful"]) + rnd.choice(["", "ness", "ly", "est"])
        rows.append((i, " ".join(w)))
        if i < 600:
            labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (2002, "Nasty AWFUL nastyish"), (None, "nasty awful awful")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("grade", F.lit("clash"))
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600, 900)]
    right = sum((got[i]["p_toxic"] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert got[2000]["p_toxic"] < 0.5 and got[2001]["p_toxic"] < 0.5 and got[2002]["p_toxic"] > 0.5
    assert all(0 <= r["severity"] <= 2 for r in got.values()) and list(model.thetas) == sorted(model.thetas)
    more = toxicity.score(spark.createDataFrame([(1, "nasty"), (2, "nasty nasty nasty awful awful awful awful")], "doc_id bigint, text string"), model)
    s = {r["doc_id"]: r["severity"] for r in more.collect()}
    assert s[2] > s[1]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (2000, 2001)").count() == 2
    assert toxicity.score(docs.where("false"), model).count() == 0
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.drop_toxic(docs, none).count() == docs.count()


def plain_ordinal(rows, grades, n_features, levels, rounds, rate=0.1, l2=1e-4):
    """Adam on the mean log loss of the threshold questions, toxic and clean rows of one weight in all: one row, question and feature at a time."""
    import math

    share = sum(g > 0 for g in grades) / len(rows)
    p = [0.0] * n_features + [1.0] + [0.0] * (levels - 2)
    m, v = [0.0] * len(p), [0.0] * len(p)
    for step in range(1, rounds + 1):
        thetas = [p[n_features] + sum(math.exp(g) for g in p[n_features + 1 : n_features + 1 + k]) for k in range(levels - 1)]
        g = [l2 * x for x in p[:n_features]] + [0.0] * (levels - 1)
        for row, grade in zip(rows, grades):
            s = sum(p[i] * math.log1p(n) for i, n in row.items())
            for k, theta in enumerate(thetas):
                e = (1 / (1 + math.exp(theta - s)) - (grade > k)) * 0.5 / (share if grade > 0 else 1 - share) / len(rows) / (levels - 1)
                for i, n in row.items():
                    g[i] += e * math.log1p(n)
                g[n_features] -= e
                for j in range(k):
                    g[n_features + 1 + j] -= e * math.exp(p[n_features + 1 + j])
        for i, x in enumerate(g):
            m[i], v[i] = 0.9 * m[i] + 0.1 * x, 0.999 * v[i] + 0.001 * x * x
            p[i] -= rate * (m[i] / (1 - 0.9**step)) / (math.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return p[:n_features], [p[n_features] + sum(math.exp(g) for g in p[n_features + 1 : n_features + 1 + k]) for k in range(levels - 1)]


@pytest.mark.parametrize("levels", [2, 3, 4])
def test_ordinal_fit_by_brute_force(levels):
    import random

    rnd = random.Random(levels)
    rows = [{i: rnd.randint(1, 4) for i in rnd.sample(range(6), rnd.randint(0, 4))} for _ in range(60)]
    grades = [rnd.randrange(levels) for _ in rows]
    w, thetas = toxicity.fit_ordinal(rows, __import__("numpy").array(grades), 6, levels, rounds=25)
    want_w, want_thetas = plain_ordinal(rows, grades, 6, levels, 25)
    assert w.tolist() == pytest.approx(want_w, rel=1e-6, abs=1e-8) and thetas.tolist() == pytest.approx(want_thetas, rel=1e-6)


def test_toxicity_scores_and_features_by_brute_force(spark):
    """The model's features from plain counts of the labelled texts, and every score from its weights and thresholds."""
    import math

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {}
    for r in labels.collect():
        if texts.get(r["doc_id"]) is not None:
            known[texts[r["doc_id"]]] = max(known.get(texts[r["doc_id"]], 0), r["toxic"])
    sides = collections.defaultdict(lambda: [0, 0])
    for t, bad in known.items():
        for f in {f for w in t.lower().split() for f in toxicity.features(w)}:
            sides[f][bad] += 1
    n = [sum(b == side for b in known.values()) for side in (0, 1)]
    odds = lambda g, b: math.log((b + 0.5) / (n[1] + 1)) - math.log((g + 0.5) / (n[0] + 1))
    want = {f for f, (g, b) in sides.items() if odds(g, b) > max(toxicity.MIN_ODDS, toxicity.MIN_Z * math.sqrt(1 / (b + 0.5) + 1 / (g + 0.5)))}
    assert set(model.index) == want
    for r in toxicity.score(docs, model).collect():
        count = collections.Counter(f for w in (texts[r["doc_id"]] or "").lower().split() for f in toxicity.features(w) if f in model.index)
        s = sum(model.weights[model.index[f]] * math.log1p(c) for f, c in count.items())
        above = [1 / (1 + math.exp(theta - s)) for theta in model.thetas]
        each = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert r["evidence"] == sum(count.values()) and r["p_toxic"] == pytest.approx(above[0]) and r["severity"] == pytest.approx(sum(above))
        assert each[r["grade"]] == pytest.approx(max(each))


def test_toxicity_on_held_out_rows(spark):
    """Fitted on half of the labelled rows of the larger table; the others tell its accuracy."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rows = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    flagged = {t: [r["p_toxic"] >= 0.5 for r in rows if r["toxic"] == t] for t in (0, 1)}
    assert sum(flagged[1]) >= 0.88 * len(flagged[1]) and sum(flagged[0]) <= 0.025 * len(flagged[0])
    mean = lambda t: sum(r["severity"] for r in rows if r["toxic"] == t) / len(flagged[t])
    assert mean(1) > 3 * mean(0)


def test_chat(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt has many items."),
        (1, 1, "assistant", "> How do I sort a list?\n> It has many items.\nUse sort()."),
        (1, 2, "user", "> > how do i  sort a list?\n> > It has many items.\n> Use sort().\nThanks"),
        (1, 3, "user", "And in place?"),
        (1, 4, "assistant", "> Use sort().\nThat is in place."),
        (2, 0, "user", "> Use sort().\nCopied from elsewhere"),
        (2, 1, "user", "> never written by anyone\nHm"),
        (3, 0, None, None),
        (3, 1, "user", ""),
        (3, 1, "user", ""),
        (None, None, "user", "lost"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("h", F.lit("clash")).withColumn("depth", F.lit("clash"))
    out = chat.link(df).collect()
    assert len(out) == len(rows)
    got = {(r["conv_id"], r["turn"]): r for r in out}
    assert got[1, 1]["body"] == "Use sort()." and (got[1, 1]["quoted_conv"], got[1, 1]["quoted_turn"]) == (1, 0)
    assert (got[1, 2]["n_quotes"], got[1, 2]["n_linked"], got[1, 2]["parent_turn"], got[1, 2]["depth"]) == (2, 2, 1, 2)
    assert got[1, 3]["parent_turn"] == 2 and got[1, 4]["parent_turn"] == 1 and got[1, 4]["depth"] == 2
    assert (got[2, 0]["parent_conv"], got[2, 0]["thread_conv"], got[2, 0]["depth"]) == (1, 1, 2)
    assert (got[2, 1]["n_quotes"], got[2, 1]["n_linked"], got[2, 1]["parent_turn"]) == (1, 0, 0)
    assert ">" not in "".join(r["body"] for r in out)
    thread = sorted((r for r in out if r["thread_conv"] == 1), key=lambda r: r["position"])
    assert [r["position"] for r in thread] == list(range(len(thread)))
    assert chat.link(df.where("false")).count() == 0


def test_quotes_of_paragraphs_and_lines_are_linked(spark):
    rows = [
        (1, 0, "user", "First paragraph here.\nIts second line.\n\nAnother paragraph.\r\n\r\nThe last one."),
        (1, 1, "user", "Something else"),
        (1, 2, "assistant", "> Another paragraph.\nYes."),
        (1, 3, "user", "unrelated"),
        (1, 4, "assistant", "> First paragraph here.\n> Its second line.\n\n> Another paragraph.\nNo.\n> The last one.\nMaybe."),
        (1, 5, "assistant", "> Its second line.\nWhy?"),
        (1, 6, "assistant", "> Another paragraph.\n>\n> The last one.\nOh."),
        (1, 7, "assistant", "> Its second line.\n> [...]\nHm."),
    ]
    out = {r["turn"]: r for r in chat.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert {t: (out[t]["n_quotes"], out[t]["n_linked"], out[t]["parent_turn"]) for t in (2, 4, 5, 6, 7)} == {2: (1, 1, 0), 4: (3, 3, 0), 5: (1, 1, 0), 6: (1, 1, 0), 7: (1, 1, 0)}


def test_long_conversations_and_threads_are_ranked_across_ranges(spark):
    df = spark.range(300).select(F.lit(1).alias("conv_id"), (F.col("id") * 3).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("m"), "id").alias("text"))
    out = sorted(chat.link(df).collect(), key=lambda r: r["turn"])
    assert [r["position"] for r in out] == list(range(300)) == [r["depth"] for r in out]
    rows = [(0, 0, "user", "welcome to all")]
    rows += [(c, t, "user", "> welcome to all\nhi" if t == 0 else f"thanks {c % 3}") for c in range(1, 200) for t in range(3)]
    out = chat.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {r["thread_conv"] for r in out} == {0} and sorted(r["position"] for r in out) == list(range(len(rows)))
    assert [r["turn"] for r in sorted(out, key=lambda r: r["position"])] == sorted(r[1] for r in rows)


def test_chat_by_brute_force(spark):
    """Random conversations with whole, partial, nested and foreign quotes, repeated rows, nulls and a very long quote."""
    import random

    rnd = random.Random(8)
    said, rows = [], []
    for c in range(25):
        for t in range(rnd.randint(1, 9)):
            own = "\n\n".join("\n".join(f"line {rnd.randrange(60)} Of  text" for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 2)))
            text = own
            if said and rnd.random() < 0.7:
                q = rnd.choice(said[-6:] if rnd.random() < 0.6 else said)
                parts = rnd.choice([[q], q.split("\n\n"), q.split("\n")[:1]])
                mark = rnd.choice(["> ", ">", "> > "])
                text = "\n".join("\n".join(mark + x.upper() for x in p.split("\n")) + f"\nre {rnd.randrange(9)}" for p in parts) + "\n" + own
            said.append(own)
            rows.append((c, t, rnd.choice(["user", "assistant", None]), text))
    rows += [rows[3], rows[3], (None, None, "user", "lost"), (None, 2, "user", "> lost\nfound"), (99, None, "user", None), (99, 0, "user", ""), (99, 5, "user", "\n".join(f"> {i}\n{i}" for i in range(20_000)))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("clash") for c in ("c", "t", "h", "lines", "position", "root", "first", "begins")})
    got = collections.Counter((r["conv_id"], r["turn"], r["role"], r["body"], r["n_quotes"], r["n_linked"], r["quoted_conv"], r["quoted_turn"], r["parent_conv"], r["parent_turn"], r["thread_conv"], r["thread_turn"], r["depth"]) for r in chat.link(df).collect())
    assert got == collections.Counter(brute.linked(rows))


def test_bm25(docs, empty, odd, spark):
    import math

    rows = [(i, t) for i, t in rows_of(2)]
    count = {i: bm25.terms(t) for i, t in rows}
    n, average = len(rows), sum(sum(c.values()) for c in count.values()) / len(rows)
    df = collections.Counter(w for c in count.values() for w in c)
    want = {}
    for q in (i for i, _ in rows if i % 4 == 0):
        scores = []
        for i, c in count.items():
            s = 0
            for w in count[q]:
                if w in c:
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average))
            if s:
                scores.append((-round(s, 6), i))
        for rank, (s, i) in enumerate(sorted(scores)[:5], 1):
            want[q, rank] = (i, -s)
    for size in (bm25.SHARD_DOCS, 5):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(bm25, "SHARD_DOCS", size)
            m.setattr(bm25, "QUERY_TERMS", 600 if size == 5 else bm25.QUERY_TERMS)
            m.setattr(bm25, "BLOCK", 3)
            got = bm25.search(docs, docs.where("doc_id % 4 = 0"), 5).collect()
        assert {(r["query_id"], r["rank"]): (r["doc_id"], pytest.approx(r["score"], abs=2e-6)) for r in got} == want
    assert bm25.search(empty, empty).count() == 0 and bm25.search(empty, docs).count() == 0 and bm25.search(docs, empty).count() == 0
    # repeated rows are results each; null ids come last among ties and ask nothing
    got = collections.defaultdict(list)
    for r in bm25.search(odd, odd.where("doc_id is null or doc_id in (0, 4, 8)"), 9).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    assert set(got) == {0, 8}
    assert [d for d, s in got[0] if s == got[0][0][1]][:8] == [0, 0, 1, 1, 100, 100, 101, 101]
    assert [d for d, _ in got[8]][:2] == [8, 8]
    tied = spark.createDataFrame([(None, "same words"), (7, "same words"), (3, "same words"), (3, "same words")], "doc_id bigint, text string")
    got = bm25.search(tied, tied, 4).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(q, d) for q in (3, 7) for d in (3, 3, 7, None)]


def test_pruning_skips_blocks_and_loses_nothing():
    import numpy as np

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    share = 1 / np.arange(1, 3001)
    # of two languages
    texts = [" ".join("xy"[i % 2] + w for w in rng.choice(words, rng.integers(20, 200), p=share / share.sum())) for i in range(1500)]
    known = bm25.TermCodes()
    codes, counts = zip(*map(known.count, texts))
    average = sum(c.sum() for c in counts) / len(texts)
    shard = bm25.Shard(bm25.shard_row(list(range(1500)), list(codes), list(counts)), average)
    idf = np.log1p((1500 - shard.df + 0.5) / (shard.df + 0.5))
    asked, floors, want = [], [], []
    for q in range(0, 1500, 50):
        t = np.searchsorted(shard.terms, codes[q])
        every = shard.scores(np.arange(1500), t, idf[t])
        asked.append((t, idf[t]))
        floors.append(np.sort(every)[-5])
        want.append(every)
    got = {i: (d.tolist(), s) for i, d, s in shard.search(asked, np.array(floors), 5)}
    for i, every in enumerate(want):
        assert set(np.flatnonzero(every >= floors[i]).tolist()) <= set(got[i][0])
        assert np.array_equal(got[i][1], every[got[i][0]])
    assert shard.entered < 0.6 * shard.blocks


def test_a_task_returns_no_ties_that_an_earlier_wave_has_beaten():
    import numpy as np
    import pyarrow as pa

    known = bm25.TermCodes()
    texts = ["same words", "same words", "other words", "same words and more of them"]
    codes, counts = zip(*map(known.count, texts))
    ids = [11, 12, 13, None]
    row = bm25.shard_row(ids, list(codes), list(counts))
    schema = pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in bm25.INDEX.split(", ")])
    batch = pa.RecordBatch.from_pylist([row], schema)
    asked = bm25.Asked(pa.table({"query_id": [11], "term": [codes[0].view(np.int64).tolist()], "idf": [[1.0] * len(codes[0])]}))

    class Sent:
        value = asked

    run = lambda: [tuple(r.values()) for b in bm25.answering(Sent, 2, 3.0)([batch]) for r in b.to_pylist()]
    first = run()
    assert [d for _, d, _ in first] == [11, 12]
    best = round(first[1][2], bm25.DECIMALS)
    for last, want in ((5, []), (11, [11]), (12, [11, 12]), (bm25.LATER, [11, 12])):
        asked.floors, asked.last = np.array([best]), np.array([last])
        assert [d for _, d, _ in run()] == want


def test_rows_know_their_runs_and_contexts_are_kept_once(spark, monkeypatch):
    import numpy as np

    index = substring_dedup.RunLengthIndex([b"abcabcabc", b"abcab", b"", b"xabcabcx"])
    rows = np.arange(index.rows)
    assert index.run.tolist() == (np.searchsorted(index.starts, rows, "right") - 1).tolist()
    assert np.diff(np.sort(index.lf(rows))).tolist() == [1] * (index.rows - 1)
    # a passage that 40 documents hold has one row of its bytes for each task, however few contexts a task keeps
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 120, np.uint8)).decode()
    rows = [(i, i, passage, []) for i in range(40)]
    base = spark.createDataFrame(rows, "doc_id bigint, th bigint, text string, later array<int>").coalesce(1)
    everything = np.full((1 << 20) // 8, 255, np.uint8).tobytes()
    monkeypatch.setattr(substring_dedup, "KNOWN_CONTEXTS", 60)
    got = substring_dedup.occurrences(base, spark.sparkContext.broadcast((everything, everything)), 20).toPandas()
    kept, met = got[got["context"].notna()], got[got["context"].isna()]
    assert len(met) == 40 * len(kept) and not kept.duplicated(["key", "h"]).any()
    assert set(kept["doc_id"]) == {0} and set(kept["th"]) == {39} and (kept["context"].map(len) == kept["n"]).all()
    assert all(passage.encode()[a : a + n] in set(kept["context"]) for a, n in zip(met["at"], met["n"]))
