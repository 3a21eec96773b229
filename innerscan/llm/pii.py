"""Personal data: base patterns with exact spans, and bootstrapped contextual extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, few, materialize, table

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with possessive repeats and a look-behind so that long
# runs are read once: a match can only begin where its run begins or where
# the match before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match holds at least; cheaper to look for.
NEEDED = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A token that may be an identifier: it holds a digit or @; phone and card numbers with their blanks are one.
CANDIDATE = (
    r"(?<![^\x20\x09-\x0D])(?:\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9])"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
#: Two words after a candidate.
AFTER = r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)"
LEFT_JUNK, RIGHT_JUNK = "([{<\"'`*_", ")]}>\"'`*_.,;:!?"
ROUNDS, MIN_SUPPORT, MIN_PATTERN, MIN_INSTANCE = 4, 3.0, 0.6, 0.6


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def luhn(s: Column) -> Column:
    n = F.length(s)

    def add(a, i):
        d = F.substr(s, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return a + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & F.when(F.length(digits(value)).between(12, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def with_starts(df: DataFrame, matches: str, gaps: str, out: str) -> DataFrame:
    """Add ``out``: where each match starts, in code points from 0.

    ``gaps`` are the texts between the matches.  The lengths before a match
    are summed in two levels of about sqrt(n), so a text of very many matches
    doesn't copy an array for each.
    """
    df = df.withColumn("__len", F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), (F.length(g) + F.length(m)).alias("n"))))
    df = df.withColumn("__step", F.ceil(F.sqrt(F.size("__len"))).cast("int"))
    df = df.withColumn("__cut", F.when(F.size("__len") > 0, F.transform(F.sequence(F.lit(1), F.size("__len"), F.col("__step")), lambda i: F.slice("__len", i, F.col("__step")))))
    state = lambda at, got: F.struct(at.alias("at"), got.alias("out"))
    begin = state(F.lit(0), F.array().cast("array<int>"))
    sums = F.transform("__cut", lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["n"]))
    before = F.aggregate(sums, begin, lambda a, n: state(a["at"] + n, F.concat(a["out"], F.array(a["at"]))), lambda a: a["out"])
    inside = lambda c, at: F.transform(
        F.aggregate(c, begin, lambda a, x: state(a["at"] + x["n"], F.concat(a["out"], F.array(a["at"] + x["g"]))), lambda a: a["out"]), lambda s: s + at
    )
    starts = F.flatten(F.zip_with("__cut", before, inside))
    return df.withColumn(out, F.coalesce(F.when(F.size("__len") > 0, starts), F.array().cast("array<int>"))).drop("__len", "__step", "__cut")


def span_struct(start: Column, value: Column, kind: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("k"), (start + F.length(value)).cast("int").alias("end"), F.lit(kind).alias("kind"), value.alias("value")
    )


SPANS = "array<struct<start:int,k:int,end:int,kind:string,value:string>>"


def gaps(text: str, matches: str, regex: str) -> Column:
    """The texts between the matches; a text without any is not searched again."""
    return F.when(F.size(matches) > 0, F.split(text, regex, -1)).otherwise(F.array(text))


def with_base(docs: DataFrame, text: str = "__text") -> DataFrame:
    """Add ``base``: the valid spans of the base patterns by start, then kind."""
    for k, p in PATTERNS.items():
        docs = docs.withColumn("__m", F.when(F.rlike(text, F.lit(NEEDED[k])), F.regexp_extract_all(text, F.lit(p), 0)).otherwise(F.array().cast("array<string>")))
        docs = with_starts(docs.withColumn("__g", gaps(text, "__m", p)), "__m", "__g", "__s")
        spans = F.filter(F.zip_with("__s", "__m", lambda s, v: span_struct(s, v, k)), lambda x: valid(k, x["value"]))
        docs = docs.withColumn(f"__{k}", F.when(F.size("__m") > 0, spans).otherwise(F.array()).cast(SPANS)).drop("__m", "__g", "__s")
    return docs.withColumn("base", F.sort_array(F.concat(*[f"__{k}" for k in KINDS]))).drop(*[f"__{k}" for k in KINDS])


def context(before: Column) -> Column:
    """The two words before, or the one before if it ends with a mark that announces a value; else null."""
    last = lambda t: F.substring_index(t, " ", -1)
    short = lambda t: F.rtrim(F.left(t, F.length(t) - F.length(last(t))))
    words = F.transform(F.array(F.rtrim(F.translate(before, WS_CHARS, " " * len(WS_CHARS)))), lambda t: F.struct(last(t).alias("one"), last(short(t)).alias("two")))
    two = F.transform(words, lambda w: F.when(F.rlike(w["one"], F.lit(r"[:=#]$")), w["one"]).when((w["one"] != "") & (w["two"] != ""), F.concat_ws(" ", w["two"], w["one"])))
    return ascii_lower(two[0])


def slotted(words: Column) -> Column:
    """The words of a context, every number in them the same."""
    return F.regexp_replace(words, "[0-9]+", "0")


def following(after: Column) -> Column:
    """The two words after, else null; only these are read."""
    word = lambda t, i: F.regexp_extract(t, AFTER, i)
    two = F.transform(F.array(after), lambda t: F.when(F.rlike(t, F.lit(AFTER)), F.concat_ws(" ", word(t, 1), word(t, 2))))
    return ascii_lower(two[0])


def between(left: Column, right: Column) -> Column:
    """The last word of the left context and the first of the right one, where there are both."""
    return F.when(left.isNotNull() & right.isNotNull(), F.concat_ws(" _ ", F.substring_index(left, " ", -1), F.substring_index(right, " ", 1)))


def with_candidates(docs: DataFrame, text: str = "__text") -> DataFrame:
    """Add ``candidates`` (start, end, value, pattern, others): tokens that may be identifiers.

    ``pattern`` is the left context, null without one; ``others`` are, with
    numbers as slots, the left and the right context and the words on either
    side.
    """
    hits = docs.withColumn("__c", F.when(F.rlike(text, F.lit("[0-9@]")), F.regexp_extract_all(text, F.lit(CANDIDATE), 0)).otherwise(F.array().cast("array<string>")))
    hits = with_starts(hits.withColumn("__g", gaps(text, "__c", CANDIDATE)), "__c", "__g", "__s")
    none = F.array(F.lit(""))
    # The gap and match before, and one match more, hold two words at least; a match begins a word.
    later = lambda c, i: F.slice(F.concat(c, none, none), F.lit(1 + i), F.size(c))
    near = F.arrays_zip(
        F.concat(none, none, "__c").alias("a"), F.concat(none, "__g").alias("b"), F.concat(none, "__c").alias("c"), F.col("__g").alias("d"),
        later(F.col("__g"), 1).alias("e"), later(F.col("__c"), 1).alias("f"), later(F.col("__g"), 2).alias("g"),
    )
    sides = F.transform(F.slice(near, F.lit(1), F.size("__c")), lambda x: F.struct(context(F.concat(x["a"], x["b"], x["c"], x["d"])).alias("l"), following(F.concat(x["e"], x["f"], x["g"])).alias("r")))
    tagged = lambda tag, c: F.when(c.isNotNull(), F.concat(F.lit(tag), c))
    others = lambda x: F.array_compact(F.array(tagged("< ", slotted(x["l"])), tagged("> ", slotted(x["r"])), tagged("| ", slotted(between(x["l"], x["r"])))))
    patterns = F.transform(sides, lambda x: F.struct(x["l"].alias("l"), others(x).alias("o")))

    def build(x):
        right = F.ltrim(x["v"], F.lit(LEFT_JUNK))
        core, at = F.rtrim(right, F.lit(RIGHT_JUNK)), x["s"] + F.length(x["v"]) - F.length(right)
        return F.struct(at.cast("int").alias("start"), (at + F.length(core)).cast("int").alias("end"), core.alias("value"), x["p"]["l"].alias("pattern"), x["p"]["o"].alias("others"))

    found = F.transform(F.arrays_zip(F.col("__s").alias("s"), F.col("__c").alias("v"), patterns.alias("p")), build)
    kind = "array<struct<start:int,end:int,value:string,pattern:string,others:array<string>>>"
    found = F.when(F.size("__c") > 0, F.filter(found, lambda x: x["value"] != "")).otherwise(F.array()).cast(kind)
    return hits.withColumn("candidates", found).drop("__c", "__g", "__s")


def seed_kind(value: Column) -> Column:
    """The base kind that a whole value is of, else null."""
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(F.rlike(value, F.lit(f"^(?:{PATTERNS[k]})$")) & valid(k, value), k).otherwise(out)
    return out


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, score) of unseen identifiers that patterns of high confidence extract.

    ``edges`` are distinct (pattern, value).  Seeds are values of a base kind
    and score 1.  In each round a pattern's confidence for a kind is the
    scores of its values, seeds or found before, over their number and one;
    a value's score is that one of its patterns at least is right.  So a
    value found in one round can raise a pattern without any seed in the
    next.  Only aggregates by pattern or value are joined: a pattern that
    very many texts share costs one row on the one side, and on the other its
    distinct values, which are split where a join is skewed.
    """
    edges = materialize(edges.withColumn("seed", seed_kind(F.col("value"))), "edges")
    totals = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SUPPORT), "patterns")
    seeds = materialize(edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").cast("double").alias("s")), "support")
    unseen = edges.where("seed is null").select("pattern", "value")
    found = None
    for _ in range(rounds):
        support = seeds
        if found is not None:
            more = unseen.join(few(found), "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
            support = seeds.unionByName(more).groupBy("pattern", "kind").agg(F.sum("s").alias("s"))
        conf = support.where(F.col("s") >= MIN_SUPPORT).join(totals, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("conf"))
        good = materialize(conf.where(F.col("conf") >= MIN_PATTERN), "good")
        got = unseen.join(few(good), "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        best = got.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score")
        found = materialize(best.where(F.col("score") >= MIN_INSTANCE), "found")
    return found


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, k, end, kind, value), a row for each row of ``docs``.

    ``base`` holds what the four patterns find, ``spans`` also the values
    that bootstrapping adds wherever they occur outside of base spans.
    Offsets are code points, the end exclusive.

    Null text is empty and has no span.  Texts of any length are read whole.
    Repeated rows are answered each; null ids stay.  Other columns are ignored;
    an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    read = with_candidates(with_base(rows)).drop("__text").withColumn("row", F.monotonically_increasing_id())
    read = materialize(read, "pii")
    seen = read.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    found = bootstrap(seen.select(F.explode(F.array_compact(F.concat(F.array("pattern"), "others"))).alias("pattern"), "value").distinct(), rounds)
    extra = seen.join(few(found).withColumnRenamed("kind", "__kind"), "value")
    kind_no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("__kind")).cast("int") - 1
    extra = extra.select("row", F.struct("start", kind_no.alias("k"), "end", F.col("__kind").alias("kind"), "value").alias("s"))
    extra = extra.groupBy("row").agg(F.collect_list("s").alias("extra"))
    free = F.filter(F.coalesce("extra", F.array().cast(SPANS)), lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    out = read.drop("candidates").join(extra, "row", "left")
    return out.select("doc_id", "base", F.sort_array(F.concat("base", free)).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
