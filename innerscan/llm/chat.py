"""Chat formatting by quotation linking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MIN_LONG, ascii_lower, few, materialize, table, ws_strip

QUOTE = r"^(?:[ \t]*>)+[ \t]?"


def quote_level(line: Column) -> Column:
    """Number of '>' marks before a line's text."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), r"[^>]", ""))


def normalized(passage: Column) -> Column:
    """A passage for comparison: A-Z lower-cased, white space runs single, none at the ends."""
    return ws_strip(F.regexp_replace(ascii_lower(passage), r"[\x20\x09-\x0D]+", " "))


def passage_hash(text: Column) -> Column:
    """Of a normalised passage."""
    return F.unhex(F.sha2(text, 256))


def pieces(passage: Column) -> Column:
    """(kind, text): 0 the passage, 1 its paragraphs, 2 its lines; normalised, none blank."""
    of = lambda kind, parts: F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), normalized(x).alias("text")))
    parts = F.concat(of(0, F.array(passage)), of(1, F.split(passage, r"\n[\x20\x09-\x0D]*\n", -1)), of(2, F.split(passage, r"\n", -1)))
    return F.filter(parts, lambda x: x["text"] != "")


def parse(messages: DataFrame) -> DataFrame:
    """Add ``lines`` (level, text), ``body`` without quotes, ``quotes`` (level, text) and ``own`` passages.

    A quote is a maximal run of lines of one level above 0.  A message's own
    passages are its body and each maximal run of unquoted lines; ``pieces`` cuts
    them further.
    """
    split = F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)
    line = lambda x: F.struct(quote_level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("text"))
    filled = lambda c: F.filter(c, lambda r: normalized(r["text"]) != "")
    m = messages.withColumn("lines", F.transform(split, line))
    # where runs begin, and one after the last line; each run is joined once
    n = F.size("lines")
    begins = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    m = m.withColumn("begins", F.when(F.exists("lines", lambda x: x["level"] > 0), begins))
    text = lambda i, j: F.array_join(F.transform(F.slice("lines", i + 1, j - i), lambda x: x["text"]), "\n")
    runs = F.zip_with(F.slice("begins", F.lit(1), F.size("begins") - 1), F.slice("begins", F.lit(2), F.size("begins") - 1), lambda i, j: F.struct(F.get("lines", i)["level"].alias("level"), text(i, j).alias("text")))
    m = m.withColumn("runs", F.coalesce(runs, F.array(F.struct(F.lit(0).alias("level"), F.coalesce("text", F.lit("")).alias("text")))))
    plain = F.filter("runs", lambda r: r["level"] == 0)
    return (
        m.withColumn("body", ws_strip(F.array_join(F.transform(plain, lambda r: r["text"]), "\n")))
        .withColumn("quotes", filled(F.filter("runs", lambda r: r["level"] > 0)))
        .withColumn("own", F.array_distinct(F.concat(F.array("body"), F.transform(filled(plain), lambda r: r["text"]))))
        .drop("runs", "begins")
    )


def before_and_rank(rows: DataFrame, keys: list[str], prev: str, rank: str) -> DataFrame:
    """Add the turn before and the 0-based rank of each row among its keys, in order of (turn, conversation, tie).

    Rows are written in ranges of that order, so a group of any size, with
    any number of equal turns, is spread over ranges; counts and last turns of
    a group's ranges are carried over.
    """
    order = [F.col(c) for c in ("t", "c", "tie")]
    cut = materialize(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__c", F.spark_partition_id()), "ranged")
    inner = Window.partitionBy("__c", *keys).orderBy(*order)
    w = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy(*keys, "__c").agg(F.count("*").alias("__n"), F.max("t").alias("__last"))
    ranges = ranges.groupBy(*keys).agg(F.collect_list(F.struct("__c", "__n", "__last")).alias("__g")).where(F.size("__g") > 1).select(*keys, F.explode("__g").alias("__g")).select(*keys, "__g.*")
    ranges = materialize(ranges.select(*keys, "__c", F.sum("__n").over(w).alias("__b"), F.max("__last").over(w).alias("__p")), "ranges")
    out = cut.withColumn("__r", F.row_number().over(inner) - 1).withColumn("__l", F.lag("t").over(inner)).join(few(ranges), ["__c", *keys], "left")
    return out.withColumn(prev, F.coalesce("__l", "__p")).withColumn(rank, F.col("__r") + F.coalesce("__b", F.lit(0))).drop("__c", "__r", "__l", "__b", "__p")


def link(messages: DataFrame) -> DataFrame:
    """Reply-ordered messages without quotes.

    Takes (conv_id, turn, role, text) and returns a row a message: conv_id,
    turn, role, body, n_quotes, n_linked, quoted (conv_id, turn of the message
    that its first linked quote comes from), parent_conv, parent_turn, thread_conv,
    thread_turn (the first message of its thread), depth, position (in its
    thread) and formatted.

    A quote is linked by the hash of its normalised text to the first message
    of the conversation that wrote it as a passage of its own, a paragraph or
    a line, else to the first such message of any conversation, always to one
    before it in the order of (conv_id, turn).  A quote that no message wrote
    as a whole is linked by the longest of its paragraphs, else of its lines,
    that one wrote.  For each hash that first message is found by an
    aggregate, so a passage that very many messages share costs one row.  A
    message replies to the origin of its outermost linked quote, or else to
    the turn before.

    Null or empty text has an empty body.  A null conv_id or turn sorts
    first and is treated as a conversation or turn of its own.  Repeated
    (conv_id, turn) rows are kept; links go to the first of them.  Extra columns are
    ignored; an empty table gives an empty result.
    """
    m = messages.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(MIN_LONG)).alias("c"),
        F.coalesce(F.col("turn").cast("long"), F.lit(MIN_LONG)).alias("t"),
        "conv_id", "turn", "role", "text",
    ).withColumn("tie", F.xxhash64("role", "text"))
    parsed = materialize(before_and_rank(parse(m).drop("lines", "text"), ["c"], "prev", "nth"), "parsed")
    own = parsed.select("c", "t", F.explode("own").alias("p"))
    own = own.select("c", "t", F.explode(F.array_distinct(F.transform(pieces(F.col("p")), lambda x: x["text"]))).alias("p")).select("c", "t", passage_hash(F.col("p")).alias("h"))
    quotes = parsed.where(F.size("quotes") > 0).select("c", "t", "nth", F.posexplode("quotes").alias("at", "q"))
    quotes = quotes.select("c", "t", "nth", "at", F.col("q.level").alias("level"), F.posexplode(pieces(F.col("q.text"))).alias("no", "p"))
    quotes = quotes.select("c", "t", "nth", "at", "level", "no", F.col("p.kind").alias("kind"), F.length("p.text").alias("size"), passage_hash(F.col("p.text")).alias("h"))
    hashes = materialize(quotes.select("h").distinct(), "hashes")
    wanted = materialize(own.join(few(hashes), "h", "left_semi").groupBy("c", "h").agg(F.min("t").alias("here")), "wanted")
    first = materialize(wanted.groupBy("h").agg(F.min(F.struct("c", F.col("here").alias("t"))).alias("first")), "first")
    found = quotes.join(few(wanted), ["c", "h"], "left").join(few(first), "h", "left")
    origin = F.when(F.col("here") < F.col("t"), F.struct("c", F.col("here").alias("t"))).when(F.col("first") < F.struct("c", "t"), F.col("first"))
    found = found.withColumn("origin", origin).where("origin is not null").groupBy("c", "t", "nth", "at", "level").agg(
        F.min(F.struct("kind", -F.col("size"), "no", "origin"))["origin"].alias("origin")
    )
    found = found.groupBy("c", "t", "nth").agg(
        F.count("origin").alias("n_linked"), F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "at", "origin"))).alias("o")
    )
    linked = parsed.join(found.select("c", "t", "nth", "n_linked", F.col("o.origin").alias("quoted")), ["c", "t", "nth"], "left")
    parent = F.coalesce("quoted", F.when(F.col("prev") < F.col("t"), F.struct("c", F.col("prev").alias("t"))))
    linked = materialize(linked.withColumn("parent", parent), "linked")
    threads = roots(linked.select("c", "t", "parent").where("parent is not null").groupBy("c", "t").agg(F.min("parent").alias("parent")))
    out = linked.join(threads, ["c", "t"], "left").select(
        "*", F.coalesce("root", F.struct("c", "t")).alias("thread"), F.coalesce("hops", F.lit(0)).alias("depth")
    )
    out = out.withColumn("rc", F.col("thread.c")).withColumn("rt", F.col("thread.t"))
    out = before_and_rank(out.drop("prev", "nth"), ["rc", "rt"], "prev", "position")
    null_if = lambda c: F.when(F.col(c) != MIN_LONG, F.col(c))
    return out.select(
        "conv_id", "turn", "role", "body",
        F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        null_if("quoted.c").alias("quoted_conv"), null_if("quoted.t").alias("quoted_turn"),
        null_if("parent.c").alias("parent_conv"), null_if("parent.t").alias("parent_turn"),
        null_if("rc").alias("thread_conv"), null_if("rt").alias("thread_turn"),
        F.col("depth").cast("long").alias("depth"), F.col("position").cast("long").alias("position"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body")).alias("formatted"),
    )


def roots(parents: DataFrame) -> DataFrame:
    """(c, t, root, hops): the first ancestor of each message, by pointer jumping: rounds grow with the log of the depth.

    Parents come before their replies, so there is no cycle.  A message that
    has reached its first ancestor takes no part in later rounds.
    """
    active, done = materialize(parents.select("c", "t", F.col("parent").alias("root"), F.lit(1).alias("hops")), "roots"), []
    while True:
        known = reduce(DataFrame.unionByName, [active, *done])
        up = known.select(F.col("c").alias("uc"), F.col("t").alias("ut"), F.col("root").alias("up"), F.col("hops").alias("more"))
        jumped = active.join(up, (F.col("root.c") == F.col("uc")) & (F.col("root.t") == F.col("ut")), "left")
        jumped = jumped.select("c", "t", F.coalesce("up", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("up").isNotNull().alias("moved"))
        jumped = materialize(jumped, "roots")
        done.append(jumped.where("not moved").drop("moved"))
        active = jumped.where("moved").drop("moved")
        if not active.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, reply-ordered messages of the whole ``conversations`` table."""
    return link(table(spark, sf_dir, "conversations"))
