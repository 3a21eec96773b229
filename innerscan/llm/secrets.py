"""Secret scans with a ledger: every content is scanned once for each version of a rule, whatever number of paths hold it.

A ledger is a folder of Parquet tables in storage that all executors share.
``blobs`` says which rules have scanned which contents, ``findings`` what they
found.  An update content-addresses the rows that it is given (SHA-256),
subtracts what the ledger has, scans one row of each content that is left and
appends.  Findings are written before the blobs they belong to, so an update
that was cut off is done again by the next; reading drops the repetitions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIN_LONG, forget, materialize, new_path, table

VALUE = r"[A-Za-z0-9+/_.=-]"


@dataclass(frozen=True)
class Rule:
    """A pattern and its version; ``version`` changes with whatever changes what the rule finds.

    A match counts if its ``group`` has ``least`` characters.  ``needs`` are
    lower-case strings of which a text with a match has one; ``flags`` are
    those of ``re``.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    flags: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order that ties of their spans take.
BASE = (
    Rule("assign", 1, rf"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?({VALUE}+)", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key"), re.I | re.A),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", needs=("akia",)),  # as AKIA[A-Z0-9]+ of 20 characters or more: both end where the run does
    Rule("hex", 1, "[0-9a-f]{24,}"),  # as [0-9a-f]+ of 24 characters or more: both take whole runs
)
#: Kinds that the scan adds: keys in armour, signed tokens, prefixed tokens, credentials in headers and addresses.
ADDED = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*-----END [A-Z ]{0,30}PRIVATE KEY-----)?", needs=("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyj",)),
    Rule("prefixed", 1, r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "aiza")),
    Rule("bearer", 1, r"bearer\x20+([A-Za-z0-9+/_.=-]{16,})", 1, needs=("bearer",), flags=re.I | re.A),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/@]{1,100}@", needs=("://",)),
)
RULES = BASE + ADDED
FOUND = "blob binary, rule string, place int, kind string, start int, end int"


@dataclass
class Ledger:
    """A ledger in the folder ``path``; ``seen`` and ``found`` read its tables."""

    spark: SparkSession
    path: str
    rules: Sequence[Rule] = field(default=RULES)

    def _tables(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        """(blob, rules): the keys of the rules that have scanned a content; a content may have several rows."""
        return self._tables("blobs", "blob binary, rules array<string>")

    def found(self) -> DataFrame:
        return self._tables("findings", FOUND)

    def unseen(self, versions: DataFrame) -> DataFrame:
        """(blob, doc, rules): contents of (doc, blob) with the rules that have not scanned them, and one row that holds each."""
        every = F.array(*[F.lit(r.key) for r in self.rules])
        known = self.seen().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("__known"))
        one = versions.groupBy("blob").agg(F.min("doc").alias("doc")).join(known, "blob", "left")
        todo = F.array_except(every, F.coalesce("__known", F.array().cast("array<string>")))
        return one.select("blob", "doc", todo.alias("rules")).where(F.size("rules") > 0)

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Scan what ``docs`` has that the ledger has not.

        Two short columns of every row are grouped by content; the texts are
        dealt once, by id, to meet the list of those to scan.
        """
        texts = addressed(docs, id_col, text_col)
        todo = materialize(self.unseen(texts.select("doc", "blob")), "unseen")
        batch = uuid.uuid4().hex
        # narrow rows are the hashed side, so texts are neither sorted nor kept in memory
        to_scan = texts.join(todo.withColumnRenamed("blob", "__b").hint("shuffle_hash"), ["doc"]).where(F.col("blob") == F.col("__b")).select("blob", "rules", "__text")
        to_scan.mapInArrow(scanner(tuple(self.rules)), FOUND).write.parquet(f"{self.path}/findings/{batch}")
        todo.select("blob", "rules").write.parquet(f"{self.path}/blobs/{batch}")
        forget(todo)

    def findings(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, blob, found) of every row of ``docs``: its content's findings by start, then rule, joined back to all that hold it.

        ``found`` is an array of (start, place, end, kind), empty where nothing
        was found; rules of other versions than the ledger's own don't count.
        The findings of a content are one written row, so the join deals both
        sides itself and may split a content that a third of the rows hold.
        """
        own = self.found().where(F.col("rule").isin([r.key for r in self.rules]))
        by_blob = own.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", "place", "end", "kind"))).alias("found"))
        by_blob = materialize(by_blob, "by_blob")
        paths = docs.select(F.col(id_col).alias("doc_id"), content(F.coalesce(F.col(text_col), F.lit(""))).alias("blob"))
        empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
        return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("found", empty).alias("found"))


def content(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, blob, __text): null text is empty, a null id the smallest number."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.select("doc", content(F.col("__text")).alias("blob"), "__text")


def scanner(rules: tuple[Rule, ...]):
    """Spans that the named rules find in each text, leftmost and not overlapping for each rule; in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.key: (place, r, re.compile(r.pattern, r.flags)) for place, r in enumerate(rules)}
        for batch in batches:
            out = []
            for blob, keys, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lower = text.lower()
                for key in keys:
                    place, r, regex = compiled[key]
                    if r.needs and not any(n in lower for n in r.needs):
                        continue
                    out += [(blob, key, place, r.kind, m.start(), m.end()) for m in regex.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], names=["blob", "rule", "place", "kind", "start", "end"])

    return run


def find_secrets(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Update the ledger at ``path`` by ``docs`` and return the findings of each row.

    Returns (doc_id, blob, found), see :meth:`Ledger.findings`.  Null text is
    empty and has no findings.  Repeated rows each get theirs; equal texts are
    scanned once, in this update or an earlier one.  An empty table gives no
    rows.  Texts are read whole, whatever their length.  Other columns, of any
    name, are ignored.
    """
    ledger = Ledger(docs.sparkSession, path, rules)
    ledger.update(docs, id_col, text_col)
    return ledger.findings(docs, id_col, text_col)


def spans(found, keep=lambda x: F.lit(True)) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(F.filter(found, keep), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`find_secrets` over the whole ``documents`` table, from a new ledger."""
    found = find_secrets(table(spark, sf_dir, "documents"), new_path(spark, "secrets"))
    kinds = [r.kind for r in BASE]
    base = lambda x: x["kind"].isin(kinds)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(spans("found", base), 256).alias("base_sha256"), spans("found").alias("spans"))
