"""Secret scans over an incremental blob ledger, with DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. Only pairs of a blob and a rule version that
the ledger hasn't seen are scanned, each blob once however many paths hold it, and findings are joined back to all
paths. The ledger is a folder of two tables to which every update adds a batch. Offsets count code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.llm.shared import Scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and how long group `part` of a match must at least be."""

    kind: str
    pattern: str
    version: int = 1
    part: int = 0
    least: int = 1


#: The three base kinds, in order, then those that this operator adds.
BASE_RULES = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        part=2,
        least=6,
    ),
    Rule("access", "AKIA[A-Z0-9]{16,}", least=20),
    Rule("hex", "[0-9a-f]{24,}", least=24),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def content_address(text: Column) -> Column:
    return F.sha2(text, 256)


def _matches(rule: Rule) -> Column:
    """The lengths of what precedes each match of a rule and of the match, and whether the match is long enough."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split("text", rule.pattern, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all("text", pattern, 0), lambda x: F.length(x))
    good = F.transform(F.regexp_extract_all("text", pattern, rule.part), lambda x: F.length(x) >= rule.least)
    both = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("n"), good.alias("good"))
    wanted = F.array_contains("todo", F.lit(rule.kind)) & F.regexp_like("text", pattern)
    return F.struct(
        F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.when(wanted, both).alias("found")
    )


def unseen(versions: DataFrame, seen: DataFrame | None, rules=RULES) -> DataFrame:
    """(blob, text, todo): each blob of versions once, with the kinds of the rule versions it wasn't scanned for."""
    blobs = versions.select(content_address(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"])
    if seen is None:
        return blobs.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    done = seen.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
    todo = F.transform(
        F.filter(current, lambda r: ~F.coalesce(F.array_contains("done", r), F.lit(False))), lambda r: r["kind"]
    )
    return blobs.join(done, "blob", "left").withColumn("todo", todo).drop("done").where(F.size("todo") > 0)


def scan(versions: DataFrame, seen: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what is new in versions (path, text).

    Gives the new ledger entries (blob, kind, version), among them pairs without a finding, and the new findings
    (blob, kind, version, start, end), end exclusive. seen holds earlier entries. A null text counts as empty.
    """
    rows = versions.select(F.coalesce("text", F.lit("")).alias("text"))
    todo = unseen(rows, seen, rules)
    numbers = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    entries = todo.select("blob", F.explode("todo").alias("kind")).withColumn("version", numbers[F.col("kind")])
    per_rule = todo.select("blob", F.explode(F.array(*[_matches(r) for r in rules])).alias("m"))
    found = per_rule.select("blob", "m.kind", "m.version", F.posexplode("m.found").alias("i", "x"))
    before = W.Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(W.Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.col("x.n")).over(before)
    found = found.withColumn("end", end).where("x.good")
    return entries, found.select("blob", "kind", "version", (F.col("end") - F.col("x.n")).alias("start"), "end")


def findings_by_blob(findings: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans): each blob's findings as an array of (start, rank, kind, end), by start and then order of rules."""
    ranks = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    span = F.struct("start", ranks[F.col("kind")].alias("rank"), "kind", "end")
    return findings.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def path_findings(versions: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """The rows of versions with `spans`, the findings of their blob: an empty array where there are none."""
    held = versions.withColumn("blob", content_address(F.coalesce("text", F.lit("")))).drop("text")
    spans = findings_by_blob(findings, rules)
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return held.join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def _of(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


class Ledger:
    """The tables `entries` (blob, kind, version) and `findings` (blob, kind, version, start, end) below one folder.

    An update that fails before its end leaves no entry, so its blobs are scanned again: findings, which are written
    first, are kept as sets, and repeated ones change nothing. An update without anything new adds no rows.
    """

    ENTRIES = "blob string, kind string, version int"
    FINDINGS = "blob string, kind string, version int, start bigint, end bigint"

    def __init__(self, spark: SparkSession, root: str, rules=RULES):
        self.spark, self.root, self.rules = spark, root, rules

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")

    def _create(self) -> None:
        for name, schema in (("entries", self.ENTRIES), ("findings", self.FINDINGS)):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/{name}")

    def update(self, versions: DataFrame) -> None:
        """Scan the blobs of versions (path, text) for the rule versions that the ledger has no entry of."""
        self._create()
        entries, found = scan(versions, self._table("entries", self.ENTRIES), self.rules)
        schema = [F.col(x.split()[0]).cast(x.split()[1]) for x in self.FINDINGS.split(", ")]
        found.select(*schema).write.mode("append").parquet(f"{self.root}/findings")
        entries.select("blob", "kind", F.col("version").cast("int")).write.mode("append").parquet(f"{self.root}/entries")

    def findings(self) -> DataFrame:
        """Findings of the rules' present versions."""
        current = [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in self.rules]
        return self._table("findings", self.FINDINGS).where(reduce(Column.__or__, current)).distinct()

    def by_path(self, versions: DataFrame) -> DataFrame:
        """The rows of versions with the `spans` of their blob, as path_findings() has them."""
        return path_findings(versions, self.findings(), self.rules)


def document_secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """One row per document: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    The documents are added to the ledger, a new one in the shared folder where none is given, and their findings are
    read back from it. spans lists kind:start:end of every finding, joined by commas, and base_sha256 is the digest of
    such a list of the base kinds. A null or empty text has none. Repeated rows each give a row; extra columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    ledger = ledger or Ledger(docs.sparkSession, Scratch(docs.sparkSession, "secrets").root)
    ledger.update(docs)
    found = ledger.by_path(docs)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [
        F.size(_of("spans", r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES
    ]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
