"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content (the blob). The ledger
lists which blobs were scanned under which version of the rules; only pairs that it lacks are
scanned, each once however many paths hold it, and findings are joined back to all paths.
Everything is built from DataFrame functions; the spans come from ``regexp_extract_all``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrove.llm.common import materialise, shared_dir

#: Changes whenever RULES do.
RULE_VERSION = "3"
#: New blobs of an increment whose ids are broadcast at most; more meet their texts in a merge join.
MAX_BROADCAST = 200_000


#: Pieces of a text whose lengths are summed together.
BLOCK = 128
EMPTY = "array<struct<start:int,end:int,ord:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` has no capturing groups but ``value`` of them; the last one's length counts, or the match's."""

    kind: str
    pattern: str
    values: int = 0
    least: int = 1
    quick: str = ""  # no match without a match of this
    before: str = ""  # characters that must not come before a match, or before ``lead``
    lead: str = ""  # what may stand between them and a match

    @property
    def start(self) -> str:
        """What must come before the pattern."""
        return (rf"(?<![{self.before}])" if self.before else "") + self.lead

    @property
    def whole(self) -> str:
        """The pattern with what must come before it."""
        return rf"{self.start}(?:{self.pattern})"


#: In the order in which kinds are listed. The first three are the base set.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 40, r"gh[opsur]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, r"xox[abprs]-[A-Za-z0-9-]{15}"),
    # from the beginning of a run of its characters alone, or each eyJ in a long one would read on to its end
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, "", r"A-Za-z0-9_-"),
)
BASE = ("assign", "access", "hex")
#: The same rules, but for a jwt that is found inside a run of its characters too. Of all eyJ in a run the first one is
#: tried alone, as the others can't match where it doesn't, so a run is read once.
INSIDE = tuple(Rule(r.kind, r.pattern, r.values, r.least, r.quick, r.before, r"(?>[A-Za-z0-9_-]*?(?=eyJ))") if r.kind == "jwt" else r for r in RULES)
#: Under which a ledger keeps what these rules found.
INSIDE_VERSION = f"{RULE_VERSION}-inside"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, end, order, kind) of the rule's matches that are long enough, in code points.

    Each piece that is extracted is the gap before a match and the match; ``\\G`` ties it to the
    piece before, so that lengths add up to places. They are summed over blocks of pieces and then within
    a piece's block, as an array that grew by a piece at a time would be copied each time.
    """
    piece = rf"\G((?s:.*?){rule.start})(?:{rule.pattern})"

    def sizes(chunk: Column) -> Column:
        gap, whole = F.char_length(F.regexp_extract(chunk, rf"\A((?s:.*?){rule.start})(?:{rule.pattern})", 1)), F.char_length(chunk)
        size = F.char_length(F.regexp_extract(chunk, piece, 1 + rule.values)) if rule.values else whole - gap
        return F.struct(gap.alias("gap"), whole.alias("whole"), size.alias("size"))

    def length(pieces: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(pieces, first + 1, n), F.lit(0), lambda a, p: a + p["whole"])

    def places(pieces: Column, starts: Column) -> Column:
        def span(p: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            at = F.get(starts, block) + length(pieces, block * BLOCK, i % BLOCK)
            kept = F.struct((at + p["gap"]).alias("start"), (at + p["whole"]).alias("end"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"))
            return F.when(p["size"] >= rule.least, kept)

        return F.array_compact(F.transform(pieces, span))

    def starts(pieces: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(pieces) / BLOCK).cast("int"))
        grown = F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + length(pieces, b * BLOCK, F.lit(BLOCK)))))
        return grown

    chunks = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    found = let(F.transform(chunks, sizes), lambda p: let(starts(p), lambda s: places(p, s)))
    return F.when(text.rlike(rule.quick or rule.whole), found).otherwise(F.array().cast(EMPTY))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id, spans (array of start, end, ord, kind; by start, then kind) of every row. Time grows with a text's length, not with its square."""
    return blobs.select("blob_id", F.array_sort(F.flatten(F.array(*[rule_spans(F.col("text"), r, i) for i, r in enumerate(rules)]))).alias("spans"))


def address(versions: DataFrame, path: str, text: str) -> DataFrame:
    """path, text (null: empty) and blob_id of every version."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return versions.select(F.col(f"`{path}`").alias("path"), content.alias("text"), F.sha2(content.cast("binary"), 256).alias("blob_id"))


@dataclass(frozen=True)
class Run:
    """What a scan did: its versions' paths and blobs, and how many blobs it scanned and passed over."""

    paths: DataFrame  # path, blob_id
    scanned: int
    skipped: int


class Ledger:
    """Findings and seen (blob, rule version) pairs as append-only Parquet tables under ``folder``, which all executors share.

    Findings are written before the pairs that stand for them, so that a scan that dies between is
    repeated by the next one; findings that are then there twice are read once.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}"

    def _read(self, name: str, schema: str) -> DataFrame:
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}")  # where there is none yet
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def seen(self) -> DataFrame:
        """blob_id, rule_version."""
        return self._read("seen", "blob_id string, rule_version string")

    def findings(self, rule_version: str = RULE_VERSION) -> DataFrame:
        """blob_id, spans of the blobs in which this version of the rules found something."""
        rows = self._read("findings", f"blob_id string, spans {EMPTY}, rule_version string")
        return rows.filter(F.col("rule_version") == rule_version).groupBy("blob_id").agg(F.any_value("spans").alias("spans"))

    def scan(self, versions: DataFrame, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> Run:
        """Scans the blobs of ``versions`` that no scan under this rule version has seen.

        Each unseen blob is read from one path, the smallest that holds it. Null texts are empty
        blobs, null paths are allowed, a version that occurs twice is one blob, an empty table adds
        nothing; other columns are not read. Texts are hashed twice, to be addressed and to be picked.
        """
        paths = materialise(address(versions, path, text).select("path", "blob_id"), "secret-paths")
        seen = self.seen().filter(F.col("rule_version") == rule_version).select("blob_id")
        blobs = materialise(paths.groupBy("blob_id").agg(F.min("path").alias("path")).join(seen.withColumn("old", F.lit(True)), "blob_id", "left").distinct(), "secret-blobs")
        unseen = blobs.filter("old IS NULL").select(F.col("blob_id").alias("b"), F.col("path").alias("p"))
        n, held = unseen.count(), blobs.count()
        if n:
            # a small increment is looked up in all texts; a first scan goes the same way at every size
            side = F.broadcast(unseen) if n <= min(MAX_BROADCAST, held // 10) else unseen.hint("merge")
            one = address(versions, path, text).join(side, (F.col("blob_id") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")), "left_semi")
            # blobs without spans go only after the aggregation: an earlier filter would be pushed below the join and scan every version
            found = scan(one, rules).groupBy("blob_id").agg(F.any_value("spans").alias("spans")).filter(F.size("spans") > 0)
            found.withColumn("rule_version", F.lit(rule_version)).write.mode("append").parquet(f"{self.folder}/findings")
            unseen.select(F.col("b").alias("blob_id"), F.lit(rule_version).alias("rule_version")).write.mode("append").parquet(f"{self.folder}/seen")
        return Run(paths, n, held - n)

    def by_path(self, paths: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
        """path, blob_id and spans (empty where nothing was found) of every row of ``paths`` (path, blob_id).

        A blob that a large part of all paths hold is one key of the join, which adaptive execution
        splits (spark.sql.adaptive.skewJoin.enabled, the default).
        """
        found = materialise(self.findings(rule_version), "secret-findings")
        return paths.join(found, "blob_id", "left").select("path", "blob_id", F.coalesce("spans", F.array().cast(EMPTY)).alias("spans"))


def secret_report(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``; by default against a new ledger."""
    ledger = ledger or Ledger(docs.sparkSession)
    rows = ledger.by_path(ledger.scan(docs, path="doc_id").paths)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(F.col("path").alias("doc_id"), *[number(k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def ledger_runs(first: DataFrame, second: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """What three scans of one ledger do: the first versions (path, text), both sets, both under an older version of the rules.

    They look for a jwt in the whole text, also inside a run of its characters.

    A row per run: run, rule_version, blobs, scanned, skipped, with_findings.
    """
    ledger = ledger or Ledger(first.sparkSession)
    both = first.select("path", "text").unionByName(second.select("path", "text"))
    old = tuple(r for r in RULES if r.kind in BASE)
    rows = []
    for i, (versions, rules, version, named) in enumerate(((first, INSIDE, INSIDE_VERSION, RULE_VERSION), (both, INSIDE, INSIDE_VERSION, RULE_VERSION), (both, old, "1", "1")), 1):
        run = ledger.scan(versions, rules=rules, rule_version=version)
        hits = ledger.findings(version).join(run.paths.select("blob_id").distinct(), "blob_id", "left_semi").count()
        rows.append((i, named, run.scanned + run.skipped, run.scanned, run.skipped, hits))
    return first.sparkSession.createDataFrame(rows, "run int, rule_version string, blobs long, scanned long, skipped long, with_findings long")
