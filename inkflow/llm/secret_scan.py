"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Each version of a text is a blob, named by its SHA-256. The ledger (two tables in a folder) holds which pairs of blob and
rule version were scanned, and the findings of each. A scan fetches the text of one row for every blob that has an unseen
pair, runs the unseen rules on it, appends to the ledger, and joins the findings back to all rows that hold the blob.

Positions: the pieces between a rule's matches (split) and the matches themselves have lengths in code points; a match
starts at the sum of all lengths before it, a running sum over the matches of one blob and rule.

Findings are appended before their pairs: a run that is lost in between scans those pairs again, and equal findings count
once. Defined results: a null text counts as empty; repeated rows each give a row; a null doc_id stays null; an empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import drop, join_groups, save, sha256_text


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those whose group is shorter than least are dropped.

    Where the whole match is tested and the pattern is head, then run once or more, a match is as long as its run, so the least
    length may stand in the pattern that is searched: the kept matches are the same.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    head: str = ""
    run: str = ""

    @property
    def searched(self) -> str:
        return f"{self.head}{self.run}{{{self.least - len(self.head)},}}" if self.run and self.least > len(self.head) else self.pattern

    @property
    def hint(self) -> str:
        """A pattern that every text with a kept match has."""
        return self.pattern[:-2] + f"{{{self.least},}})" if self.group and self.pattern.endswith("]+)") else self.searched


# The base rules.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, "AKIA", "[A-Z0-9]"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32, "", "[0-9a-f]"),
)
#: What the scan finds besides: private key headers, JSON web tokens, prefixed access tokens.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("prefixed", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20})", 0, 1),
)
RULES = (*BASE_RULES, *MORE_RULES)

#: Bits of the filter of rows to fetch: 2**18 words of 64.
MASK_BITS = 24

SCANNED = "sha string, kind string, version int"
FINDINGS = "sha string, kind string, version int, start long, end long"


def _hint(rule: Rule) -> Column:
    """A cheap test that every text with a kept match of the rule passes."""
    text = F.col("text")
    plain = {"access": "AKIA", "private_key": "PRIVATE KEY-----", "jwt": "eyJ"}.get(rule.kind)
    return text.contains(plain) & text.rlike(rule.hint) if plain else text.rlike(rule.hint)


def hits(rules: tuple[Rule, ...]) -> Column:
    """The kinds of the rules that may match."""
    return F.array_compact(F.array(*(F.when(_hint(r), F.lit(r.kind)) for r in rules)))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of blobs (sha, text, kinds: the rules to run)."""
    per_rule = []
    for rule in rules:
        p = F.lit(rule.searched)
        gaps = F.transform(F.split("text", p, -1), F.length)
        matches = F.transform(F.regexp_extract_all("text", p, F.lit(0)), F.length)
        tested = F.transform(F.regexp_extract_all("text", p, F.lit(rule.group)), F.length) if rule.group else matches
        found = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), F.arrays_zip(gaps.alias("gap"), matches.alias("size"), tested.alias("tested")).alias("parts"))
        per_rule.append(F.when(F.array_contains("kinds", rule.kind), found))
    each = blobs.select("sha", F.explode(F.array_compact(F.array(*per_rule))).alias("r"))
    each = each.select("sha", "r.kind", "r.version", "r.least", F.posexplode("r.parts").alias("i", "part"))
    each = each.select("sha", "kind", "version", "least", "i", F.col("part.gap").cast("long").alias("gap"), F.col("part.size").cast("long").alias("size"), F.col("part.tested").alias("tested"))
    each = each.repartition("sha", "kind").distinct()  # rows that repeat doc_id and text
    so_far = Window.partitionBy("sha", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(so_far)
    placed = each.withColumn("end", end).where("tested >= least")
    return placed.select("sha", "kind", "version", (F.col("end") - F.col("size")).alias("start"), "end")


def _asked(rows: DataFrame, wanted: DataFrame, key: Column) -> DataFrame:
    """rows with _asked, whether the key may be one of wanted: true of all of these, and of few others while there are bits enough.

    The bits are 2**MASK_BITS at most, as words of 64 in a table that is broadcast.
    """
    bits = min(MASK_BITS, max(10, (16 * wanted.count()).bit_length()))
    at = F.shiftrightunsigned(key, 64 - bits)
    bit = F.expr("shiftleft(1L, cast(_at & 63 AS int))")
    mask = wanted.select(at.alias("_at")).select(F.shiftright("_at", 6).alias("_word"), bit.alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_mask"))
    return rows.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(mask), "_word").select(*rows.columns, (F.col("_mask").bitwiseAND(bit) != 0).alias("_asked"))


class Ledger:
    """The scanned pairs and the findings under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def scanned(self) -> DataFrame:
        return self._table("scanned", SCANNED).distinct()

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """Of the given rule versions."""
        versions = {r.kind: r.version for r in rules}
        wanted = F.lit(False)
        for kind, version in versions.items():
            wanted |= (F.col("kind") == kind) & (F.col("version") == version)
        return self._table("findings", FINDINGS).where(wanted).distinct()

    def unseen(self, rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """Blobs with pairs to scan: sha, doc_id of a row that holds it, kinds."""
        blobs = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
        pairs = blobs.select("sha", "doc_id", F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))).alias("r")).select("sha", "doc_id", "r.kind", "r.version")
        left = pairs.join(self.scanned(), ["sha", "kind", "version"], "left_anti")
        return left.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.collect_set("kind").alias("kinds"))

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is unseen and returns doc_id, sha of every row; findings() has what was found."""
        whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", sha256_text(F.col("text")))
        rows = save(whole.select("doc_id", "sha"), "secret-rows")
        todo = save(self.unseen(rows, rules), "secret-todo")
        # only rows that may be asked for and may hold a match are sent to meet what is asked
        may = _asked(whole, todo, F.xxhash64("doc_id", "sha")).withColumn("hits", F.when(F.col("_asked"), hits(rules))).where(F.size("hits") > 0)
        w, t = may.alias("w"), todo.alias("t")
        blobs = w.join(t, F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.sha") == F.col("t.sha"))).select("w.sha", "w.text", F.array_intersect("w.hits", "t.kinds").alias("kinds"))
        scan_blobs(blobs, rules).write.mode("append").parquet(f"{self.folder}/findings")
        versions = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
        pairs = todo.select("sha", F.explode("kinds").alias("kind")).select("sha", "kind", versions[F.col("kind")].alias("version"))
        pairs.write.mode("append").parquet(f"{self.folder}/scanned")
        drop(self.spark, todo)
        return rows


def scan_documents(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans.

    A span is kind:start:end in code points, end exclusive; spans are in order of start, then of the rules.
    """
    ledger = Ledger(docs.sparkSession, folder)
    rows = ledger.scan(docs, rules)
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    base = [r.kind for r in BASE_RULES]
    found = ledger.findings(rules).groupBy("sha").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base),
        F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("all"),
    )

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = found.select("sha", *(f"n_{k}" for k in base), joined(F.filter("all", lambda s: s["kind"].isin(base))).alias("base"), joined(F.col("all")).alias("spans"))
    blobs = save(rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n_rows")).join(found, "sha", "left"), "secret-blobs")
    return join_groups(rows, blobs, ["sha"], "n_rows", rows.count()).select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
