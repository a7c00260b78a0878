"""Secret scan over an incremental ledger of content-addressed blobs.

Every text is a blob named by its SHA-256; a path (doc_id) with several rows
has several historical versions. The ledger says which blob has been scanned
under which version of which rule, and what each of these found. A scan first
asks the ledger by blob names alone; texts are read only of blobs with rules
left to run, once however many paths hold them, and only those rules run. Their
rows are appended, and the findings of the rules in force joined back to all
paths: what an older version of a rule found stays in the ledger and out of
the findings.

Only DataFrame functions: where a rule's matches lie follows from the lengths
of the matches and of the pieces between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelspark.llm.common import broadcast_if, prepare


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: Cheap necessary conditions: one of these strings is in the text (lower-cased first if ``fold``) ...
    hints: tuple[str, ...] = ()
    fold: bool = False
    #: ... or this pattern occurs.
    probe: str = ""
    #: A match counts if this group (0: the match) has at least so many characters.
    group: int = 0
    least: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three patterns and their least lengths. Findings at one place are ordered as listed here.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         hints=("password", "passwd", "secret", "token", "apikey", "api_key"), fold=True, group=2, least=8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", hints=("AKIA",), least=16),
    Rule("hex", 1, r"[0-9a-f]{32,}", probe=r"[0-9a-f]{32}", least=32),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", hints=("eyJ",), least=40),
)
BASE_KINDS = ("assign", "access", "hex")

_SPANS = "array<struct<rule:string,kind:string,start:bigint,end:bigint>>"
LEDGER_SCHEMA = f"blob binary, rules array<string>, spans {_SPANS}"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _worth(rule: Rule, todo: Column) -> Column:
    """Whether the rule is to be run on the text and may match."""
    if rule.probe:
        may = F.col("text").rlike(rule.probe)
    else:
        where = F.lower("text") if rule.fold else F.col("text")
        may = F.lit(False)
        for hint in rule.hints:
            may = may | where.contains(hint)
    return F.array_contains(todo, rule.id) & may


def _matches(rule: Rule) -> Column:
    """array<struct<kind, gap, size, tested>>: text between, length, tested length of each match."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    tested = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), whole.alias("m"), tested.alias("t"))
    return F.transform(zipped, lambda z: F.struct(F.lit(rule.kind).alias("kind"), F.length(z["gap"]).alias("gap"),
                                                  F.length(z["m"]).alias("size"), F.length(z["t"]).alias("tested")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for (blob, text, todo) rows: one per blob, todo being the ids of the rules to run."""
    none = F.lit(None).cast("array<struct<kind:string,gap:int,size:int,tested:int>>")
    each = [F.when(_worth(r, F.col("todo")), _matches(r)).otherwise(none) for r in rules]
    least = F.lit(0)
    for r in rules:
        least = F.when(F.col("m.kind") == r.kind, F.lit(r.least)).otherwise(least)
    found = blobs.select("blob", F.explode(F.array(*each)).alias("ms")).where("ms is not null").select("blob", F.posexplode("ms").alias("i", "m"))
    upto = Window.partitionBy("blob", "m.kind").orderBy("i")
    ids = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.id)])
    end = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(upto)
    spans = (found.withColumn("end", end.cast("bigint")).where(F.col("m.size").isNotNull() & (F.col("m.tested") >= least))
             .groupBy("blob").agg(F.collect_list(F.struct(F.element_at(ids, F.col("m.kind")).alias("rule"), "m.kind", (F.col("end") - F.col("m.size")).alias("start"), "end")).alias("spans")))
    return (blobs.select("blob", F.col("todo").alias("rules")).join(spans, "blob", "left")
            .select("blob", "rules", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")))


def unseen(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo): each distinct text with the rules the ledger lacks for it."""
    every = F.array(*[F.lit(r.id) for r in rules])
    none = F.array().cast("array<string>")
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    # names first, with one path to take the text from; texts follow those that are left
    todo = (named.groupBy("blob").agg(F.min("doc_id").alias("path")).join(seen, "blob", "left")
            .withColumn("todo", F.array_except(every, F.coalesce("seen", none))).where(F.size("todo") > 0).select("blob", "path", "todo").checkpoint())
    return (named.join(broadcast_if(todo, todo.count()), "blob").where(F.col("doc_id").eqNullSafe(F.col("path")))
            .select("blob", "text", "todo").dropDuplicates(["blob"]))


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` (made if absent) lacks, append it, return the whole ledger."""
    spark = docs.sparkSession
    prepare(spark)
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(path)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    scan_blobs(unseen(docs, ledger, rules), rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 (of
    the spans of the three base kinds), spans (all), the spans in order of
    start, then kind as listed, as kind:start:end joined by commas.

    A null text is empty; repeated rows and null doc_ids each get a row; other
    columns are ignored; an empty table gives an empty result.
    """
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    versions = F.array(*[F.lit(r.id) for r in rules])
    in_force = F.filter("spans", lambda s: F.array_contains(versions, s["rule"]))
    spans = (ledger.withColumn("spans", in_force).where(F.size("spans") > 0).groupBy("blob")
             .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(
                 s["start"].alias("start"), F.element_at(place, s["kind"]).alias("k"), s["kind"].alias("kind"), s["end"].alias("end"))))))).alias("s")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blob_id(F.col("text")).alias("blob"))
    some = F.coalesce("s", F.array().cast("array<struct<start:bigint,k:int,kind:string,end:bigint>>"))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return (rows.join(spans, "blob", "left").withColumn("s", some)
            .select("doc_id", *[count(k) for k in BASE_KINDS],
                    F.sha2(text(F.filter("s", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"), text(F.col("s")).alias("spans")))
