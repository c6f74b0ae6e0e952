"""Secret scan with an incremental blob ledger, in built-in functions.

Every text is a blob, named by its SHA-256. The ledger is a Parquet table in the shared folder with a row for each blob and run:
the blob, the rule versions that the run applied to it, and the spans found. A run scans only blobs, and for each only the rule
versions, that the ledger lacks; equal texts are one blob, scanned once. Findings then go back to all documents ("paths") that
hold a blob, in this run or any later one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.native import bound, distinct_sorted, id_and_text, scanned
from tideline.llm.store import exists, new_path, written

_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A pattern, and how a match must be: value, the group that needs `least` characters. hint: a string that every match holds."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    hint: str = ""

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.value, self.least)).encode()).hexdigest()[:8]}"


#: The base kinds, in their order. Lengths are judged after the match, so that a match that fails still uses its text.
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Public token formats, added to the base.
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
)
RULES = BASE_RULES + MORE_RULES


def _found(text: Column, rule: Rule) -> Column:
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(rule.hint)), matches).otherwise(F.array().cast("array<string>")) if rule.hint else matches


def _placed(text: Column, found: Column, rule: Rule) -> Column:
    """Spans in code points: the lengths of what stands between the matches and of the matches add up to their places."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.cast("bigint").alias("gap"), m.alias("m"), F.char_length(m).cast("bigint").alias("n")))
    empty = F.array().cast(_SPANS)

    def total(piece: Column) -> Column:
        return F.aggregate(piece, F.lit(0).cast("bigint"), lambda t, x: t + x["gap"] + x["n"])

    def placed(piece: Column, before: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            value = F.regexp_extract(x["m"], rule.pattern, rule.value) if rule.value else x["m"]
            span = F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"))
            return F.struct((start + x["n"]).alias("at"), F.when(F.char_length(value) >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(piece, F.struct(before.alias("at"), empty.alias("spans")), step)["spans"]

    spans = scanned(pairs, total, lambda a, b: a + b, F.lit(0).cast("bigint"), placed)
    return F.when(F.size(found) > 0, spans).otherwise(empty)


def ordered(spans: Column, rules=RULES) -> Column:
    """By start, then by the kinds' order."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(distinct_sorted(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


class BlobLedger:
    """The ledger at a path of the shared folder; a new path begins an empty one."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules=RULES):
        self.spark, self.path, self.rules = spark, path or new_path(spark, "ledger"), tuple(rules)

    def rows(self) -> DataFrame | None:
        schema = f"blob binary, rules array<string>, spans {_SPANS}"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else None

    def update(self, docs: DataFrame) -> None:
        """Scan what the ledger has not seen, and append it."""
        blobs = id_and_text(docs).select(F.coalesce("text", F.lit("")).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")
        versions = F.array(*[F.lit(r.version) for r in self.rules])
        blobs = blobs.dropDuplicates(["blob"])
        seen = self.rows()
        if seen is None:
            blobs = blobs.withColumn("todo", versions)
        else:
            known = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
            blobs = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(versions, F.coalesce("done", F.array().cast("array<string>")))).where(F.size("todo") > 0)
        none = F.array().cast("array<string>")
        asked = lambda r: F.array_contains("todo", r.version)
        found = blobs.select("blob", "text", "todo", *[F.when(asked(r), _found(F.col("text"), r)).otherwise(none).alias(r.kind) for r in self.rules])
        spans = F.concat(*[_placed(F.col("text"), F.col(r.kind), r) for r in self.rules])
        found.select("blob", F.col("todo").alias("rules"), spans.alias("spans")).write.mode("append").parquet(self.path)

    def blobs(self) -> DataFrame:
        """(blob, spans), the spans of all runs by the present rule versions, ordered."""
        rows = self.rows()
        if rows is None:
            return self.spark.createDataFrame([], f"blob binary, spans {_SPANS}")
        versions = F.create_map(*[F.lit(x) for r in self.rules for x in (r.kind, r.version)])
        mine = F.filter("spans", lambda s: F.coalesce(F.array_contains("rules", F.element_at(versions, s["kind"])), F.lit(False)))
        per = rows.select("blob", mine.alias("spans")).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        return per.select("blob", ordered(F.col("spans"), self.rules).alias("spans"))

    def findings(self, docs: DataFrame) -> DataFrame:
        """Per row of docs (doc_id, text): blob and spans, ordered. Null texts are empty ones; equal rows each have a row; a
        blob that the ledger lacks has null spans; rule versions that are not among the rules are left out; what two runs at
        one time have both appended counts once. An empty table gives none; other columns, whatever their names, are ignored."""
        paths = id_and_text(docs).select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
        # a written table, so that the join has plain exchanges below it and Spark can split a blob that very many paths share
        return paths.join(written(self.blobs(), "findings"), "blob", "left").select("doc_id", "blob", "spans")

    def scan(self, docs: DataFrame) -> DataFrame:
        self.update(docs)
        return self.findings(docs)


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, and each run of spans that overlap, replaced by the mask. spans: ordered. A place is found by
    counting characters from the text's start, so each piece of spans cuts its own part of the text first."""
    zero = F.lit(0).cast("bigint")
    last = lambda piece: F.array_max(F.transform(piece, lambda s: s["end"]))

    def cut(piece: Column, before: Column) -> Column:
        def inside(own: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                gap = F.substring(own, (acc["at"] - before + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
                parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, F.lit(mask)))).otherwise(acc["parts"])
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

            return F.aggregate(piece, F.struct(before.alias("at"), F.array().cast("array<string>").alias("parts")), step)["parts"]

        return bound(F.substring(text, (before + 1).cast("int"), (F.greatest(before, last(piece)) - before).cast("int")), inside)

    parts = scanned(spans, last, F.greatest, zero, cut)
    whole = F.concat(F.array_join(parts, ""), F.substring(text, (last(spans) + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
