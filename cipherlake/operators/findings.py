"""Detection over lines, and findings with identity, severity and what is derived from them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cipherlake.functions import scalars as S
from cipherlake.sources import files as sources
from cipherlake.sources import rules as R

HIT_CAP, KEY_CAP = 4096, 8
SLASH_COMMENTS = ("js", "mjs", "cjs", "jsx", "ts", "tsx", "go", "rs", "c", "cc", "cpp", "h")
HASH_COMMENTS = ("py", "rb", "sh", "yml", "yaml", "toml", "conf", "cfg", "ini")


def comment_only(path: Column, line: Column) -> Column:
    ext = S.extension(path)
    return F.when(ext.isin(*SLASH_COMMENTS), line.rlike(r"^\s*(//|/\*|\*)")).when(ext.isin(*HASH_COMMENTS), line.rlike(r"^\s*#")).otherwise(False)


def detect(files: DataFrame, rules: tuple[R.Rule, ...] = R.PACK) -> DataFrame:
    """Every match of the regex and key rules, by line: no shuffle, and texts without any match are left early.

    Texts are tried for all rules, after a quick look for their hints; lines for the rules that hit their text."""
    used = [r for r in R.validate(list(rules)) if r.kind in ("regex", "key")]
    # the rules that hit a text at all: its lines are tried for these only
    told = lambda r: reduce(or_, (F.contains("low", F.lit(h)) for h in r.hints)) if r.hints else F.lit(True)
    hit = F.array_compact(F.array(*(F.when(told(r) & F.col("text").rlike(r.pattern), F.lit(r.id)) for r in used)))
    told_of = lambda f: F.element_at(F.create_map(*(F.lit(x) for r in used for x in (r.id, f(r)))), F.col("rule_id"))
    # all lines of a text for one rule, then for the next: a pattern is compiled once for each
    # outer: of a plain explode the optimizer infers a filter that tries all rules a second time
    hot = files.withColumn("low", F.lower("text")).withColumn("rule_id", F.explode_outer(hit)).where("rule_id is not null")
    marked = F.regexp_replace("content", told_of(lambda r: r.pattern), F.lit("\u0001$0\u0002"))
    found = sources.lines(hot, "rule_id").withColumn("marked", marked).where(F.contains("marked", F.lit("\u0001")))
    found = found.withColumns({"kind": told_of(lambda r: r.kind), "scope": told_of(lambda r: r.scope), "parts": F.split("marked", "\u0001")})
    found = found.withColumn("detector_seq", F.when(F.col("kind") == "regex", 2).otherwise(5)).where((F.col("kind") == "key") | ~comment_only(F.col("path"), F.col("content")))
    at = found.select("*", F.posexplode("parts").alias("k", "part")).where("k > 0")
    before = F.replace(F.array_join(F.slice("parts", F.lit(1), F.col("k")), ""), F.lit("\u0002"), F.lit(""))
    match = F.split_part("part", F.lit("\u0002"), F.lit(1))
    trimmed = F.when(F.col("scope") == "config", F.ltrim(match)).otherwise(match)
    return at.select(
        "rule_id", "path", "line", (F.length(before) + F.length(match) - F.length(trimmed) + 1).alias("column"), trimmed.alias("match"),
        F.when(F.col("kind") == "key", "private_key").otherwise("regex").alias("evidence_type"), "file_seq", "detector_seq",
    )


def capped(detections: DataFrame, cap: int = HIT_CAP) -> DataFrame:
    """The first hits of each rule and file; ``truncated`` says whether there were more. ``scan`` itself reports every hit: the bound is there for reports that ask for it."""
    by = Window.partitionBy("rule_id", "path")
    ranked = detections.withColumn("rn", F.row_number().over(by.orderBy("line", "column"))).withColumn("truncated", F.count(F.lit(1)).over(by) > cap)
    return ranked.where(F.col("rn") <= cap).drop("rn")


def findings(detections: DataFrame, rules: DataFrame) -> DataFrame:
    """Detections of known rules, one for each identity, the first in pipeline order. The pack is small: its rows are code."""
    joined = detections.join(F.broadcast(rules.withColumnRenamed("id", "rule_id")), "rule_id")
    masked = S.mask_preview(F.col("match"))
    named = joined.withColumn("match", masked).withColumn("finding_id", S.native_id("finding", F.col("rule_id"), F.col("path"), F.col("line"), F.col("column"), masked))
    severity = S.adjusted_severity(F.col("category"), F.col("risk"), F.col("confidence"), F.col("severity"), F.col("evidence_type"))
    row = F.struct("rule_id", "category", "risk", severity.alias("severity"), F.col("confidence").cast("double").alias("confidence"), "migration_hint", "description", "path", "line", "column", "match", "evidence_type", "file_seq")
    # the first by pipeline order: aggregated before the shuffle, without a sort
    return named.groupBy("finding_id").agg(F.min_by(row, F.struct("file_seq", "detector_seq", "line", "column")).alias("f")).select("finding_id", "f.*")


def scan(spark: SparkSession, files: DataFrame, rules: tuple[R.Rule, ...] = R.PACK) -> DataFrame:
    """Files to findings: selection, detection, identity."""
    return findings(detect(sources.select_files(files), rules), R.frame(spark, rules))


def is_inventory(df_severity: Column = None, risk: Column = None) -> Column:
    severity = F.col("severity") if df_severity is None else df_severity
    return (severity == "info") | ((F.col("risk") if risk is None else risk) == "quantum-safe")


def summary(found: DataFrame) -> DataFrame:
    """Counts by severity, by risk, and in all."""
    sets = found.groupingSets([[F.col("severity")], [F.col("risk")], []], "severity", "risk").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.coalesce("severity", F.lit("*")).alias("severity"), F.coalesce("risk", F.lit("*")).alias("risk"), "n")


def cbom(found: DataFrame) -> DataFrame:
    """One entry for each rule, place and match; the component is the first path segment."""
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    keyed = found.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("component"), F.col("match").alias("algorithm"), F.col("category").alias("usage_type"), place.alias("location"), F.col("risk").alias("quantum_risk"), "migration_hint", "rule_id")
    return keyed.dropDuplicates(["rule_id", "location", "algorithm"]).drop("rule_id")


def rule_groups(found: DataFrame) -> DataFrame:
    """By rule: occurrences, files, the highest severity."""
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("path").alias("files"), S.severity_name(F.max(S.severity_rank(F.col("severity")))).alias("severity"), F.array_join(F.array_sort(F.collect_set("risk")), ",").alias("risks"))


def rule_index(found: DataFrame) -> DataFrame:
    """By rule and whether it is inventory or a risk candidate."""
    return rule_groups_by(found.withColumn("inventory", is_inventory()))


def rule_groups_by(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id", "inventory").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("path").alias("files"), S.severity_name(F.max(S.severity_rank(F.col("severity")))).alias("severity"))


def severity_distribution(found: DataFrame) -> DataFrame:
    counts = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("severity", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))  # one row with one row per severity


def metrics(found: DataFrame) -> DataFrame:
    inv = is_inventory()
    return found.agg(F.count_if(~inv).alias("candidates"), F.count_if(inv).alias("inventory"), F.countDistinct("path").alias("files"))


def file_tree(found: DataFrame) -> DataFrame:
    """Findings below every directory and in every file. Counted by file first, so prefixes of few rows are spread out."""
    files = found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select(F.explode(prefixes).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))


def same_location(found: DataFrame) -> DataFrame:
    """Places that several rules hit."""
    return found.groupBy("path", "line", "column").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), F.countDistinct("rule_id").alias("n")).where("n > 1")


def fail_on(found: DataFrame, threshold: str) -> DataFrame:
    return found.agg(F.coalesce(F.bool_or(S.severity_rank(F.col("severity")) >= S.SEVERITIES.index(threshold)), F.lit(False)).alias("fails"))


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(S.severity_rank(F.col("severity")).desc(), "path", "line", "column", "rule_id")


def coverage(files: DataFrame, detections: DataFrame) -> DataFrame:
    """How many files were selected, hit, and why others were not; and the status of the whole."""
    kind = sources.disposition(F.col("path"), F.col("size"))
    counts = files.select(kind.alias("d")).groupBy().agg(F.count(F.lit(1)).alias("enumerated"), *(F.count_if(F.col("d") == d).alias(d) for d in ("selected", "excluded_directory", "known_extension", "over_size")))
    hits = detections.agg(F.countDistinct("path").alias("files_with_hits"))
    return counts.crossJoin(hits).withColumn("status", F.when(F.col("enumerated") == 0, "unknown").otherwise("complete_within_scope"))  # one row with one row


def private_ranges(files: DataFrame) -> DataFrame:
    """(path, first, last): lines of key blocks; a block that never ends runs to the line before the next, or the last. Only files with a block are split into lines, and each within its row."""
    begins, ends = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
    held = files.where(F.col("text").rlike(begins)).select("path", F.split("text", "\n").alias("p"))
    held = held.select("path", F.when(F.element_at("p", -1) == "", F.slice("p", F.lit(1), F.size("p") - 1)).otherwise(F.col("p")).alias("p"))
    span = "struct<first:int,last:int>"
    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.array().cast(f"array<{span}>").alias("out"))

    def closed(s: Column, end: Column) -> Column:
        """The spans so far, with the open one, which goes to its end or to the given line."""
        here = F.struct(s["first"].alias("first"), F.when(s["last"] > 0, s["last"]).otherwise(end).alias("last")).cast(span)
        return F.when(s["first"] > 0, F.array_append(s["out"], here)).otherwise(s["out"])

    def step(s: Column, text: Column) -> Column:
        line, b, e = s["line"] + 1, text.rlike(begins), text.rlike(ends)
        last = F.when(b, F.when(e, line).otherwise(0)).when(e & (s["first"] > 0) & (s["last"] == 0), line).otherwise(s["last"])
        return F.struct(line.alias("line"), F.when(b, line).otherwise(s["first"]).alias("first"), last.alias("last"), F.when(b, closed(s, s["line"])).otherwise(s["out"]).alias("out"))

    return held.select("path", F.inline(F.aggregate("p", start, step, lambda s: closed(s, s["line"]))))


def in_private_range(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings inside a key block: an interval semi-join within each file."""
    r = ranges.withColumnRenamed("path", "rpath")
    return found.join(r, (F.col("path") == F.col("rpath")) & F.col("line").between(F.col("first"), F.col("last")), "left_semi")


def merge_intervals(spans: DataFrame, *key: str) -> DataFrame:
    """Overlapping or touching (first, last) of each key as one. Missing ends come last and begin nothing after a known last; a span that ends before it begins is one by itself."""
    by = Window.partitionBy(*key).orderBy(F.asc_nulls_last("first"), F.asc_nulls_last("last"))
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("new", F.when(F.col("first") > F.coalesce(before, F.col("first") - 1), 1).otherwise(0))
    # counted by rows: equal spans may each begin one
    island = F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return starts.withColumn("island", island).groupBy(*key, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def source_snippets(found: DataFrame, rows: DataFrame, around: int = 2) -> DataFrame:
    """Each finding's lines, two before and two after, redacted. Lines are looked up by equality, not by range."""
    wanted = found.select("finding_id", "path", F.col("line").alias("target"), "evidence_type", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line"))
    return _snippets(wanted.join(rows.select("path", "line", "content"), ["path", "line"]))


def file_snippets(found: DataFrame, files: DataFrame, around: int = 2) -> DataFrame:
    """As source_snippets, from whole files: a file meets all its findings once, and only lines near one leave it."""
    places = found.groupBy("path").agg(F.collect_list(F.struct("finding_id", F.col("line").alias("target"), "evidence_type")).alias("places"))
    held = places.join(files.select("path", "text"), "path").select("places", F.split("text", "\n").alias("p"))
    n = F.size("p") - F.when(F.element_at("p", -1) == "", 1).otherwise(0)
    lines_near = lambda f: F.filter(F.sequence(f["target"] - around, f["target"] + around), lambda i: (i > 0) & (i <= n))
    near = F.transform("places", lambda f: F.transform(lines_near(f), lambda i: F.struct(f["finding_id"].alias("finding_id"), f["target"].alias("target"), f["evidence_type"].alias("evidence_type"), i.alias("line"), F.get("p", i - 1).alias("content"))))
    return _snippets(held.select(F.inline(F.flatten(near))).withColumn("content", F.regexp_replace("content", r"\r$", "")))


def _snippets(near: DataFrame) -> DataFrame:
    """(finding_id, lines) of (finding_id, target, evidence_type, line, content)."""
    private = F.col("evidence_type") == "private_key"
    # a column for each step: as one expression, each would be evaluated wherever the next one names it
    near = near.withColumn("content", F.regexp_replace("content", r"\r$", "")).withColumn("clean", F.when(~private, S.redact_text(F.col("content"))))
    text = S.exported_line(F.col("clean"), private)
    each = near.select("finding_id", F.struct("line", text.alias("text"), (F.col("line") == F.col("target")).alias("highlighted")).alias("s"))
    return each.groupBy("finding_id").agg(F.array_sort(F.collect_list("s")).alias("lines"))
