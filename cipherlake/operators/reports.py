"""Findings, assets and changes as documents for others. Everything passes ``sanitise`` first; a document is rows of JSON or lines, so none is gathered in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.functions import scalars as S
from cipherlake.operators.findings import is_inventory
from cipherlake.sources.tables import written


def sanitise(found: DataFrame, *columns: str) -> DataFrame:
    """Free text of a result, redacted, before any writer sees it."""
    return found.withColumns({c: S.redact_text(F.col(c)) for c in columns})


def finding_json(found: DataFrame) -> DataFrame:
    """(finding_id, json): a finding of the plain report."""
    place = F.struct(F.col("path").alias("file"), "line", "column")
    evidence = F.struct(F.col("evidence_type").alias("type"), "match")
    return found.select("finding_id", F.to_json(F.struct("finding_id", "rule_id", "category", "risk", "severity", "migration_hint", place.alias("location"), evidence.alias("evidence"))).alias("json"))


def sarif_column(path: Column, method: Column, before: Column, column: Column) -> Column:
    """A column that SARIF may state: one from a syntax tree counts bytes, so only where what stands before is ASCII."""
    return F.when(~method.isin("ast", "tree_sitter") | ~F.coalesce(before, F.lit("ÿ")).rlike(r"[^\x00-\x7f]"), column)


def sarif_results(found: DataFrame) -> DataFrame:
    """(finding_id, json): a result of SARIF 2.1.0."""
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.greatest("column", F.lit(1)).alias("startColumn"))
    physical = F.struct(F.struct(S.path_to_uri(F.col("path")).alias("uri")).alias("artifactLocation"), region.alias("region"))
    body = F.struct(
        F.col("rule_id").alias("ruleId"), S.sarif_level(F.col("severity")).alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(F.struct(physical.alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("finding_id").alias("cipherlake/v1")).alias("partialFingerprints"), F.struct("category", "risk", "severity").alias("properties"),
    )
    return found.select("finding_id", F.to_json(body).alias("json"))


def sarif_rules(found: DataFrame) -> DataFrame:
    """(rule_id, json): each rule that was hit, with the text of its first finding."""
    first = found.groupBy("rule_id").agg(F.min_by(F.struct("description", "migration_hint"), F.struct("path", "line", "column")).alias("f"))
    return first.select("rule_id", F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("f.description").alias("text")).alias("shortDescription"), F.struct(F.col("f.migration_hint").alias("text")).alias("help"))).alias("json"))


def sarif_lines(found: DataFrame, tool: str = "cipherlake") -> DataFrame:
    """(part, key, line): a whole SARIF document by lines; sorted by part and key and written as text, its files in order are the document."""
    # read for the rules, the results and the first of each: scanned once
    found = written(found.select("finding_id", "rule_id", "category", "risk", "severity", "migration_hint", "description", "path", "line", "column"), "findings")
    rules, results = sarif_rules(found).select(F.col("rule_id").alias("key"), "json"), sarif_results(found).select(F.col("finding_id").alias("key"), "json")
    spark = found.sparkSession

    def listed(rows: DataFrame, part: int) -> DataFrame:
        first = rows.agg(F.min("key").alias("first"))  # one row
        return rows.crossJoin(F.broadcast(first)).select(F.lit(part).alias("part"), "key", F.concat(F.when(F.col("key") != F.col("first"), ",").otherwise(""), F.col("json")).alias("line"))

    frame = [
        (0, "", f'{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":['), (2, "", ']}},"results":['), (4, "", "]}]}"),
    ]
    return spark.createDataFrame(frame, "part int, key string, line string").unionByName(listed(rules, 1)).unionByName(listed(results, 3))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text, in order over the files. Spark's committer replaces the target only when all tasks are done."""
    lines.orderBy("part", "key").select("line").write.mode("overwrite").text(path)


def cyclonedx_components(assets: DataFrame, observations: DataFrame) -> DataFrame:
    """(id, json): each algorithm asset as a component of CycloneDX 1.7, with where it was seen first and how often."""
    seen = observations.groupBy("asset_id").agg(F.min(F.struct("path", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    body = F.struct(
        F.lit("cryptographic-asset").alias("type"), F.col("id").alias("bom-ref"), F.col("identifier").alias("name"), F.struct(F.lit("algorithm").alias("assetType")).alias("cryptoProperties"),
        F.struct(F.array(F.struct(F.col("first.path").alias("location"), F.col("first.line").alias("line"))).alias("occurrences")).alias("evidence"),
        F.array(F.struct(F.lit("cipherlake:occurrences").alias("name"), F.coalesce("n", F.lit(0)).cast("string").alias("value"))).alias("properties"),
    )
    return assets.join(seen, assets["id"] == seen["asset_id"]).select("id", F.to_json(body).alias("json"))


def cyclonedx_observations(assets: DataFrame, observations: DataFrame) -> DataFrame:
    """(id, path, line): the observations that a component stands for."""
    return observations.join(assets.select("id"), observations["asset_id"] == F.col("id")).select("id", "path", "line")


def cyclonedx_losses(assets: DataFrame, observations: DataFrame) -> DataFrame:
    """(reason, n): what the document cannot hold: all but the first place of a component, and observations without one."""
    kept = cyclonedx_observations(assets, observations).groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n")).select(F.lit("occurrence_not_listed").alias("reason"), "n")
    lost = observations.join(assets.select("id"), observations["asset_id"] == F.col("id"), "left_anti").select(F.lit("no_component").alias("reason"), F.lit(1).cast("long").alias("n"))
    return kept.unionByName(lost).groupBy("reason").agg(F.sum("n").alias("n")).where("n > 0")


def _cell(value: Column) -> Column:
    return F.replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown(groups: DataFrame) -> DataFrame:
    """(rule_id, line): a table row for each rule."""
    return groups.select("rule_id", F.concat(F.lit("| "), F.concat_ws(" | ", *(_cell(F.col(c)) for c in ("severity", "rule_id", "occurrences", "files", "risks"))), F.lit(" |")).alias("line"))


def escaped(value: Column) -> Column:
    out = value.cast("string")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def html(groups: DataFrame) -> DataFrame:
    """(rule_id, line): a table row for each rule, nothing in it markup but its own."""
    return groups.select("rule_id", F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *(escaped(F.col(c)) for c in ("severity", "rule_id", "occurrences", "files", "risks"))), F.lit("</td></tr>")).alias("line"))


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): every row as a record: inventories, changes, assessments and diagnostics."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns))).alias("json"))


def ordered_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(S.severity_rank(F.col("severity")).desc(), "rule_id")


def ordered_occurrences(found: DataFrame) -> DataFrame:
    return found.orderBy("path", "line", "column", "finding_id")


def page(groups: DataFrame, number: int, size: int = 20) -> DataFrame:
    """A page of the rules of a report, counted from 0."""
    return ordered_groups(groups).offset(number * size).limit(size)


def matching(found: DataFrame, mode: str = "all", severity: str | None = None, risk: str | None = None, rule: str | None = None, path: str | None = None, text: str = "") -> DataFrame:
    """The filters of a report, all of which must hold; text is looked for in rule, description and file, in any case."""
    out = found if mode == "all" else found.where(is_inventory() if mode == "inventory" else ~is_inventory())
    for name, value in (("severity", severity), ("risk", risk), ("rule_id", rule), ("path", path)):
        out = out.where(F.col(name) == value) if value is not None else out
    return out.where(F.contains(F.lower(F.concat_ws(" ", "rule_id", "description", "path")), F.lit(text.lower()))) if text else out


def common_actions(actions: DataFrame) -> DataFrame:
    """(rule_id, actions): what is recommended for every finding of a rule. actions: (rule_id, finding_id, action)."""
    all_of = actions.groupBy("rule_id").agg(F.countDistinct("finding_id").alias("all"))
    each = actions.groupBy("rule_id", "action").agg(F.countDistinct("finding_id").alias("n"))
    return each.join(all_of, "rule_id").where("n = all").groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list("action")), ",").alias("actions"))


def self_scan_summary(found: DataFrame, limit: int = 100) -> DataFrame:
    """The most frequent (file, rule, level)."""
    return found.groupBy("path", "rule_id", S.sarif_level(F.col("severity")).alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path", "rule_id", "level").limit(limit)


def mask_sensitive(cbom: DataFrame, sensitive: DataFrame) -> DataFrame:
    """CBOM rows whose place, category and match a sensitive finding has, masked; the others as they are."""
    keys = ["location", "usage_type", "algorithm"]
    marked = sensitive.select(*keys).distinct().withColumn("_masked", F.lit(True))
    return cbom.join(marked, keys, "left").withColumn("algorithm", F.when(F.col("_masked"), S.PRIVATE_MATERIAL).otherwise(F.col("algorithm"))).select(*cbom.columns)


def unassociated(observations: DataFrame, links: DataFrame) -> DataFrame:
    return observations.join(links.select("observation_id").distinct(), "observation_id", "left_anti")


def span_dedup(hits: DataFrame) -> DataFrame:
    """One hit for each rule, file and span: the one of the most specific method."""
    first = Window.partitionBy("rule_id", "path", "line", "start", "stop").orderBy("method")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
