"""Assets assessed: certificates by their roles, how sure an assessment is, and the review policy over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asset_support(observations: DataFrame) -> DataFrame:
    """(asset_id, observation_id): each observation supports each of its assets once."""
    return observations.select(F.explode(F.array_distinct("asset_ids")).alias("asset_id"), "observation_id").distinct()


def certainty(support: DataFrame, observations: DataFrame) -> DataFrame:
    """(asset_id, certainty): unknown if all that supports an asset is of unknown assurance."""
    joined = support.join(observations.select("observation_id", "assurance"), "observation_id")
    return joined.groupBy("asset_id").agg(F.when(F.every(F.col("assurance") == "unknown"), "unknown").otherwise("uncalibrated_static_evidence").alias("certainty"))


def certificate_roles(certificates: DataFrame, components: DataFrame, now: int | None) -> DataFrame:
    """(id, exposure, parameters_known, concerns) of certificates from those of their signature and their key.

    certificates: id, not_before, not_after; components: id, role, purpose, exposure, parameters_known, concern."""
    mismatch = F.bool_or((F.col("role") == "certificate_signature") & ~F.col("purpose").isin("signature", "unknown"))
    parts = components.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("exposure") == "vulnerable").alias("bad"), F.every(F.col("exposure") == "designed_resistant").alias("good"),
        F.every("parameters_known").alias("known"), F.array_sort(F.collect_set("concern")).alias("found"), mismatch.alias("mismatch"),
    )
    rows = certificates.join(parts, "id", "left")
    both, start, end = F.coalesce(F.col("n") == 2, F.lit(False)), F.col("not_before"), F.col("not_after")
    wrong = F.coalesce("mismatch", F.lit(False))
    exposure = F.when(wrong, "unknown").when(F.coalesce("bad", F.lit(False)), "vulnerable").when(both & F.col("good"), "designed_resistant").otherwise("unknown")
    at = F.lit(now).cast("long")
    validity = F.when(start > end, "invalid_certificate_validity_interval").when(at.isNull() | start.isNull() | end.isNull(), "certificate_validity_unknown").when(at < start, "certificate_not_yet_valid").when(at > end, "certificate_expired")
    concerns = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array(F.when(wrong, "certificate_signature_purpose_mismatch"), validity)))))
    settled = both & F.coalesce("known", F.lit(False)) & ~wrong & ~F.coalesce(validity == "certificate_validity_unknown", F.lit(False))
    return rows.select("id", exposure.alias("exposure"), settled.alias("parameters_known"), F.array_join(concerns, ",").alias("concerns"))


def priority(decision: Column, exposure: Column, concerns: Column) -> Column:
    """high for what is known to fall to both, medium for one of them, else review."""
    return F.when((decision == "fail") & (exposure == "vulnerable") & (concerns != ""), "high").when(decision == "fail", "medium").otherwise("review")


def evaluate(decided: DataFrame, candidates: DataFrame) -> DataFrame:
    """(asset_id, decision, reasons, priority, candidates) of every assessed asset."""
    listed = candidates.groupBy("identifier").agg(F.array_join(F.array_sort(F.collect_set("candidate")), ",").alias("candidates"))
    joined = decided.join(listed, "identifier", "left")
    return joined.select("asset_id", "decision", "reasons", priority(F.col("decision"), F.col("exposure"), F.col("concerns")).alias("priority"), F.when(F.col("decision") == "fail", F.coalesce("candidates", F.lit(""))).otherwise("").alias("candidates"))


def bind_target(drafts: DataFrame, inspected: Column) -> DataFrame:
    """Drafts whose target is another file than the inspected one lose their facts and say so."""
    off = ~F.col("target").eqNullSafe(inspected)
    return drafts.withColumns({"facts": F.when(~off, F.col("facts")), "capture_status": F.when(off, "target_mismatch").otherwise(F.col("capture_status")), "target": inspected})


def dependency_assertion(found: DataFrame) -> DataFrame:
    """(path, name, declared, resolved, capture_status): versions as far as they may be stated.

    A locked version is stated if it is exact, a declared one if it is plain; what comes from elsewhere has none."""
    elsewhere = F.col("origin").isin("path", "git", "archive", "workspace_inherited")
    status = F.when(elsewhere, "version_not_asserted").when(F.col("resolved").isNotNull(), "resolved").when(F.col("declared").isNotNull(), "declared").otherwise("version_unknown")
    return found.select("path", "name", F.when(~elsewhere, F.col("declared")).alias("declared"), F.when(~elsewhere, F.col("resolved")).alias("resolved"), status.alias("capture_status"))


def audit_findings(reports: DataFrame) -> DataFrame:
    """(report, kind, advisory, package): vulnerabilities and warnings of dependency audits in one list; a report whose count disagrees is marked.

    reports: report, count, vulnerabilities and warnings as arrays of (advisory, package)."""
    each = F.concat(F.transform("vulnerabilities", lambda v: F.struct(F.lit("vulnerability").alias("kind"), v["advisory"].alias("advisory"), v["package"].alias("package"))), F.transform("warnings", lambda v: F.struct(F.lit("warning").alias("kind"), v["advisory"].alias("advisory"), v["package"].alias("package"))))
    return reports.select("report", (F.col("count") == F.size("vulnerabilities")).alias("consistent"), F.inline(each))
