"""How far an inspection got: statuses of detectors, diagnostics, coverage and the checks that hold among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code, stage, disposition and message of each diagnostic.
DIAGNOSTICS = (
    ("read_failed", "read", "failed", "File contents could not be read."),
    ("detector_failed", "detection", "failed", "Detector execution failed."),
    ("detector_not_reported", "detection", "not_reported", "Detector does not report internal inspection completeness."),
    ("detector_unsupported", "detection", "unsupported", "A required inspection is unsupported by the detector."),
    ("detector_partial", "detection", "partial", "Detector completed only part of the inspection."),
    ("detector_truncated", "detection", "truncated", "Detector reached an inspection limit; omitted results are not counted."),
    ("no_detectors", "detection", "not_reported", "No detectors were supplied for selected files."),
    ("excluded_path", "enumeration", "excluded_by_policy", "Path is excluded by the default scan policy."),
    ("file_too_large", "enumeration", "excluded_by_policy", "File exceeds the configured size limit."),
    ("metadata_failed", "enumeration", "failed", "File metadata could not be read; the entry was not selected."),
    ("enumeration_failed", "enumeration", "failed", "A repository entry could not be enumerated."),
)
#: Counters of files by how their inspection ended.
ENDS = ("analyzed", "partial", "failed", "unsupported", "unknown", "not_applicable")


def status_fold(outcomes: DataFrame) -> DataFrame:
    """(path, disposition) from (path, status, hits) of every detector. What was partly inspected is partial, whatever else went well."""
    has = lambda *names: F.bool_or(F.col("status").isin(*names))
    marks = outcomes.groupBy("path").agg(
        has("complete").alias("complete"), has("partial", "truncated").alias("partial"), has("failed").alias("failed"),
        has("unsupported").alias("unsupported"), has("not_reported").alias("unknown"), (F.sum("hits") > 0).alias("found"),
    )
    stopped, usable = F.col("failed") | F.col("unsupported"), F.col("complete") | F.col("found")
    end = F.when(F.col("partial") | (stopped & usable), "partial").when(F.col("failed"), "failed").when(F.col("unsupported"), "unsupported")
    return marks.select("path", end.when(F.col("unknown"), "unknown").when(F.col("complete"), "analyzed").otherwise("not_applicable").alias("disposition"))


def diagnostics(outcomes: DataFrame) -> DataFrame:
    """(code, file, detector) of every outcome that needs one, each once. Not reporting is a matter of the detector, not of a file."""
    said = outcomes.where(F.col("status").isin("failed", "unsupported", "partial", "truncated", "not_reported"))
    code = F.concat(F.lit("detector_"), F.col("status"))
    return said.select(code.alias("code"), F.when(F.col("status") != "not_reported", F.col("path")).alias("file"), "detector").distinct()


def explained(found: DataFrame) -> DataFrame:
    """Diagnostics with stage, disposition and message: the dimension is a constant."""
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(d, ("c", "stage", "disposition", "message")))) for d in DIAGNOSTICS))
    d = F.filter(rows, lambda r: r["c"] == F.col("code"))[0]
    return found.select("code", "file", "detector", d["stage"].alias("stage"), d["disposition"].alias("disposition"), d["message"].alias("message"))


def by_code(found: DataFrame) -> DataFrame:
    """By code: how many, in how many files, and the first three of these."""
    # distinct files first, so that no list of all of them is gathered: each partial list keeps three
    counted = found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))
    first = found.where("file is not null").groupBy("code", "file").agg(F.lit(1).alias("one")).groupBy("code", F.pmod(F.xxhash64("file"), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_set("file")), 1, 3).alias("some"))
    examples = first.groupBy("code").agg(F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, 3), ",").alias("examples"))
    return counted.join(examples, "code", "left").select("code", "n", "files", F.coalesce("examples", F.lit("")).alias("examples"))


def coverage(ends: DataFrame, read_failed: Column | None = None) -> DataFrame:
    """One row: files by how they ended, and the status of the whole."""
    counts = ends.groupBy().agg(F.count(F.lit(1)).alias("selected_files"), *(F.count_if(F.col("disposition") == e).alias(f"{e}_files") for e in ENDS), F.count_if(F.col("disposition") == "read_failed").alias("read_failed_files"))
    read_ok = F.col("selected_files") - F.col("read_failed_files")
    failed, short = F.col("failed_files") + F.col("read_failed_files"), F.col("partial_files") + F.col("unsupported_files")
    status = F.when((failed > 0) & (read_ok == F.col("failed_files")), "failed").when((failed > 0) | (short > 0), "partial").when(F.col("unknown_files") > 0, "unknown").otherwise("complete_within_scope")
    return counts.withColumn("read_ok_files", read_ok).withColumn("status", status)


def require_complete(covered: DataFrame) -> DataFrame:
    return covered.select((F.col("status") == "complete_within_scope").alias("complete"))


def partition_check(covered: DataFrame) -> DataFrame:
    """Every selected file was read or not, and every read one ended in one way."""
    ends = sum((F.col(f"{e}_files") for e in ENDS[1:]), F.col(f"{ENDS[0]}_files"))
    return covered.select((F.col("selected_files") == F.col("read_ok_files") + F.col("read_failed_files")).alias("selection_holds"), (F.col("read_ok_files") == ends).alias("ends_hold"))


def rates(covered: DataFrame, enumerated: Column) -> DataFrame:
    """Shares of a population and what is left of it; null where there is nothing to share."""
    applicable = F.col("read_ok_files") - F.col("not_applicable_files")
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 9)
    return covered.select(share(F.col("selected_files"), enumerated).alias("enumeration"), share(applicable, F.col("read_ok_files")).alias("applicability"), share(F.col("analyzed_files"), applicable).alias("completion"))


def detector_counts(outcomes: DataFrame, kind: Column) -> DataFrame:
    """Outcomes by format, detector and status; a detector that reports twice on a file counts as a duplicate."""
    once = outcomes.groupBy("path", kind.alias("format"), "detector", "status").agg(F.count(F.lit(1)).alias("c"))
    return once.groupBy("format", "detector", "status").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("c") > 1).cast("long")).alias("duplicates"))
