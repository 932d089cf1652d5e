"""Two inventories compared. Absence is never read as removal: what is only in one run stays unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.sources.tables import written


def diff_assets(before: DataFrame, after: DataFrame, key: str = "id", facts: str = "facts") -> DataFrame:
    """(key, status): unchanged, changed, added, or unresolved for what only the earlier run has."""
    b = before.select(F.col(key).alias("b_key"), F.col(facts).alias("b_facts"))
    both = b.join(after.select(key, facts), F.col("b_key") == F.col(key), "full")
    status = F.when(F.col("b_key").isNull(), "added").when(F.col(key).isNull(), "unresolved").when(F.col("b_facts").eqNullSafe(F.col(facts)), "unchanged").otherwise("changed")
    return both.select(F.coalesce(key, "b_key").alias(key), status.alias("status"))


def diff_occurrences(before: DataFrame, after: DataFrame, key: str = "occurrence_key", facts: str = "facts") -> DataFrame:
    """As diff_assets for rows with a key; rows without one, on either side, are unresolved as they are."""
    keyed = diff_assets(before.where(F.col(key).isNotNull()), after.where(F.col(key).isNotNull()), key, facts)
    loose = lambda df: df.where(F.col(key).isNull()).select(F.lit(None).cast("string").alias(key), F.lit("unresolved").alias("status"))
    return keyed.select(F.col(key).cast("string").alias(key), "status").unionByName(loose(before)).unionByName(loose(after))


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Candidates for moved occurrences (anchor, occurrence_key, path, signature).

    Anchors must be alone on both sides, counted before anything is filtered; paths differ, and neither key is known to the other side."""
    one = lambda df, p: df.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("occurrence_key").alias(f"{p}_key"), F.min("path").alias(f"{p}_path"), F.min("signature").alias(f"{p}_sig")).where("c = 1").drop("c")
    pairs = one(before, "old").join(one(after, "new"), "anchor").where("old_path <> new_path and old_sig <=> new_sig")
    known = lambda df, name: df.where("occurrence_key is not null").select(F.col("occurrence_key").alias(name)).distinct()
    return pairs.join(known(after, "old_key"), "old_key", "left_anti").join(known(before, "new_key"), "new_key", "left_anti").select("anchor", "old_key", "new_key", "old_path", "new_path")


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


#: Fields of a run whose change makes two runs less comparable.
DRIFT = ("scope", "rules_digest", "profile", "scanner_version", "catalog_version", "coverage_status", "options_digest")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: which fields of the two run records differ. Either side is one row."""
    b = before.select(*(F.col(c).alias(f"b_{c}") for c in DRIFT))
    changed = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in DRIFT)), lambda x: x.isNotNull())
    return b.crossJoin(after).select(F.array_join(changed, ",").alias("changed"), F.size(changed).alias("n"))  # one row with one row


def key_union(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return before.select(key).union(after.select(key)).distinct()


def reviewed(results: DataFrame, allowances: DataFrame) -> DataFrame:
    """Results without those that a review allows: rule, place and digest agree, and the number of results there is exactly the reviewed one."""
    keys = ["path", "digest", "rule_id", "line", "column"]
    counts = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    allowed = counts.join(allowances.select(*keys, F.col("count").alias("allowed")), keys).where("found = allowed").select(*keys)
    return results.join(allowed, keys, "left_anti")


def closure(edges: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """(root, node): everything reachable over (src, dst), cycles too. Semi-naive rounds, each a written table, until one finds nothing new; more than ``rounds`` is an error."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    reach = new = written(roots.select(F.col("node").alias("root"), "node").distinct(), "reach")
    done = 0
    while not new.isEmpty():
        if rounds is not None and done > rounds:
            raise ValueError(f"nodes further away than {rounds} edges")
        step = new.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        known = reach.select(F.col("root").alias("r"), F.col("node").alias("n"))
        new = written(step.join(known, F.col("root").eqNullSafe(F.col("r")) & F.col("node").eqNullSafe(F.col("n")), "left_anti"), "reach")
        reach = reach.union(new)  # a union of written tables: no work is repeated
        done += 1
    return reach
