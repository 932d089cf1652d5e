"""Observations, assets and their relations, and the checks that hold between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.functions.scalars import native_id

#: How an observation was made, what it is worth, and what it says about use.
METHODS = {"regex": ("text_pattern", "textual", "reference"), "config": ("configuration_pattern", "textual", "configuration"), "ast": ("syntax_node", "syntactic", "reference"), "dependency": ("manifest_entry", "declared", "dependency"), "certificate": ("certificate_field", "parsed", "certificate"), "key": ("key_marker", "textual", "key_material")}


def observations(drafts: DataFrame, scope: Column) -> DataFrame:
    """Drafts (path, rule_id, method, anchor facts, line, column) with anchor, ordinal, confidence and keys.

    The anchor leaves positions out, so moved lines keep it. Anchors that occur more than once in a file are ambiguous."""
    anchor = native_id("anchor", F.col("rule_id"), F.col("method"), F.col("match"))
    d = drafts.withColumn("anchor", anchor)
    by = Window.partitionBy("path", "anchor")
    d = d.withColumn("ordinal", F.row_number().over(by.orderBy("line", "column")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    safe = F.col("path").rlike(r"^[^/\x00-\x1f][^\x00-\x1f]*$") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    key = F.when(scope.isNotNull() & safe, native_id("occurrence", scope, F.col("path"), F.col("anchor"), F.col("ordinal")))
    return d.select("path", "rule_id", "method", "match", "line", "column", "anchor", "ordinal", F.when(F.col("n") > 1, "ambiguous").otherwise("stable").alias("identity_confidence"), key.alias("occurrence_key"))


def assets(observed: DataFrame) -> DataFrame:
    """One algorithm asset for each match text; different facts under one id are marked."""
    a = observed.select(native_id("algorithm", F.col("match")).alias("id"), "match", "method", "path")
    return a.groupBy("id").agg(F.min("match").alias("identifier"), F.count(F.lit(1)).alias("observations"), F.countDistinct("path").alias("files"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"), (F.countDistinct("match") > 1).alias("conflicting_descriptors"))


def relations(observed: DataFrame) -> DataFrame:
    """(src, relationship, dst): each file uses each algorithm once."""
    return observed.select(native_id("usage", F.col("path")).alias("src"), F.lit("uses").alias("relationship"), native_id("algorithm", F.col("match")).alias("dst")).distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti")


def duplicates(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def associate(found: DataFrame, bindings: DataFrame) -> DataFrame:
    """Findings with the sorted ids of the observations bound to the same rule, place and match."""
    keys = ["rule_id", "path", "line", "column", "match"]
    ids = bindings.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("observation_id")), ",").alias("observation_ids"))
    return found.join(ids, keys, "left").select("finding_id", F.coalesce("observation_ids", F.lit("")).alias("observation_ids"))


def losses(bindings: DataFrame, found: DataFrame) -> DataFrame:
    """Observations that no finding stands for, by rule."""
    keys = ["rule_id", "path", "line", "column", "match"]
    return bindings.join(found.select(*keys), keys, "left_anti").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def only_related(edges: DataFrame, kind: str) -> DataFrame:
    """(src, dst) of sources with exactly one relation of the kind."""
    return edges.where(F.col("relationship") == kind).groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.min("dst").alias("dst")).where("c = 1").select("src", "dst")


def method_triple(observed: DataFrame) -> DataFrame:
    """Observations with the name, assurance and usage of the method they were made by."""
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in METHODS.items() for x in (k, v[i]))), F.col("method"))
    return observed.withColumns({n: pick(i) for i, n in enumerate(("method_name", "assurance", "usage"))})


def build(observed: DataFrame, certificates: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assets, relations) of an inventory: algorithms, usages, certificates with their keys, and dependencies.

    assets: id, kind, name; relations: src, relationship, dst. An id that came with several names keeps the least of them."""
    algorithm, usage = native_id("algorithm", F.col("match")), native_id("usage", F.col("path"))
    certificate, key = native_id("certificate", F.col("sha256")), native_id("public_key", F.col("key_sha256"))
    dependency = native_id("dependency", F.col("ecosystem"), F.col("name"), F.col("version"))
    signature, key_algorithm = native_id("algorithm", F.col("signature_oid")), native_id("algorithm", F.col("key_oid"))
    known = certificates.where("sha256 is not null")
    asset = lambda id_, kind, name: F.struct(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"))
    edge = lambda src, kind, dst: F.struct(src.alias("src"), F.lit(kind).alias("relationship"), dst.alias("dst"))
    # all rows of a source come from one pass over it
    rows = lambda df, *of: df.select(F.inline(F.array(*of)))
    nodes = [
        rows(observed, asset(algorithm, "algorithm", F.col("match")), asset(usage, "usage", F.col("path"))),
        rows(known, asset(certificate, "certificate", F.col("sha256")), asset(key, "public_key", F.col("key_sha256")), asset(signature, "algorithm", F.col("signature_oid")), asset(key_algorithm, "algorithm", F.col("key_oid"))),
        rows(dependencies, asset(dependency, "dependency", F.concat_ws(" ", "name", "version"))),
    ]
    edges = [rows(observed, edge(usage, "uses", algorithm)), rows(known, edge(certificate, "signature_algorithm", signature), edge(certificate, "subject_key", key), edge(key, "key_algorithm", key_algorithm))]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(nodes).groupBy("id", "kind").agg(F.min("name").alias("name")), union(edges).distinct()
