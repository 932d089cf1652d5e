"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ten words (the whole item if it has fewer). A window occurs
in a document only if each of its word pairs does, so its rarest pair, by counts over the whole
corpus, is the necessary prefix: documents' pairs are joined with rarest pairs only. The pair's
place in the window bounds the place of the window, which must fit in the document, and the ten
words there are compared exactly. Windows are few by nature; their size is checked, and they
are broadcast up to ``BROADCAST_BYTES``, beyond which pairs are joined by shuffle and checked
against the documents fetched again by id; the result is the same.

Null and empty texts have no words; null and word-free items have no windows. Each document row
gives one row with the hits of its own text, whether its id is null, unique or shared. Empty
tables give no rows and no hits. Extra columns are kept by ``remove`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

WINDOW = 10
#: Windows of up to so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOW), _BETWEEN), lambda w: w != "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window) of each item, distinct."""
    listed = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return listed.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), size).alias("window")).distinct()


def _key(doc_id: Column, text: Column) -> Column:
    """What tells document rows apart: id and text; never null."""
    return F.struct(F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), doc_id.isNull().alias("none"), F.xxhash64(text.cast("string")).alias("text"))


def _pairs(w: Column) -> Column:
    """(place, first, second) of each word pair of w; a lone word pairs with the empty word."""
    return F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(i.alias("at"), F.element_at(w, i).alias("first"), F.element_at(w, i + 1).alias("second")))).otherwise(
        F.array(F.struct(F.lit(1).alias("at"), F.element_at(w, 1).alias("first"), F.lit("").alias("second")))
    )


def _positions(docs: DataFrame) -> DataFrame:
    """Each word of each document with the next one: (doc_id, w, pos from 1, first, second)."""
    listed = docs.select("doc_id", words(F.col("text")).alias("w"))
    return listed.select("doc_id", "w", F.posexplode("w").alias("p", "first")).withColumn("pos", F.col("p") + 1).withColumn("second", F.get("w", F.col("pos")))


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, pos, len): where each window occurs."""
    found = written(windows(items, size), "windows")
    size_of = F.aggregate("window", F.lit(32).cast("long"), lambda a, w: a + F.octet_length(w) + 16)
    small = (found.agg(F.sum(size_of)).first()[0] or 0) <= limit
    hint = F.broadcast if small else (lambda df: df)
    pairs = found.select("item_id", "window", F.inline(_pairs(F.col("window"))))
    keys = pairs.select("first", "second").distinct()
    here = _positions(docs).drop("w").withColumn("second", F.coalesce("second", F.lit("")))
    lone = keys.where(F.col("second") == "")
    counted = here.join(hint(keys.where(F.col("second") != "")), ["first", "second"]).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.join(hint(counted), ["first", "second"], "left")
    # a pair that no document holds is rarest of all: its window occurs nowhere and finds no partner
    rarest = ranked.groupBy("item_id", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "first", "second")).alias("r")).select("item_id", "window", F.col("r.at").alias("at"), F.col("r.first").alias("first"), F.col("r.second").alias("second"))
    rarest = written(rarest, "prefixes")
    several = rarest.where(F.col("second") != "")
    fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.size("window") <= F.size("w"))
    same = F.slice("w", F.greatest(F.col("pos") - F.col("at") + 1, F.lit(1)), F.size("window")) == F.col("window")
    here = _positions(docs)
    out = ["doc_id", "item_id", (F.col("pos") - F.col("at") + 1).alias("pos"), F.size("window").alias("len")]
    if small:
        hits = here.where(F.col("second").isNotNull()).join(F.broadcast(several), ["first", "second"]).where(fits & same).select(*out)
    else:
        near = here.where(F.col("second").isNotNull()).drop("w").join(several, ["first", "second"])
        listed = docs.select("doc_id", words(F.col("text")).alias("w"))
        hits = near.join(listed, "doc_id").where(fits & same).select(*out)
    if not lone.isEmpty():
        single = rarest.where(F.col("second") == "").select("item_id", "first")
        hits = hits.unionByName(here.select("doc_id", "first", "pos").join(hint(single), "first").select("doc_id", "item_id", "pos", F.lit(1).alias("len")))
    return hits


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", _key(F.col("doc_id"), F.col("text")))
    hits = occurrences(docs.select(F.col("key").alias("doc_id"), "text"), items.select("item_id", "text"), size, limit)
    # one row for each document and start, with the longest window and the items there
    starts = hits.groupBy("doc_id", "pos").agg(F.max("len").alias("len"), F.collect_set("item_id").alias("items"))
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1))))
    per = starts.groupBy("doc_id").agg(F.size(covered).cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    rows = docs.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    per = per.select(F.col("doc_id").alias("key"), "n_hit", F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(per, "key", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"), F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    key = "__key"
    narrow = docs.select(_key(F.col("doc_id"), F.col("text")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    leaked = occurrences(narrow, items.select("item_id", "text")).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, _key(F.col("doc_id"), F.col("text"))).join(leaked, key, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: benchmark passages in every document."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, len(w[i:i + 9]) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.doc_id, win.item_id, d.i, win.n
        FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)) d
        JOIN win ON win.n = d.n AND win.s = d.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""
