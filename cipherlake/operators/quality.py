"""Measuring detection against labelled truth, and performance samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_truth(predictions: DataFrame, units: DataFrame) -> DataFrame:
    """Predictions (pred_id, path, rule_id, line, column, dep_name) with the unit they fall into, or none.

    A unit is a rule's half-open column interval on one line; a prediction without a line is matched by dependency name."""
    u = units.select("unit_id", F.col("path").alias("u_path"), F.col("rule_id").alias("u_rule"), F.col("line").alias("u_line"), "start_column", "end_column", "dependency_name")
    placed = predictions.where("line > 0").join(u, F.expr("path = u_path and rule_id = u_rule and line = u_line and column >= start_column and column < end_column"), "left")
    named = predictions.where("line = 0").join(u, F.expr("path = u_path and rule_id = u_rule and dep_name = dependency_name"), "left")
    out = ["pred_id", "path", "rule_id", "line", "column", "unit_id"]
    return placed.select(*out).unionByName(named.select(*out))


def first_match(matched: DataFrame) -> DataFrame:
    """``hit`` for the first prediction of each unit; later ones and those outside any unit are not."""
    by = Window.partitionBy("unit_id").orderBy("line", "column", "pred_id")
    inside = matched.where("unit_id is not null").withColumn("hit", F.row_number().over(by) == 1)
    return inside.unionByName(matched.where("unit_id is null").withColumn("hit", F.lit(False)))


def ratio(part: Column, whole: Column) -> Column:
    """NULL, never 0 or 1, where the whole is empty."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 9)


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn and excluded from (label, predicted); labels other than positive and negative are excluded."""
    yes, no, said = F.col("label") == "positive", F.col("label") == "negative", F.col("predicted")
    count = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy(*by).agg(count(yes & said, "tp"), count(no & said, "fp"), count(yes & ~said, "fn"), count(no & ~said, "tn"), count(~(yes | no), "excluded"))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, false-positive and false-negative rate."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)})


def stratify(rows: DataFrame, *strata: str) -> DataFrame:
    """Rates of every value of every stratum, in one pass by grouping sets."""
    long = rows.select("label", "predicted", F.explode(F.array(*(F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata))).alias("x")).select("label", "predicted", "x.*")
    return rates(confusion(long, "stratum", "value"))


def nonregression(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Changes of tp, fp and fn by group; worse with fewer tp, more fp or more fn."""
    names = ("tp", "fp", "fn")
    b = before.select(F.col(key).alias("b_key"), *(F.col(n).alias(f"b_{n}") for n in names))
    both = b.join(after.select(key, *names), F.col("b_key") == F.col(key), "full")
    change = {n: F.coalesce(n, F.lit(0)) - F.coalesce(f"b_{n}", F.lit(0)) for n in names}
    worse = (change["tp"] < 0) | (change["fp"] > 0) | (change["fn"] > 0)
    return both.select(F.coalesce(key, "b_key").alias(key), *(change[n].alias(f"d_{n}") for n in names), worse.alias("regressed"))


def rule_coverage(rows: DataFrame, key: str = "rule_id") -> DataFrame:
    """Verified, Partial, Unknown, Unsupported or Not Tested for each rule, from its labelled cases."""
    n = lambda label, said=None: F.count_if((F.col("label") == label) & (F.lit(True) if said is None else F.col("predicted") == F.lit(said)))
    c = rows.groupBy(key).agg(n("positive").alias("p"), n("positive", True).alias("tp"), n("negative").alias("q"), n("negative", True).alias("fp"), n("unsupported").alias("u"), n("ambiguous").alias("a"))
    good = (F.col("p") > 0) & (F.col("q") > 0) & (F.col("tp") == F.col("p")) & (F.col("fp") == 0)
    return c.select(key, F.when(good, "Verified").when((F.col("p") + F.col("q")) > 0, "Partial").when(F.col("u") > 0, "Unsupported").when(F.col("a") > 0, "Unknown").otherwise("Not Tested").alias("coverage"))


def distribution(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Least, median and greatest value; NULL where any is missing."""
    whole = F.count_if(F.col(value).isNull()) == 0
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.when(whole, f(value)), 9).alias(k) for k, f in (("least", F.min), ("median", F.median), ("greatest", F.max))))


def throughput(rows: DataFrame, *by: str) -> DataFrame:
    """Units per second over successful samples, and whether the greatest time is over twice that of ``before``."""
    ok = F.col("exit_code") == 0
    return rows.groupBy(*by).agg(F.count_if(ok).alias("samples"), F.count_if(~ok).alias("failures"), ratio(F.sum(F.when(ok, F.col("units"))), F.sum(F.when(ok, F.col("seconds")))).alias("per_second"), F.round(F.max(F.when(ok, F.col("seconds"))), 9).alias("slowest"))


def over_twice(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    b = before.select(key, F.col("slowest").alias("was"))
    return now.join(b, key).select(key, ratio(F.col("slowest"), F.col("was")).alias("ratio"), (F.col("slowest") > 2 * F.col("was")).alias("signal"))


def digests(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A digest that depends on no order of rows, and the number of rows. Rows are hashed where they are; only sums meet."""
    h = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256)
    part = lambda k: F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(part(k)).cast("string").alias(f"sum_{k}") for k in range(2)))


def ordered_digest(rows: DataFrame, key: str, row: Column, order: str, block: int = 1000) -> DataFrame:
    """(key, digest): depends on the order of a group's rows. Digests of blocks of rows are digested again, so only digests of blocks meet."""
    ranked = rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("_n"), F.sha2(row, 256).alias("_h"))

    def together(part: DataFrame, *by: str) -> DataFrame:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_h"))), lambda x: x["_h"])
        return part.groupBy(key, *by).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("_h"))

    blocks = together(ranked.withColumn("_b", F.floor((F.col("_n") - 1) / block)), "_b").withColumnRenamed("_b", "_n")
    return together(blocks).select(key, F.col("_h").alias("digest"))
