"""Scans of files as they arrive. Detection keeps no state, so the batch operators run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cipherlake.operators import findings as O
from cipherlake.sources import files as X
from cipherlake.sources import rules as R


def detections(files: DataFrame, rules: tuple[R.Rule, ...] = R.PACK) -> DataFrame:
    """The matches in a stream of files (path, text, size, file_seq)."""
    return O.detect(X.select_files(files), rules)


def counts_by_window(files: DataFrame, seen_at: str, width: str = "1 hour", late: str = "1 hour", rules: tuple[R.Rule, ...] = R.PACK) -> DataFrame:
    """Matches by rule and time window of arrival; files later than ``late`` are left out by the watermark."""
    marked = files.withWatermark(seen_at, late)
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike(r.pattern), F.lit(r.id)) for r in R.validate(list(rules)))))
    return marked.select(F.window(seen_at, width).alias("w"), F.explode(hit).alias("rule_id")).groupBy("w", "rule_id").agg(F.count(F.lit(1)).alias("files")).select(F.col("w.start").alias("start"), "rule_id", "files")


def append_findings(files: DataFrame, folder: str, checkpoint: str, rules: tuple[R.Rule, ...] = R.PACK) -> StreamingQuery:
    """Write the findings of all files that are there now, and of each only once however often this is called: the checkpoint knows them."""
    frame = R.frame(files.sparkSession, rules)

    def write(batch: DataFrame, number: int) -> None:
        found = O.findings(O.detect(X.select_files(batch), rules), frame)
        found.write.mode("overwrite").parquet(f"{folder}/batch={number}")  # a batch that is run again replaces itself

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
