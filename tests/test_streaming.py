"""Scans of a stream: each file once, the same findings as a batch scan."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cipherlake.operators import findings as O
from cipherlake.streaming import incremental as N

SCHEMA = "path string, text string, size long, file_seq long, seen timestamp"


def _put(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("path", "text", "size", "file_seq", "seen"), r))) for r in rows))


def test_files_are_scanned_once(spark, tmp_path):
    arriving = tmp_path / "in"
    arriving.mkdir()
    stream = lambda: spark.readStream.schema(SCHEMA).json(str(arriving))
    rows = [(f"a/{k}/x.js", 'sign("RS256")' if k % 2 else "plain", 20, k, f"2026-01-01T0{k}:10:00") for k in range(6)]
    for part in (rows[:4], rows[4:]):
        _put(arriving, f"{part[0][3]}.json", part)
        N.append_findings(stream(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    N.append_findings(stream(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = sorted(r["finding_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    whole = O.scan(spark, spark.read.schema(SCHEMA).json(str(arriving)))
    assert got == sorted(r["finding_id"] for r in whole.collect()) and len(got) == 3


def test_counts_by_window(spark, tmp_path):
    arriving = tmp_path / "in"
    arriving.mkdir()
    _put(arriving, "a.json", [(f"a/{k}.js", "RS256" if k < 3 else "md5", 5, k, f"2026-01-01T0{k // 2}:10:00") for k in range(5)])
    files = spark.readStream.schema(SCHEMA).json(str(arriving))
    q = N.counts_by_window(files, "seen").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r["h"], r["rule_id"], r["files"]) for r in spark.table("windows").withColumn("h", F.hour("start")).collect())
    assert [x[1:] for x in got] == [("JWT_RSA", 2), ("HASH_MD5", 1), ("JWT_RSA", 1), ("HASH_MD5", 1)]
