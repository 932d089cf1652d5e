"""What the near-duplicate operator shuffles."""

from __future__ import annotations

import random

from cipherlake.llm import near_dup
from tests.llm import brute


def _shuffled(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_texts_that_are_not_compared_are_not_shuffled(spark, tmp_path):
    """Confirming a few near copies does not send the other texts through a shuffle, and loses no link."""
    rng = random.Random(5)
    text = lambda: " ".join(f"{rng.getrandbits(40):x}" for _ in range(3000))
    rows = [(k, text()) for k in range(400)]
    rows += [(1000 + k, f"{rows[k][1]} more words {k}") for k in range(10)] + [(None, rows[0][1] + " nameless"), (2000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs, before = spark.read.parquet(f"{tmp_path}/docs"), _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.report(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    named = [(d, t) for d, t in rows if d is not None]
    want = brute.near(named)
    assert {d: got[d][1] for d, _ in named} == {d: want[d][1] for d, _ in named}
    assert got[1003][1] == 3 and not got[1003][2] and got[None][1] == 0 and not got[None][2]
    assert _shuffled(spark) - before < sum(len(t or "") for _, t in rows) / 2
