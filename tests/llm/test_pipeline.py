"""The whole pipeline against plain versions of its stages."""

from __future__ import annotations

import base64

import corpus_pipeline
from cipherlake.llm import byte_bpe, pii, quality
from tests.llm import brute


def test_pipeline_on_the_small_table(spark):
    import tiktoken

    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    verdict = {r["doc_id"]: r["kept"] for r in quality.rate(docs, quality.learn(docs, labels)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if verdict[r["doc_id"]]]
    assert all(not brute.quality_base(t)[-1] for _, t in rows)
    near = brute.near(rows)
    rows = [(d, t) for d, t in rows if near[d][1] == d]
    rows = [(d, t) for d, t in rows if brute.contamination(t, items)[1] == 0]
    plain = dict(rows)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs.where(docs.doc_id.isin([d for d, _ in rows]))).collect()}
    for d, t in clean.items():
        assert not brute.personal(t)
        assert brute.personal(plain[d]) or t == plain[d]
    with open(byte_bpe.vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})
    want = {d: (len(ids := enc.encode_ordinary(t)), brute.sha(",".join(map(str, ids))), brute.sha(t)) for d, t in clean.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and len(want) > 20


def test_stages_keep_the_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.limit(5).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars").unionByName(docs.limit(5)).unionByName(docs.limit(1).selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars"))
    for rows in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, rows, folder)
            assert got.columns == docs.columns, name
            assert got.count() <= rows.count(), name
