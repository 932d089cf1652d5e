"""Findings of the third review: each test failed before."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cipherlake.functions import algorithms as A
from cipherlake.operators import findings as O
from cipherlake.plans import more, queries
from cipherlake.sources import files as X
from cipherlake.sources import manifests as M
from tests.oracle import compare, connect


@pytest.mark.parametrize("odd", ["missing", "negative"])
def test_merged_intervals_of_odd_spans_equal_their_sql(spark, tmp_path, odd):
    """rows without an end, or whose end is before their begin, some of them twice."""
    ends = [None, 3, 40, None, 3, 3] if odd == "missing" else [-7, -7, 40, -49, -7, 3]
    rows = [(k, 10 * i % 30 if odd == "negative" or ((k or 4) + i) % 4 else None, ends[((k or 4) + i) % 6], i) for k in (1, 2, 3, None) for i in range(12) for _ in range(2)]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    pq.write_table(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))}), tmp_path / "lineitem.parquet")
    name = "win_merge_intervals"
    assert compare(entry.queries()[name](spark, str(tmp_path)), entry.oracle_sql()[name], connect(str(tmp_path))) == ""


SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parents_of_more_projects_than_a_recursion_may_have_rows(spark):
    """at most spark.sql.cteRecursionRowLimit rows, a million, came out of the recursion."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        name = "dep_maven_parent"
        assert compare(entry.queries()[name](spark, SMALL), entry.oracle_sql()[name], connect(SMALL)) == ""
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_parents_end_at_sixteen_levels_and_at_cycles(spark):
    parent = "<project><parent><groupId>g</groupId><artifactId>a</artifactId><version>1</version>{}</parent><properties><p{}>{}</p{}><all>{}</all></properties></project>"
    deep = [("/".join("d" * k) + "/pom.xml" if k else "pom.xml", parent.format("", k, k, k, k)) for k in range(21)]
    ring = [(f"{a}/pom.xml", parent.format(f"<relativePath>../{b}/pom.xml</relativePath>", a, a, a, a)) for a, b in (("x", "y"), ("y", "x"))]
    got = {r["path"]: r["inherited"] for r in M.inherited_properties(spark.createDataFrame(deep + ring, "path string, text string")).collect()}
    lowest = got["/".join("d" * 20) + "/pom.xml"]
    assert sorted(lowest) == sorted(["all", *(f"p{k}" for k in range(4, 20))]) and lowest["all"] == "19"
    assert got["x/pom.xml"] == {"px": "x", "py": "y", "all": "y"}


def test_inventory_reads_each_source_once(spark):
    """every kind of asset and relation was a pass of its own over the certificates, and validation made the inventory five times."""
    nodes, edges = more._inventory(spark, SMALL)
    assert plan(nodes).count("MapInArrow") == 2 and plan(edges).count("MapInArrow") == 1  # certificates and dependencies; certificates
    assert "MapIn" not in plan(entry.queries()["inv_validate"](spark, SMALL))


def test_truth_match_and_sarif_document_scan_once(spark):
    """F4, F8: both read the findings several times, each time by a scan of their own."""
    for name in ("join_truth_match", "out_sarif_document"):
        assert "RLIKE" not in plan(entry.queries()[name](spark, SMALL)).upper()


def test_recognition_does_not_cut_texts_into_tokens(spark):
    """nearly all tokens are no names."""
    text = "RS256 xRS256 RS256-x ml-kem-768,MlKem768;ML-KEM_RSA\nRSA_ _RSA RSA.Ed25519é ML-KEM-768x ML-KEM"
    got = spark.createDataFrame([(text,), ("",), (None,), ("RSA",)], "text string").select(A.algorithms_in(F.col("text")).alias("a"))
    assert [r["a"] for r in got.collect()] == [["Ed25519", "ML-KEM", "ML-KEM-768", "RS256", "RSA"], [], None, ["RSA"]]
    assert "split(" not in plan(got)


def test_snippets_send_no_lines_through_a_shuffle(spark):
    """all lines of all files were joined with the findings."""
    query, scan = entry.queries()["fn_source_snippet"](spark, SMALL), queries.found(spark, SMALL)
    assert plan(query).count("posexplode") == plan(scan).count("posexplode")
    texts = [("a/1.js", "one\r\n\ntwo\r\r\nRS256\n"), ("a/2.js", "RS256"), ("a/3.js", "\n\n\nRS256\n\n"), ("b/3.js", "none\n")]
    files = spark.createDataFrame([(p, t, len(t), k) for k, (p, t) in enumerate(texts)], "path string, text string, size long, file_seq long")
    found = O.scan(spark, files)
    rows = lambda df: sorted((r["finding_id"], [tuple(x) for x in r["lines"]]) for r in df.collect())
    assert rows(O.file_snippets(found, files)) == rows(O.source_snippets(found, X.lines(files)))


def test_lock_files_are_read_by_the_compiled_loader(spark, monkeypatch):
    """the loader in Python took most of the time, and a pattern was compiled for each name."""
    import yaml

    if not yaml.__with_libyaml__:
        pytest.skip("no libyaml here")
    monkeypatch.setattr(yaml, "SafeLoader", None)
    lock = "lockfileVersion: '9.0'\npackages:\n  jose@5.1.1:\n    resolution: {integrity: x}\n"
    assert [tuple(i)[:5] for i in M.items("pnpm-lock.yaml", lock)[0]] == [("jose", "5.1.1", "npm", "pkg:npm/jose@5.1.1", 3)]
    old = lambda text, key: M.only_line(text, r"""["']?""" + re.escape(key) + r"""["']?\s*[:=]""")
    for text in ("a: 1\nb: 2\na b: 3", "xa = 1\n", "a\n: 1", "'a' : 1, a=2\nb", "a a a: 1\n\na", "a:\r\nb\r\na :", 'aa: 1\n"a" \t: 2', ""):
        for key in ("a", "b", "a b", "aa", "a\nb", ":", ""):
            assert M._keyed(text, key) == old(text, key), (text, key)
