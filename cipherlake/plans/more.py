"""Queries of what is left: scalar functions over lines, digests, inventories of all kinds, constructors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.functions import algorithms as A
from cipherlake.functions import scalars as S
from cipherlake.operators import findings as O
from cipherlake.operators import inventory as I
from cipherlake.operators import quality as Q
from cipherlake.operators import reports as P
from cipherlake.plans.detectors import _MADE, made
from cipherlake.plans.manifests import manifest
from cipherlake.plans.queries import _FILES, _LINES, BASE, _sql_redact, files, found, query, sql_id, sql_mask, table
from cipherlake.plans.reports import pol_evaluate
from cipherlake.sources import certificates as C
from cipherlake.sources import files as X
from cipherlake.sources import manifests as M
from cipherlake.sources import rules as R
from cipherlake.sources import syntax as Y
from cipherlake.sources.tables import written


@query("SELECT page_id, CAST(page_id % 30 + CASE WHEN page_id % 2 = 0 THEN 4570 ELSE 0 END AS INT) AS code, CASE WHEN page_id % 2 = 0 AND page_id % 30 BETWEEN 17 AND 19 THEN 'hybrid' WHEN page_id % 2 = 1 AND page_id % 30 IN (23, 24, 29) THEN 'classical' ELSE 'unknown' END AS class FROM pages")
def fn_tls_group(spark, sf_dir):
    code = (F.col("page_id") % 30 + F.when(F.col("page_id") % 2 == 0, 4570).otherwise(0)).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", code.alias("code"), A.tls_group(code).alias("class"))


_CUT = "replace(substring(text, greatest(n - 64, 0) + 1, n + 10 + 64 - greatest(n - 64, 0)), chr(10), ' ')"


@query(f"SELECT doc_id, {sql_mask(f'CASE WHEN length({_CUT}) > 180 THEN left({_CUT}, 180) || chr(46) || chr(46) || chr(46) ELSE {_CUT} END')} AS snippet FROM (SELECT doc_id, text, CAST(length(text) // 2 AS INT) AS n FROM documents)")
def fn_snippet(spark, sf_dir):
    at = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", S.snippet(F.col("text"), at, at + 10).alias("snippet"))


@query(f"WITH {_FILES}, {_LINES} SELECT path, line, CASE WHEN line % 5 = 0 THEN '[masked-private-key-material]' WHEN length(c) > 240 THEN left(c, 240) || '...' ELSE c END AS clean FROM (SELECT path, line, {_sql_redact('content')} AS c FROM lines)")
def fn_sanitize_line(spark, sf_dir):
    rows = X.lines(files(spark, sf_dir))
    return rows.select("path", "line", S.sanitize_line(F.col("content"), F.col("line") % 5 == 0).alias("clean"))


@query("SELECT doc_id, '[masked-sensitive-value]' AS secret, 'https://[masked-userinfo]@h.example/' || CAST(doc_id AS VARCHAR) AS url, lang AS plain FROM documents")
def fn_metadata_redact(spark, sf_dir):
    values = F.create_map(F.lit("API-Token"), F.col("doc_id").cast("string"), F.lit("url"), F.concat(F.lit("https://u:p@h.example/"), F.col("doc_id").cast("string")), F.lit("lang"), F.col("lang"))
    clean = table(spark, sf_dir, "documents").select("doc_id", S.redact_metadata(values).alias("m"))
    return clean.select("doc_id", F.col("m")["API-Token"].alias("secret"), F.col("m")["url"].alias("url"), F.col("m")["lang"].alias("plain"))


@query(BASE + "SELECT finding_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level FROM findings")
def fn_severity_to_level(spark, sf_dir):
    return found(spark, sf_dir).select("finding_id", S.sarif_level(F.col("severity")).alias("level"))


@query(BASE + f", l AS (SELECT path, line, {_sql_redact('content')} AS c FROM lines) SELECT finding_id, count(*) AS n, min(l.line) AS first, CAST(count(*) FILTER (WHERE l.line = f.line) AS BIGINT) AS marked, min(CASE WHEN l.line = f.line THEN CASE WHEN evidence_type = 'private_key' THEN '[masked-private-key-material]' WHEN length(c) > 240 THEN left(c, 240) || '...' ELSE c END END) AS text FROM findings f JOIN l ON l.path = f.path AND l.line BETWEEN f.line - 2 AND f.line + 2 GROUP BY finding_id")
def fn_source_snippet(spark, sf_dir):
    """The lines around each finding, redacted, with its own marked."""
    s = O.file_snippets(found(spark, sf_dir), files(spark, sf_dir))
    own = F.filter("lines", lambda x: x["highlighted"])
    return s.select("finding_id", F.size("lines").cast("long").alias("n"), F.col("lines")[0]["line"].alias("first"), F.size(own).cast("long").alias("marked"), own[0]["text"].alias("text"))


@query("""WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, sha256(CAST(doc_id AS VARCHAR) || ':' || source) AS h FROM documents), b AS (SELECT lang, (n - 1) // 100 AS b, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM r GROUP BY 1, 2)
    SELECT lang, sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM b GROUP BY lang""")
def agg_digests(spark, sf_dir):
    """Order-sensitive digests, by blocks of rows."""
    return Q.ordered_digest(table(spark, sf_dir, "documents"), "lang", F.concat_ws(":", F.col("doc_id").cast("string"), "source"), "doc_id", 100)


@query("SELECT CAST(doc_id AS VARCHAR) AS case, round(doc_id % 7 * 2.0 / 4.0, 9) AS ratio, doc_id % 7 * 2.0 > 8 AS signal FROM documents")
def agg_ratio2x(spark, sf_dir):
    """Slowest samples of two runs: which are beyond twice those before."""
    case = F.col("doc_id").cast("string").alias("case")
    d = table(spark, sf_dir, "documents")
    return Q.over_twice(d.select(case, (F.col("doc_id") % 7 * 2.0).alias("slowest")), d.select(case, F.lit(4.0).alias("slowest")), "case")


@query("WITH p AS (SELECT 'x' || CAST(doc_id AS VARCHAR) AS asset_id, CASE WHEN doc_id % 3 = 0 THEN 'fail' ELSE 'indeterminate' END AS decision, 'r' AS reasons, CASE WHEN doc_id % 3 > 0 THEN 'review' WHEN doc_id % 18 = 0 THEN 'high' ELSE 'medium' END AS priority, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'ML-DSA,ML-KEM' ELSE 'SHA-256' END ELSE '' END AS candidates FROM documents) SELECT asset_id, CAST(to_json({'asset_id': asset_id, 'decision': decision, 'reasons': reasons, 'priority': priority, 'candidates': candidates}) AS VARCHAR) AS json FROM p")
def out_assessment(spark, sf_dir):
    return P.as_json(pol_evaluate(spark, sf_dir), "asset_id")


@query("SELECT 'r' || CAST(doc_id AS VARCHAR) AS path, CAST(l AS INT) AS line, CASE l WHEN 2 THEN '1024, F4' ELSE CAST(doc_id AS VARCHAR) END AS arguments FROM documents, (VALUES (2), (4)) t(l)")
def det_ast_rsa_constructor(spark, sf_dir):
    """Constructors in code; none in a comment or a string."""

    def run(batches):
        import pandas as pd

        for b in batches:
            text = lambda d: f"// new RSAKeyGenParameterSpec(1)\nx = new RSAKeyGenParameterSpec(1024,\n  F4);\ny = new  RSAKeyGenParameterSpec({d}); s = \"new RSAKeyGenParameterSpec(3)\";\n"
            rows = [(f"r{d}", at, a) for d in b["doc_id"] for at, a in Y.constructors(text(d), "java", "RSAKeyGenParameterSpec")]
            # the first one's arguments go over a line
            yield pd.DataFrame(rows, columns=["path", "line", "arguments"]).astype({"line": "int32"})

    return table(spark, sf_dir, "documents").select("doc_id").mapInPandas(run, "path string, line int, arguments string")


def _inventory(spark, sf_dir):
    used = table(spark, sf_dir, "documents").select(F.concat(F.lit("alg"), (F.col("doc_id") % 10).cast("string")).alias("match"), F.concat(F.lit("p"), (F.col("doc_id") % 30).cast("string")).alias("path"))
    return I.build(used, C.certificates(made(spark, sf_dir, "der")), M.dependencies(manifest(spark, sf_dir, "requirements.txt", "plain\nPyJWT==2.{id}.0\n")))


@query(
    f"""WITH {_MADE}, o AS (SELECT 'alg' || CAST(doc_id % 10 AS VARCHAR) AS match, 'p' || CAST(doc_id % 30 AS VARCHAR) AS path FROM documents),
    n AS (SELECT {sql_id('algorithm', 'match')} AS id, 'algorithm' AS kind, match AS name FROM o UNION SELECT {sql_id('usage', 'path')}, 'usage', path FROM o UNION SELECT {sql_id('algorithm', 'signature_oid')}, 'algorithm', signature_oid FROM m UNION SELECT {sql_id('algorithm', 'key_oid')}, 'algorithm', key_oid FROM m
    UNION SELECT {sql_id('dependency', "'pypi'", "'plain'", "'unknown'")}, 'dependency', 'plain unknown' UNION SELECT {sql_id('dependency', "'pypi'", "'PyJWT'", "'2.' || CAST(doc_id AS VARCHAR) || '.0'")}, 'dependency', 'PyJWT 2.' || CAST(doc_id AS VARCHAR) || '.0' FROM documents) SELECT id, kind, name FROM n"""
)
def inv_build(spark, sf_dir):
    """All assets whose names SQL can say: those of certificates and keys go by digests."""
    return _inventory(spark, sf_dir)[0].where("kind not in ('certificate', 'public_key')")


@query(f"WITH {_MADE}, o AS (SELECT DISTINCT 'alg' || CAST(doc_id % 10 AS VARCHAR) AS match, 'p' || CAST(doc_id % 30 AS VARCHAR) AS path FROM documents), c AS (SELECT DISTINCT signature_oid, key_oid, key_bits, curve, not_before, not_after FROM m), k AS (SELECT DISTINCT key_oid, key_bits FROM m) SELECT 'uses' AS relationship, count(*) AS n FROM o UNION ALL SELECT 'signature_algorithm', count(*) FROM c UNION ALL SELECT 'subject_key', count(*) FROM c UNION ALL SELECT 'key_algorithm', count(*) FROM k")
def inv_build_relations(spark, sf_dir):
    return _inventory(spark, sf_dir)[1].groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS dangling, CAST(0 AS BIGINT) AS repeated, CAST(1 AS BIGINT) AS planted")
def inv_validate(spark, sf_dir):
    """A whole inventory has no dangling relation and no repeated id; one that is planted is found."""
    nodes, edges = (written(df, name) for df, name in zip(_inventory(spark, sf_dir), ("assets", "relations")))  # each is read several times
    wrong = edges.limit(1).withColumn("dst", F.lit("nowhere"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(I.dangling(edges, nodes), "dangling").crossJoin(count(I.duplicates(nodes), "repeated")).crossJoin(count(I.dangling(wrong, nodes), "planted"))  # one row each


@query("SELECT kind, count(*) AS n FROM (VALUES " + ", ".join(f"('{r.kind}')" for r in R.PACK) + ") t(kind) GROUP BY kind")
def agg_rule_counts_by_kind(spark, sf_dir):
    return R.frame(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
