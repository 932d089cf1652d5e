"""Queries of encodings, places, paths and checks, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.plans.manifests import manifest
from cipherlake.plans.queries import _FILES, BASE, _quoted, files, found, query, sql_id, table
from cipherlake.functions import scalars as S
from cipherlake.sources import files as X
from cipherlake.sources import manifests as M
from cipherlake.sources import texts as T

#: How a document's bytes are written, by its number.
_FORMS = ("UTF-8", "UTF-16LE", "UTF-16BE", "marked UTF-16LE", "marked UTF-8", "binary")


def encoded(spark, sf_dir):
    text, k = F.concat(F.lit("plain ascii head "), F.coalesce("lang", F.lit("")), F.lit(" tail")), F.col("doc_id") % len(_FORMS)
    raw = F.when(k == 0, F.encode(text, "UTF-8")).when(k == 1, F.encode(text, "UTF-16LE")).when(k == 2, F.encode(text, "UTF-16BE")).when(k == 3, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(k == 4, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("0001FFFE00")), F.encode(text, "UTF-8")))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("f/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".der").otherwise(".txt")).alias("path"), raw.alias("bytes"))


_ENCODED = "e AS (SELECT doc_id, doc_id % 6 AS k, 'f/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 4 = 0 THEN '.der' ELSE '.txt' END AS path, 'plain ascii head ' || coalesce(lang, '') || ' tail' AS text FROM documents)"


@query(f"WITH {_ENCODED} SELECT path, CASE WHEN k < 5 THEN text END AS text, ['utf-8', 'utf-16-le', 'utf-16-be', 'utf-16-le', 'utf-8', 'binary'][k + 1] AS encoding FROM e")
def src_decode_text(spark, sf_dir):
    return T.decoded(encoded(spark, sf_dir))


@query(f"WITH {_ENCODED} SELECT path FROM e WHERE k = 5 AND doc_id % 4 <> 0")
def src_non_text(spark, sf_dir):
    d = T.decoded(encoded(spark, sf_dir))
    return d.where(T.non_text(F.col("path"), F.col("text"), F.col("encoding"))).select("path")


@query("SELECT doc_id, CAST(octet_length(encode(left(text, n))) AS BIGINT) AS utf8, CAST(2 + 2 * length(left(text, n)) + 2 * length(regexp_replace(left(text, n), '[^\\x{10000}-\\x{10ffff}]', '', 'g')) AS BIGINT) AS utf16 FROM (SELECT doc_id, text, CAST(length(text) // 3 AS INT) AS n FROM documents WHERE text IS NOT NULL)")
def src_offset_map(spark, sf_dir):
    at = F.floor(F.length("text") / 3).cast("int")
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", T.byte_offset(F.col("text"), at).alias("utf8"), T.byte_offset(F.col("text"), at, "UTF-16LE", 2).alias("utf16"))


@query(f"WITH {_FILES}, p AS (SELECT path, 'x/' || path AS q FROM files) SELECT path, (q LIKE '%.js' OR q LIKE '%/keys/%' OR q LIKE 'x/%/de/%') AND NOT q LIKE '%/old.pem' AS ignored FROM p")
def src_walk_ignore(spark, sf_dir):
    """Ignore lines: by name, a folder anywhere, an anchored path, and one that takes back."""
    return files(spark, sf_dir).select("path", T.ignored(F.concat(F.lit("x/"), "path"), ["# note", "*.js", "keys/", "/x/**/de/**", "!old.pem", ""]).alias("ignored"))


@query(f"WITH {_FILES} SELECT path, regexp_replace(path, '/[^/]+/[^/]+$', '') || '/etc/site.conf' AS other FROM files WHERE path LIKE '%/etc/site.conf'")
def src_repo_context(spark, sf_dir):
    """A file reached from itself by way of its parent's folder."""
    f = files(spark, sf_dir)
    return T.beside(f, f.where("path like '%/etc/site.conf'").select("path", F.lit("../etc/./site.conf").alias("relative"))).select("path", "other")


@query("SELECT 'g' || CAST(doc_id % 20 AS VARCHAR) AS folder, string_agg(p, ',' ORDER BY p) AS paths FROM (SELECT doc_id, 'g' || CAST(doc_id % 20 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.gemspec' AS p, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY 'g' || CAST(doc_id % 20 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.gemspec') AS n FROM documents WHERE doc_id % 3 > 0) WHERE n <= 4 GROUP BY 1")
def src_siblings(spark, sf_dir):
    d = F.col("doc_id")
    f = table(spark, sf_dir, "documents").select(F.concat(F.lit("g"), (d % 20).cast("string"), F.lit("/"), d.cast("string"), F.when(d % 3 > 0, ".gemspec").otherwise(".rb")).alias("path"))
    return T.siblings(f, "gemspec", 4)


_ID = sql_id("algorithm", "CAST(doc_id AS VARCHAR)")


@query("SELECT doc_id, ['valid', 'malformed', 'dangling_reference', 'repeated_id', 'invalid_id'][doc_id % 5 + 1] AS status, CAST(doc_id % 5 = 0 AS INT) AS assets, CAST(doc_id % 5 = 0 AS INT) AS observations FROM documents")
def src_inventory_json(spark, sf_dir):
    """Inventories: whole, cut off, with a reference to nothing, with an id twice, with an id of another form."""
    d, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    name = F.when(k == 4, F.lit("plain")).otherwise(S.native_id("algorithm", d))
    asset = F.struct(name.alias("id"), d.alias("identifier"))
    whole = F.to_json(F.struct(F.lit("r").alias("run"), F.when(k == 3, F.array(asset, asset)).otherwise(F.array(asset)).alias("assets"), F.array(F.struct(d.alias("id"), F.array(F.when(k == 2, "gone").otherwise(name)).alias("asset_ids"))).alias("observations")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 1, F.left(whole, F.lit(20))).otherwise(whole).alias("body"))
    return T.read_inventory(rows, "doc_id", "body")


@query(f"SELECT doc_id, doc_id % 2 = 0 AS id_ok, doc_id % 3 > 0 AS sha_ok, doc_id % 4 = 1 AS oid_ok FROM documents WHERE {_ID} IS NOT NULL")
def pred_identifiers(spark, sf_dir):
    d, k = F.col("doc_id").cast("string"), F.col("doc_id")
    name, digest = S.native_id("algorithm", d), F.sha2(d, 256)
    oid = F.when(k % 4 == 0, F.concat(d, F.lit("."))).when(k % 4 == 1, F.concat(F.lit("1.2."), d)).when(k % 4 == 2, d).otherwise(F.concat(F.lit("1.x."), d))
    return table(spark, sf_dir, "documents").select("doc_id", T.valid_id(F.when(k % 2 == 0, name).otherwise(F.upper(name)), "algorithm").alias("id_ok"), T.is_sha256(F.when(k % 3 > 0, digest).otherwise(F.concat(digest, F.lit("0")))).alias("sha_ok"), T.is_oid(oid).alias("oid_ok"))


#: Names and versions with what the grammars say: (ecosystem, name, valid, version, exact, resolved).
_GRAMMAR = (
    ("npm", "@scope/kit", True, "1.2.3", True, True), ("npm", "a/b", False, "01.2.3", True, False), ("npm", "left-pad", True, "1.2.3-rc.1+b", True, True), ("npm", "..", False, "^1.2.3", False, False), ("maven", "g:a", True, "1.2+x", True, False), ("maven", "a", False, "1.x", False, False),
    ("golang", "example.org/a/b", True, "1.2.3-0.2020", True, True), ("golang", "/abs", False, "1..2", False, False), ("gem", "rails", True, "7.0.1", True, True), ("gem", "a b", False, "7.0-1", True, False), ("pypi", "PyJWT", True, "2.0.0.", False, False), ("cargo", "serde_json", True, "1.0", True, False),
)
_CASES = ", ".join(f"('{e}', '{n}', {str(v).lower()}, '{w}', {str(x).lower()}, {str(r).lower()}, {i})" for i, (e, n, v, w, x, r) in enumerate(_GRAMMAR))


@query(f"SELECT doc_id, ecosystem, name, valid, version, exact, resolved FROM documents JOIN (VALUES {_CASES}) t(ecosystem, name, valid, version, exact, resolved, k) ON k = doc_id % {len(_GRAMMAR)}")
def pred_dependency_grammar(spark, sf_dir):
    def run(batches):
        import pandas as pd

        for b in batches:
            cases = [_GRAMMAR[d % len(_GRAMMAR)] for d in b["doc_id"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ecosystem": [c[0] for c in cases], "name": [c[1] for c in cases], "valid": [M.valid_name(c[1], c[0]) for c in cases], "version": [c[3] for c in cases], "exact": [M.exact(c[3]) for c in cases], "resolved": [M.resolved(c[0], c[3]) for c in cases]})

    return table(spark, sf_dir, "documents").select("doc_id").mapInPandas(run, "doc_id long, ecosystem string, name string, valid boolean, version string, exact boolean, resolved boolean")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array('TLSv1 TLSv1;xTLSv1 TLSv1.1 ' || lang || ' TLSv1', '[\\s;,]'), lambda x: x = 'TLSv1')) AS n FROM documents")
def det_regex_delim_reuse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.delimited(F.concat(F.lit("TLSv1 TLSv1;xTLSv1 TLSv1.1 "), "lang", F.lit(" TLSv1")), "TLSv1").alias("n"))


@query("""WITH l AS (SELECT 'app/' || CAST(doc_id AS VARCHAR) || '/go.mod' AS path, unnest([{'l': 1, 'b': NULL}, {'l': 2, 'b': NULL}, {'l': 3, 'b': 'require'}, {'l': 4, 'b': 'require'}, {'l': 5, 'b': NULL}, {'l': 6, 'b': NULL}, {'l': 7, 'b': NULL}, {'l': 8, 'b': 'replace'}, {'l': 9, 'b': NULL}]) AS e FROM documents) SELECT path, CAST(e.l AS INT) AS line, CAST(e.b AS VARCHAR) AS block FROM l""")
def win_block_state(spark, sf_dir):
    m = manifest(spark, sf_dir, "go.mod", "module x{id}\nrequire (\n\ta v1\n\tb v2\n)\ngo 1.21\nreplace (\n\ta => ../a\n)\n").withColumn("file_seq", F.lit(0))
    return T.block_state(X.lines(m)).select("path", "line", "block")


_WORDS = (("JWT_RSA", "ja", "トークンの RSA 署名"), ("HASH_MD5", "ja", "破られたハッシュ"))


@query(BASE + f"SELECT finding_id, CASE rule_id {' '.join(f'WHEN {_quoted(r)} THEN {_quoted(t)}' for r, _, t in _WORDS)} ELSE (SELECT description FROM rules r WHERE r.rule_id = f.rule_id) END AS description FROM findings f")
def fn_localize(spark, sf_dir):
    words = spark.createDataFrame([*_WORDS, ("JWT_RSA", "en", "RSA")], "rule_id string, lang string, text string")
    return T.localized(found(spark, sf_dir), words, "ja").select("finding_id", "description")
