"""Queries of certificates and of syntax-aware detection, over files made from documents; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.operators import inventory as I
from cipherlake.plans.queries import _DRAFT, _list, _quoted, BASE, observed, query, table
from cipherlake.sources import certificates as C
from cipherlake.sources import syntax as Y

_NOW = 1_700_000_000  # 2023-11-14


def made(spark, sf_dir, form: str):
    """A certificate for each document: RSA of three sizes or an elliptic curve, valid in one of four ways.

    form: der, pem (two blocks, and one that is broken) or p12."""
    endings = {"der": "der", "pem": "pem", "p12": "p12"}

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for d in b["doc_id"]:
                rsa = d % 4 < 3
                start, end = [("20200101000000Z", "20300101000000Z"), ("20240101000000Z", "20300101000000Z"), ("20100101000000Z", "20200101000000Z"), ("20300101000000Z", "20200101000000Z")][d // 4 % 4]
                der = C.put_certificate("1.2.840.113549.1.1.5" if d % 2 else "1.2.840.113549.1.1.11", "1.2.840.113549.1.1.1" if rsa else "1.2.840.10045.2.1", 1024 * (1 + d % 4), None if rsa else "1.2.840.10045.3.1.7", start, end)
                body = der if form == "der" else C.put_container(der, der) if form == "p12" else f"text\n{C.put_pem(der)}\n-----BEGIN CERTIFICATE-----\nAAAA\n-----END CERTIFICATE-----\n-----BEGIN CERTIFICATE-----\n".encode()
                out.append((f"c/{d}.{endings[form]}", body))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return table(spark, sf_dir, "documents").select("doc_id").mapInPandas(run, "path string, bytes binary")


_MADE = """m AS (SELECT doc_id, doc_id % 4 < 3 AS rsa, CASE WHEN doc_id % 2 = 1 THEN '1.2.840.113549.1.1.5' ELSE '1.2.840.113549.1.1.11' END AS signature_oid, CASE WHEN doc_id % 4 < 3 THEN '1.2.840.113549.1.1.1' ELSE '1.2.840.10045.2.1' END AS key_oid,
    CAST(CASE WHEN doc_id % 4 < 3 THEN 1024 * (1 + doc_id % 4) ELSE 256 END AS INT) AS key_bits, CASE WHEN doc_id % 4 = 3 THEN 'P-256' END AS curve,
    [epoch(TIMESTAMP '2020-01-01'), epoch(TIMESTAMP '2024-01-01'), epoch(TIMESTAMP '2010-01-01'), epoch(TIMESTAMP '2030-01-01')][doc_id // 4 % 4 + 1]::BIGINT AS not_before, [epoch(TIMESTAMP '2030-01-01'), epoch(TIMESTAMP '2030-01-01'), epoch(TIMESTAMP '2020-01-01'), epoch(TIMESTAMP '2020-01-01')][doc_id // 4 % 4 + 1]::BIGINT AS not_after,
    ['valid', 'not_yet_valid', 'expired', 'unknown'][doc_id // 4 % 4 + 1] AS validity FROM documents)"""
_FACTS = "signature_oid, key_oid, key_bits, curve, not_before, not_after"


@query(f"WITH {_MADE} SELECT 'c/' || CAST(doc_id AS VARCHAR) || '.der' AS path, 'complete' AS status, {_FACTS}, CASE WHEN rsa THEN 'null' END AS plain_parameters FROM m")
def det_cert_attributes(spark, sf_dir):
    c = C.certificates(made(spark, sf_dir, "der"))
    return c.select("path", "status", *_FACTS.split(", "), F.when(F.length("parameters") < 64, F.col("parameters")).alias("plain_parameters"))


@query(f"WITH {_MADE}, l AS (SELECT doc_id, key_bits, rsa, CASE WHEN rsa THEN 5 + [4, 7, 9][key_bits // 1024] ELSE 0 END AS n FROM m) SELECT 'c/' || CAST(doc_id AS VARCHAR) || '.pem' AS path, CAST(o AS INT) AS ordinal, CASE o WHEN 0 THEN 'complete' ELSE 'partial' END AS status, CASE o WHEN 0 THEN CAST(2 AS INT) END AS first_line FROM l, range(3) t(o)")
def det_pem_blocks(spark, sf_dir):
    """A whole block, one of no certificate, one without an end."""
    return C.certificates(made(spark, sf_dir, "pem")).select("path", "ordinal", "status", F.when(F.col("ordinal") == 0, F.col("line")).alias("first_line"))


@query(f"WITH {_MADE} SELECT 'c/' || CAST(doc_id AS VARCHAR) || '.p12' AS path, CAST(o AS INT) AS ordinal, 'pkcs12' AS kind, {_FACTS} FROM m, range(2) t(o)")
def det_pkcs12(spark, sf_dir):
    return C.certificates(made(spark, sf_dir, "p12")).select("path", "ordinal", "kind", *_FACTS.split(", "))


@query(f"WITH {_MADE} SELECT 'c/' || CAST(doc_id AS VARCHAR) || '.der' AS path, validity FROM m")
def det_cert_validity(spark, sf_dir):
    return C.certificates(made(spark, sf_dir, "der")).select("path", C.validity(_NOW).alias("validity"))


@query(f"WITH {_MADE} SELECT 'c/' || CAST(doc_id AS VARCHAR) || '.der' AS path, CASE WHEN doc_id % 2 = 1 THEN 'sha1WithRSAEncryption' ELSE 'sha256WithRSAEncryption' END AS signature, CASE WHEN rsa THEN 'RSA' ELSE 'EC' END AS key FROM m")
def fn_cert_names(spark, sf_dir):
    return C.readable(C.certificates(made(spark, sf_dir, "der"))).select("path", "signature", "key")


_CERT_RULES = [("CERT_SHA1", "signature_oid", r"^1\.2\.840\.113549\.1\.1\.5$"), ("CERT_RSA_SMALL", "rsa_modulus_bits", r"^1024$"), ("CERT_EXPIRED", "certificate_validity", "^expired$"), ("CERT_EC", "any", r"\bEC 256 P-256\b"), ("CERT_LONG", "legacy_not_after_2026", ".")]


@query(f"""WITH {_MADE}, r AS (SELECT doc_id, unnest([CASE WHEN doc_id % 2 = 1 THEN {{'r': 'CERT_SHA1', 'm': signature_oid}} END, CASE WHEN rsa AND key_bits = 1024 THEN {{'r': 'CERT_RSA_SMALL', 'm': '1024'}} END, CASE WHEN validity = 'expired' THEN {{'r': 'CERT_EXPIRED', 'm': 'expired'}} END,
    CASE WHEN NOT rsa THEN {{'r': 'CERT_EC', 'm': CASE WHEN doc_id % 2 = 1 THEN 'sha1WithRSAEncryption' ELSE 'sha256WithRSAEncryption' END || ' EC 256 P-256 ' || validity}} END, CASE WHEN not_after >= 1767225600 THEN {{'r': 'CERT_LONG', 'm': 'after_2026'}} END]) AS e FROM m)
    SELECT e.r AS rule_id, 'c/' || CAST(doc_id AS VARCHAR) || '.der' AS path, CAST(0 AS INT) AS ordinal, e.m AS match FROM r WHERE e IS NOT NULL""")
def det_certificate(spark, sf_dir):
    return C.detect(C.certificates(made(spark, sf_dir, "der")), _CERT_RULES, _NOW)


# sources by language; {d} is the document's number
_SOURCES = {
    "js": ("src/{d}.js", 'const alg = "RS256"; // RS512 here\nconst again = alg;\nsign(token{d}, {algorithm: again});\nlet myRS256x = 1;\n'),
    "py": ("src/{d}.py", "import hashlib as h\nfrom jwt import encode as enc\n# md5 in a comment\nx = h.md5(b'a')\nenc(p{d}, k)\n"),
    "java": ("src/{d}.java", '/* getInstance("RSA") */\nString a = "RSA";\nKeyPairGenerator.getInstance(a);\nCipher.getInstance("DES/ECB{d}");\n'),
    "go": ("src/{d}.go", 'package p\nimport (\n\t"crypto/rsa"\n\tx "crypto/md5"\n)\nvar s = "crypto/rsa"\nimport "os"\n'),
    "rs": ("src/{d}.rs", 'let v = "RS256";\nuse rsa::RsaPrivateKey;\nsign(v);\n'),
    "txt": ("src/{d}.txt", "RS256"),
}
_SYNTAX_RULES = [("AST_JWT", "javascript,rust", r"RS(256|384|512)"), ("AST_MD5", "python", r"hashlib\.md5"), ("AST_JWT_CALL", "python", r"jwt\.encode"), ("AST_RSA", "java", r"\bRSA\b"), ("AST_DES", "java", r"\bDES\b"), ("AST_RSA_TYPE", "rust", r"\brsa\b")]


def sources(spark, sf_dir, *kinds: str):
    d = F.col("doc_id").cast("string")
    each = F.array(*(F.struct(F.replace(F.lit(_SOURCES[k][0]), F.lit("{d}"), d).alias("path"), F.replace(F.lit(_SOURCES[k][1]), F.lit("{d}"), d).alias("text")) for k in kinds))
    return table(spark, sf_dir, "documents").select(F.inline(each))


def _expected(rows: list[tuple]) -> str:
    names = ("path", "rule_id", "line", "column", "match", "method")
    value = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"replace({_quoted(x)}, '{{d}}', CAST(doc_id AS VARCHAR))"
    return " UNION ALL ".join("SELECT " + ", ".join(f"CAST({value(x)} AS {'INT' if n in ('line', 'column') else 'VARCHAR'}) AS \"{n}\"" for n, x in zip(names, r)) + " FROM documents" for r in rows)


@query(_expected([
    ("src/{d}.js", "AST_JWT", 1, 14, "RS256", "syntax"), ("src/{d}.js", "AST_JWT", 2, 15, "RS256", "binding"), ("src/{d}.js", "AST_JWT", 3, 26, "RS256", "binding"),
]).replace("CAST(26 AS INT)", "CAST(25 + length(CAST(doc_id AS VARCHAR)) AS INT)"))
def det_facts_js(spark, sf_dir):
    """A string, a name for it, and a name for that name; no comment, and no name that only holds it."""
    return Y.detect(sources(spark, sf_dir, "js", "txt"), _SYNTAX_RULES).select("path", "rule_id", "line", "column", "match", "method")


@query(_expected([("src/{d}.py", "AST_MD5", 4, 5, "hashlib.md5", "call"), ("src/{d}.py", "AST_JWT_CALL", 5, 1, "jwt.encode", "call")]))
def det_py_alias(spark, sf_dir):
    return Y.detect(sources(spark, sf_dir, "py"), _SYNTAX_RULES).select("path", "rule_id", "line", "column", "match", "method")


@query(_expected([("src/{d}.java", "AST_RSA", 2, 13, "RSA", "syntax"), ("src/{d}.java", "AST_RSA", 3, 30, "RSA", "binding"), ("src/{d}.java", "AST_DES", 4, 21, "DES", "syntax")]))
def det_facts_java(spark, sf_dir):
    return Y.detect(sources(spark, sf_dir, "java"), _SYNTAX_RULES).select("path", "rule_id", "line", "column", "match", "method")


@query(_expected([("src/{d}.rs", "AST_JWT", 1, 10, "RS256", "syntax"), ("src/{d}.rs", "AST_RSA_TYPE", 2, 5, "rsa", "syntax"), ("src/{d}.rs", "AST_JWT", 3, 6, "RS256", "binding")]))
def det_facts_rust(spark, sf_dir):
    return Y.detect(sources(spark, sf_dir, "rs"), _SYNTAX_RULES).select("path", "rule_id", "line", "column", "match", "method")


@query("SELECT 'src/' || CAST(doc_id AS VARCHAR) || '.go' AS path, e.p AS import, CAST(e.l AS INT) AS line FROM (SELECT doc_id, unnest([{'p': 'crypto/rsa', 'l': 3}, {'p': 'crypto/md5', 'l': 4}, {'p': 'os', 'l': 7}]) AS e FROM documents)")
def det_go_imports(spark, sf_dir):
    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(p, i, at) for p, t in zip(b["path"], b["text"]) for i, at in Y.go_imports(t)], columns=["path", "import", "line"]).astype({"line": "int32"})

    return sources(spark, sf_dir, "go").mapInPandas(run, "path string, import string, line int")


@query("SELECT doc_id, 'a ' || repeat(' ', 8 + length(CAST(doc_id AS VARCHAR))) || ' b' || chr(10) || repeat(' ', 7) || chr(10) || repeat(' ', 5) || 'RS256' AS view FROM documents")
def det_template_view(spark, sf_dir):
    """Template regions are blank, over lines too, and all places stay."""

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "view": [Y.template_view(f"a {{{{ xx{d} }}}} b\n{{% if x\n y %}}RS256") for d in b["doc_id"]]})

    return table(spark, sf_dir, "documents").select("doc_id").mapInPandas(run, "doc_id long, view string")


@query(BASE + f", {_DRAFT}, k(method, method_name, assurance, usage) AS (VALUES {', '.join(f'({_list((m, *t))})' for m, t in I.METHODS.items())}) SELECT occurrence_key, method_name, assurance, usage FROM keyed JOIN k USING (method)")
def inv_method_triple(spark, sf_dir):
    return I.method_triple(observed(spark, sf_dir)).select("occurrence_key", "method_name", "assurance", "usage")
