"""The library's own functions against literals, and awkward input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cipherlake.functions import documents as D
from cipherlake.functions import scalars as S
from cipherlake.operators import diff
from cipherlake.operators import findings as O
from cipherlake.operators import reports as P
from cipherlake.sources import certificates as C
from cipherlake.sources import files as X
from cipherlake.sources import manifests as M
from cipherlake.sources import rules as R
from cipherlake.sources import syntax as Y
from cipherlake.sources import texts as T


def test_redaction_of_credentials(spark):
    """What must go, with the literal that stands for it."""
    v = "[masked-sensitive-value]"
    cases = {
        "password='CANARY'": f"password='{v}'",
        r'api_key="CANARY\"TAIL"': f'api_key="{v}"',
        "Authorization: Bearer CANARY": f"Authorization: Bearer {v}",
        "https://u:CANARY@host.example/path?token=CANARY&mode=read": f"https://[masked-userinfo]@host.example/path?token={v}&mode=read",
        "AWS_SECRET_ACCESS_KEY=CANARY": f"AWS_SECRET_ACCESS_KEY={v}",
        '{"my-key-material": "CANARY", "x": 1}': f'{{"my-key-material": "{v}", "x": 1}}',
        "client_secret = 'it is token: CANARY';": f"client_secret = '{v}';",
        "apikey:CANARY, secret_key=CANARY2": f"apikey:{v}, secret_key={v}",
        "x BEGIN RSA PRIVATE KEY y": "[masked-private-key-material]",
        "  MII" + "A" * 70: "[masked-sensitive-content]",
        "B" * 70 + "=": "[masked-sensitive-content]",
    }
    same = ["RS256", "1.2.840.113549.1.1.11", "key_bits=2048", "private_key_algorithm=RSA", 'const token = jwt.sign(payload, privateKey, { algorithm: "RS256" });', "const token = await signWithPqc(payload);", "https://host.example/docs?version=1.2.3", "PUBLIC_NAME_" + "a1" * 40, "password", "", "token: new"]
    rows = [(k, w) for k, w in cases.items()] + [(k, k) for k in same]
    got = spark.createDataFrame(rows, "text string, want string").withColumn("got", S.redact_text(F.col("text"))).withColumn("twice", S.redact_text(F.col("got"))).collect()
    for r in got:
        assert r["got"] == r["want"] and r["twice"] == r["got"] and "CANARY" not in r["got"]
    for name in ("password", "passwd", "secret", "token", "api_key", "apikey", "api_token", "access_token", "client_secret", "private_key", "key_material", "authorization", "secret_key", "secret_access_key"):
        row = spark.range(1).select(S.secret_name(F.lit(name)).alias("a"), S.secret_name(F.lit(f"PREFIX-{name.upper()}")).alias("b"), S.secret_name(F.lit(f"{name}x")).alias("c")).first()
        assert row["a"] and row["b"] and not row["c"]
    assert spark.range(1).select(S.redact_text(F.lit(None).cast("string")).alias("x")).first()["x"] is None


def test_no_canary_reaches_a_sink(spark):
    files = spark.createDataFrame([("a/b/x.js", 'let password = "CANARYCANARY"; sign("RS256")', 60, 1)], "path string, text string, size long, file_seq long")
    found = O.scan(spark, files).withColumn("migration_hint", F.lit("token=CANARY1"))
    clean = P.sanitise(found, "migration_hint", "match", "description")
    for out in (P.finding_json(clean), P.sarif_results(clean), P.sarif_rules(clean), P.sarif_lines(clean), P.as_json(clean, "finding_id")):
        rows = out.collect()
        assert rows and not any("CANARY" in str(r) for r in rows)
    lines = O.source_snippets(found, X.lines(files)).collect()
    assert lines and "CANARY" not in str(lines)


def test_sarif_document_is_json(spark, tmp_path):
    import json

    files = spark.createDataFrame([(f"a/{k}/x.js", 'sign("RS256")', 20, k) for k in range(5)], "path string, text string, size long, file_seq long")
    P.write_lines(P.sarif_lines(O.scan(spark, files)), str(tmp_path / "out"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    run = json.loads(text)["runs"][0]
    assert len(run["results"]) == 5 and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["JWT_RSA"]


def test_closure_of_a_long_chain_and_a_cycle(spark):
    """Nodes far away are reached; a bound that is too small is an error."""
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(20)] + [("20", "18")], "src string, dst string")
    roots = spark.createDataFrame([("0",)], "node string")
    assert sorted(int(r["node"]) for r in diff.closure(edges, roots).collect()) == list(range(21))
    with pytest.raises(ValueError):
        diff.closure(edges, roots, 5)


def test_manifests_that_are_not_what_they_say():
    for name in M.FORMATS:
        for text in ("", "{", "[[", "<a>", "\x00", "null", "[]", "a: &x 1\nb: *x"):
            assert M.items(f"a/{name}", text)[0] == [] or name == "requirements.txt"  # there a word is a name
    assert M.items("x/package.json", '{"dependencies": {"../up": "1", "ok": "2"}}') == ([M.Item("ok", "2", "npm", "pkg:npm/ok", 1, "manifest", "2", None, "manifest")], "partial")
    many = "\n".join(f"p{k}==1.0" for k in range(M.MOST_ITEMS + 1))
    found, status = M.items("requirements.txt", many)
    assert len(found) == M.MOST_ITEMS and status == "truncated"
    assert M.items("pom.xml", '<!DOCTYPE a [<!ENTITY x "y">]><project>&x;</project>') == ([], "partial")
    assert M.read_package_url("pkg:npm/%40s/kit@1.0") == ("npm", "@s/kit", "1.0") and M.read_package_url("pkg:npm/a/b/c") is None and M.read_package_url("pkg:npm/%zz") is None
    assert M.package_url("maven", "g:a", "1.0") == "pkg:maven/g/a@1.0"


def test_certificates_cut_short():
    der = C.put_certificate("1.2.840.113549.1.1.11", "1.2.840.113549.1.1.1", 2048, None, "20200101000000Z", "20300101000000Z")
    assert C.facts(der).key_bits == 2048 and C.facts(der).parameters == "null"
    for size in range(len(der)):
        got = C.read_file("x.der", der[:size])
        assert got == [] if size == 0 else all(f is None for _, _, f in got)
    assert [bool(f) for _, _, f in C.read_file("x.p12", C.put_container(der, der))] == [True, True]
    assert C.read_file("x.p12", b"junk")[0][2] is None
    assert [(at, label, content is not None) for at, label, content in C.pem_blocks("-----BEGIN A-----\nAAAA\n-----END B-----\n-----BEGIN C-----\nAAAA\n-----END C-----")] == [(1, "A", False), (4, "C", True)]


def test_syntax():
    rules = [("R", "*", r"RS256")]
    assert Y.hits("// RS256\nx = 'RS256'; RS256x; a.RS256", "javascript", rules)[0] == [Y.Hit("R", 2, 6, "RS256", "syntax"), Y.Hit("R", 2, 24, "RS256", "syntax")]
    assert Y.hits("x = = 'RS256'", "python", rules)[1] == "partial" and Y.hits("", "go", rules) == ([], "complete") and Y.hits("RS256", "go", [("R", "java", "RS256")]) == ([], "not_applicable")
    assert Y.bindings("let a = 'x'; let a = 'y'; let b = c; let c = b;", "javascript") == {}
    assert Y.python_calls("import a.b as c\nd = c\nd.e()\ndef c(): pass\n") == [("c.e", 3, 1)]


def test_encodings_and_contexts():
    for name, mark in (("utf-16-le", b"\xff\xfe"), ("utf-32-be", b"\0\0\xfe\xff"), ("utf-8", b"\xef\xbb\xbf")):
        assert T.decode(mark + "naïve 😀".encode(name)) == ("naïve 😀", name)
    assert T.decode(b"\xff\xfea") == (None, "utf-16-le") and T.decode(b"a\xffb")[0] == "a�b" and T.decode(b"") == ("", "utf-8")
    assert T.decode("plain words".encode("utf-32-le")) == ("plain words", "utf-32-le") and T.decode(bytes(range(256)))[0] is None
    assert T.read_context('{"version": 1, "runtime": true, "pki": null}')["runtime"] is True
    for bad in ("{", "[]", '{"version": 2}', '{"version": 1, "SECRET": 1}', '{"version": 1, "pki": "yes"}', " " * 20_000):
        with pytest.raises(ValueError) as e:
            T.read_context(bad)
        assert "SECRET" not in str(e.value)


def test_ignore_lines():
    import re

    hit = lambda line, path: bool(re.search(T.ignore_pattern(line)[0], path))
    assert hit("*.log", "a/b.log") and not hit("*.log", "a/b.logs") and hit("/bin", "bin/x") and not hit("/bin", "a/bin") and hit("a/**/z", "a/z") and hit("a/**/z", "a/b/c/z") and hit("d/", "x/d/e") and not hit("d/", "x/d") and hit("?.c", "q.c")
    assert T.ignore_pattern("# c") is None and T.ignore_pattern("!keep")[1]


def test_handshakes():
    whole = D.write_kexinit({"kex": ["a", "b"], "mac_in": ["m"]})
    assert D.read_kexinit(whole)["kex"] == ["a", "b"] and D.read_kexinit(whole)["mac_out"] == []
    assert all(D.read_kexinit(whole[:n]) is None for n in range(len(whole)))
    assert D.read_kexinit(D.write_kexinit({"kex": ["x" * 65]})) is None and D.read_kexinit(D.write_kexinit({"kex": ["x"] * 257})) is None


def test_rules_all_or_none():
    good = {"id": "A", "kind": "regex", "category": "c", "severity": "low", "risk": "quantum-safe", "confidence": 0.5, "migration_hint": "m", "pattern": "a"}
    text = "- " + "\n  ".join(f"{k}: {v}" for k, v in good.items())
    assert [r.id for r in R.parse_yaml([text])] == ["A"]
    for change in (("pattern: a", "pattern: '('"), ("confidence: 0.5", "confidence: 2"), ("kind: regex", "kind: other"), ("id: A", "id: ' '")):
        with pytest.raises(ValueError):
            R.parse_yaml([text.replace(*change)])
    with pytest.raises(ValueError):
        R.parse_yaml([text, text])


def test_key_blocks(spark):
    b, e = "-----BEGIN EC PRIVATE KEY-----", "-----END EC PRIVATE KEY-----"
    texts = {"one": f"a\n{b}\nx\n{e}\nz", "open": f"{b}\nx\ny\n", "two": f"{b}\n{b}\nx\n{e}\n{e}\n{b}{e}", "none": "a\nb"}
    files = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "path string, text string, file_seq int")
    got = sorted((r["path"], r["first"], r["last"]) for r in O.private_ranges(files).collect())
    assert got == [("one", 2, 4), ("open", 1, 3), ("two", 1, 1), ("two", 2, 4), ("two", 6, 6)]
    masked = {r["path"]: r["m"] for r in files.select("path", D.mask_private_blocks(F.col("text")).alias("m")).collect()}
    assert masked["none"] == texts["none"] and masked["one"].count(S.PRIVATE_MATERIAL) == 3 and "x" not in masked["two"]
