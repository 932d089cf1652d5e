"""Queries of reports, diagnostics, advice and assessed assets, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherlake.functions import documents as T
from cipherlake.functions import scalars as S
from cipherlake.operators import advice as V
from cipherlake.operators import assets as A
from cipherlake.operators import diagnostics as G
from cipherlake.operators import findings as O
from cipherlake.operators import reports as P
from cipherlake.plans.queries import _EXT, _FILES, _RANK, BASE, _list, _quoted, _sql_redact, files, found, query, sql_id, table
from cipherlake.sources import files as X

_TEXT = "(SELECT description FROM rules r WHERE r.rule_id = f.rule_id)"
_URI = "replace(replace(replace(url_encode(path), '%2F', '/'), '%7E', '~'), '*', '%2A')"
_LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"


@query(BASE + "SELECT finding_id, CAST(to_json({'finding_id': finding_id, 'rule_id': rule_id, 'category': category, 'risk': risk, 'severity': severity, 'migration_hint': migration_hint, 'location': {'file': path, 'line': line, 'column': col}, 'evidence': {'type': evidence_type, 'match': match}}) AS VARCHAR) AS json FROM findings")
def out_json(spark, sf_dir):
    return P.finding_json(P.sanitise(found(spark, sf_dir), "migration_hint"))


@query(
    BASE
    + f"""SELECT finding_id, CAST(to_json({{'ruleId': rule_id, 'level': {_LEVEL}, 'message': {{'text': {_TEXT}}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': {_URI}}}, 'region': {{'startLine': line, 'startColumn': col}}}}}}],
    'partialFingerprints': {{'cipherlake/v1': finding_id}}, 'properties': {{'category': category, 'risk': risk, 'severity': severity}}}}) AS VARCHAR) AS json FROM findings f"""
)
def out_sarif(spark, sf_dir):
    return P.sarif_results(found(spark, sf_dir))


@query(BASE + f"SELECT rule_id, CAST(to_json({{'id': rule_id, 'shortDescription': {{'text': {_TEXT}}}, 'help': {{'text': min(migration_hint)}}}}) AS VARCHAR) AS json FROM findings f GROUP BY rule_id")
def agg_sarif_rules(spark, sf_dir):
    return P.sarif_rules(found(spark, sf_dir))


@query(BASE + ", l AS (SELECT 1 AS part, count(DISTINCT rule_id) AS n FROM findings UNION ALL SELECT 3, count(*) FROM findings UNION ALL SELECT unnest([0, 2, 4]), 1) SELECT CAST(part AS INT) AS part, n, greatest(n - 1, 0) * CAST(part IN (1, 3) AS BIGINT) AS commas FROM l")
def out_sarif_document(spark, sf_dir):
    """The document by lines: how many of each part, and that all list entries but the first follow a comma."""
    lines = P.sarif_lines(found(spark, sf_dir))
    return lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("line").startswith(",") & F.col("part").isin(1, 3)).alias("commas"))


@query(BASE + f"SELECT finding_id, {_sql_redact('match')} AS match, {_sql_redact('migration_hint')} AS migration_hint FROM findings")
def sink_sanitize(spark, sf_dir):
    return P.sanitise(found(spark, sf_dir), "match", "migration_hint").select("finding_id", "match", "migration_hint")


def _assets(spark, sf_dir):
    seen = found(spark, sf_dir).select(S.native_id("algorithm", F.col("match")).alias("asset_id"), "match", "path", "line", "rule_id")
    kept = seen.where("rule_id <> 'JWT_RSA'").select(F.col("asset_id").alias("id"), F.col("match").alias("identifier")).distinct()
    return kept, seen


_ASSETS = f", o AS (SELECT {sql_id('algorithm', 'match')} AS asset_id, match, path, line, rule_id FROM findings), a AS (SELECT DISTINCT asset_id AS id, match AS identifier FROM o WHERE rule_id <> 'JWT_RSA')"


@query(
    BASE + _ASSETS
    + """SELECT id, CAST(to_json({'type': 'cryptographic-asset', 'bom-ref': id, 'name': identifier, 'cryptoProperties': {'assetType': 'algorithm'}, 'evidence': {'occurrences': [{'location': (min({'p': path, 'l': line})).p, 'line': (min({'p': path, 'l': line})).l}]},
    'properties': [{'name': 'cipherlake:occurrences', 'value': CAST(count(*) AS VARCHAR)}]}) AS VARCHAR) AS json FROM a JOIN o ON o.asset_id = a.id GROUP BY id, identifier"""
)
def out_cyclonedx(spark, sf_dir):
    return P.cyclonedx_components(*_assets(spark, sf_dir))


@query(BASE + _ASSETS + "SELECT id, path, line FROM a JOIN o ON o.asset_id = a.id")
def join_cdx_observations(spark, sf_dir):
    return P.cyclonedx_observations(*_assets(spark, sf_dir))


@query(BASE + _ASSETS + "SELECT 'occurrence_not_listed' AS reason, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT id, count(*) AS n FROM a JOIN o ON o.asset_id = a.id GROUP BY id) HAVING sum(n - 1) > 0 UNION ALL SELECT 'no_component', count(*) FROM o WHERE asset_id NOT IN (SELECT id FROM a) HAVING count(*) > 0")
def agg_cdx_losses(spark, sf_dir):
    return P.cyclonedx_losses(*_assets(spark, sf_dir))


_GROUPS = f", g AS (SELECT rule_id, count(*) AS occurrences, count(DISTINCT path) AS files, [{_list(S.SEVERITIES)}][max({_RANK('severity')}) + 1] AS severity, string_agg(DISTINCT risk, ',' ORDER BY risk) AS risks FROM findings GROUP BY rule_id)"


@query(BASE + _GROUPS + "SELECT rule_id, '| ' || concat_ws(' | ', severity, rule_id, occurrences, files, risks) || ' |' AS line FROM g")
def out_markdown(spark, sf_dir):
    return P.markdown(O.rule_groups(found(spark, sf_dir)))


@query(BASE + _GROUPS + "SELECT rule_id, '<tr><td>' || concat_ws('</td><td>', severity, rule_id, occurrences, files, risks) || '</td></tr>' AS line FROM g")
def out_html(spark, sf_dir):
    return P.html(O.rule_groups(found(spark, sf_dir)))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM documents")
def fn_html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.escaped(F.col("text")).alias("safe"))


@query(BASE + _ASSETS + "SELECT id, CAST(to_json({'id': id, 'identifier': identifier}) AS VARCHAR) AS json FROM a")
def out_inventory(spark, sf_dir):
    return P.as_json(_assets(spark, sf_dir)[0], "id")


@query("WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 3 = 1 THEN 'unchanged' ELSE 'unresolved' END AS status FROM documents) SELECT id, CAST(to_json({'id': id, 'status': status}) AS VARCHAR) AS json FROM c")
def out_diff(spark, sf_dir):
    from cipherlake.operators import diff as D

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("f").alias("facts"), F.col("doc_id"))
    return P.as_json(D.diff_assets(docs.where("doc_id % 3 <> 0").drop("doc_id"), docs.where("doc_id % 3 <> 2").drop("doc_id")), "id")


@query(BASE + _GROUPS + f"SELECT rule_id, severity, occurrences FROM g ORDER BY {_RANK('severity')} DESC, rule_id LIMIT 3 OFFSET 3")
def lim_paging(spark, sf_dir):
    return P.page(O.rule_groups(found(spark, sf_dir)), 1, 3).select("rule_id", "severity", "occurrences")


@query(BASE + _GROUPS + f"SELECT rule_id, row_number() OVER (ORDER BY {_RANK('severity')} DESC, rule_id) AS place FROM g")
def ord_groups(spark, sf_dir):
    """The place of each rule as the order has it: read back from the sorted rows."""
    rows = P.ordered_groups(O.rule_groups(found(spark, sf_dir))).select("rule_id").collect()  # as many as there are rules
    return spark.createDataFrame([(r["rule_id"], i) for i, r in enumerate(rows, 1)], "rule_id string, place long")


@query(BASE + "SELECT finding_id, path, line, col AS \"column\" FROM findings ORDER BY path, line, col, finding_id")
def ord_occurrences(spark, sf_dir):
    return P.ordered_occurrences(found(spark, sf_dir)).select("finding_id", "path", "line", "column")


@query(BASE + f"SELECT finding_id FROM findings f WHERE NOT (severity = 'info' OR risk = 'quantum-safe') AND severity = 'high' AND contains(lower(concat_ws(' ', rule_id, {_TEXT}, path)), 'rs')")
def pred_report_filters(spark, sf_dir):
    return P.matching(found(spark, sf_dir), "candidate", severity="high", text="RS").select("finding_id")


@query(BASE + f"SELECT path, rule_id, {_LEVEL} AS level, count(*) AS n FROM findings GROUP BY 1, 2, 3 ORDER BY n DESC, path, rule_id, level LIMIT 100")
def agg_self_scan_summary(spark, sf_dir):
    return P.self_scan_summary(found(spark, sf_dir))


@query(BASE + ", c AS (SELECT DISTINCT rule_id, split_part(path, '/', 1) AS component, match AS algorithm, category AS usage_type, path || ':' || line AS location, evidence_type FROM findings) SELECT component, location, CASE WHEN (location, usage_type, algorithm) IN (SELECT (location, usage_type, algorithm) FROM c WHERE evidence_type = 'private_key') THEN '[masked-private-key-material]' ELSE algorithm END AS algorithm FROM c")
def join_cbom_mask(spark, sf_dir):
    f = found(spark, sf_dir)
    sensitive = f.where("evidence_type = 'private_key'").select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("location"), F.col("category").alias("usage_type"), F.col("match").alias("algorithm"))
    return P.mask_sensitive(O.cbom(f), sensitive).select("component", "location", "algorithm")


@query(f"WITH {_FILES}, h AS (SELECT path, unnest(range(1, 4)) AS k FROM files) SELECT path, CAST(k // 2 AS BIGINT) AS start, CASE WHEN k = 1 THEN 'regex' ELSE 'ast' END AS method FROM h WHERE k IN (1, 2)")
def win_span_dedup(spark, sf_dir):
    """Of hits of one span, the one by the syntax tree stays."""
    hits = files(spark, sf_dir).select("path", F.lit("r").alias("rule_id"), F.lit(1).alias("line"), F.explode(F.array(*(F.struct(F.lit(k // 2).cast("long").alias("start"), F.lit(k // 2 + 1).alias("stop"), F.lit("ast" if k == 2 else "regex").alias("method")) for k in (1, 2, 3)))).alias("h")).select("path", "rule_id", "line", "h.*")
    return P.span_dedup(hits).select("path", "start", "method")


@query(f"WITH {_FILES} SELECT path, CASE WHEN file_seq % 2 = 0 OR file_seq % 3 > 0 THEN CAST(file_seq % 100 AS INT) END AS \"column\" FROM files")
def fn_sarif_column(spark, sf_dir):
    seq = F.col("file_seq")
    return files(spark, sf_dir).select("path", P.sarif_column(F.col("path"), F.when(seq % 2 == 0, "regex").otherwise("ast"), F.when(seq % 3 == 0, "é").otherwise("a"), (seq % 100).cast("int")).alias("column"))


# statuses of three detectors on every file, as the document's number gives them
_STATUSES = ("complete", "not_applicable", "unsupported", "partial", "truncated", "failed", "not_reported")


def outcomes(spark, sf_dir):
    seq = F.col("file_seq")
    pick = lambda d: F.get(F.array(*map(F.lit, _STATUSES)), ((seq / F.lit(7**d)).cast("long") % 7).cast("int"))
    each = F.array(*(F.struct(F.lit(n).alias("detector"), pick(d).alias("status"), F.when(seq % 5 == d, 1).otherwise(0).alias("hits")) for d, n in enumerate(("regex", "key", "dependency"))))
    return files(spark, sf_dir).select("path", "file_seq", F.inline(each))


_OUT = f"o AS (SELECT path, file_seq, ['regex', 'key', 'dependency'][d + 1] AS detector, [{_list(_STATUSES)}][file_seq // CAST(pow(7, d) AS BIGINT) % 7 + 1] AS status, CASE WHEN file_seq % 5 = d THEN 1 ELSE 0 END AS hits FROM files, range(3) t(d))"
_ENDS = """e AS (SELECT path, CASE WHEN p OR ((f OR u) AND (c OR h)) THEN 'partial' WHEN f THEN 'failed' WHEN u THEN 'unsupported' WHEN n THEN 'unknown' WHEN c THEN 'analyzed' ELSE 'not_applicable' END AS disposition FROM
    (SELECT path, bool_or(status = 'complete') AS c, bool_or(status IN ('partial', 'truncated')) AS p, bool_or(status = 'failed') AS f, bool_or(status = 'unsupported') AS u, bool_or(status = 'not_reported') AS n, sum(hits) > 0 AS h FROM o GROUP BY path))"""
_COVER = "c AS (SELECT count(*) AS selected_files, " + ", ".join(f"CAST(count(*) FILTER (WHERE disposition = '{e}') AS BIGINT) AS {e}_files" for e in G.ENDS) + ", CAST(0 AS BIGINT) AS read_failed_files, count(*) AS read_ok_files FROM e), cs AS (SELECT *, CASE WHEN failed_files > 0 AND read_ok_files = failed_files THEN 'failed' WHEN failed_files + partial_files + unsupported_files > 0 THEN 'partial' WHEN unknown_files > 0 THEN 'unknown' ELSE 'complete_within_scope' END AS status FROM c)"
_WITH = f"WITH {_FILES}, {_OUT}, {_ENDS}, {_COVER} "


@query(_WITH + "SELECT path, disposition FROM e")
def det_status_fold(spark, sf_dir):
    return G.status_fold(outcomes(spark, sf_dir))


_DIAG = ", d AS (SELECT DISTINCT 'detector_' || status AS code, CASE WHEN status <> 'not_reported' THEN path END AS file, detector FROM o WHERE status NOT IN ('complete', 'not_applicable'))"


@query(_WITH.rstrip() + _DIAG + " SELECT code, file, detector FROM d")
def agg_diagnostics_distinct(spark, sf_dir):
    return G.diagnostics(outcomes(spark, sf_dir))


@query(_WITH.rstrip() + _DIAG + " SELECT code, count(*) AS n, count(DISTINCT file) AS files, coalesce(array_to_string(list_sort(list_distinct(list(file)))[:3], ','), '') AS examples FROM d GROUP BY code")
def agg_diagnostics_by_code(spark, sf_dir):
    return G.by_code(G.diagnostics(outcomes(spark, sf_dir)))


@query(_WITH.rstrip() + _DIAG + ", k(code, stage, disposition, message) AS (VALUES " + ", ".join(f"({_list(d)})" for d in G.DIAGNOSTICS) + ") SELECT d.code, file, detector, CAST(to_json({'code': d.code, 'file': file, 'detector': detector, 'stage': stage, 'disposition': disposition, 'message': message}) AS VARCHAR) AS json FROM d JOIN k ON k.code = d.code WHERE file IS NOT NULL")
def out_diagnostics(spark, sf_dir):
    rows = G.explained(G.diagnostics(outcomes(spark, sf_dir)).where("file is not null"))
    return rows.select("code", "file", "detector", F.to_json(F.struct(*rows.columns)).alias("json"))


@query(_WITH + "SELECT * FROM cs")
def agg_coverage_lattice(spark, sf_dir):
    return G.coverage(G.status_fold(outcomes(spark, sf_dir)))


@query(_WITH + "SELECT status = 'complete_within_scope' AS complete FROM cs")
def pred_require_complete(spark, sf_dir):
    return G.require_complete(G.coverage(G.status_fold(outcomes(spark, sf_dir))))


@query(_WITH + "SELECT selected_files = read_ok_files + read_failed_files AS selection_holds, read_ok_files = analyzed_files + partial_files + failed_files + unsupported_files + unknown_files + not_applicable_files AS ends_hold FROM cs")
def agg_partition_check(spark, sf_dir):
    return G.partition_check(G.coverage(G.status_fold(outcomes(spark, sf_dir))))


@query(_WITH + "SELECT round(selected_files / CAST(selected_files + 10 AS DOUBLE), 9) AS enumeration, round((read_ok_files - not_applicable_files) / CAST(read_ok_files AS DOUBLE), 9) AS applicability, round(analyzed_files / CAST(read_ok_files - not_applicable_files AS DOUBLE), 9) AS completion FROM cs")
def agg_rates(spark, sf_dir):
    return G.rates(G.coverage(G.status_fold(outcomes(spark, sf_dir))), F.col("selected_files") + 10)


@query(_WITH + f"SELECT {_EXT} AS format, detector, status, count(*) AS n, CAST(0 AS BIGINT) AS duplicates FROM o GROUP BY 1, 2, 3")
def agg_detector_counts(spark, sf_dir):
    return G.detector_counts(outcomes(spark, sf_dir), S.extension(F.col("path")))


# key blocks, nested documents, hosts, handshakes, version hints
@query("SELECT doc_id, 'a' || chr(10) || concat_ws(chr(10), CASE WHEN doc_id % 3 > 0 THEN '[masked-private-key-material]' || chr(10) || '[masked-private-key-material]' ELSE 'x' END, CASE WHEN doc_id % 3 = 1 THEN '[masked-private-key-material]' || chr(10) || 'z' WHEN doc_id % 3 = 2 THEN '[masked-private-key-material]' ELSE 'z' END) AS masked FROM documents")
def fn_mask_private_blocks(spark, sf_dir):
    """Closed blocks, open ones, none."""
    k, begin = F.col("doc_id") % 3, "a\n-----BEGIN EC PRIVATE KEY-----\nMII"
    text = F.when(k == 0, "a\nx\nz").when(k == 1, f"{begin}\n-----END EC PRIVATE KEY-----\nz").otherwise(f"{begin}\nz")
    return table(spark, sf_dir, "documents").select("doc_id", T.mask_private_blocks(text).alias("masked"))


def _nested(spark, sf_dir):
    body = F.to_json(F.struct(F.col("source").alias("a/b"), F.struct(F.lit("tok{x}").alias("token"), F.concat(F.lit("password="), F.col("doc_id").cast("string")).alias("n~m")).alias("in"), F.array(F.lit("x"), F.lit("y")).alias("list")))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))


_LEAVES = "SELECT doc_id, unnest([{'p': '/a~1b', 'n': 'a/b', 'v': source}, {'p': '/in/token', 'n': 'token', 'v': {T}}, {'p': '/in/n~0m', 'n': 'n~m', 'v': {P}}, {'p': '/list/0', 'n': '0', 'v': 'x'}, {'p': '/list/1', 'n': '1', 'v': 'y'}]) AS e FROM documents"


@query(f"SELECT doc_id, e.p AS pointer, e.n AS name, e.v AS value FROM ({_LEAVES.replace('{T}', _quoted('tok{x}')).replace('{P}', chr(39) + 'password=' + chr(39) + ' || CAST(doc_id AS VARCHAR)')})")
def fn_json_flatten(spark, sf_dir):
    return T.json_flatten(_nested(spark, sf_dir), "doc_id", "body")


@query(f"SELECT doc_id, e.p AS pointer, e.n AS name, e.v AS value FROM ({_LEAVES.replace('{T}', _quoted(S.VALUE)).replace('{P}', _quoted('password=' + S.VALUE))})")
def fn_deep_redact_json(spark, sf_dir):
    return T.redact_leaves(T.json_flatten(_nested(spark, sf_dir), "doc_id", "body"))


@query("SELECT page_id, page_id % 5 IN (0, 3) AS valid FROM pages")
def fn_host_validate(spark, sf_dir):
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    host = F.when(k == 0, F.concat(F.lit("a"), n, F.lit(".example"))).when(k == 1, F.concat(F.lit("-a"), n)).when(k == 2, F.concat(F.lit("1.2.3."), n)).when(k == 3, F.concat(F.lit("x-"), n, F.lit(".y."))).otherwise(F.concat(F.lit("a_b"), n))
    return table(spark, sf_dir, "pages").select("page_id", T.valid_host(host).alias("valid"))


@query("SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'curve25519-sha256,alg' || CAST(page_id AS VARCHAR) END AS kex, CASE WHEN page_id % 4 < 3 THEN CAST(page_id % 4 AS BIGINT) END AS ciphers FROM pages")
def fn_kexinit_parse(spark, sf_dir):
    """Messages made and read; every fourth is cut short."""
    schema = "page_id long, kex string, ciphers long"

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for k in b["page_id"]:
                message = T.write_kexinit({"kex": ["curve25519-sha256", f"alg{k}"], "encryption_out": ["aes256-ctr"] * (k % 4)})
                got = T.read_kexinit(message[: len(message) - 20 * (k % 4 == 3)])
                rows.append((k, ",".join(got["kex"]) if got else None, len(got["encryption_out"]) if got else None))
            out = pd.DataFrame(rows, columns=["page_id", "kex", "ciphers"])
            yield out.assign(ciphers=out["ciphers"].astype("Int64"))

    return table(spark, sf_dir, "pages").select("page_id").mapInPandas(run, schema)


#: A repository of a file for each document: its name and text by the document's number.
_PROFILE = {0: ("nginx/pom.xml", "<java.version>1{d}</java.version>"), 1: ("k8s/go.mod", "module x\ngo 1.2{d}\n"), 2: ("app/package.json", '{"engines": {"node": ">=2{d}.1"}}'), 3: ("app/runtime.txt", "python-3.1{d}"), 4: ("app/Cargo.toml", 'rust-version = "1.7{d}"'), 5: ("app/notes.txt", "nothing")}


def profile_files(spark, sf_dir):
    k, d = (F.col("doc_id") % 6).cast("int"), (F.col("doc_id") % 10).cast("string")
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for n, v in _PROFILE.items() for x in (n, v[i]))), k)
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", F.col("doc_id").cast("string"), pick(0)).alias("path"), F.replace(pick(1), F.lit("{d}"), d).alias("text"), F.col("doc_id").alias("file_seq"))


@query("WITH f AS (SELECT doc_id, doc_id % 6 AS k, CAST(doc_id % 10 AS VARCHAR) AS d FROM documents) SELECT doc_id AS file_seq, ['java', 'go', 'node', 'python', 'rust'][k + 1] AS language, ['1' || d, '1.2' || d, '2' || d || '.1', '3.1' || d, '1.7' || d][k + 1] AS version FROM f WHERE k < 5")
def fn_version_hint(spark, sf_dir):
    f = profile_files(spark, sf_dir).select("file_seq", T.version_hint(F.col("path"), F.col("text")).alias("h")).where("h is not null")
    return f.select("file_seq", "h.language", "h.version")


@query("""WITH f AS (SELECT doc_id, doc_id % 6 AS k, CAST(doc_id % 10 AS VARCHAR) AS d FROM documents), h AS (SELECT doc_id, ['java', 'go', 'node', 'python', 'rust'][k + 1] AS name, ['1' || d, '1.2' || d, '2' || d || '.1', '3.1' || d, '1.7' || d][k + 1] AS value FROM f WHERE k < 5)
    SELECT 'version' AS kind, name, min_by(value, doc_id) AS value FROM h GROUP BY name UNION ALL SELECT DISTINCT 'middleware', CASE k WHEN 0 THEN 'nginx' ELSE 'k8s' END, '' FROM f WHERE k < 2 UNION ALL SELECT DISTINCT 'signal', CASE WHEN doc_id % 2 = 0 THEN 'java-bouncycastle' ELSE 'jwt-lib' END, '' FROM documents""")
def agg_runtime_profile(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "org.bc:bcprov-jdk18on").otherwise("jose").alias("name"))
    return V.runtime_profile(profile_files(spark, sf_dir), names)


@query("SELECT doc_id, concat_ws(',', CASE WHEN v >= 24 THEN 'java.jca-ml-dsa-ml-kem' ELSE 'java.runtime-upgrade-for-pqc' END, CASE WHEN doc_id % 4 = 0 OR v < 24 OR v IS NULL THEN 'java.bouncycastle-pqc' END) AS actions FROM (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN 17 + doc_id % 10 END AS v FROM documents)")
def rec_java_family(spark, sf_dir):
    version = F.when(F.col("doc_id") % 7 > 0, (17 + F.col("doc_id") % 10).cast("string"))
    signals = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("java-bouncycastle"))).otherwise(F.array(F.lit("openssl")))
    return table(spark, sf_dir, "documents").select("doc_id", V.java_family(version, signals).alias("actions"))


@query(BASE + "SELECT finding_id, CASE WHEN lower(category) IN ('tls', 'middleware') THEN concat_ws(',', " + ", ".join(f"CASE WHEN starts_with(lower(rule_id), '{t}_') OR regexp_matches(lower(path), '{'|'.join(w)}') THEN '{t}' END" for t, w in V.TARGETS.items()) + ") ELSE '' END AS targets FROM findings")
def rec_middleware_targets(spark, sf_dir):
    f = found(spark, sf_dir)
    return f.select("finding_id", V.middleware_targets(f).alias("targets"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'tls.remove-rsa-kex' ELSE concat_ws(',', CASE WHEN doc_id % 3 = 1 THEN 'tls.k8s-ingress-hardening,tls.envoy-hardening' END, CASE WHEN doc_id % 3 > 0 THEN 'k8s.pqc-signature-readiness-note,envoy.pqc-signature-readiness-note' END) END AS actions FROM documents")
def rec_tls_family(spark, sf_dir):
    k = F.col("doc_id") % 3
    f = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "TLS_CIPHER_RSA").otherwise("OTHER").alias("rule_id"), F.lit("tls").alias("category"), F.when(k == 0, "a/b.conf").when(k == 1, "k8s/envoy.yml").otherwise("k8s/envoy.txt").alias("path"))
    return f.select("doc_id", V.tls_family(f).alias("actions"))


@query(BASE + f"SELECT finding_id, CASE l {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v[0])}' for k, v in V.RUNTIME.items())} END AS note, l AS language FROM (SELECT finding_id, coalesce(CASE WHEN starts_with(rule_id, 'JCA_') THEN 'java' WHEN starts_with(rule_id, 'GO_') THEN 'go' WHEN starts_with(rule_id, 'PY_') THEN 'python' END, CASE {_EXT} {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in X.LANGUAGES.items())} END) AS l FROM findings)")
def rec_runtime_pqc(spark, sf_dir):
    """The language of each finding, and what its runtime can do."""
    language = V.language_of(F.col("path"), F.col("rule_id"))
    return found(spark, sf_dir).select("finding_id", language.alias("language"), V.runtime_note(language).alias("note"))


# assets, their support and their assessment
def _observed(spark, sf_dir):
    a = lambda k: F.concat(F.lit("a"), (F.col("doc_id") % k).cast("string"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("observation_id"), F.array(a(50), a(30), a(50)).alias("asset_ids"), F.when(F.col("doc_id") % 50 < 25, "unknown").otherwise("lexical").alias("assurance"), F.col("doc_id"))


_OBSERVED = "o AS (SELECT 'o' || CAST(doc_id AS VARCHAR) AS observation_id, doc_id, CASE WHEN doc_id % 50 < 25 THEN 'unknown' ELSE 'lexical' END AS assurance FROM documents), s AS (SELECT DISTINCT 'a' || CAST(doc_id % k AS VARCHAR) AS asset_id, observation_id FROM o, (VALUES (50), (30)) t(k))"


@query(f"WITH {_OBSERVED} SELECT asset_id, observation_id FROM s")
def join_asset_support(spark, sf_dir):
    return A.asset_support(_observed(spark, sf_dir))


@query(f"WITH {_OBSERVED} SELECT asset_id, CASE WHEN bool_and(assurance = 'unknown') THEN 'unknown' ELSE 'uncalibrated_static_evidence' END AS certainty FROM s JOIN o USING (observation_id) GROUP BY asset_id")
def agg_certainty(spark, sf_dir):
    o = _observed(spark, sf_dir)
    return A.certainty(A.asset_support(o), o)


@query(f"WITH {_OBSERVED} SELECT observation_id FROM o WHERE doc_id % 4 <> 0")
def join_unassociated(spark, sf_dir):
    o = _observed(spark, sf_dir)
    return P.unassociated(o, o.where("doc_id % 4 = 0")).select("observation_id")


_CERT = """SELECT id, CASE WHEN k % 5 = 4 THEN 'unknown' WHEN k % 3 = 0 THEN 'vulnerable' WHEN k % 7 > 0 AND k % 3 = 1 THEN 'designed_resistant' ELSE 'unknown' END AS exposure,
    k % 7 > 0 AND k % 5 <> 4 AND k % 4 < 3 AS parameters_known,
    array_to_string(list_sort(list_filter([CASE WHEN k % 3 = 0 THEN 'weak' END, CASE WHEN k % 5 = 4 THEN 'certificate_signature_purpose_mismatch' END, ['certificate_not_yet_valid', 'certificate_expired', 'invalid_certificate_validity_interval', 'certificate_validity_unknown'][k % 4 + 1]], lambda x: x IS NOT NULL)), ',') AS concerns
    FROM (SELECT 'c' || CAST(doc_id AS VARCHAR) AS id, doc_id AS k FROM documents)"""


@query(_CERT)
def agg_certificate_roles(spark, sf_dir):
    k = F.col("k")
    base = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("k"))
    pick = lambda *x: F.get(F.array(*(F.lit(v).cast("long") for v in x)), (k % 4).cast("int"))
    certificates = base.select("id", pick(200, 10, 300, None).alias("not_before"), pick(300, 50, 100, 100).alias("not_after"))
    bad, role = F.when(k % 3 == 0, "vulnerable").when(k % 3 == 1, "designed_resistant").otherwise("unknown"), F.col("role")
    parts = base.select("id", "k", F.explode(F.array(F.lit("certificate_signature"), F.when(k % 7 > 0, "subject_public_key"))).alias("role")).where("role is not null")
    components = parts.select("id", "role", F.when((role == "certificate_signature") & (k % 5 == 4), "hash").otherwise("signature").alias("purpose"), bad.alias("exposure"), F.lit(True).alias("parameters_known"), F.when(k % 3 == 0, "weak").alias("concern"))
    return A.certificate_roles(certificates, components, 100)


@query("""SELECT 'x' || CAST(doc_id AS VARCHAR) AS asset_id, CASE WHEN doc_id % 3 = 0 THEN 'fail' ELSE 'indeterminate' END AS decision, 'r' AS reasons, CASE WHEN doc_id % 3 > 0 THEN 'review' WHEN doc_id % 6 = 0 AND doc_id % 9 = 0 THEN 'high' ELSE 'medium' END AS priority,
    CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'ML-DSA,ML-KEM' ELSE 'SHA-256' END ELSE '' END AS candidates FROM documents""")
def pol_evaluate(spark, sf_dir):
    d = F.col("doc_id")
    decided = table(spark, sf_dir, "documents").select(F.concat(F.lit("x"), d.cast("string")).alias("asset_id"), F.when(d % 2 == 0, "RSA").otherwise("MD5").alias("identifier"), F.when(d % 3 == 0, "fail").otherwise("indeterminate").alias("decision"), F.lit("r").alias("reasons"), F.when(d % 2 == 0, "vulnerable").otherwise("unknown").alias("exposure"), F.when(d % 9 == 0, "weak").otherwise("").alias("concerns"))
    listed = spark.createDataFrame([("RSA", "ML-KEM"), ("RSA", "ML-DSA"), ("MD5", "SHA-256")], "identifier string, candidate string")
    return A.evaluate(decided, listed)


@query("SELECT doc_id, 'f' || CAST(doc_id AS VARCHAR) AS target, CASE WHEN doc_id % 3 > 0 THEN 'facts' END AS facts, CASE WHEN doc_id % 3 > 0 THEN 'captured' ELSE 'target_mismatch' END AS capture_status FROM documents")
def inv_bind_target(spark, sf_dir):
    here = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    drafts = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, here).otherwise("other").alias("target"), F.lit("facts").alias("facts"), F.lit("captured").alias("capture_status"))
    return A.bind_target(drafts, here)


@query("""WITH i AS (SELECT 'app/' || CAST(doc_id AS VARCHAR) || '/Cargo.toml' AS path, unnest([{'n': 'a', 'd': '1.' || CAST(doc_id AS VARCHAR), 's': 'declared'}, {'n': 'b', 'd': NULL, 's': 'version_not_asserted'}, {'n': 'c', 'd': NULL, 's': 'version_unknown'}]) AS e FROM documents) SELECT path, e.n AS name, e.d AS declared, CAST(NULL AS VARCHAR) AS resolved, e.s AS capture_status FROM i""")
def inv_dependency_assertion(spark, sf_dir):
    from cipherlake.plans.manifests import manifest
    from cipherlake.sources import manifests as M

    return A.dependency_assertion(M.dependencies(manifest(spark, sf_dir, "Cargo.toml", '[dependencies]\na = "1.{id}"\nb = { git = "https://host.example/b", version = "2" }\nc = {}\n')))


@query("SELECT 'r' || CAST(doc_id AS VARCHAR) AS report, doc_id % 4 <> 0 AS consistent, e.k AS kind, e.a AS advisory, e.p AS package FROM (SELECT doc_id, unnest([{'k': 'vulnerability', 'a': 'A-' || CAST(doc_id AS VARCHAR), 'p': 'p'}, {'k': 'warning', 'a': 'W-1', 'p': 'q'}]) AS e FROM documents)")
def agg_audit_findings(spark, sf_dir):
    d = F.col("doc_id")
    reports = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), d.cast("string")).alias("report"), F.when(d % 4 == 0, 3).otherwise(1).alias("count"), F.array(F.struct(F.concat(F.lit("A-"), d.cast("string")).alias("advisory"), F.lit("p").alias("package"))).alias("vulnerabilities"), F.array(F.struct(F.lit("W-1").alias("advisory"), F.lit("q").alias("package"))).alias("warnings"))
    return A.audit_findings(reports)


@query("WITH a AS (SELECT 'r' || CAST(doc_id % 20 AS VARCHAR) AS rule_id, doc_id, unnest(['all', CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS action FROM documents) SELECT rule_id, string_agg(action, ',' ORDER BY action) AS actions FROM (SELECT rule_id, action FROM a GROUP BY rule_id, action HAVING count(DISTINCT doc_id) = (SELECT count(DISTINCT doc_id) FROM a b WHERE b.rule_id = a.rule_id)) GROUP BY rule_id")
def agg_common_actions(spark, sf_dir):
    d = F.col("doc_id")
    each = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), (d % 20).cast("string")).alias("rule_id"), d.alias("finding_id"), F.explode(F.array(F.lit("all"), F.when(d % 2 == 0, "even").otherwise("odd"))).alias("action"))
    return P.common_actions(each)
