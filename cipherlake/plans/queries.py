"""The registered queries and their DuckDB twins, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.functions import algorithms as A
from cipherlake.functions import scalars as S
from cipherlake.operators import diff as D
from cipherlake.operators import findings as O
from cipherlake.operators import inventory as I
from cipherlake.operators import quality as Q
from cipherlake.sources import files as X
from cipherlake.sources import rules as R
from cipherlake.sources.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick(k: int) -> str:
    return "CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN " + " || chr(10) || ".join(map(_quoted, v[k].split("\n"))) for i, v in X.CORPUS.items()) + " END"


def _list(values) -> str:
    return ", ".join(map(_quoted, values))


def sql_id(domain: str, *parts: str) -> str:
    frame = lambda x: f"unhex(printf('%016x', octet_length(encode(CAST({x} AS VARCHAR))))) || encode(CAST({x} AS VARCHAR))"
    head = [frame(_quoted(x)) for x in (S.NAMESPACE, "1", domain)]
    return f"'{domain}-v1-' || sha256({' || '.join([*head, f"unhex('{len(parts):016X}')", *map(frame, parts)])})"


def sql_mask(x: str) -> str:
    t = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN contains({t}, 'PRIVATE KEY') THEN '[masked-private-key]' WHEN length({t}) <= 20 THEN {t} ELSE left({t}, 8) || '***' || right({t}, 6) END"


_EXT = r"lower(regexp_extract(path, '[^/]\.([^./]*)$', 1))"
_NAME = "split_part(path, '/', -1)"
_EXCLUDED = f"(list_has_any(string_split(lower(path), '/')[:-2], [{_list(X.EXCLUDED_DIRS)}]) OR {_EXT} = 'md')"
_DISPOSITION = f"CASE WHEN {_EXCLUDED} THEN 'excluded_directory' WHEN {_EXT} IN ({_list(X.KNOWN_EXTENSIONS)}) THEN 'known_extension' WHEN size > {X.MAX_BYTES} THEN 'over_size' ELSE 'selected' END"
_COMMENT = rf"(CASE WHEN {_EXT} IN ({_list(O.SLASH_COMMENTS)}) THEN regexp_matches(content, '^\s*(//|/\*|\*)') WHEN {_EXT} IN ({_list(O.HASH_COMMENTS)}) THEN regexp_matches(content, '^\s*#') ELSE false END)"
_RANK = lambda x: f"(list_position([{_list(S.SEVERITIES)}], {x}) - 1)"
_RULES = ", ".join(f"({', '.join([*map(_quoted, r[:5]), str(r.confidence), *map(_quoted, r[6:10])])})" for r in R.PACK)
_FILES = f"files AS (SELECT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR), {_pick(0)}) AS path, coalesce(text, '') || chr(10) || {_pick(1)} AS text, doc_id AS file_seq, CAST(octet_length(encode(coalesce(text, '') || chr(10) || {_pick(1)})) AS BIGINT) AS size FROM documents)"
_LINES = "split AS (SELECT path, file_seq, size, string_split(text, chr(10)) AS p FROM files), lines AS (SELECT path, file_seq, size, i AS line, regexp_replace(p[i], chr(13) || '$', '') AS content FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM split) WHERE NOT (i = len(p) AND p[i] = ''))"
_DETECT = rf"""rules(rule_id, kind, category, severity, risk, confidence, migration_hint, pattern, scope, description) AS (VALUES {_RULES}),
hits AS ({" UNION ALL ".join(f"SELECT path, file_seq, size, line, content, {_quoted(r.id)} AS rule_id, string_split(regexp_replace(content, {_quoted(r.pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM lines WHERE regexp_matches(content, {_quoted(r.pattern)})" for r in R.PACK)}),
raw AS (SELECT h.rule_id, r.kind, h.path, h.line, h.file_seq, 1 + length(replace(array_to_string(parts[1:k], ''), chr(2), '')) AS col, split_part(parts[k + 1], chr(2), 1) AS m
        FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM hits WHERE {_DISPOSITION} = 'selected') h JOIN rules r ON r.rule_id = h.rule_id WHERE r.kind = 'key' OR NOT {_COMMENT})"""
_SENSITIVE = "(lower(category) IN ('tls', 'pki', 'jwt', 'auth', 'authentication') AND risk = 'quantum-vulnerable' AND CAST(confidence AS FLOAT) >= CAST(0.45 AS FLOAT))"
_FIND = f"""findings AS (SELECT DISTINCT {sql_id("finding", "raw.rule_id", "path", "line", "col", sql_mask("m"))} AS finding_id, raw.rule_id, category, risk,
  CASE WHEN {_SENSITIVE} AND raw.kind = 'key' THEN 'critical' WHEN {_SENSITIVE} THEN [{_list(S.SEVERITIES)}][least({_RANK("severity")} + 1, 4) + 1] ELSE severity END AS severity,
  round(CAST(confidence AS DOUBLE), 6) AS confidence, migration_hint, path, line, col, {sql_mask("m")} AS match, CASE WHEN raw.kind = 'key' THEN 'private_key' ELSE 'regex' END AS evidence_type
  FROM raw JOIN rules ON rules.rule_id = raw.rule_id)"""
BASE = f"WITH {_FILES}, {_LINES}, {_DETECT}, {_FIND} "


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus. A table of fewer splits than there are cores is small: it is dealt out to all of them before detection."""
    documents = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return X.corpus(documents.repartition(cores) if documents.rdd.getNumPartitions() < cores else documents)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.scan(spark, files(spark, sf_dir))


@query(BASE + "SELECT finding_id, rule_id, category, risk, severity, confidence, path, line, col AS \"column\", match, evidence_type FROM findings ORDER BY " + _RANK("severity") + " DESC, path, line, col, rule_id")
def findings_ordered(spark, sf_dir):
    """The whole scan: selection, detection, identity, severity, order."""
    f = O.ordered(found(spark, sf_dir))
    return f.select("finding_id", "rule_id", "category", "risk", "severity", F.round("confidence", 6).alias("confidence"), "path", "line", "column", "match", "evidence_type")


@query(f"WITH {_FILES} SELECT {_DISPOSITION} AS disposition, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def src_select(spark, sf_dir):
    d = X.disposition(F.col("path"), F.col("size"))
    return files(spark, sf_dir).groupBy(d.alias("disposition")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(
    f"""WITH {_FILES} SELECT path, {_EXCLUDED} AS excluded, {_EXT} IN ({_list(X.KNOWN_EXTENSIONS)}) AS known_binary, {_EXT} IN ({_list(X.CRYPTO_EXTENSIONS)}) AS protected, {_NAME} IN ({_list(X.MANIFESTS)}) OR ends_with({_NAME}, '.gemspec') AS manifest,
    {_EXT} IN ({_list(X.CERTIFICATES)}) AS certificate, ends_with(lower({_NAME}), '.json') AND regexp_matches(lower({_NAME}), 'bom|cyclonedx|spdx') AS sbom, CASE {_EXT} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items())} END AS language FROM files"""
)
def pred_classify(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", X.in_excluded_dir(p).alias("excluded"), X.is_known_binary(p).alias("known_binary"), X.is_protected(p).alias("protected"), X.is_manifest(p).alias("manifest"), X.is_certificate(p).alias("certificate"), X.is_sbom(p).alias("sbom"), X.language(p).alias("language"))


@query(f"WITH {_FILES}, {_LINES} SELECT path, count(*) AS n_lines, CAST(count(*) FILTER (WHERE {_COMMENT}) AS BIGINT) AS n_comments FROM lines GROUP BY path")
def pred_comment_only(spark, sf_dir):
    rows = X.lines(files(spark, sf_dir))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(O.comment_only(F.col("path"), F.col("content"))).alias("n_comments"))


@query(BASE + 'SELECT rule_id, path, line, col AS "column", m AS match FROM raw')
def det_regex_and_keys(spark, sf_dir):
    return O.detect(X.select_files(files(spark, sf_dir))).select("rule_id", "path", "line", "column", "match")


@query(BASE + "SELECT rule_id, path, count(*) AS kept, bool_or(truncated) AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, path ORDER BY line, col) AS rn, count(*) OVER (PARTITION BY rule_id, path) > 1 AS truncated FROM raw) WHERE rn <= 1 GROUP BY rule_id, path")
def win_hit_cap(spark, sf_dir):
    return O.capped(O.detect(X.select_files(files(spark, sf_dir))), 1).groupBy("rule_id", "path").agg(F.count(F.lit(1)).alias("kept"), F.bool_or("truncated").alias("truncated"))


@query(BASE + "SELECT coalesce(severity, '*') AS severity, coalesce(risk, '*') AS risk, count(*) AS n FROM findings GROUP BY GROUPING SETS ((severity), (risk), ())")
def agg_summary(spark, sf_dir):
    return O.summary(found(spark, sf_dir))


@query(BASE + "SELECT DISTINCT split_part(path, '/', 1) AS component, match AS algorithm, category AS usage_type, path || ':' || line AS location, risk AS quantum_risk, migration_hint FROM findings")
def agg_cbom(spark, sf_dir):
    return O.cbom(found(spark, sf_dir))


@query(BASE + f"SELECT rule_id, count(*) AS occurrences, count(DISTINCT path) AS files, [{_list(S.SEVERITIES)}][max({_RANK('severity')}) + 1] AS severity, string_agg(DISTINCT risk, ',' ORDER BY risk) AS risks FROM findings GROUP BY rule_id")
def agg_rule_groups(spark, sf_dir):
    return O.rule_groups(found(spark, sf_dir))


@query(BASE + f"SELECT rule_id, severity = 'info' OR risk = 'quantum-safe' AS inventory, count(*) AS hits, count(DISTINCT path) AS files, [{_list(S.SEVERITIES)}][max({_RANK('severity')}) + 1] AS severity FROM findings f GROUP BY rule_id, f.severity = 'info' OR risk = 'quantum-safe'".replace("severity = 'info' OR risk = 'quantum-safe' AS inventory", "f.severity = 'info' OR risk = 'quantum-safe' AS inventory"))
def agg_md_index(spark, sf_dir):
    return O.rule_index(found(spark, sf_dir))


@query(BASE + "SELECT severity, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM findings GROUP BY severity")
def agg_severity_distribution(spark, sf_dir):
    return O.severity_distribution(found(spark, sf_dir)).withColumn("percent", F.col("percent").cast("double"))


@query(BASE + "SELECT CAST(count(*) FILTER (WHERE NOT (severity = 'info' OR risk = 'quantum-safe')) AS BIGINT) AS candidates, CAST(count(*) FILTER (WHERE severity = 'info' OR risk = 'quantum-safe') AS BIGINT) AS inventory, count(DISTINCT path) AS files FROM findings")
def agg_metrics(spark, sf_dir):
    return O.metrics(found(spark, sf_dir))


@query(BASE + "SELECT array_to_string(p[1:i], '/') AS node, count(*) AS n FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split(path, '/') AS p FROM findings)) GROUP BY 1")
def agg_file_tree(spark, sf_dir):
    return O.file_tree(found(spark, sf_dir))


@query(BASE + ", two AS (SELECT path, line, col, rule_id FROM findings UNION ALL SELECT path, line, col, 'OTHER' FROM findings WHERE line % 2 = 0) SELECT path, line, col AS \"column\", string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, count(DISTINCT rule_id) AS n FROM two GROUP BY path, line, col HAVING count(DISTINCT rule_id) > 1")
def join_same_location(spark, sf_dir):
    """Findings, and on even lines those of a second pack at the same places."""
    f = found(spark, sf_dir)
    return O.same_location(f.unionByName(f.where("line % 2 = 0").withColumn("rule_id", F.lit("OTHER"))))


@query(BASE + f"SELECT coalesce(bool_or({_RANK('severity')} >= 4), false) AS fails FROM findings")
def pred_fail_on(spark, sf_dir):
    return O.fail_on(found(spark, sf_dir), "critical")


@query(BASE + ", d AS (SELECT " + _DISPOSITION + " AS d FROM files) SELECT (SELECT count(*) FROM d) AS enumerated, " + ", ".join(f"(SELECT count(*) FROM d WHERE d = '{x}') AS {x}" for x in ("selected", "excluded_directory", "known_extension", "over_size")) + ", (SELECT count(DISTINCT path) FROM raw) AS files_with_hits, 'complete_within_scope' AS status")
def agg_coverage(spark, sf_dir):
    all_files = files(spark, sf_dir)
    return O.coverage(all_files, O.detect(X.select_files(all_files)))


_PRIVATE = r"""kb AS (SELECT path, line, regexp_matches(content, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS b, regexp_matches(content, '-----END [A-Z ]*PRIVATE KEY-----') AS e FROM lines),
blocks AS (SELECT *, sum(CAST(b AS INT)) OVER (PARTITION BY path ORDER BY line) AS block FROM kb),
ranges AS (SELECT path, min(line) AS first, coalesce(min(line) FILTER (WHERE e), max(line)) AS last FROM blocks WHERE block > 0 GROUP BY path, block) """


@query(f"WITH {_FILES}, {_LINES}, {_PRIVATE} SELECT path, first, last FROM ranges")
def win_private_ranges(spark, sf_dir):
    return O.private_ranges(files(spark, sf_dir))


@query(BASE + f", {_PRIVATE} SELECT finding_id, f.path, line FROM findings f WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.path = f.path AND f.line BETWEEN r.first AND r.last)")
def join_privacy_interval(spark, sf_dir):
    return O.in_private_range(found(spark, sf_dir), O.private_ranges(files(spark, sf_dir))).select("finding_id", "path", "line")


@query("""WITH s AS (SELECT l_orderkey AS k, CAST(l_partkey % 1000 AS INT) AS first, CAST(l_partkey % 1000 + l_suppkey % 50 AS INT) AS last FROM lineitem),
n AS (SELECT *, CASE WHEN first > coalesce(max(last) OVER (PARTITION BY k ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first - 1) THEN 1 ELSE 0 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM n) SELECT k, min(first) AS first, max(last) AS last FROM i GROUP BY k, island""")
def win_merge_intervals(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 1000).cast("int").alias("first"), (F.col("l_partkey") % 1000 + F.col("l_suppkey") % 50).cast("int").alias("last"))
    return O.merge_intervals(spans, "k")


_TOKENS = r"t AS (SELECT path, list_distinct(regexp_split_to_array(text, '[^A-Za-z0-9_-]+')) AS w FROM files), tok AS (SELECT path, unnest(w) AS w FROM t)"
_RECOGNIZED = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**{c: c for c in A.CANONICAL}, **A.SPELLINGS}.items()) + " END"


@query(f"WITH {_FILES}, {_TOKENS} SELECT path, string_agg(DISTINCT {_RECOGNIZED}, ',' ORDER BY {_RECOGNIZED}) AS algorithms FROM tok WHERE {_RECOGNIZED} IS NOT NULL GROUP BY path")
def fn_recognized_algorithm(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.array_join(A.algorithms_in(F.col("text")), ",").alias("algorithms")).where("algorithms <> ''")


_CATALOG = "cat(identifier, construction, standardization, purpose, exposure, parameters_known, concerns) AS (VALUES " + ", ".join(f"('{a.identifier}', '{a.construction}', '{a.standardization}', '{a.purpose}', '{a.exposure}', {a.parameters_known}, '{a.concerns}')" for a in A.catalog()) + ")"
_USED = "used AS (SELECT identifier, identifier AS asked FROM cat UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{oid}')" for oid, name in A.OIDS.items()) + ") UNION ALL SELECT 'unheard-of', 'unheard-of')"


def _used(spark):
    return spark.createDataFrame([(a.identifier,) for a in A.catalog()] + [(oid,) for oid in A.OIDS] + [("unheard-of",)], "asked string")


@query(f"WITH {_CATALOG}, {_USED} SELECT asked, coalesce(construction, 'unknown') AS construction, coalesce(standardization, 'unknown') AS standardization, coalesce(purpose, 'unknown') AS purpose, coalesce(exposure, 'unknown') AS exposure, coalesce(parameters_known, false) AS parameters_known, coalesce(concerns, '') AS concerns FROM used LEFT JOIN cat USING (identifier)")
def fn_assess_algorithm(spark, sf_dir):
    return A.assess(_used(spark), "asked").select("asked", "construction", "standardization", "purpose", "exposure", "parameters_known", "concerns")


_ALL_SUPPORT = {k: True for k in ("runtime", "provider", "parameters", "peer", "protocol", "jose", "verifiers")}


@query(
    f"""WITH {_CATALOG} SELECT identifier, CASE WHEN exposure = 'vulnerable' OR concerns <> '' THEN 'fail' WHEN exposure = 'unknown' OR NOT parameters_known THEN 'indeterminate' WHEN purpose <> 'signature' THEN 'indeterminate' ELSE 'pass' END AS decision,
    CASE WHEN exposure = 'vulnerable' AND concerns <> '' THEN 'observed_primitive_quantum_vulnerable+known_classical_concern_in_profile_scope' WHEN exposure = 'vulnerable' THEN 'observed_primitive_quantum_vulnerable' WHEN concerns <> '' THEN 'known_classical_concern_in_profile_scope'
    WHEN exposure = 'unknown' OR NOT parameters_known THEN 'algorithm_or_parameters_unresolved' WHEN purpose <> 'signature' THEN 'use_case_unknown_or_purpose_mismatch' ELSE 'bounded_primitive_review_only_operator_claims_unverified' END AS reasons FROM cat"""
)
def pol_primitive(spark, sf_dir):
    return A.decide(A.assess(A.frame(spark).select("identifier")), "applicable", "jwt", _ALL_SUPPORT).select("identifier", "decision", "reasons")


@query(
    f"""WITH {_CATALOG}, p AS (SELECT identifier, unnest(CASE WHEN purpose <> 'unknown' THEN [purpose] WHEN exposure = 'vulnerable' THEN ['key_establishment', 'signature'] ELSE [] END) AS for_purpose FROM cat)
    SELECT identifier, for_purpose, CASE for_purpose WHEN 'key_establishment' THEN 'ML-KEM' WHEN 'signature' THEN 'ML-DSA' WHEN 'hash' THEN 'SHA-256' ELSE 'AES' END AS candidate FROM p"""
)
def pol_candidates(spark, sf_dir):
    return A.candidates(A.assess(A.frame(spark).select("identifier")))


@query(f"WITH {_CATALOG} SELECT count(*) AS n, CAST(count(*) FILTER (WHERE exposure = 'vulnerable' OR concerns <> '') AS BIGINT) AS failing, 'fail' AS decision FROM cat")
def agg_policy_summary(spark, sf_dir):
    return A.policy_summary(A.decide(A.assess(A.frame(spark).select("identifier")), "applicable", "jwt", _ALL_SUPPORT), True)


_ACTION_CASES = ", ".join(f"CASE WHEN {c} THEN {p} || ':{a}' END" for a, p, _, c in A.ACTIONS)


@query(BASE + f"SELECT finding_id, array_to_string(list_transform(list_sort(list_filter([{_ACTION_CASES}], lambda x: x IS NOT NULL))[1:4], lambda x: split_part(x, ':', 2)), ',') AS actions FROM findings")
def rec_actions(spark, sf_dir):
    return A.recommend(found(spark, sf_dir))


_DRAFT = f"""drafts AS (SELECT path, rule_id, CASE WHEN evidence_type = 'private_key' THEN 'key' ELSE 'regex' END AS method, match, line, col FROM findings),
anch AS (SELECT *, {sql_id("anchor", "rule_id", "method", "match")} AS anchor FROM drafts),
obs AS (SELECT *, row_number() OVER (PARTITION BY path, anchor ORDER BY line, col) - 1 AS ordinal, count(*) OVER (PARTITION BY path, anchor) AS n FROM anch),
keyed AS (SELECT path, rule_id, method, match, line, col AS "column", anchor, ordinal, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'stable' END AS identity_confidence, {sql_id("occurrence", "'repo'", "path", "anchor", "ordinal")} AS occurrence_key FROM obs) """


def observed(spark, sf_dir):
    f = found(spark, sf_dir).withColumn("method", F.when(F.col("evidence_type") == "private_key", "key").otherwise("regex"))
    return I.observations(f, F.lit("repo"))


@query(BASE + f", {_DRAFT} SELECT path, rule_id, line, \"column\", anchor, CAST(ordinal AS INT) AS ordinal, identity_confidence, occurrence_key FROM keyed")
def inv_observations(spark, sf_dir):
    return observed(spark, sf_dir).select("path", "rule_id", "line", "column", "anchor", F.col("ordinal").cast("int").alias("ordinal"), "identity_confidence", "occurrence_key")


@query(BASE + f", {_DRAFT} SELECT {sql_id('algorithm', 'match')} AS id, min(match) AS identifier, count(*) AS observations, count(DISTINCT path) AS files, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, false AS conflicting_descriptors FROM keyed GROUP BY 1")
def inv_assets(spark, sf_dir):
    return I.assets(observed(spark, sf_dir))


@query(BASE + f", {_DRAFT} SELECT DISTINCT {sql_id('usage', 'path')} AS src, 'uses' AS relationship, {sql_id('algorithm', 'match')} AS dst FROM keyed")
def inv_relations(spark, sf_dir):
    return I.relations(observed(spark, sf_dir))


@query(BASE + f", {_DRAFT}, e AS (SELECT DISTINCT path, match FROM keyed) SELECT {sql_id('usage', 'path')} AS src, min({sql_id('algorithm', 'match')}) AS dst FROM e GROUP BY path HAVING count(*) = 1")
def join_related(spark, sf_dir):
    return I.only_related(I.relations(observed(spark, sf_dir)), "uses")


@query(BASE + f", {_DRAFT} SELECT DISTINCT {sql_id('usage', 'path')} AS src, 'uses' AS relationship, {sql_id('algorithm', 'match')} AS dst FROM keyed WHERE match = 'RS256'")
def join_integrity(spark, sf_dir):
    """Relations to an asset that has been taken out."""
    seen = observed(spark, sf_dir)
    return I.dangling(I.relations(seen), I.assets(seen).where("identifier <> 'RS256'")).select("src", "relationship", "dst")


_BIND = ', b AS (SELECT rule_id, path, line, col, match, CAST(line % 2 AS VARCHAR) || \'-\' || rule_id AS oid FROM findings WHERE col % 3 <> 0)'


def bindings(f):
    return f.where("`column` % 3 <> 0").select("rule_id", "path", "line", "column", "match", F.concat_ws("-", (F.col("line") % 2).cast("string"), "rule_id").alias("observation_id"))


@query(BASE + _BIND + " SELECT f.finding_id, coalesce(string_agg(DISTINCT b.oid, ',' ORDER BY b.oid), '') AS observation_ids FROM findings f LEFT JOIN b ON f.rule_id = b.rule_id AND f.path = b.path AND f.line = b.line AND f.col = b.col AND f.match = b.match GROUP BY f.finding_id")
def join_associate(spark, sf_dir):
    f = found(spark, sf_dir)
    return I.associate(f, bindings(f))


@query(BASE + _BIND + " SELECT rule_id, count(*) AS n FROM b WHERE rule_id = 'JWT_RSA' GROUP BY rule_id")
def join_losses(spark, sf_dir):
    f = found(spark, sf_dir)
    return I.losses(bindings(f), f.where("rule_id <> 'JWT_RSA'"))


_RUN = lambda p: f"(SELECT user_id || ':' || event_type AS id, CAST(count(*) AS VARCHAR) AS facts FROM events WHERE {p} GROUP BY 1)"
_RUNS = f"b AS {_RUN('event_id % 2 = 0')}, a AS {_RUN('event_id % 2 = 1')}"
_STATUS = "CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'unresolved' WHEN a.facts = b.facts THEN 'unchanged' ELSE 'changed' END"


def runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id")).agg(F.count(F.lit(1)).cast("string").alias("facts"))
    return one(0), one(1)


@query(f"WITH {_RUNS} SELECT coalesce(a.id, b.id) AS id, {_STATUS} AS status FROM b FULL JOIN a ON a.id = b.id")
def join_diff_assets(spark, sf_dir):
    return D.diff_assets(*runs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT {_STATUS} AS status, count(*) AS n FROM b FULL JOIN a ON a.id = b.id GROUP BY 1")
def agg_diff_summary(spark, sf_dir):
    return D.diff_summary(D.diff_assets(*runs(spark, sf_dir)))


@query(f"WITH {_RUNS} SELECT id FROM b UNION SELECT id FROM a")
def set_key_union(spark, sf_dir):
    return D.key_union(*runs(spark, sf_dir), "id")


@query(f"WITH {_RUNS} SELECT id FROM b INTERSECT SELECT id FROM a")
def set_intersect(spark, sf_dir):
    b, a = runs(spark, sf_dir)
    return b.select("id").intersect(a.select("id"))


@query(f"WITH {_RUNS} SELECT id FROM b EXCEPT SELECT id FROM a WHERE id NOT LIKE '%7:%'")
def set_except(spark, sf_dir):
    b, a = runs(spark, sf_dir)
    return b.select("id").exceptAll(a.where("id not like '%7:%'").select("id"))


_OCC = lambda k: f"(SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id // 4 AS VARCHAR) || '-' || CAST((event_id % 4 + {k}) % 3 AS VARCHAR) END AS occurrence_key, event_type AS facts, CAST(event_id // 4 AS VARCHAR) AS anchor, 'd' || ((user_id + {k} * (event_id % 2)) % 50) AS path, event_type AS signature FROM events WHERE event_id % 4 = {k})"
_OCCS = f"b AS {_OCC(0)}, a AS {_OCC(1)}"


def occurrences(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    group = F.floor(F.col("event_id") / 4).cast("string")

    def one(k):
        key = F.when(F.col("event_id") % 10 != 0, F.concat_ws("-", group, ((F.col("event_id") % 4 + k) % 3).cast("string")))
        path = F.concat(F.lit("d"), ((F.col("user_id") + k * (F.col("event_id") % 2)) % 50).cast("string"))
        return e.where(F.col("event_id") % 4 == k).select(key.alias("occurrence_key"), F.col("event_type").alias("facts"), group.alias("anchor"), path.alias("path"), F.col("event_type").alias("signature"))

    return one(0), one(1)


@query(f"""WITH {_OCCS}, kb AS (SELECT * FROM b WHERE occurrence_key IS NOT NULL), ka AS (SELECT * FROM a WHERE occurrence_key IS NOT NULL)
SELECT coalesce(ka.occurrence_key, kb.occurrence_key) AS occurrence_key, CASE WHEN kb.occurrence_key IS NULL THEN 'added' WHEN ka.occurrence_key IS NULL THEN 'unresolved' WHEN ka.facts = kb.facts THEN 'unchanged' ELSE 'changed' END AS status
FROM kb FULL JOIN ka ON ka.occurrence_key = kb.occurrence_key UNION ALL SELECT NULL, 'unresolved' FROM b WHERE occurrence_key IS NULL UNION ALL SELECT NULL, 'unresolved' FROM a WHERE occurrence_key IS NULL""")
def join_diff_occurrences(spark, sf_dir):
    return D.diff_occurrences(*occurrences(spark, sf_dir))


@query(f"""WITH {_OCCS}, ob AS (SELECT anchor, min(occurrence_key) AS old_key, min(path) AS old_path, min(signature) AS old_sig FROM b GROUP BY anchor HAVING count(*) = 1), na AS (SELECT anchor, min(occurrence_key) AS new_key, min(path) AS new_path, min(signature) AS new_sig FROM a GROUP BY anchor HAVING count(*) = 1)
SELECT ob.anchor, old_key, new_key, old_path, new_path FROM ob JOIN na ON ob.anchor = na.anchor WHERE old_path <> new_path AND old_sig IS NOT DISTINCT FROM new_sig AND NOT EXISTS (SELECT 1 FROM a WHERE occurrence_key = old_key) AND NOT EXISTS (SELECT 1 FROM b WHERE occurrence_key = new_key)""")
def join_moves(spark, sf_dir):
    return D.moves(*occurrences(spark, sf_dir))


_RECORD = lambda k: f"(SELECT min(event_type) AS scope, sha256(CAST(count(*) AS VARCHAR)) AS rules_digest, max(event_type) AS profile, CAST(count(DISTINCT user_id) AS VARCHAR) AS scanner_version, CAST(NULL AS VARCHAR) AS catalog_version, CAST(max(event_id) AS VARCHAR) AS coverage_status, 'o' AS options_digest FROM events WHERE event_id % 3 = {k})"


@query(f"SELECT array_to_string(c, ',') AS changed, CAST(len(c) AS INT) AS n FROM (SELECT list_filter([{', '.join(f'CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN {_quoted(c)} END' for c in D.DRIFT)}], lambda x: x IS NOT NULL) AS c FROM {_RECORD(0)} b, {_RECORD(1)} a)")
def agg_drift(spark, sf_dir):
    """The records of two runs over thirds of the events."""
    e = table(spark, sf_dir, "events")

    def record(k):
        text = lambda c: c.cast("string")
        return e.where(F.col("event_id") % 3 == k).agg(
            F.min("event_type").alias("scope"), F.sha2(text(F.count(F.lit(1))), 256).alias("rules_digest"), F.max("event_type").alias("profile"), text(F.countDistinct("user_id")).alias("scanner_version"),
            F.lit(None).cast("string").alias("catalog_version"), text(F.max("event_id")).alias("coverage_status"), F.lit("o").alias("options_digest"),
        )

    return D.drift(record(0), record(1))


_TRUTH = "rows AS (SELECT lang, source, CASE WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'negative' ELSE 'ambiguous' END AS label, {said} AS predicted FROM labels JOIN documents USING (doc_id))"
_RATE = "round(CASE WHEN {b} = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / ({b}) END, 9)"
_COUNTS = "CAST(count(*) FILTER (WHERE label = 'positive' AND predicted) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE label = 'negative' AND predicted) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE label = 'positive' AND NOT predicted) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE label = 'negative' AND NOT predicted) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE label NOT IN ('positive', 'negative')) AS BIGINT) AS excluded"
_RATES = ", ".join(_RATE.format(a=a, b=b) + f" AS {n}" for a, b, n in (("tp", "tp + fp", "precision"), ("tp", "tp + fn", "recall"), ("2 * tp", "2 * tp + fp + fn", "f1"), ("fp", "fp + tn", "fpr"), ("fn", "fn + tp", "fnr")))


def truth(spark, sf_dir, said):
    q = F.col("quality")
    label = F.when(q == 1, "positive").when(q == 0, "negative").otherwise("ambiguous")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").select("lang", "source", label.alias("label"), F.expr(said).alias("predicted"))


@query(f"WITH {_TRUTH.format(said='n_chars > 1000')}, c AS (SELECT lang, {_COUNTS} FROM rows GROUP BY lang) SELECT *, {_RATES} FROM c")
def agg_confusion_prf(spark, sf_dir):
    return Q.rates(Q.confusion(truth(spark, sf_dir, "n_chars > 1000"), "lang"))


@query(f"WITH {_TRUTH.format(said='n_chars > 1000')}, c AS (SELECT 'lang' AS stratum, lang AS value, {_COUNTS} FROM rows GROUP BY lang UNION ALL SELECT 'source', source, {_COUNTS} FROM rows GROUP BY source) SELECT *, {_RATES} FROM c")
def agg_stratify(spark, sf_dir):
    return Q.stratify(truth(spark, sf_dir, "n_chars > 1000"), "lang", "source")


@query(
    f"WITH {_TRUTH.format(said='n_chars > 1000')}, {_TRUTH.format(said='n_chars > 1500').replace('rows AS', 'rows2 AS')}, b AS (SELECT lang, {_COUNTS} FROM rows GROUP BY lang), a AS (SELECT lang, {_COUNTS} FROM rows2 GROUP BY lang) SELECT a.lang, a.tp - b.tp AS d_tp, a.fp - b.fp AS d_fp, a.fn - b.fn AS d_fn, a.tp < b.tp OR a.fp > b.fp OR a.fn > b.fn AS regressed FROM a JOIN b ON a.lang = b.lang"
)
def agg_nonregression(spark, sf_dir):
    one = lambda said: Q.confusion(truth(spark, sf_dir, said), "lang")
    return Q.nonregression(one("n_chars > 1000"), one("n_chars > 1500"), "lang")


@query(f"WITH {_TRUTH.format(said='n_chars > 1000')} SELECT source, CASE WHEN p > 0 AND q > 0 AND tp = p AND fp = 0 THEN 'Verified' WHEN p + q > 0 THEN 'Partial' WHEN a > 0 THEN 'Unknown' ELSE 'Not Tested' END AS coverage FROM (SELECT source, count(*) FILTER (WHERE label = 'positive') AS p, count(*) FILTER (WHERE label = 'negative') AS q, count(*) FILTER (WHERE label = 'ambiguous') AS a, count(*) FILTER (WHERE label = 'positive' AND predicted) AS tp, count(*) FILTER (WHERE label = 'negative' AND predicted) AS fp FROM rows GROUP BY source)")
def agg_rule_coverage(spark, sf_dir):
    return Q.rule_coverage(truth(spark, sf_dir, "n_chars > 1000"), "source")


_UNITS = "u AS (SELECT row_number() OVER (ORDER BY finding_id) AS unit_id, path, rule_id, line, col AS s, col + 3 AS e FROM findings WHERE line % 2 = 0), p AS (SELECT path, rule_id, line, col + k AS c, finding_id || '/' || k AS pred_id FROM findings, (VALUES (0), (1), (5)) t(k))"


def truth_match(spark, sf_dir):
    f = written(found(spark, sf_dir).select("finding_id", "path", "rule_id", "line", "column"), "findings")  # both sides of the match, scanned once
    units = f.where("line % 2 = 0").select(F.col("finding_id").alias("unit_id"), "path", "rule_id", "line", F.col("column").alias("start_column"), (F.col("column") + 3).alias("end_column"), F.lit(None).cast("string").alias("dependency_name"))
    preds = f.select("path", "rule_id", "line", "column", "finding_id", F.explode(F.array(*map(F.lit, (0, 1, 5)))).alias("k"))
    preds = preds.select(F.concat_ws("/", "finding_id", F.col("k").cast("string")).alias("pred_id"), "path", "rule_id", "line", (F.col("column") + F.col("k")).alias("column"), F.lit(None).cast("string").alias("dep_name"))
    return Q.first_match(Q.match_truth(preds, units))


@query(BASE + f', {_UNITS}, m AS (SELECT pred_id, p.path, p.rule_id, p.line, c, s, u.unit_id FROM p LEFT JOIN u ON u.path = p.path AND u.rule_id = p.rule_id AND u.line = p.line AND c >= s AND c < e) SELECT pred_id, c AS "column", unit_id IS NOT NULL AS inside, unit_id IS NOT NULL AND row_number() OVER (PARTITION BY unit_id ORDER BY line, c, pred_id) = 1 AS hit FROM m')
def join_truth_match(spark, sf_dir):
    return truth_match(spark, sf_dir).select("pred_id", "column", F.col("unit_id").isNotNull().alias("inside"), "hit")


@query("SELECT event_type, count(*) AS n, round(min(value), 9) AS least, round(median(value), 9) AS median, round(max(value), 9) AS greatest FROM events GROUP BY event_type")
def agg_distribution(spark, sf_dir):
    return Q.distribution(table(spark, sf_dir, "events"), "value", "event_type")


_SAMPLES = "s AS (SELECT event_type, event_id % 2 AS run, CASE WHEN user_id % 17 = 0 THEN 1 ELSE 0 END AS exit_code, 100 AS units, CAST(1 + event_id % 97 AS BIGINT) AS seconds FROM events)"


def samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 2).alias("run"), F.when(F.col("user_id") % 17 == 0, 1).otherwise(0).alias("exit_code"), F.lit(100).alias("units"), (1 + F.col("event_id") % 97).cast("long").alias("seconds"))


@query(f"WITH {_SAMPLES} SELECT event_type, CAST(count(*) FILTER (WHERE exit_code = 0) AS BIGINT) AS samples, CAST(count(*) FILTER (WHERE exit_code <> 0) AS BIGINT) AS failures, round(CAST(sum(units) FILTER (WHERE exit_code = 0) AS DOUBLE) / sum(seconds) FILTER (WHERE exit_code = 0), 9) AS per_second, CAST(max(seconds) FILTER (WHERE exit_code = 0) AS BIGINT) AS slowest FROM s GROUP BY event_type")
def agg_throughput(spark, sf_dir):
    return Q.throughput(samples(spark, sf_dir), "event_type").withColumn("slowest", F.col("slowest").cast("long"))


@query("SELECT coalesce(category, '?') AS category, severity, count(*) AS n FROM (VALUES " + _RULES + ") r(id, kind, category, severity, risk, confidence, hint, pattern, scope, description) GROUP BY 1, 2")
def agg_rule_counts(spark, sf_dir):
    return R.frame(spark).groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, {sql_id('document', 'doc_id', 'lang', 'text')} AS id FROM documents")
def fn_native_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.native_id("document", F.col("doc_id"), F.col("lang"), F.col("text")).alias("id"))


@query(r"""SELECT doc_id, CAST(length(left(text, n)) - length(replace(left(text, n), chr(10), '')) + 1 AS INT) AS line, CAST(length(split_part(left(text, n), chr(10), -1)) + 1 AS INT) AS "column", """ + sql_mask("text") + " AS masked FROM (SELECT doc_id, text, length(text) // 2 AS n FROM documents)")
def fn_line_col_mask(spark, sf_dir):
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", S.line_of(F.col("text"), half).alias("line"), S.column_of(F.col("text"), half).alias("column"), S.mask_preview(F.col("text")).alias("masked"))


def _sql_redact(x: str) -> str:
    """The same two passes for an engine without lookahead: what ends a value is taken and put back."""
    mark, stop = "\ue000", S.STOP.replace("(?:", "(", 1)
    steps = [
        (S.LOGIN, rf"\1{S.USERINFO}@"), (S.PARAMETER, rf"\1{S.VALUE}"), (S.NAMED, rf"\0{mark}"),
        (rf'{mark}"(?:\\.|[^"\\])*"{stop}', rf'"{S.VALUE}"\1'), (rf"{mark}'(?:\\.|[^'\\])*'{stop}", rf"'{S.VALUE}'\1"),
        (rf"(?i){mark}(bearer|basic)\s+[-a-z0-9._~+/=]+{stop}", rf"\1 {S.VALUE}\2"), (rf"(?i){mark}({'|'.join(S.CODE_WORDS)}){stop}", r"\1\2"), (rf"(?i){mark}((?:bearer|basic)\s+\[masked)", r"\1"), (rf"(?i){mark}[-a-z0-9_+/=]+{stop}", rf"{S.VALUE}\1"),
    ]
    out = x
    for pattern, to in steps:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    encoded = rf"regexp_matches(trim({x}), '^[A-Za-z0-9+/=_-]{{64,}}$') AND (trim({x}) LIKE 'MII%' OR trim({x}) LIKE '%=')"
    return f"CASE WHEN regexp_matches({x}, {_quoted(S.PRIVATE_MARKER)}) THEN {_quoted(S.PRIVATE_MATERIAL)} WHEN {encoded} THEN {_quoted(S.SENSITIVE)} ELSE replace({out}, '{mark}', '') END"


@query(f"WITH {_FILES}, {_LINES} SELECT path, line, {_sql_redact('content')} AS clean FROM lines")
def fn_redact_text(spark, sf_dir):
    """Every line, redacted."""
    rows = X.lines(X.corpus(table(spark, sf_dir, "documents")))
    return rows.select("path", "line", S.redact_text(F.col("content")).alias("clean"))


@query("SELECT page_id, replace(replace(replace(url_encode(url), '%2F', '/'), '%7E', '~'), '*', '%2A') AS uri FROM pages")
def fn_path_to_uri(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.path_to_uri(F.col("url")).alias("uri"))


_OCTETS = "page_id * 7919 % 256 AS a, page_id * 104729 % 256 AS b, page_id * 31 % 256 AS c, page_id % 256 AS d"


@query(
    f"""SELECT page_id, a || '.' || b || '.' || c || '.' || d AS ip, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2))
    OR (a = 192 AND b = 88 AND c = 99) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) AS special FROM (SELECT page_id, {_OCTETS} FROM pages)"""
)
def fn_target_authorized(spark, sf_dir):
    """Addresses dealt over all first octets: which of them no probe may address."""
    k = F.col("page_id")
    ip = F.concat_ws(".", *((k * m % 256).cast("string") for m in (7919, 104729, 31, 1)))
    return table(spark, sf_dir, "pages").select("page_id", ip.alias("ip"), S.special_address(ip).alias("special"))


#: Offered names and what they are, dealt over the pages.
_OFFERED = (("kex", "curve25519-sha256", "classical"), ("kex", "sntrup761x25519-sha512@openssh.com", "hybrid"), ("kex", "mlkem768x25519-sha256", "hybrid"), ("kex", "ext-info-c", "marker"), ("kex", "own@vendor", "unknown"), ("host_key", "ssh-ed25519", "classical"), ("host_key", "rsa-sha2-512", "classical"), ("host_key", "mlkem768x25519-sha256", "unknown"))
_OFFER = lambda i: f"[{_list(x[i] for x in _OFFERED)}][page_id % 8 + 1]"


@query(f"SELECT page_id, {_OFFER(0)} AS kind, {_OFFER(1)} AS name, {_OFFER(2)} AS class FROM pages")
def fn_ssh_classify(spark, sf_dir):
    pick = lambda i: F.get(F.array(*(F.lit(x[i]) for x in _OFFERED)), (F.col("page_id") % 8).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", pick(0).alias("kind"), pick(1).alias("name")).withColumn("class", A.ssh_name(F.col("kind"), F.col("name")))


_RESULTS = "r AS (SELECT path, rule_id, line, col, sha256(match) AS digest, count(*) OVER (PARTITION BY path, rule_id, line, col, match) AS n, finding_id FROM findings), al AS (SELECT DISTINCT path, rule_id, line, col, digest, CASE WHEN rule_id = 'HASH_MD5' THEN 2 ELSE 1 END AS allowed FROM r WHERE rule_id IN ('HASH_MD5', 'JWT_RSA'))"


@query(BASE + f", {_RESULTS} SELECT finding_id FROM r WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.path = r.path AND al.rule_id = r.rule_id AND al.line = r.line AND al.col = r.col AND al.digest = r.digest AND al.allowed = r.n)")
def join_reviewed_results(spark, sf_dir):
    results = found(spark, sf_dir).withColumn("digest", F.sha2("match", 256))
    allowed = results.where("rule_id in ('HASH_MD5', 'JWT_RSA')").select("path", "digest", "rule_id", "line", "column", F.when(F.col("rule_id") == "HASH_MD5", 2).otherwise(1).alias("count")).distinct()
    return D.reviewed(results, allowed).select("finding_id")


_TREE = "SELECT CAST(p_partkey AS VARCHAR) AS src, CAST(p_partkey // 2 AS VARCHAR) AS dst FROM part UNION ALL SELECT '0', '3'"


@query(f"WITH RECURSIVE e AS ({_TREE}), r(root, node) AS (SELECT CAST(p_partkey AS VARCHAR), CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 50 = 0 UNION SELECT root, dst FROM r JOIN e ON e.src = r.node) SELECT root, node FROM r")
def agg_closure(spark, sf_dir):
    """A tree of parts whose root leads back into it."""
    part = table(spark, sf_dir, "part")
    edges = part.select(F.col("p_partkey").cast("string").alias("src"), F.floor(F.col("p_partkey") / 2).cast("string").alias("dst"))
    back = spark.createDataFrame([("0", "3")], "src string, dst string")
    return D.closure(edges.unionByName(back), part.where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("string").alias("node")))
