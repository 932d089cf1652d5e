"""What the contracts fix without any model, as queries of their own, so that SQL can check it on whole tables.

Each takes its columns from the operator's own query; only the method's columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import pii, quality, secret_scan
from .shared import table


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and base verdict of the quality rules."""
    return quality.query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of addresses, cards and phones."""
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the base secrets."""
    return secret_scan.query(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id
"""
_LUHN = "list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[len(x) + 1 - i] AS INT) ELSE CAST(x[len(x) + 1 - i] AS INT) * 2 - CASE WHEN CAST(x[len(x) + 1 - i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_PII = rf"""
SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
       CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS INT), 0) > 255)) = 0)) AS BIGINT) AS n_ip,
       CAST(len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 13 AND 19 AND {_LUHN})) AS BIGINT) AS n_card,
       CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
_SECRETS = r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda m: length(m) >= 8)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda m: length(m) >= 16)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda m: length(m) >= 32)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
QUERIES = {"base_quality_rules": quality_base, "base_pii": pii_base, "base_secret_scans": secrets_base}
ORACLE_SQL = {"base_quality_rules": _QUALITY, "base_pii": _PII, "base_secret_scans": _SECRETS}
