"""What to do about findings: the profile of a repository, targets, and advice by language and protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.functions import documents as T
from cipherlake.functions import scalars as S

#: Middleware that advice is given for, and what in a path tells of it.
TARGETS = {"k8s": ("k8s", "kubernetes", "ingress", "gatewayapi"), "nginx": ("nginx",), "httpd": ("httpd", "apache"), "envoy": ("envoy",), "istio": ("istio",), "haproxy": ("haproxy",), "traefik": ("traefik",)}
#: Signals that dependencies give, and the names that give them.
SIGNALS = {"java-bouncycastle": "bouncycastle|bcprov|bcpkix", "jwt-lib": "jsonwebtoken|^jose$", "openssl": "openssl"}
#: What each language's runtime can do, and from which version on.
RUNTIME = {"java": ("JCA ML-KEM and ML-DSA", 24), "go": ("crypto/mlkem and hybrid TLS", 1), "javascript": ("ML-DSA and ML-KEM in crypto", 24), "typescript": ("ML-DSA and ML-KEM in crypto", 24), "python": ("cryptography on OpenSSL 3.5", 3), "rust": ("rustls X25519MLKEM768", 1), "ruby": ("openssl gem groups", 3)}
#: Rules whose advice is their own alone.
OWN_ADVICE = {"TLS_CIPHER_RSA": "tls.remove-rsa-kex"}
#: Hardening of each target.
HARDENING = {"k8s": "tls.k8s-ingress-hardening", "nginx": "tls.nginx-hardening", "httpd": "tls.httpd-hardening", "envoy": "tls.envoy-hardening", "istio": "tls.istio-hardening"}


def _lower(name: str) -> Column:
    return F.lower(F.col(name))


def middleware_targets(found: DataFrame) -> Column:
    """Targets of a finding, comma-joined: only for TLS and middleware, by rule name or path."""
    each = [F.when(_lower("rule_id").startswith(f"{t}_") | _lower("path").rlike("|".join(words)), F.lit(t)) for t, words in TARGETS.items()]
    return F.when(_lower("category").isin("tls", "middleware"), F.concat_ws(",", *each)).otherwise("")


def runtime_profile(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(kind, name, value): the first version of each language in file order, middleware seen in paths, and signals of dependencies.

    files: path, text, file_seq; dependencies: name."""
    hinted = files.select("file_seq", T.version_hint(F.col("path"), F.col("text")).alias("h")).where("h is not null")
    versions = hinted.groupBy(F.col("h.language").alias("name")).agg(F.min_by("h.version", "file_seq").alias("value")).select(F.lit("version").alias("kind"), "name", "value")
    seen = F.array_compact(F.array(*(F.when(_lower("path").rlike("|".join(w)), F.lit(t)) for t, w in TARGETS.items())))
    targets = files.select(F.explode(seen).alias("name")).distinct().select(F.lit("middleware").alias("kind"), "name", F.lit("").alias("value"))
    told = F.array_compact(F.array(*(F.when(_lower("name").rlike(p), F.lit(s)) for s, p in SIGNALS.items())))
    signals = dependencies.select(F.explode(told).alias("name")).distinct().select(F.lit("signal").alias("kind"), "name", F.lit("").alias("value"))
    return versions.unionByName(targets).unionByName(signals)


def language_of(path: Column, rule: Column) -> Column:
    """The language of a finding: of its rule's name, else of its file."""
    from cipherlake.sources import files as X

    by_rule = F.when(rule.startswith("JCA_"), "java").when(rule.startswith("GO_"), "go").when(rule.startswith("PY_"), "python")
    return F.coalesce(by_rule, X.language(path))


def runtime_note(language: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in RUNTIME.items() for x in (k, v[0]))), language)


def java_family(version: Column, signals: Column) -> Column:
    """Advice for Java, comma-joined: the platform's own algorithms from 24 on, else an upgrade; a provider where it is there already or the platform is older."""
    new = F.coalesce(T.first_number(version) >= RUNTIME["java"][1], F.lit(False))
    return F.concat_ws(",", F.when(new, "java.jca-ml-dsa-ml-kem").otherwise("java.runtime-upgrade-for-pqc"), F.when(F.array_contains(signals, "java-bouncycastle") | ~new, "java.bouncycastle-pqc"))


def tls_family(found: DataFrame) -> Column:
    """Advice for TLS, comma-joined: a rule's own alone if it has one; else hardening of each target, for configuration only, and a note for each."""
    own = F.element_at(F.create_map(*(F.lit(x) for kv in OWN_ADVICE.items() for x in kv)), F.col("rule_id"))
    targets = middleware_targets(found)
    config = S.extension(F.col("path")).isin("conf", "cfg", "yml", "yaml", "ini")
    hardening = F.create_map(*(F.lit(x) for kv in HARDENING.items() for x in kv))
    listed = F.when(targets != "", F.split(targets, ",")).otherwise(F.array().cast("array<string>"))
    harden = F.when(config, F.array_compact(F.transform(listed, lambda t: F.element_at(hardening, t)))).otherwise(F.array().cast("array<string>"))
    notes = F.transform(listed, lambda t: F.concat(t, F.lit(".pqc-signature-readiness-note")))
    return F.coalesce(own, F.array_join(F.concat(harden, notes), ","))
