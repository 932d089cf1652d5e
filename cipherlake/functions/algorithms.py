"""What is known of algorithms, and the review policy over it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of the recognised vocabulary that differ from the canonical name.
SPELLINGS = {
    "ml-kem-512": "ML-KEM-512", "ml-kem-768": "ML-KEM-768", "MlKem768": "ML-KEM-768", "MLKEM768PrivateKey": "ML-KEM-768", "ml-kem-1024": "ML-KEM-1024", "MlKem1024": "ML-KEM-1024", "MLKEM1024PrivateKey": "ML-KEM-1024", "mlkem": "ML-KEM", "ml_kem": "ML-KEM",
    "mldsa": "ML-DSA", "ml_dsa": "ML-DSA", "ml-dsa-44": "ML-DSA-44", "MLDSA44PrivateKey": "ML-DSA-44", "ml-dsa-65": "ML-DSA-65", "MLDSA65PrivateKey": "ML-DSA-65", "ml-dsa-87": "ML-DSA-87", "MLDSA87PrivateKey": "ML-DSA-87", "slh_dsa": "SLH-DSA",
}
CANONICAL = ("ML-KEM", "ML-KEM-512", "ML-KEM-768", "ML-KEM-1024", "ML-DSA", "ML-DSA-44", "ML-DSA-65", "ML-DSA-87", "SLH-DSA", "RSA", "RS256", "RS384", "RS512", "ES256", "Ed25519", "Kyber512", "Kyber768", "Kyber1024", "Dilithium2", "Dilithium3", "Dilithium5", "X25519Kyber768Draft00")
#: Object identifiers.
OIDS = {
    "2.16.840.1.101.3.4.4.1": "ML-KEM-512", "2.16.840.1.101.3.4.4.2": "ML-KEM-768", "2.16.840.1.101.3.4.4.3": "ML-KEM-1024", "2.16.840.1.101.3.4.3.17": "ML-DSA-44", "2.16.840.1.101.3.4.3.18": "ML-DSA-65", "2.16.840.1.101.3.4.3.19": "ML-DSA-87",
    **{f"2.16.840.1.101.3.4.3.{20 + i}": f"SLH-DSA-{h}-{n}{v}" for i, (h, n, v) in enumerate((h, n, v) for h in ("SHA2", "SHAKE") for n in (128, 192, 256) for v in "sf")},
    "1.2.840.113549.1.1.1": "RSA", "1.2.840.113549.1.1.10": "RSA-PSS", "1.2.840.113549.1.1.11": "RSA-SHA256", "1.2.840.113549.1.1.12": "RSA-SHA384", "1.2.840.113549.1.1.13": "RSA-SHA512", "1.2.840.113549.1.1.5": "RSA-SHA1", "1.2.840.113549.1.1.4": "RSA-MD5",
    "1.2.840.10045.2.1": "EC", "1.2.840.10045.4.3.2": "ECDSA", "1.2.840.10045.4.3.3": "ECDSA", "1.2.840.10045.4.3.4": "ECDSA", "1.2.840.10045.4.1": "ECDSA-SHA1", "1.2.840.10040.4.1": "DSA", "1.2.840.10040.4.3": "DSA-SHA1", "1.3.101.112": "Ed25519", "1.3.101.110": "X25519",
}


class Algorithm(NamedTuple):
    identifier: str
    construction: str
    standardization: str
    purpose: str
    exposure: str
    parameters_known: bool
    concerns: str = ""


def catalog() -> list[Algorithm]:
    """One row for each known identifier, built by family."""
    out = []
    sign, kem = "signature", "key_establishment"
    slh = [f"SLH-DSA-{h}-{n}{v}" for h in ("SHA2", "SHAKE") for n in (128, 192, 256) for v in "sf"]
    for name in ("ML-KEM", "ML-KEM-512", "ML-KEM-768", "ML-KEM-1024", "ML-DSA", "ML-DSA-44", "ML-DSA-65", "ML-DSA-87", "SLH-DSA", *slh):
        exact = name not in ("ML-KEM", "ML-DSA", "SLH-DSA")
        out.append(Algorithm(name, "post_quantum", "nist_final", kem if name.startswith("ML-KEM") else sign, "designed_resistant" if exact else "unknown", exact))
    for name in ("Kyber512", "Kyber768", "Kyber1024", "Dilithium2", "Dilithium3", "Dilithium5"):
        out.append(Algorithm(name, "post_quantum", "draft", kem if name.startswith("Kyber") else sign, "unknown", False))
    out.append(Algorithm("X25519Kyber768Draft00", "hybrid", "draft", kem, "unknown", False))
    for name in ("RSA-PSS", "RS256", "RS384", "RS512", "RSA-SHA256", "RSA-SHA384", "RSA-SHA512", "RSA-SHA1", "RSA-MD5", "ECDSA", "ECDSA-SHA1", "ES256", "DSA", "DSA-SHA1", "Ed25519"):
        weak = "signature_uses_weak_collision_digest" if name.endswith(("SHA1", "MD5")) else ""
        out.append(Algorithm(name, "classical_public_key", "classical_standard", sign, "vulnerable", name in ("ES256", "Ed25519"), weak))
    for name in ("ECDH", "DH", "X25519"):
        out.append(Algorithm(name, "classical_public_key", "classical_standard", kem, "vulnerable", name == "X25519"))
    for name in ("RSA", "EC"):
        out.append(Algorithm(name, "classical_public_key", "classical_standard", "unknown", "vulnerable", False))
    for bits in (128, 192, 256):
        out.append(Algorithm(f"AES-{bits}", "symmetric", "classical_standard", "encryption", "generic_search", True))
    for name in ("SHA-1", "SHA-256", "SHA-384", "SHA-512", "MD5"):
        out.append(Algorithm(name, "hash", "classical_standard", "hash", "generic_search", True, "weak_collision_resistance" if name in ("SHA-1", "MD5") else ""))
    return out


SCHEMA = "identifier string, construction string, standardization string, purpose string, exposure string, parameters_known boolean, concerns string"


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog(), SCHEMA)


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def recognized(token: Column) -> Column:
    """The canonical name of an exactly spelled token; null for all others, which are not kept."""
    return F.coalesce(_lookup(SPELLINGS, token), F.when(token.isin(*CANONICAL), token))


#: A known spelling as a whole token; texts are not cut into tokens, of which nearly all are no names.
_KNOWN = sorted({*SPELLINGS, *CANONICAL}, key=lambda x: (-len(x), x))
_WHOLE = rf"(?<![A-Za-z0-9_-])(?=[{''.join(sorted({x[0] for x in _KNOWN}))}])(?:{'|'.join(_KNOWN)})(?![A-Za-z0-9_-])"


def algorithms_in(text: Column) -> Column:
    """Sorted distinct algorithms that a text names."""
    named = F.regexp_extract_all(text, F.lit(_WHOLE), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(named), recognized)))


def namespace(identifier: Column) -> Column:
    return F.when(identifier.startswith("Kyber") | identifier.startswith("Dilithium") | identifier.contains("Draft"), "draft").otherwise("named")


def canonical_oid(identifier: Column) -> Column:
    return F.coalesce(_lookup(OIDS, identifier), identifier)


#: Sizes of named curves.
CURVES = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521}


def assess(used: DataFrame, column: str = "identifier", key_bits: str | None = None, curve: str | None = None) -> DataFrame:
    """Rows with what the catalog knows of their algorithm; unknown ones say so. Key sizes settle RSA and EC parameters."""
    known = frame(used.sparkSession).withColumnRenamed("identifier", "_id")
    rows = used.join(F.broadcast(known), canonical_oid(F.col(column)) == F.col("_id"), "left")
    fill = {c: F.coalesce(c, F.lit("unknown")) for c in ("construction", "standardization", "purpose", "exposure")}
    bits = F.col(key_bits) if key_bits else F.lit(None).cast("int")
    if curve:
        bits = F.when(F.col("_id").isin("EC", "ECDH", "ECDSA"), F.coalesce(bits, F.element_at(F.create_map(*(F.lit(x) for kv in CURVES.items() for x in kv)), F.col(curve)))).otherwise(bits)
    sized = F.coalesce(F.col("_id").isin("RSA", "RSA-PSS", "EC", "ECDH", "ECDSA") & bits.isNotNull(), F.lit(False))
    small = sized & (bits < F.when(F.col("_id").startswith("RSA"), 2048).otherwise(224))
    concerns = F.when(small, "public_key_below_local_minimum").otherwise(F.coalesce("concerns", F.lit("")))
    return rows.withColumns(fill | {"parameters_known": F.coalesce("parameters_known", F.lit(False)) | sized, "concerns": concerns}).drop("_id")


#: What each declared use is for.
USE_PURPOSE = {"jwt": "signature", "signature": "signature", "pki": "signature", "tls": "key_establishment", "key_establishment": "key_establishment", "hash": "hash", "encryption": "encryption"}


def decide(assessed: DataFrame, applicability: str | None, use_case: str | None, support: dict[str, bool | None] | None = None, collision_required: bool | None = None) -> DataFrame:
    """The review policy: the first rung that applies decides. Undeclared support is unknown, never true."""
    support = support or {}
    wanted = USE_PURPOSE.get(use_case or "", "unknown")
    needs = ["runtime", "provider", "parameters"] + ["peer"] * (wanted in ("key_establishment", "signature")) + ["protocol"] * (wanted != "hash")
    needs += ["jose", "verifiers"] * (use_case == "jwt") + ["pki"] * (use_case == "pki")
    ready = all(support.get(n) is True for n in needs)
    collision = collision_required is True or use_case in ("jwt", "pki", "signature")
    weak, concern = F.col("concerns") == "weak_collision_resistance", F.col("concerns") != ""
    known = (concern & ~weak) | (weak & F.lit(collision))
    bad = (F.col("exposure") == "vulnerable") | known
    why = F.concat_ws("+", F.when(F.col("exposure") == "vulnerable", "observed_primitive_quantum_vulnerable"), F.when(known, "known_classical_concern_in_profile_scope"))
    ladder = [
        (F.lit(applicability == "not_applicable"), "not_applicable", F.lit("operator_excluded_local_profile")),
        (F.lit(applicability in (None, "unknown")), "indeterminate", F.lit("profile_applicability_unknown")),
        (bad, "fail", why),
        ((F.col("exposure") == "unknown") | ~F.col("parameters_known"), "indeterminate", F.lit("algorithm_or_parameters_unresolved")),
        (concern, "indeterminate", F.lit("classical_concern_context_unresolved")),
        ((F.col("purpose") == "unknown") | (F.col("purpose") != wanted), "indeterminate", F.lit("use_case_unknown_or_purpose_mismatch")),
        (F.lit(not ready), "indeterminate", F.lit("required_support_not_declared_true")),
    ]
    decision, reason = F.when(ladder[0][0], ladder[0][1]), F.when(ladder[0][0], ladder[0][2])
    for condition, verdict, text in ladder[1:]:
        decision, reason = decision.when(condition, verdict), reason.when(condition, text)
    return assessed.withColumns({"decision": decision.otherwise("pass"), "reasons": reason.otherwise("bounded_primitive_review_only_operator_claims_unverified")})


#: What to move to, by purpose.
CANDIDATES = {"key_establishment": "ML-KEM", "signature": "ML-DSA", "hash": "SHA-256", "encryption": "AES"}


def candidates(assessed: DataFrame, use_case: str | None = None) -> DataFrame:
    """(identifier, candidate): a known purpose has one; an unknown one that is vulnerable has both public-key ones."""
    wanted = USE_PURPOSE.get(use_case or "", "unknown")
    both = F.array(F.lit("key_establishment"), F.lit("signature"))
    named = F.array(F.col("purpose"))
    open_purpose = F.lit(wanted) if wanted in ("signature", "key_establishment") else F.lit(None).cast("string")
    unknown = F.when(F.lit(wanted == "unknown") & (F.col("exposure") == "vulnerable"), both).when(open_purpose.isNotNull(), F.array(open_purpose))
    purposes = F.when((F.col("purpose") != "unknown") & (F.lit(wanted == "unknown") | (F.col("purpose") == wanted)), named).when(F.col("purpose") == "unknown", unknown)
    known = assessed.where(F.col("construction") != "unknown")
    return known.select("identifier", F.explode(purposes).alias("for_purpose")).distinct().select("identifier", "for_purpose", _lookup(CANDIDATES, F.col("for_purpose")).alias("candidate"))


def policy_summary(decided: DataFrame, complete: bool) -> DataFrame:
    """One row; it passes only if everything does and the inspection was complete, which a static scan never is."""
    has = lambda d: F.coalesce(F.bool_or(F.col("decision") == d), F.lit(False))
    decision = F.when(has("fail"), "fail").when(F.lit(complete) & has("pass") & ~has("indeterminate"), "pass").otherwise("indeterminate")
    return decided.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "fail").alias("failing"), decision.alias("decision"))


#: Recommended actions: (id, priority, title, condition over findings). The ids are fixed values.
ACTIONS = (
    ("incident.private-key-rotation", 1, "Remove and rotate the private key", "evidence_type = 'private_key'"),
    ("plan.hybrid-migration", 2, "Plan a staged or hybrid move", "risk = 'quantum-vulnerable'"),
    ("jwt.remove-rsa-algorithms", 2, "Inventory token issuers and verifiers", "category = 'jwt'"),
    ("tls.remove-rsa-kex", 2, "Take key transport by RSA out of the suites", "rule_id = 'TLS_CIPHER_RSA'"),
    ("pki.hybrid-certificate-roadmap", 3, "Plan certificates with post-quantum signatures", "category = 'pki'"),
    ("runtime.verify-pqc-capabilities", 3, "Find out what the deployed runtime can do", "category in ('crypto', 'jwt', 'tls', 'pki')"),
    ("dependency.track-pqc-readiness", 3, "Follow the library's post-quantum plans", "substr(rule_id, 1, 4) = 'DEP_'"),
    ("java.jca-ml-dsa-ml-kem", 4, "Use the platform's ML-DSA and ML-KEM", "path like '%.java' and risk = 'quantum-vulnerable'"),
    ("java.runtime-upgrade-for-pqc", 5, "Move to a platform that has them", "path like '%.java' and risk = 'quantum-vulnerable'"),
    ("java.bouncycastle-pqc", 5, "Or use a provider that has them", "path like '%.java' and risk = 'quantum-vulnerable'"),
    ("node.webcrypto.pqc", 4, "Use the runtime's ML-DSA and ML-KEM", "(path like '%.js' or path like '%.ts') and risk = 'quantum-vulnerable'"),
    ("go.hybrid-kem", 4, "Use crypto/mlkem beside the classical exchange", "path like '%.go' and risk = 'quantum-vulnerable'"),
    ("python.signing-gateway", 4, "Sign behind one gateway that can change", "path like '%.py' and risk = 'quantum-vulnerable'"),
    ("rust.oqs-integration", 4, "Choose a provider with post-quantum groups", "path like '%.rs' and risk = 'quantum-vulnerable'"),
    ("ruby.crypto-service-boundary", 4, "Keep keys behind a service that can change", "path like '%.rb' and risk = 'quantum-vulnerable'"),
    ("tls.nginx-hardening", 4, "TLS 1.3 and hybrid groups in nginx", "category = 'tls' and path like '%nginx%'"),
    ("tls.httpd-hardening", 4, "TLS 1.3 and hybrid groups in httpd", "category = 'tls' and path like '%httpd%'"),
    ("tls.envoy-hardening", 4, "TLS 1.3 and hybrid groups in Envoy", "category = 'tls' and path like '%envoy%'"),
    ("tls.istio-hardening", 4, "TLS 1.3 and hybrid groups in Istio", "category = 'tls' and path like '%istio%'"),
    ("tls.k8s-ingress-hardening", 4, "TLS 1.3 and hybrid groups at the ingress", "category = 'tls' and path like '%ingress%'"),
    ("nginx.pqc-signature-readiness-note", 6, "Signatures are a matter of certificates", "category in ('tls', 'middleware') and path like '%nginx%'"),
    ("envoy.pqc-signature-readiness-note", 6, "Signatures are a matter of certificates", "category in ('tls', 'middleware') and path like '%envoy%'"),
    ("istio.pqc-signature-readiness-note", 6, "Signatures are a matter of certificates", "category in ('tls', 'middleware') and path like '%istio%'"),
    ("haproxy.pqc-signature-readiness-note", 6, "Signatures are a matter of certificates", "category in ('tls', 'middleware') and path like '%haproxy%'"),
    ("traefik.pqc-signature-readiness-note", 6, "Signatures are a matter of certificates", "category in ('tls', 'middleware') and path like '%traefik%'"),
    ("k8s.pqc-signature-readiness-note", 6, "Signatures are a matter of certificates", "category in ('tls', 'middleware') and path like '%k8s%'"),
    ("cryptoapi.abstraction-layer", 7, "Put cryptography behind one interface", "category = 'crypto'"),
    ("tls.review-reference", 8, "Review where TLS is set up", "category = 'tls'"),
    ("crypto.review-reference", 9, "Review how the algorithm is used", "risk <> 'quantum-safe'"),
)


def recommend(found: DataFrame, limit: int = 4) -> DataFrame:
    """(finding_id, actions): the ids of the first actions by priority, each once."""
    items = F.array(*(F.when(F.expr(c), F.struct(F.lit(p).alias("p"), F.lit(a).alias("a"))) for a, p, _, c in ACTIONS))
    chosen = F.slice(F.array_sort(F.filter(items, lambda x: x.isNotNull())), 1, limit)
    return found.select("finding_id", F.array_join(F.transform(chosen, lambda x: x["a"]), ",").alias("actions"))


def ssh_name(kind: Column, name: Column) -> Column:
    """What an offered SSH algorithm is: marker, hybrid, post_quantum, classical or unknown."""
    marker = name.isin("ext-info-c", "ext-info-s", "kex-strict-c-v00@openssh.com", "kex-strict-s-v00@openssh.com")
    hybrid = name.rlike(r"^(sntrup761x25519-sha512|mlkem(768|1024)(x25519|nistp256|nistp384)-sha(256|384|512))(@openssh\.com)?$")
    classical = F.when(kind == "kex", name.rlike(r"^(curve25519-sha256(@libssh\.org)?|ecdh-sha2-nistp(256|384|521)|diffie-hellman-group.*)$")).otherwise(name.rlike(r"^(ssh-rsa|rsa-sha2-(256|512)|ssh-ed25519|ssh-dss|ecdsa-sha2-nistp(256|384|521))$"))
    return F.when(marker, "marker").when(hybrid & (kind == "kex"), "hybrid").when(classical, "classical").otherwise("unknown")


def tls_group(group: Column) -> Column:
    return F.when(group.between(4587, 4589), "hybrid").when(group.isin(23, 24, 29), "classical").otherwise("unknown")
