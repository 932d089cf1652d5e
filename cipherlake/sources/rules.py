"""Detection rules: an own pack, a YAML loader, and validation that takes all rules or none."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Rule(NamedTuple):
    id: str
    kind: str
    category: str
    severity: str
    risk: str
    confidence: float
    migration_hint: str
    pattern: str
    scope: str = "*"
    description: str = ""
    hints: tuple[str, ...] = ()  # lower-case text of which a match holds at least one: a quick look before the pattern


KINDS = ("regex", "tree_sitter", "dependency", "certificate", "key")
SEVERITIES = ("info", "low", "medium", "high", "critical")
RISKS = ("quantum-vulnerable", "quantum-uncertain", "quantum-safe", "non-quantum-risk")
SCHEMA = "id string, kind string, category string, severity string, risk string, confidence float, migration_hint string, pattern string, scope string, description string"

#: Patterns use only what Java's and RE2's dialects share, so the SQL twins can run them.
PACK = (
    Rule("JWT_RSA", "regex", "jwt", "medium", "quantum-vulnerable", 0.8, "Plan ML-DSA once JOSE registers it", r"\b(RS256|RS384|RS512)\b", "*", "RSA signatures in tokens", ("rs256", "rs384", "rs512",)),
    Rule("JWT_EC", "regex", "jwt", "medium", "quantum-vulnerable", 0.8, "Plan ML-DSA once JOSE registers it", r"\b(ES256|ES384|ES512)\b", "*", "Elliptic-curve signatures in tokens", ("es256", "es384", "es512",)),
    Rule("TLS_OLD_VERSION", "regex", "tls", "high", "non-quantum-risk", 0.9, "Allow TLS 1.2 or later only", r"TLSv1(\.1)?\b", "config", "Outdated protocol versions", ("tlsv1",)),
    Rule("TLS_CIPHER_RSA", "regex", "tls", "medium", "quantum-vulnerable", 0.6, "Prefer hybrid key exchange", r"\bTLS_RSA_WITH_[A-Z0-9_]+", "config", "Key transport by RSA", ("tls_rsa_with_",)),
    Rule("HASH_SHA1", "regex", "crypto", "medium", "non-quantum-risk", 0.7, "Use SHA-256", r"(?i)\bsha-?1\b", "*", "Weak hash", ("sha",)),
    Rule("HASH_MD5", "regex", "crypto", "high", "non-quantum-risk", 0.7, "Use SHA-256", r"(?i)\bmd5\b", "*", "Broken hash", ("md5",)),
    Rule("SSH_DH_SHA1", "regex", "ssh", "high", "quantum-vulnerable", 0.9, "Use a hybrid key exchange", r"diffie-hellman-group[0-9]+-sha1", "config", "Old SSH key exchange", ("diffie-hellman-group",)),
    Rule("SSH_CURVE", "regex", "ssh", "low", "quantum-vulnerable", 0.4, "Use a hybrid key exchange", r"curve25519-sha256", "config", "Classical SSH key exchange", ("curve25519-sha256",)),
    Rule("OPENSSL_GENRSA", "regex", "pki", "medium", "quantum-vulnerable", 0.44, "Review key sizes", r"\bopenssl genrsa\b", "*", "RSA key generation", ("openssl genrsa",)),
    Rule("JCA_RSA", "regex", "crypto", "medium", "quantum-vulnerable", 0.9, "Use ML-KEM or ML-DSA providers", r"getInstance\(\"RSA", "java", "RSA through JCA", ('getinstance("rsa',)),
    Rule("JCA_DES", "regex", "crypto", "critical", "non-quantum-risk", 0.9, "Use AES-GCM", r"getInstance\(\"DES", "java", "DES through JCA", ('getinstance("des',)),
    Rule("PQC_KEM", "regex", "pqc", "info", "quantum-safe", 0.9, "None", r"\bML-KEM-(512|768|1024)\b", "*", "Post-quantum key establishment", ("ml-kem-",)),
    Rule("PQC_DRAFT", "regex", "pqc", "low", "quantum-uncertain", 0.9, "Move to the final standard", r"\b(X25519)?Kyber(512|768|1024)[A-Za-z0-9]*", "*", "Draft post-quantum names", ("kyber",)),
    Rule("KEY_PRIVATE", "key", "KeyMaterial", "critical", "quantum-vulnerable", 0.95, "Remove the key and rotate it", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----", "*", "Private key in a file", ("private key-----",)),
)

#: Further rules by family: (id, category, severity, risk, confidence, pattern, hints, scope, description); the family gives the hint for migration.
_FAMILIES = {
    "Plan ML-DSA signatures": (
        ("JWT_PSS", "jwt", "medium", "quantum-vulnerable", 0.8, r"\bPS(256|384|512)\b", ("ps256", "ps384", "ps512"), "*", "RSA-PSS signatures in tokens"),
        ("JWT_EDDSA", "jwt", "low", "quantum-vulnerable", 0.6, r"\bEdDSA\b", ("eddsa",), "*", "Edwards-curve signatures in tokens"),
        ("JWT_NONE", "jwt", "critical", "non-quantum-risk", 0.7, r"(?i)[\"']?alg[\"']?\s*[:=]\s*[\"']none[\"']", ("none",), "*", "Tokens without a signature"),
        ("SIG_ECDSA", "crypto", "medium", "quantum-vulnerable", 0.7, r"(?i)\becdsa\b", ("ecdsa",), "*", "Elliptic-curve signatures"),
        ("SIG_ED25519", "crypto", "low", "quantum-vulnerable", 0.6, r"(?i)\bed25519\b", ("ed25519",), "*", "Edwards-curve signatures"),
        ("SIG_DSA", "crypto", "high", "quantum-vulnerable", 0.6, r"\bDSA(Private|Public)Key\b|\bSHA1withDSA\b", ("dsaprivatekey", "dsapublickey", "sha1withdsa"), "*", "DSA"),
        ("SIG_SHA1_RSA", "pki", "high", "quantum-vulnerable", 0.9, r"(?i)\bsha1withrsa(encryption)?\b", ("sha1withrsa",), "*", "RSA signatures over SHA-1"),
        ("SIG_SHA256_RSA", "pki", "medium", "quantum-vulnerable", 0.8, r"(?i)\bsha256withrsa(encryption)?\b", ("sha256withrsa",), "*", "RSA signatures"),
    ),
    "Plan ML-KEM or hybrid key establishment": (
        ("KEX_ECDH", "crypto", "medium", "quantum-vulnerable", 0.7, r"\bECDHE?\b", ("ecdh",), "*", "Elliptic-curve key agreement"),
        ("KEX_X25519", "crypto", "low", "quantum-vulnerable", 0.6, r"\b[Xx]25519\b", ("x25519",), "*", "Curve25519 key agreement"),
        ("KEX_DH", "crypto", "medium", "quantum-vulnerable", 0.5, r"\bDiffie-?Hellman\b", ("diffie",), "*", "Finite-field key agreement"),
        ("TLS_ECDHE_SUITE", "tls", "low", "quantum-vulnerable", 0.6, r"\bTLS_ECDHE_(RSA|ECDSA)_WITH_[A-Z0-9_]+", ("tls_ecdhe_",), "config", "Classical key exchange in a suite"),
        ("TLS_CURVES", "tls", "low", "quantum-vulnerable", 0.6, r"\bssl_ecdh_curve\b", ("ssl_ecdh_curve",), "config", "Groups set by hand"),
        ("SSH_ECDH", "ssh", "low", "quantum-vulnerable", 0.6, r"\becdh-sha2-nistp(256|384|521)\b", ("ecdh-sha2-",), "config", "Classical SSH key exchange"),
        ("SSH_RSA_KEY", "ssh", "medium", "quantum-vulnerable", 0.6, r"\bssh-rsa\b", ("ssh-rsa",), "*", "RSA host or user keys"),
        ("GO_RSA", "crypto", "medium", "quantum-vulnerable", 0.9, r"\brsa\.(GenerateKey|EncryptOAEP|EncryptPKCS1v15|SignPKCS1v15|SignPSS)\b", ("rsa.",), "go", "RSA in Go"),
        ("PY_RSA", "crypto", "medium", "quantum-vulnerable", 0.9, r"\brsa\.generate_private_key\b|\bRSA\.(generate|import_key)\b", ("rsa.",), "python", "RSA in Python"),
        ("NODE_RSA", "crypto", "medium", "quantum-vulnerable", 0.8, r"generateKeyPair(Sync)?\([\"']rsa", ("generatekeypair",), "javascript", "RSA in Node"),
        ("RUST_RSA", "crypto", "medium", "quantum-vulnerable", 0.8, r"\bRsa(Private|Public)Key::", ("rsaprivatekey", "rsapublickey"), "rust", "RSA in Rust"),
        ("RUBY_RSA", "crypto", "medium", "quantum-vulnerable", 0.9, r"\bOpenSSL::PKey::RSA\b", ("openssl::pkey",), "ruby", "RSA in Ruby"),
        ("JCA_EC", "crypto", "medium", "quantum-vulnerable", 0.8, r"getInstance\(\"EC(DH|DSA)?\"", ('getinstance("ec',), "java", "Elliptic curves through JCA"),
        ("OPENSSL_ECPARAM", "pki", "low", "quantum-vulnerable", 0.6, r"\bopenssl ecparam\b", ("openssl ecparam",), "*", "Elliptic-curve key generation"),
        ("CLOUD_RSA", "kms", "medium", "quantum-vulnerable", 0.7, r"\bRSA_(2048|3072|4096)\b|\bRSA_SIGN_[A-Z0-9_]+", ("rsa_",), "*", "RSA keys of a key service"),
        ("CLOUD_ECC", "kms", "medium", "quantum-vulnerable", 0.7, r"\bECC_NIST_P(256|384|521)\b|\bEC_SIGN_[A-Z0-9_]+", ("ecc_nist_", "ec_sign_"), "*", "Elliptic-curve keys of a key service"),
    ),
    "Use current ciphers and hashes": (
        ("CIPHER_3DES", "crypto", "high", "non-quantum-risk", 0.8, r"(?i)\b(3des|desede|des-ede3(-cbc)?)\b", ("3des", "desede", "des-ede3"), "*", "Triple DES"),
        ("CIPHER_RC4", "crypto", "high", "non-quantum-risk", 0.8, r"(?i)\b(rc4|arcfour)\b", ("rc4", "arcfour"), "*", "RC4"),
        ("CIPHER_ECB", "crypto", "high", "non-quantum-risk", 0.8, r"\bAES/ECB\b|\bMODE_ECB\b|\baes-(128|192|256)-ecb\b", ("ecb",), "*", "Blocks encrypted alone"),
        ("CIPHER_AES128", "crypto", "info", "quantum-safe", 0.5, r"(?i)\baes-?128(-(cbc|gcm|ctr))?\b", ("aes",), "*", "AES with short keys"),
        ("CIPHER_AES256", "crypto", "info", "quantum-safe", 0.6, r"(?i)\baes-?256(-(cbc|gcm|ctr))?\b", ("aes",), "*", "AES with long keys"),
        ("HASH_MD4", "crypto", "high", "non-quantum-risk", 0.7, r"(?i)\bmd4\b", ("md4",), "*", "Broken hash"),
        ("HASH_RIPEMD", "crypto", "medium", "non-quantum-risk", 0.6, r"(?i)\bripemd-?160\b", ("ripemd",), "*", "Dated hash"),
        ("HASH_SHA256", "crypto", "info", "quantum-safe", 0.5, r"(?i)\bsha-?256\b", ("sha",), "*", "Current hash"),
        ("HASH_SHA3", "crypto", "info", "quantum-safe", 0.6, r"(?i)\bsha3-(224|256|384|512)\b", ("sha3-",), "*", "Current hash"),
        ("MAC_HMAC_MD5", "crypto", "medium", "non-quantum-risk", 0.8, r"(?i)\bhmac-?md5\b", ("hmac",), "*", "MAC over a broken hash"),
        ("TLS_SSLV3", "tls", "critical", "non-quantum-risk", 0.9, r"\bSSLv[23]\b", ("sslv",), "config", "Broken protocol versions"),
        ("TLS_NO_VERIFY", "tls", "high", "non-quantum-risk", 0.7, r"\bInsecureSkipVerify\s*:\s*true|\bverify\s*=\s*False\b|\brejectUnauthorized\s*:\s*false", ("insecureskipverify", "verify", "rejectunauthorized"), "*", "Peers not verified"),
        ("TLS_EXPORT", "tls", "critical", "non-quantum-risk", 0.8, r"\bEXPORT(40|56|1024)?\b[-_A-Z0-9]*", ("export",), "config", "Export-grade suites"),
        ("KDF_PBKDF2_SHA1", "crypto", "medium", "non-quantum-risk", 0.8, r"\bPBKDF2WithHmacSHA1\b", ("pbkdf2",), "*", "Key derivation over SHA-1"),
    ),
    "None": (
        ("PQC_DSA", "pqc", "info", "quantum-safe", 0.9, r"\bML-DSA-(44|65|87)\b", ("ml-dsa-",), "*", "Post-quantum signatures"),
        ("PQC_SLH", "pqc", "info", "quantum-safe", 0.9, r"\bSLH-DSA\b", ("slh-dsa",), "*", "Post-quantum signatures"),
        ("PQC_HYBRID_GROUP", "pqc", "info", "quantum-safe", 0.9, r"\bX25519MLKEM768\b", ("x25519mlkem768",), "*", "Hybrid key establishment"),
        ("PQC_SSH_HYBRID", "pqc", "info", "quantum-safe", 0.9, r"\b(sntrup761x25519-sha512|mlkem768x25519-sha256)\b", ("sntrup761", "mlkem768"), "*", "Hybrid SSH key exchange"),
        ("PQC_DILITHIUM", "pqc", "low", "quantum-uncertain", 0.8, r"(?i)\bdilithium[235]?\b", ("dilithium",), "*", "Draft post-quantum names"),
    ),
}
PACK += tuple(Rule(i, "regex", c, s, r, f, hint, p, scope, text, hints) for hint, family in _FAMILIES.items() for i, c, s, r, f, p, hints, scope, text in family)


def validate(rules: list[Rule]) -> list[Rule]:
    """The rules by id; ValueError names the first that is not valid."""
    seen: set[str] = set()
    for r in rules:
        if not r.id.strip() or r.id in seen:
            raise ValueError(f"rule id {r.id!r} is blank or given twice")
        seen.add(r.id)
        if r.kind not in KINDS or r.severity not in SEVERITIES or r.risk not in RISKS:
            raise ValueError(f"rule {r.id}: unknown kind, severity or risk")
        if not math.isfinite(r.confidence) or not 0 <= r.confidence <= 1:
            raise ValueError(f"rule {r.id}: confidence is not within 0 and 1")
        if any(h != h.lower() for h in r.hints):
            raise ValueError(f"rule {r.id}: hints are lower-case")
        try:
            re.compile(r.pattern)
        except re.error as e:
            raise ValueError(f"rule {r.id}: {e}") from None
    return sorted(rules, key=lambda r: r.id)


def parse_yaml(texts: list[str]) -> list[Rule]:
    """Rules of YAML texts, each a list of maps or one map."""
    import yaml

    found = []
    for text in texts:
        data = yaml.safe_load(text)
        for item in data if isinstance(data, list) else [data] if data else []:
            found.append(Rule(**{k: tuple(v) if k == "hints" else v for k, v in item.items() if k in Rule._fields}))
    return validate(found)


def load(spark: SparkSession, folder: str) -> list[Rule]:
    """The rules of a folder's YAML files, read through Spark."""
    read = lambda ending: spark.read.option("wholetext", "true").option("pathGlobFilter", ending).text(folder)
    return parse_yaml([r[0] for r in read("*.y*ml").collect()])


def frame(spark: SparkSession, rules: tuple[Rule, ...] | list[Rule] = PACK) -> DataFrame:
    return spark.createDataFrame([r[: len(SCHEMA.split(", "))] for r in validate(list(rules))], SCHEMA)
