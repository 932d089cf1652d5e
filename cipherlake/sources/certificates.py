"""Public certificates in files: PEM blocks, DER and unencrypted PKCS#12 bags, with the facts that rules ask for.

The encodings are nested binary structures, so they are read in Python, file by file in Arrow
batches; files are chosen by extension or by a PEM line in the JVM. Private keys are never read.
What is cut short or wrong gives a row with the status ``partial`` and no facts.
"""

from __future__ import annotations

import base64
import calendar
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Object identifiers and their names.
SIGNATURES = {"1.2.840.113549.1.1.4": "md5WithRSAEncryption", "1.2.840.113549.1.1.5": "sha1WithRSAEncryption", "1.2.840.113549.1.1.11": "sha256WithRSAEncryption", "1.2.840.113549.1.1.12": "sha384WithRSAEncryption", "1.2.840.113549.1.1.13": "sha512WithRSAEncryption", "1.2.840.113549.1.1.10": "RSASSA-PSS", "1.2.840.10045.4.3.2": "ecdsa-with-SHA256", "1.2.840.10045.4.3.3": "ecdsa-with-SHA384", "1.3.101.112": "Ed25519", "2.16.840.1.101.3.4.3.18": "ML-DSA-65"}
KEYS = {"1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "EC", "1.2.840.10040.4.1": "DSA", "1.3.101.112": "Ed25519", "2.16.840.1.101.3.4.3.18": "ML-DSA-65"}
CURVES = {"1.2.840.10045.3.1.7": ("P-256", 256), "1.3.132.0.34": ("P-384", 384), "1.3.132.0.35": ("P-521", 521), "1.3.132.0.10": ("secp256k1", 256)}
_DATA, _CERT_BAG, _X509 = "1.2.840.113549.1.7.1", "1.2.840.113549.1.12.10.1.3", "1.2.840.113549.1.9.22.1"
MOST_BAGS, DEEPEST = 256, 8


class Node(NamedTuple):
    tag: int
    body: bytes
    whole: bytes


def read(data: bytes, at: int = 0) -> tuple[Node, int]:
    """The element at a place and where it ends; ValueError if it is not whole."""
    if at + 2 > len(data):
        raise ValueError("cut short")
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        count = size & 0x7F
        if not 0 < count <= 4 or start + count > len(data):
            raise ValueError("length")
        size, start = int.from_bytes(data[start : start + count]), start + count
    if start + size > len(data):
        raise ValueError("cut short")
    return Node(tag, data[start : start + size], data[at : start + size]), start + size


def parts(node: Node) -> list[Node]:
    out, at = [], 0
    while at < len(node.body):
        child, at = read(node.body, at)
        out.append(child)
    return out


def oid(body: bytes) -> str:
    values, value = [], 0
    for b in body:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            values.append(value)
            value = 0
    if not values:
        raise ValueError("object identifier")
    first = min(values[0] // 40, 2)
    return ".".join(map(str, [first, values[0] - 40 * first, *values[1:]]))


def seconds(node: Node) -> int:
    """Unix seconds of a UTCTime or GeneralizedTime in Zulu form."""
    text = node.body.decode("ascii")
    if node.tag == 0x17:
        text = ("19" if int(text[:2]) >= 50 else "20") + text
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)Z", text)
    if not m or node.tag not in (0x17, 0x18):
        raise ValueError("time")
    return calendar.timegm(tuple(map(int, m.groups())))


class Facts(NamedTuple):
    signature_oid: str
    key_oid: str
    key_bits: int | None
    curve: str | None
    parameters: str  # absent, null, or sha256 of other parameters
    not_before: int
    not_after: int
    sha256: str
    key_sha256: str


def facts(der: bytes) -> Facts:
    root, end = read(der)
    if end != len(der) or root.tag != 0x30:
        raise ValueError("not one certificate")
    body, signature, _ = parts(root)
    fields = parts(body)
    fields = fields[1:] if fields[0].tag == 0xA0 else fields
    validity, key = parts(fields[3]), fields[5]
    algorithm, bits = parts(key)
    named = parts(algorithm)
    key_oid, given = oid(named[0].body), named[1] if len(named) > 1 else None
    size, curve = None, None
    if KEYS.get(key_oid) == "RSA":
        modulus = parts(read(bits.body, 1)[0])[0].body
        size = int.from_bytes(modulus).bit_length()
    elif KEYS.get(key_oid) == "EC" and given is not None and given.tag == 6:
        curve, size = CURVES.get(oid(given.body), (oid(given.body), None))
    kind = "absent" if given is None else "null" if given.tag == 5 else hashlib.sha256(given.whole).hexdigest()
    return Facts(oid(parts(signature)[0].body), key_oid, size, curve, kind, seconds(validity[0]), seconds(validity[1]), hashlib.sha256(der).hexdigest(), hashlib.sha256(key.whole).hexdigest())


def pem_blocks(text: str) -> Iterator[tuple[int, str, bytes | None]]:
    """(line, label, content) of each block; None if it never ends, ends under another label or is no base64."""
    label, begun, held = "", 0, []
    for at, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*-----(BEGIN|END) ([A-Z0-9 ]+)-----\s*$", line):
            if label and (m[1] == "BEGIN" or m[2] != label):
                yield begun, label, None
                label = ""
            if m[1] == "BEGIN":
                label, begun, held = m[2], at, []
            elif label:
                try:
                    content = base64.b64decode("".join(held), validate=True)
                except ValueError:
                    content = None
                yield begun, label, content
                label = ""
        elif label:
            held.append(line.strip())
    if label:
        yield begun, label, None


def bags(data: bytes) -> list[bytes]:
    """Certificates in the unencrypted bags of a PKCS#12 container."""

    def inside(node: Node, depth: int) -> Iterator[bytes]:
        if depth > DEEPEST or node.tag not in (0x30, 0x31, 0xA0):
            return
        children = parts(node)
        kind = oid(children[0].body) if children and children[0].tag == 6 else None
        if kind == _X509:
            yield parts(children[1])[0].body
        elif kind == _DATA:
            inner = parts(children[1])[0].body if len(children) > 1 else b""
            yield from inside(read(inner)[0], depth + 1) if inner else ()
        elif kind is None or kind == _CERT_BAG:
            for c in children:
                yield from inside(c, depth + 1)

    out = []
    for der in inside(read(data)[0], 0):
        out.append(der)
        if len(out) == MOST_BAGS:
            break
    return out


def read_file(path: str, data: bytes) -> list[tuple[int, str, Facts | None]]:
    """(line, kind, facts) of every certificate in a file: DER first, else PEM blocks, else PKCS#12."""
    if not data:
        return []
    if path.lower().endswith((".p12", ".pfx")):
        try:
            return [(0, "pkcs12", facts(c)) for c in bags(data)]
        except (ValueError, IndexError):
            return [(0, "pkcs12", None)]
    if data[0] == 0x30:
        try:
            return [(0, "der", facts(data))]
        except (ValueError, IndexError):
            return [(0, "der", None)]
    out: list[tuple[int, str, Facts | None]] = []
    for line, label, content in pem_blocks(data.decode("utf-8", "replace")):
        if label.endswith("CERTIFICATE"):
            try:
                out.append((line, "pem", facts(content) if content is not None else None))
            except (ValueError, IndexError):
                out.append((line, "pem", None))
    return out


SCHEMA = "path string, ordinal int, line int, kind string, status string, signature_oid string, key_oid string, key_bits int, curve string, parameters string, not_before long, not_after long, sha256 string, key_sha256 string"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in SCHEMA.split(", ")])


def certificates(files: DataFrame) -> DataFrame:
    """One row for each certificate of files (path, bytes)."""
    from cipherlake.sources.files import is_certificate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, (line, kind, f) in enumerate(read_file(path, data or b"")):
                    rows.append((path, i, line, kind, "complete" if f else "partial", *(f or [None] * 9)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    return files.where(is_certificate(F.col("path"))).select("path", F.col("bytes").cast("binary")).mapInArrow(run, SCHEMA)


def validity(now: int) -> Column:
    """At a fixed clock, both ends included."""
    start, end, at = F.col("not_before"), F.col("not_after"), F.lit(now)
    return F.when(start.isNull() | (start > end), "unknown").when(at < start, "not_yet_valid").when(at > end, "expired").otherwise("valid")


def _named(names: dict, column: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col(column)), F.col(column))


def readable(found: DataFrame) -> DataFrame:
    return found.withColumns({"signature": _named(SIGNATURES, "signature_oid"), "key": _named(KEYS, "key_oid")})


def detect(found: DataFrame, rules: list[tuple[str, str, str]], now: int) -> DataFrame:
    """(rule_id, path, ordinal, match): certificates that fit a rule (id, target, pattern). Targets are a field each, or else all of them in one text."""
    rows = readable(found.where("status = 'complete'")).withColumn("certificate_validity", validity(now))
    targets = {
        "signature_oid": F.col("signature_oid"), "public_key_oid": F.col("key_oid"), "rsa_modulus_bits": F.when(F.col("key") == "RSA", F.col("key_bits").cast("string")), "certificate_validity": F.col("certificate_validity"),
        "legacy_not_after_2026": F.when(F.col("not_after") >= 1767225600, "after_2026"),
    }
    all_of = F.concat_ws(" ", "signature", "key", F.col("key_bits").cast("string"), "curve", "certificate_validity")
    hits = F.array_compact(F.array(*(F.when(targets.get(target, all_of).rlike(pattern), F.struct(F.lit(rule).alias("rule_id"), targets.get(target, all_of).alias("match"))) for rule, target, pattern in rules)))
    return rows.select("path", "ordinal", F.inline(hits)).select("rule_id", "path", "ordinal", "match")


# writers of the same forms, for corpora and tests


def put(tag: int, *bodies: bytes) -> bytes:
    body = b"".join(bodies)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8)
    return bytes([tag]) + head + body


def put_oid(text: str) -> bytes:
    a, b, *rest = map(int, text.split("."))
    out = b""
    for value in (40 * a + b, *rest):
        chunk = [value & 0x7F]
        while value := value >> 7:
            chunk.append(value & 0x7F | 0x80)
        out += bytes(chunk[::-1])
    return put(6, out)


def put_certificate(signature: str, key: str, bits: int, curve: str | None, start: str, end: str) -> bytes:
    """A certificate of these facts (times as YYYYMMDDhhmmssZ); its names and values are empty."""
    number = lambda n: put(2, b"\0" * (n.bit_length() % 8 == 0) + n.to_bytes((n.bit_length() + 7) // 8 or 1))
    algorithm = put(0x30, put_oid(key), put_oid(curve) if curve else put(5))
    point = b"\4" + b"\1" * 64 if curve else put(0x30, number((1 << bits) - 1), number(65537))
    body = put(0x30, put(0xA0, number(2)), number(1), put(0x30, put_oid(signature)), put(0x30), put(0x30, put(0x18, start.encode()), put(0x18, end.encode())), put(0x30), put(0x30, algorithm, put(3, b"\0" + point)))
    return put(0x30, body, put(0x30, put_oid(signature)), put(3, b"\0sig"))


def put_pem(der: bytes, label: str = "CERTIFICATE") -> str:
    text = base64.b64encode(der).decode()
    return "\n".join([f"-----BEGIN {label}-----", *(text[i : i + 64] for i in range(0, len(text), 64)), f"-----END {label}-----"])


def put_container(*ders: bytes) -> bytes:
    """An unencrypted PKCS#12 container."""
    bag = lambda der: put(0x30, put_oid(_CERT_BAG), put(0xA0, put(0x30, put_oid(_X509), put(0xA0, put(4, der)))))
    safe = put(0x30, put_oid(_DATA), put(0xA0, put(4, put(0x30, *map(bag, ders)))))
    return put(0x30, put(2, b"\3"), put(0x30, put_oid(_DATA), put(0xA0, put(4, put(0x30, safe)))))
