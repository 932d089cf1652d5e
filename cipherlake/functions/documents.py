"""Functions over whole texts and documents: key blocks, nested JSON, host names, handshakes, version hints."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.functions import scalars as S


def mask_private_blocks(text: Column) -> Column:
    """Lines of private key blocks, their frame included, each replaced; a block that never ends goes on to the last line."""
    lines = F.split(text, "\n")
    begins, ends = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside"))

    def step(state: Column, line: Column) -> Column:
        inside = state["inside"] | line.rlike(begins)
        return F.struct(F.array_append(state["out"], F.when(inside, S.PRIVATE_MATERIAL).otherwise(line)).alias("out"), (inside & ~line.rlike(ends)).alias("inside"))

    return F.when(text.rlike(begins), F.aggregate(lines, start, step, lambda s: F.array_join(s["out"], "\n"))).otherwise(text)


def leaves(value, path: str = "", key: str = "") -> Iterator[tuple[str, str, str]]:
    """(pointer, key, value) of every leaf of a JSON value; empty lists and objects are leaves too."""
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    below = False
    for k, v in items:
        below = True
        yield from leaves(v, f"{path}/{str(k).replace('~', '~0').replace('/', '~1')}", str(k))
    if not below:
        yield path, key, value if isinstance(value, str) else json.dumps(value)


def json_flatten(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pointer, name, value): the leaves of a JSON column; what is no JSON gives none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(k, *leaf) for leaf in leaves(json.loads(text))] if text else []
                except ValueError:
                    continue
            kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[key, "pointer", "name", "value"])

    return docs.select(key, column).mapInArrow(run, f"{key} {kind}, pointer string, name string, value string")


def redact_leaves(flat: DataFrame) -> DataFrame:
    """Flattened JSON with its strings redacted: the value of a secret name is masked."""
    return flat.withColumn("value", F.when(S.secret_name(F.col("name")), F.lit(S.VALUE)).otherwise(S.redact_text(F.col("value"))))


def valid_host(host: Column) -> Column:
    """An ASCII host name: labels of letters, digits and inner hyphens, the last one not all digits."""
    label = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    return F.coalesce((F.length(host) <= 253) & host.rlike(rf"^(?:{label}\.)*{label}\.?$") & ~host.rlike(r"(?:^|\.)[0-9]+\.?$"), F.lit(False))


#: The name lists of a key exchange message, in order.
KEXINIT = ("kex", "host_key", "encryption_out", "encryption_in", "mac_out", "mac_in", "compression_out", "compression_in", "languages_out", "languages_in")
MOST_NAMES, LONGEST_NAME = 256, 64


def read_kexinit(payload: bytes) -> dict[str, list[str]] | None:
    """The ten name lists of an SSH key exchange message; None if it is cut short, too long or no such message."""
    if len(payload) < 17 or payload[0] != 20:
        return None
    at, out = 17, {}
    for name in KEXINIT:
        if at + 4 > len(payload):
            return None
        (size,) = struct.unpack_from(">I", payload, at)
        at += 4
        if at + size > len(payload):
            return None
        names = payload[at : at + size].decode("ascii", "replace").split(",") if size else []
        if len(names) > MOST_NAMES or any(not 0 < len(n) <= LONGEST_NAME or not n.isprintable() or "�" in n for n in names):
            return None
        out[name] = names
        at += size
    return out if at + 5 <= len(payload) else None


def write_kexinit(lists: dict[str, list[str]]) -> bytes:
    """A message of these lists, for tests and corpora."""
    parts = [",".join(lists.get(n, [])).encode() for n in KEXINIT]
    return b"\x14" + b"\0" * 16 + b"".join(struct.pack(">I", len(p)) + p for p in parts) + b"\0" * 5


#: Language, file name and pattern of a version hint; the first that fits a file decides.
HINTS = (
    ("java", "pom.xml", r"<maven\.compiler\.release>\s*([^<]+)<"), ("java", "pom.xml", r"<java\.version>\s*([^<]+)<"), ("java", "pom.xml", r"<maven\.compiler\.source>\s*([^<]+)<"),
    ("java", "build.gradle", r"JavaLanguageVersion\.of\(([^)]+)\)"), ("java", "build.gradle", r"(?m)^\s*(?:source|target)Compatibility[^=\n]*=([^\n]+)"),
    ("java", "build.gradle.kts", r"JavaLanguageVersion\.of\(([^)]+)\)"), ("node", "package.json", r'"engines"\s*:\s*\{[^}]*"node"\s*:\s*"([^"]+)"'), ("go", "go.mod", r"(?m)^\s*go ([^\n]+)"),
    ("rust", "Cargo.toml", r"(?m)^\s*rust-version\s*=([^\n]+)"), ("ruby", "Gemfile", r"(?m)^\s*ruby\s+([^\n]+)"), ("ruby", ".ruby-version", r"([0-9][^\n]*)"), ("python", "pyproject.toml", r"(?m)^\s*requires-python\s*=([^\n]+)"), ("python", "runtime.txt", r"python-([^\n]+)"),
)


def version_hint(path: Column, text: Column) -> Column:
    """struct<language, version>: what a file says of its language's version, without quotes and comparators; null if nothing."""
    name, out = S.basename(path), None
    for language, file_name, pattern in HINTS:
        found = F.regexp_extract(text, pattern, 1)
        clean = F.trim(F.regexp_replace(found, "[\"'^~<>=v\\s]+", " "))
        value = F.when((name == file_name) & (clean != ""), F.struct(F.lit(language).alias("language"), F.split_part(clean, F.lit(" "), F.lit(1)).alias("version")))
        out = value if out is None else F.coalesce(out, value)
    return out


def first_number(version: Column) -> Column:
    return F.regexp_extract(version, r"^\D*(\d+)", 1).try_cast("int")
