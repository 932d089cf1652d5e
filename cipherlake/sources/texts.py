"""From bytes to text and back: encodings, places, ignored paths, files beside files, inventories and contexts from JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.sources import files as X

#: Byte-order marks, longest first.
MARKS = ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8"))
#: Bytes looked at, and of wide units in them the share that must be ASCII.
SAMPLE, SHARE = 1024, 0.75


def decode(data: bytes) -> tuple[str | None, str]:
    """The text of bytes and its encoding: by mark, strictly; without one as UTF-8 with replacements, or as a wide encoding if three of four units are ASCII; else None."""
    for mark, name in MARKS:
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(name), name
            except UnicodeDecodeError:
                return None, name
    head = data[:SAMPLE]
    if 0 not in head:
        return data.decode("utf-8", "replace"), "utf-8"
    for size, least, name in ((4, 16, "utf-32"), (2, 8, "utf-16")):
        if len(data) < least or len(data) % size:
            continue
        units = [head[i : i + size] for i in range(0, len(head) - size + 1, size)]
        for order, at in (("le", 0), ("be", size - 1)):
            plain = sum(0 < u[at] < 128 and sum(u) == u[at] for u in units)
            if plain >= SHARE * len(units):
                try:
                    text = data.decode(f"{name}-{order}")
                except UnicodeDecodeError:
                    continue
                if all(c.isprintable() or c in "\t\n\r\f" for c in text):
                    return text, f"{name}-{order}"
    return None, "binary"


def decoded(files: DataFrame) -> DataFrame:
    """(path, text, encoding) of files (path, bytes). Key containers have no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            got = [(None, "opaque") if p.lower().endswith((".p12", ".pfx")) else decode(b or b"") for p, b in zip(paths, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["path", "text", "encoding"])

    return files.select("path", F.col("bytes").cast("binary")).mapInArrow(run, "path string, text string, encoding string")


def non_text(path: Column, text: Column, encoding: Column) -> Column:
    """Files left out because they are no text: not those of keys and certificates, nor those that name a wide encoding."""
    return ~X.is_protected(path) & text.isNull() & (encoding == "binary")


def byte_offset(text: Column, at: Column, encoding: str = "UTF-8", mark: int = 0) -> Column:
    """Where a 0-based code point of a text lies in its raw bytes."""
    return (F.octet_length(F.encode(F.left(text, at), encoding)) + mark).cast("long")


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression over a relative path, whether it takes back) of a line of an ignore file; None for blank lines and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    body = line[back:].removeprefix("\\")
    only_dir, body = body.endswith("/"), body.rstrip("/")
    anchored, body = "/" in body, body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i]))
            i += 1
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if only_dir else "(?:/.*)?$"), back


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether an ignore file leaves a path out; later lines win."""
    out = F.lit(False)
    for pattern in filter(None, map(ignore_pattern, lines)):
        out = F.when(path.rlike(pattern[0]), F.lit(not pattern[1])).otherwise(out)
    return out


def beside(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, other, text): files that others ask for by a path relative to their own. wanted: path, relative."""
    steps = F.split(F.concat_ws("/", F.regexp_replace("path", "/?[^/]*$", ""), "relative"), "/")
    up = lambda parts, p: F.when(p == "..", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).when(p.isin(".", ""), parts).otherwise(F.array_append(parts, p))
    other = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")
    return wanted.select("path", other.alias("other")).join(files.select(F.col("path").alias("other"), "text"), "other")


def siblings(files: DataFrame, ending: str, most: int = 129) -> DataFrame:
    """(folder, paths): files of an extension in each folder, at most so many, by name."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    from pyspark.sql import Window

    ranked = files.where(F.col("path").endswith(f".{ending}")).select(folder.alias("folder"), "path").withColumn("n", F.row_number().over(Window.partitionBy("folder").orderBy("path"))).where(F.col("n") <= most)
    return ranked.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))


INVENTORY = "run string, assets array<struct<id: string, identifier: string>>, observations array<struct<id: string, asset_ids: array<string>>>"
MOST_BYTES, MOST_RECORDS = 16 << 20, 100_000


def read_inventory(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, status, assets, observations): inventories as JSON, checked; what fails says why and never repeats its input."""
    parsed = rows.select(key, F.col(column).alias("_raw"), F.from_json(column, INVENTORY).alias("i"))
    ids = F.transform("i.assets", lambda a: a["id"])
    named = F.flatten(F.transform("i.observations", lambda o: o["asset_ids"]))
    bad = [
        (F.octet_length("_raw") > MOST_BYTES, "too_large"), (F.col("_raw").isNull() | F.col("i.run").isNull() | F.col("i.assets").isNull() | F.col("i.observations").isNull(), "malformed"),
        (F.size("i.assets") + F.size("i.observations") > MOST_RECORDS, "too_many_records"), (F.size(F.array_distinct(ids)) < F.size(ids), "repeated_id"),
        (F.exists(ids, lambda x: ~valid_id(x, "algorithm")), "invalid_id"), (F.size(F.array_except(named, ids)) > 0, "dangling_reference"),
    ]
    status = F.when(bad[0][0], bad[0][1])
    for condition, name in bad[1:]:
        status = status.when(F.coalesce(condition, F.lit(True)), name)
    fine = status.otherwise("valid")
    return parsed.select(key, fine.alias("status"), F.when(fine == "valid", F.size("i.assets")).otherwise(0).alias("assets"), F.when(fine == "valid", F.size("i.observations")).otherwise(0).alias("observations"))


def valid_id(value: Column, domain: str) -> Column:
    return value.rlike(f"^{domain}-v1-[0-9a-f]{{64}}$")


def is_sha256(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{64}$")


def is_oid(value: Column) -> Column:
    return (F.length(value) <= 128) & value.rlike(r"^[0-9]+(\.[0-9]+)+$")


#: What an assessment context may hold.
CONTEXT = ("runtime", "provider", "parameters", "peer", "protocol", "jose", "verifiers", "pki", "collision_resistance_required", "long_term_confidentiality")


def read_context(text: str) -> dict:
    """An assessment context: version 1, applicability, use case and support that may be true, false or left out. ValueError for anything else, without its content."""
    if len(text.encode()) > 16_384:
        raise ValueError("the context is too large")
    try:
        whole = json.loads(text)
    except ValueError:
        raise ValueError("the context is no JSON") from None
    if not isinstance(whole, dict) or whole.get("version") != 1 or set(whole) - {"version", "applicability", "use_case", *CONTEXT}:
        raise ValueError("the context has an unknown version or field")
    if any(not isinstance(whole[k], (bool, type(None))) for k in CONTEXT if k in whole):
        raise ValueError("support is true, false or left out")
    return whole


def delimited(text: Column, word: str) -> Column:
    """How often a word stands between delimiters; one delimiter may end a match and begin the next."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?<![^\s;,'\"]){word}(?![^\s;,'\"])"), F.lit(0))).cast("long")


def block_state(lines: DataFrame) -> DataFrame:
    """(path, line, content, block): the directive whose block a line of a module file stands in. Lines of a file are one partition of the window."""
    from pyspark.sql import Window

    header, end = F.regexp_extract("content", r"^\s*([a-z]+)\s*\($", 1), F.trim("content") == ")"
    mark = F.when(header != "", header).when(end, "")
    last = F.last(mark, ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.select("path", "line", "content", F.when(mark.isNull(), F.nullif(last, F.lit(""))).alias("block"))


def localized(found: DataFrame, words: DataFrame, lang: str) -> DataFrame:
    """Findings with descriptions in another language where a word list has one. words: rule_id, lang, text; a row for each rule."""
    mine = words.where(F.col("lang") == lang).select(F.col("rule_id").alias("_rule"), F.col("text").alias("_text"))
    return found.join(F.broadcast(mine), found["rule_id"] == F.col("_rule"), "left").withColumn("description", F.coalesce("_text", "description")).drop("_rule", "_text")
