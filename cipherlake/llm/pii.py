"""Information-theoretic sanitisation of personal data.

Base spans (email, ip, card, phone) are the protected entities. Every other term of a text that
holds an entity is a candidate; how strongly it reveals the entity is their pointwise mutual
information over the distinct texts of the corpus (copies of a text count once), with the share
of a term's texts that hold the entity drawn towards the entity's share of all texts by
``PRIOR`` texts more, so entities and terms seen once count too, but less surely. A term whose
information about an entity reaches a share of the entity's own information content
(``DISCLOSURE``) is sanitised wherever it stands in a document that holds the entity: removed if
it all but names the entity (``REMOVAL``), else generalised to its form (a number, initials, a
name, a word), which many terms share. A document that holds the term but not the entity is left
as it is.

Null and empty texts have no spans. Each input row gives one row; rows of one text get the same
spans, whatever their ids (null ones too); an empty table gives none; extra columns are kept as
they are. Offsets are code points, end exclusive. A term's places in a text are listed once, so a
long text takes room in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from .shared import table, written

KINDS = ("email", "ip", "card", "phone")
#: Texts by which the smoothed share of a term is drawn to the entity's share of all texts.
PRIOR = 1.0
DISCLOSURE, REMOVAL = 0.9, 0.98
#: Characters of a term at least: many names have two.
LEAST_TERM = 2
#: What stands for a term that is generalised, by its form in the text.
FORMS = (("NUMBER", re.compile(r"[^0-9]*[0-9]")), ("INITIALS", re.compile(r"[A-Z]{2,}\Z")), ("NAME", re.compile(r"[A-Z]|[^\x00-\x7f]")), ("WORD", re.compile("")))
#: Bits of the filter that spares the corpus count most other words: its size is fixed.
FILTER_BITS = 22

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_LETTER = re.compile("[a-z\xc0-\U0010ffff]")
_NONE = hashlib.sha256(b"").hexdigest()
_DIGIT, _TERM_BYTE = np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_TERM_BYTE[48:58] = _TERM_BYTE[65:91] = _TERM_BYTE[97:123] = _TERM_BYTE[128:] = True
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", max(at, done))) >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            yield begin, done
        at += 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the entities, by kind and then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.groups())]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold an entity at all."""
    digits = T.per_text(_DIGIT[data], offsets)
    return np.flatnonzero((T.per_text(data == 64, offsets) > 0) | (digits >= 4))


def entities(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The distinct entities of a text."""
    low = text.translate(_LOW)
    return list(dict.fromkeys(f"{KINDS[kind]}:{low[a:b] if kind < 2 else _digits(low[a:b])}" for kind, a, b in spans))


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Each term of a text outside its entities, with where each of its occurrences starts."""
    low = text.translate(_LOW)
    inside, k = sorted((a, b) for _, a, b in spans), 0
    places: dict[str, list[int]] = {}
    for m in _TERM.finditer(low):
        a, b = m.span()
        while k < len(inside) and inside[k][1] <= a:
            k += 1
        if (k == len(inside) or b <= inside[k][0]) and b - a >= LEAST_TERM and _LETTER.search(m[0]):
            places.setdefault(m[0], []).append(a)
    return [{"term": term, "places": at} for term, at in places.items()]


FOUND = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<string>, terms array<struct<term: string, places: array<int>>>"
_ENTITIES, _TERMS = pa.list_(pa.string()), pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.int32()))]))


def find(docs: DataFrame) -> DataFrame:
    """Base spans and entities of each document and the places of its terms, without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                n = part.num_rows
                counts, base, held, terms = np.zeros((4, n), np.int64), [""] * n, [[] for _ in range(n)], [[] for _ in range(n)]
                column = part.column("text")
                for i in _suspects(*T.buffers(column)).tolist():
                    text = column[i].as_py() or ""
                    spans = base_spans(text)
                    if spans:
                        for k, _, _ in spans:
                            counts[k, i] += 1
                        base[i] = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
                        held[i], terms[i] = entities(text, spans), terms_of(text, spans)
                columns = [part.column("doc_id"), part.column("text_hash"), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(held, _ENTITIES), pa.array(terms, _TERMS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base", "entities", "terms"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def term_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return T.hash_runs(data, starts, ends)


def _filter(rows: DataFrame, slots) -> np.ndarray:
    """A bit filter of fixed size of the slots that slots() gives for each batch of rows."""
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots(batch) & mask).astype(np.int64))], names=["slot"])

    hit = np.zeros(1 << FILTER_BITS, bool)
    hit[rows.mapInArrow(run, "slot long").distinct().toPandas()["slot"].to_numpy(np.int64)] = True
    return np.packbits(hit)


def _term_slots(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = T.buffers(batch.column("term"))
    return term_hash(data, offsets[:-1], offsets[1:])


def _text_slots(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("text_hash").to_numpy().astype(np.uint64)


def document_counts(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """How many distinct texts hold each of the given terms.

    Two fixed-size filters: one drops other words early, one finds the texts that may have copies,
    whose terms are kept apart by text; those of all other texts are summed at once."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    copied = found.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_hash")
    packed = docs.sparkSession.sparkContext.broadcast((_filter(terms, _term_slots), _filter(copied, _text_slots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, copies = (np.unpackbits(x).astype(bool) for x in packed.value)
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offsets = T.buffers(part.column("text"))
                data = T.LOWER[data]
                starts, ends, doc = T.runs(_TERM_BYTE[data], offsets)
                keys = term_hash(data, starts, ends)
                chosen = np.flatnonzero(table[(keys & mask).astype(np.int64)])
                pair = keys[chosen] ^ T.mix(doc[chosen].astype(np.uint64))
                once = chosen[~T.repeated(pair)[1]]
                text_hash = part.column("text_hash").to_numpy()
                apart = copies[(text_hash.astype(np.uint64) & mask).astype(np.int64)][doc[once]]
                single, several = once[~apart], once[apart]
                _, first, count = np.unique(keys[single], return_index=True, return_counts=True)
                raw = data.tobytes()
                at = np.concatenate([single[first], several])
                names = [raw[starts[j] : ends[j]].decode("utf-8", "replace") for j in at.tolist()]
                whose = pa.array(text_hash[doc[at]], pa.int64(), mask=np.arange(at.size) < first.size)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), whose, pa.array(np.append(count, np.ones(several.size)).astype(np.int64))], names=["term", "text_hash", "n"])

    texts = docs.select(F.col("text").cast("string")).withColumn("text_hash", F.xxhash64("text"))
    each = texts.mapInArrow(run, "term string, text_hash long, n long").groupBy("term", "text_hash").agg(F.sum("n").alias("n"))
    counted = each.groupBy("term").agg(F.sum(F.when(F.col("text_hash").isNull(), F.col("n")).otherwise(1)).alias("n_term"))
    return terms.join(counted, "term")


def disclosures(docs: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """Terms of the texts that reveal an entity beyond the threshold, with the share of its information."""
    total = F.lit(float(found.select("text_hash").distinct().count()))
    held = texts.select("text_hash", F.explode("entities").alias("entity"))
    sized = held.join(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "entity")
    terms = texts.select("text_hash", F.explode("terms.term").alias("term"))
    terms = terms.join(document_counts(docs, found, terms.select("term").distinct()), "term")
    whole = F.greatest(F.log2(total / F.col("n_entity")), F.lit(1e-9))
    shared = lambda joint: F.log2((joint + PRIOR * F.col("n_entity") / total) / (F.col("n_term") + PRIOR) * total / F.col("n_entity")) / whole
    # a pair can reach the threshold only if it would with every text of the rarer one shared
    open_pairs = sized.join(terms, "text_hash").where(shared(F.least("n_entity", "n_term")) >= DISCLOSURE)
    joint = open_pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("joint"))
    return joint.select("entity", "term", F.least(shared(F.col("joint")), F.lit(1.0)).alias("share")).where(F.col("share") >= DISCLOSURE)


def holding(found: DataFrame) -> DataFrame:
    """The distinct texts that hold an entity."""
    return found.where(F.size("entities") > 0).select("text_hash", "entities", "terms").dropDuplicates(["text_hash"])


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """(text_hash, terms): places of the terms to sanitise, with their action, by start; None if no text holds an entity."""
    texts = written(holding(found), "holding")
    if texts.isEmpty():
        return None
    shown = disclosures(docs, found, texts)
    held = texts.select("text_hash", F.explode("entities").alias("entity")).join(shown, "entity").groupBy("text_hash", "term").agg(F.max("share").alias("share"))
    hits = texts.select("text_hash", F.inline("terms")).join(held, ["text_hash", "term"]).select("text_hash", F.char_length("term").alias("size"), F.explode("places").alias("place"), "share")
    item = F.struct(F.col("place").cast("long").alias("a"), (F.col("place") + F.col("size")).cast("long").alias("b"), F.when(F.col("share") >= REMOVAL, "removed").otherwise("generalised").alias("action"))
    return written(hits.groupBy("text_hash").agg(F.array_sort(F.collect_list(item)).alias("terms")), "terms")


def analyse(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    found = written(find(docs), "entities")
    return found, term_spans(docs, found)


def report(docs: DataFrame) -> DataFrame:
    """op5's columns for every row."""
    found, terms = analyse(docs)
    found = found.drop("entities", "terms")
    listed = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["a"], t["b"])), ",") if terms is not None else F.lit("")
    rows = found.join(terms, "text_hash", "left") if terms is not None else found
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(listed != "", listed)).alias("spans"))


def general(term: str) -> str:
    """The form of a term, in brackets."""
    return next(f"<{name}>" for name, form in FORMS if form.match(term))


def sanitise_text(text: str | None, terms: list[dict] | None = None) -> str | None:
    """The text with entities replaced by their kinds, and disclosing terms by their forms or removed."""
    if text is None:
        return None
    cuts = [(a, b, f"<{KINDS[k].upper()}>") for k, a, b in base_spans(text)]
    cuts += [(t["a"], t["b"], "" if t["action"] == "removed" else general(text[t["a"] : t["b"]])) for t in terms or ()]
    out, done = [], 0
    for a, b, name in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if a >= done:
            out += [text[done:a], name]
        done = max(done, b)
    return "".join(out) + text[done:]


def sanitise(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with sanitised texts; ``length``, where it is a column, is the new text's code points."""
    schema = docs.schema
    _, terms = analyse(docs)
    key, extra, listed = "__text_hash", "__terms", terms is not None
    rows = docs
    if terms is not None:
        rows = docs.withColumn(key, F.xxhash64(F.col(text).cast("string"))).join(terms.select(F.col("text_hash").alias(key), F.col("terms").alias(extra)), key, "left").select(*docs.columns, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text):
                column = part.column(text)
                todo = set(_suspects(*T.buffers(column)).tolist())
                more = part.column(extra).to_pylist() if listed else [None] * part.num_rows
                new = {i: s for i in range(part.num_rows) if (i in todo or more[i]) and (s := sanitise_text(column[i].as_py(), more[i])) != column[i].as_py()}
                arrays = {name: part.column(name) for name in schema.names}
                if new:
                    values = column.to_pylist()
                    for i, s in new.items():
                        values[i] = s
                    arrays[text] = pa.array(values, column.type)
                    if length in arrays:
                        sizes = arrays[length].to_pylist()
                        for i, s in new.items():
                            sizes[i] = len(s)
                        arrays[length] = pa.array(sizes, arrays[length].type)
                yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: personal data of every document."""
    return report(table(spark, sf_dir, "documents"))
