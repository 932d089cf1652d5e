"""Quality rules: hard rules on document statistics, then gradient-boosted trees over them.

Statistics of a text (null: no words) come from byte arrays in one pass. The trees learn from
``labels.quality``; they are constrained so that more symbols, repeated lines, repeated
windows, capitals or exclamation marks never raise a document's score. Every row of the input
gives one row of the result, in any order; repeated rows and ids are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from .shared import table
from .gbt import Forest, fit

#: Most labelled rows that the trees learn from: those of least hash.
SAMPLE = 20_000
#: Bytes of text that a worker takes at once: arrays over their bytes and words take many times as much.
SLICE = 1 << 19
#: The method rejects below this probability of good quality.
THRESHOLD = 0.5
LEAST_WORDS, REPEAT_PERCENT = 50, 50

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "punctuation", "exclaims", "line_words", "distinct", "stops", "closed_lines", "non_ascii")
MONOTONE = np.array([0, 0, -1, -1, -1, -1, 0, 0, -1, 0, 0, 0, 0, 0])

_SYMBOL, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT[list(b"!\"'(),-./:;?[]_`{}~")] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the trees' features."""
    n = offsets.size - 1
    word = ~T.SPACE[data]
    starts, ends, doc = T.runs(word, offsets)
    count = lambda index: np.bincount(index, minlength=n).astype(np.int64)
    n_words = count(doc)
    word_chars = T.per_text(word & ((data & 0xC0) != 0x80), offsets)
    n_symbols = T.per_text(_SYMBOL[data], offsets)

    hashes = T.hash_runs(data, starts, ends)
    salt = T.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    distinct = n_words - count(doc[T.repeated(hashes ^ salt[doc])[1]])
    covered = np.zeros(doc.size, bool)
    if doc.size > 2:
        window = T.mix(hashes[:-2] + np.uint64(3) * T.mix(hashes[1:-1] + np.uint64(5) * T.mix(hashes[2:]))) ^ salt[doc[:-2]]
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        twice = whole[T.repeated(window[whole])[0]]
        for k in range(3):
            covered[twice + k] = True
    n_repeat = count(doc[covered])

    line_starts, line_ends, line_doc = T.runs(data != 10, offsets)
    has_word = np.zeros(line_starts.size, bool)
    if starts.size:
        has_word[np.searchsorted(line_starts, starts, "right") - 1] = True
    line_starts, line_ends, line_doc = line_starts[has_word], line_ends[has_word], line_doc[has_word]
    n_lines = count(line_doc)
    dup = T.repeated(T.hash_runs(data, line_starts, line_ends) ^ salt[line_doc])[1]
    n_dup = count(line_doc[dup])

    upper = T.per_text((data >= 65) & (data <= 90), offsets)
    letters = upper + T.per_text((data >= 97) & (data <= 122), offsets)
    share = lambda a, b: a / np.maximum(b, 1)
    closed = np.isin(data[line_ends - 1], list(b".!?")) if line_ends.size else np.zeros(0, bool)
    features = np.stack(
        [
            np.log1p(n_words), share(word_chars, n_words), share(n_symbols, n_words), share(n_dup, n_lines), share(n_repeat, n_words), share(upper, letters),
            share(T.per_text((data >= 48) & (data <= 57), offsets), word_chars), share(T.per_text(_PUNCT[data], offsets), word_chars), share(T.per_text(data == 33, offsets), n_words),
            np.log1p(share(n_words, n_lines)), share(distinct, n_words), share(T.per_text((data == 46) | (data == 44), offsets), n_words), share(count(line_doc[closed]), n_lines), share(T.per_text(data >= 0xC0, offsets), word_chars),
        ],
        axis=1,
    )
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "features": features}


def verdicts(stats: dict[str, np.ndarray], model: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept and the trees' probability."""
    failed = (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * stats["n_words"])
    score = model.probability(stats["features"])
    return failed, ~failed & (score >= THRESHOLD), score


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Trees from the labelled rows of docs, at most ``sample`` of them. Null labels do not count."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one text for each id, so that what is collected is bounded by the sample
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text")).select("text", "_y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                x = statistics(*T.buffers(part.column("text")))["features"]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("_y")], names=["x", "y"])

    got = rows.mapInArrow(features, "x array<double>, y double").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    y = got["y"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same trees, however the rows arrive
    return fit(x[order], y[order], MONOTONE)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def rate(docs: DataFrame, model: Forest) -> DataFrame:
    """One row per document with its statistics and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                stats = statistics(*T.buffers(part.column("text")))
                failed, kept, score = verdicts(stats, model)
                columns = [part.column("doc_id"), *(pa.array(stats[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(kept), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Forest) -> DataFrame:
    """The documents that pass, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                yield part.filter(pa.array(verdicts(statistics(*T.buffers(part.column("text"))), model)[1]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return rate(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
