"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

Features are lexicon densities, lexicon words near the second person, capitals, punctuation and
obfuscation rates. The lexicon is a short list of insults joined with the words that training
labels single out. Labels are read only for training rows (crc32 of the id modulo 4 is not 2),
at most ``SAMPLE`` of them, those of least hash; trees learn from two thirds, the calibration
from the rest. Language, source and id are no inputs. A row without id is not held out. Null and empty texts are scored like any
other. Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from .shared import table
from .gbt import Forest, fit, isotonic

SAMPLE = 20_000
#: Learned lexicon: most words, fewest training documents that hold one, and least log-odds.
WORDS, LEAST_DOCS, LEAST_ODDS = 400, 8, 2.0
NEAR, LIMIT = 5, 0.3

SEED = "idiot idiots moron morons stupid dumb loser losers worthless pathetic trash scum garbage fool ugly hate disgusting imbecile".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti vuestro".split()

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MASK = np.zeros(256, bool)
_MASK[list(b"*@$!#%013457_")] = True


def hashes(words: list[str]) -> np.ndarray:
    column = pa.array(words, pa.string())
    data, offsets = T.buffers(column)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    return np.unique(T.hash_runs(data, offsets[:-1][filled], offsets[1:][filled]))


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not table.size:
        return np.zeros(keys.size, bool)
    return table[np.minimum(np.searchsorted(table, keys), table.size - 1)] == keys


class Lexicon(NamedTuple):
    seed: np.ndarray
    learned: np.ndarray
    second: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits, lower-cased: starts, ends, text index and hashes."""
    low = T.LOWER[data]
    starts, ends, doc = T.runs(_WORD[low], offsets)
    return starts, ends, doc, T.hash_runs(low, starts, ends)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    n = offsets.size - 1
    _, _, doc, keys = words(data, offsets)
    count = lambda index: np.bincount(index, minlength=n)
    total = count(doc)
    share = lambda a, b: a / np.maximum(b, 1)
    seed, learned, second = (_among(keys, table) for table in lexicon)
    any_hit = seed | learned
    hit, you = np.flatnonzero(any_hit), np.flatnonzero(second)
    near = np.zeros(hit.size, bool)
    if you.size and hit.size:
        right = np.searchsorted(you, hit)
        for pick in (np.maximum(right - 1, 0), np.minimum(right, you.size - 1)):
            near |= (np.abs(you[pick] - hit) <= NEAR) & (doc[you[pick]] == doc[hit])
    upper = (data >= 65) & (data <= 90)
    letters = T.per_text(_LETTER[data], offsets)
    inner = np.zeros(data.size, bool)
    if data.size > 2:
        inner[1:-1] = _MASK[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]]
    stretched = np.zeros(data.size, bool)
    if data.size > 3:
        stretched[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
    size = np.diff(offsets)
    hits = count(doc[any_hit])
    return np.stack(
        [
            share(hits, total), np.log1p(hits), share(count(doc[seed]), total), np.log1p(count(doc[seed])), share(count(doc[learned]), total), np.log1p(count(doc[learned])), np.log1p(count(doc[hit[near]])), share(count(doc[second]), total),
            share(T.per_text(upper, offsets), letters), share(T.per_text(data == 33, offsets), total), share(T.per_text(data == 63, offsets), total), share(T.per_text((data < 128) & ~_WORD[data] & ~T.SPACE[data], offsets), size),
            share(T.per_text(inner, offsets), total), share(T.per_text(stretched, offsets), total), np.log1p(total),
        ],
        axis=1,
    ).astype(float)


MONOTONE = np.array([1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0])


class Model(NamedTuple):
    lexicon: Lexicon
    forest: Forest
    knots: np.ndarray
    levels: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = self.forest.margin(features(data, offsets, self.lexicon))
        if not self.knots.size:
            return 1 / (1 + np.exp(-margin))
        return np.clip(np.interp(margin, self.knots, self.levels), 0, 1)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The lexicon, trees and calibration, from training rows alone."""
    usable = labels.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col(label).isNotNull())
    chosen = usable.groupBy("doc_id").agg(F.max(label).cast("double").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("_apart", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    # one text for each id, so that what is collected is bounded by the sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y", "_apart").agg(F.min("text").alias("text"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offsets = T.buffers(part.column("text"))
                starts, ends, doc, keys = words(data, offsets)
                once = np.flatnonzero(~T.repeated(keys ^ T.mix(doc.astype(np.uint64)))[1])
                raw = T.LOWER[data].tobytes()
                y = np.asarray(part.column("_y").to_numpy(zero_copy_only=False), float)
                _, first, inverse = np.unique(keys[once], return_index=True, return_inverse=True)
                names = [raw[starts[j] : ends[j]].decode("utf-8", "replace") for j in once[first].tolist()]
                size = len(names)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.bincount(inverse, minlength=size).astype(np.int64)), pa.array(np.bincount(inverse, y[doc[once]], size).astype(np.int64))], names=["word", "n", "hits"])

    # rows kept apart for calibration have no say in the lexicon, else its features would know their labels
    ours = rows.where(~F.col("_apart"))
    got = chosen.where(~F.col("_apart")).agg(F.count(F.lit(1)), F.sum("_y")).first()
    total, positive = float(got[0] or 0), float(got[1] or 0)
    odds = F.log((F.col("hits") + 0.5) / (F.lit(positive) + 1)) - F.log((F.col("n") - F.col("hits") + 0.5) / (F.lit(total - positive) + 1))
    scored = ours.select("text", "_y").mapInArrow(counts, "word string, n long, hits long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where((F.col("n") >= LEAST_DOCS) & (odds >= LEAST_ODDS))
    learned = [r["word"] for r in scored.orderBy((odds * F.sqrt("hits")).desc(), "word").limit(WORDS).select("word").collect()]
    lexicon = Lexicon(hashes(SEED), hashes(learned), hashes(SECOND))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                x = features(*T.buffers(part.column("text")), lexicon)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64())), part.column("_y"), part.column("_apart")], names=["doc_id", "x", "y", "apart"])

    table = rows.mapInArrow(vectors, "doc_id long, x array<double>, y double, apart boolean").toPandas()
    x, y = np.array(table["x"].tolist()).reshape(-1, MONOTONE.size), table["y"].to_numpy(float)
    order = np.lexsort((*x.T, y, table["doc_id"].to_numpy()))
    x, y, apart = x[order], y[order], table["apart"].to_numpy(bool)[order]
    forest = fit(x[~apart], y[~apart], MONOTONE, trees=50, depth=3)
    knots, levels = isotonic(forest.margin(x[apart]), y[apart])
    return Model(lexicon, forest, knots, levels)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def rate(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                score = model.score(*T.buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= limit).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return rate(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
