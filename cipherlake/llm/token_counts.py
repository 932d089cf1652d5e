"""Token counts: lengths only, from the library's own batch encoding.

The vocabulary drops white space and never joins across it, so any ASCII white space is a safe
boundary: a text is the sum of its space-free chunks, however long it is. Equal chunks of a
batch are encoded once, and the chunks sent to the library are grouped by bytes. Null and
empty texts have no tokens. Each input row gives one row, a null id and repeated rows included;
other columns do not matter; an empty table gives none. A chunk without white space is one call's
business, however long: no other boundary is safe.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from .shared import table

LIMIT = 2048
#: Chunk lengths that a worker remembers at most, and bytes in one call of the library.
REMEMBERED, CALL_BYTES = 1_000_000, 1 << 18

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens of space-free chunks, remembering what it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.known: dict[int, int] = {}
        if any(len(self.encoder.encode(f"x{c}y", add_special_tokens=False)) != 2 * len(self.encoder.encode("x", add_special_tokens=False)) for c in " \t\n\v\f\r"):
            raise ValueError("this vocabulary does not drop white space, so texts can't be cut there")

    def encode(self, chunks: list[str]) -> list[int]:
        counts: list[int] = []
        call: list[str] = []
        size = 0
        for chunk in chunks:
            call.append(chunk)
            size += len(chunk.encode("utf-8")) + 16
            if size >= CALL_BYTES:
                counts += [len(e) for e in self.encoder.encode_batch(call, add_special_tokens=False)]
                call, size = [], 0
        if call:
            counts += [len(e) for e in self.encoder.encode_batch(call, add_special_tokens=False)]
        return counts

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        starts, ends, doc = T.runs(~T.SPACE[data], offsets)
        keys, first, inverse = np.unique(T.hash_runs(data, starts, ends), return_index=True, return_inverse=True)
        names = keys.tolist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [i for i, k in enumerate(names) if k not in self.known]
        raw = data.tobytes()
        chunks = [raw[starts[j] : ends[j]].decode("utf-8", "replace") for j in first[new].tolist()]
        self.known.update(zip((names[i] for i in new), self.encode(chunks)))
        lengths = np.fromiter((self.known[k] for k in names), np.int64, len(names))
        return np.bincount(doc, lengths[inverse] if len(names) else None, offsets.size - 1).astype(np.int64)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offsets = T.buffers(part.column("text"))
                n = counter.count(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())
