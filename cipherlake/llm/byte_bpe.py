"""Byte-level BPE encoding and decoding by a rank file.

The rank file becomes a BPE model of the tokenizers library: each token's merges are all its
splits into two tokens, in rank order, over the byte-to-character alphabet. Texts are cut at
single spaces between two other characters, where no match of the pattern can cross, and equal
pieces of a batch are encoded once. One corner differs between the two libraries: when the
same token can arise from two overlapping pairs, the rank rule takes the leftmost pair. Pieces
that contain such an overlap are merged by the rank rule itself. Decoding goes from ids through
the character table back to bytes; characters split over tokens join again because bytes are
concatenated before anything is read as UTF-8.

Null and empty texts have no ids; their hashes are those of no bytes. One row per input row, a
null id and repeated rows included; other columns do not matter; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from .shared import table

#: Pieces that a worker remembers at most, and pieces strung together for one call of the library.
REMEMBERED, CHAIN = 400_000, 4096
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def alphabet() -> list[str]:
    """A printable character for each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in chars):
        chars[b] = chr(256 + n)
    return [chars[b] for b in range(256)]


def by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: merge the leftmost pair of least rank until none is left.

    Pairs wait in a heap by rank and place, so a match of n bytes takes n log n steps."""
    if piece in ranks:
        return [ranks[piece]]
    end = len(piece)
    after = list(range(1, end + 1))  # where the part that begins here ends
    before = list(range(-1, end - 1))  # where the part before begins
    alive = [True] * end

    def pair(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        rank = ranks.get(piece[i : after[j]]) if j < end else None
        return None if rank is None else (rank, i, after[j])

    waiting = [x for i in range(end) if (x := pair(i))]
    heapq.heapify(waiting)
    while waiting:
        rank, i, stop = heapq.heappop(waiting)
        j = after[i] if alive[i] else end
        if j >= end or after[j] != stop:
            continue  # one of its halves has been merged meanwhile
        alive[j], after[i] = False, stop
        if stop < end:
            before[stop] = i
        for k in (before[i], i):
            if k >= 0 and (x := pair(k)):
                heapq.heappush(waiting, x)
    return [ranks[piece[i : after[i]]] for i in range(end) if alive[i]]


class Codec:
    def __init__(self, path: str, split: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import ahocorasick
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        char = alphabet()
        text = {token: "".join(char[b] for b in token) for token in self.ranks}
        merges, overlaps = [], set()
        for token, _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            halves = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks]
            merges += [(text[a], text[b]) for a, b in halves]
            left = {a: b for a, b in halves}
            overlaps |= {a + b + left[b] for a, b in halves if b in left}
        self.encoder = Tokenizer(models.BPE(vocab={text[t]: r for t, r in self.ranks.items()}, merges=merges, ignore_merges=True))
        self.encoder.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(split), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.overlap = ahocorasick.Automaton()
        for x in overlaps:
            self.overlap.add_word(x.decode("latin-1"), len(x))
        self.overlap.make_automaton()
        back = {c: b for b, c in enumerate(char)}
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.table[r] = bytes(back[c] for c in text[token])
        self.sizes = np.array([len(x) for x in self.table], np.int64)
        self.names = [str(i) for i in range(len(self.table))]
        self.known: dict[int, tuple[int, str, bytes]] = {}

    def ids(self, texts: list[bytes], inner: list[bool]) -> list[list[int]]:
        """Ids of each text. inner: cut on both sides within a text."""
        out: list[list[int] | None] = [None] * len(texts)
        for i in self.overlapping(texts):
            text = texts[i].decode("utf-8")
            out[i] = [x for begin, end in self.pieces(text) for x in by_rank(text[begin:end].encode("utf-8"), self.ranks)]
        # pieces with a cut on either side stay apart when strung together
        chain, alone = [], []
        for i, x in enumerate(out):
            if x is None:
                (chain if inner[i] else alone).append(i)
        for i, e in zip(alone, self.encoder.encode_batch_fast([texts[i].decode("utf-8") for i in alone], add_special_tokens=False)):
            out[i] = e.ids
        for begin in range(0, len(chain), CHAIN):
            group = chain[begin : begin + CHAIN]
            ids = np.array(self.encoder.encode_batch_fast([b"".join(texts[i] for i in group).decode("utf-8")], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(texts[i]) for i in group])) + 1
            flat, start = ids.tolist(), 0
            for i, stop in zip(group, ends.tolist()):
                out[i] = flat[start:stop]
                start = stop
        return out

    def overlapping(self, texts: list[bytes]) -> list[int]:
        """Indexes of the texts that hold an overlap."""
        if not len(self.overlap):
            return []
        size = np.cumsum([len(x) + 1 for x in texts])
        found = {int(np.searchsorted(size, end, "right")) for end, _ in self.overlap.iter(b"\xff".join(texts).decode("latin-1"))}
        return sorted(found)

    def pieces(self, text: str) -> list[tuple[int, int]]:
        """Offsets of the pattern's matches."""
        from tokenizers import Regex, pre_tokenizers

        split = getattr(self, "_split", None)
        if split is None:
            split = self._split = pre_tokenizers.Split(Regex(pattern()), "isolated")
        return [at for _, at in split.pre_tokenize_str(text)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[str], list[str]]:
        """Of each text: the number of ids, the digest of the ids and that of the decoded bytes."""
        starts, ends, doc = cuts(data, offsets)
        keys, first, inverse = np.unique(T.hash_runs(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        names = keys.tolist()
        new = [i for i, k in enumerate(names) if k not in self.known]
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        edge = np.zeros(data.size + 1, bool)
        edge[offsets] = True
        inner = ~(edge[starts[first[new]]] | edge[ends[first[new]]])
        for i, ids in zip(new, self.ids(texts, inner.tolist())):
            self.known[names[i]] = (len(ids), ",".join(map(self.names.__getitem__, ids)), self.decode(ids))
        found = [self.known[k] for k in names]
        lengths = np.array([x[0] for x in found], np.int64)
        joined, decoded = np.empty(len(found), object), np.empty(len(found), object)
        joined[:], decoded[:] = [x[1] for x in found], [x[2] for x in found]
        n = np.bincount(doc, lengths[inverse] if names else None, offsets.size - 1).astype(np.int64)
        at = np.searchsorted(doc, np.arange(offsets.size))
        joined, decoded = joined[inverse].tolist(), decoded[inverse].tolist()
        digest = lambda x: hashlib.sha256(x).hexdigest()
        spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
        return n.tolist(), [digest(",".join(joined[a:b]).encode()) for a, b in spans], [digest(b"".join(decoded[a:b])) for a, b in spans]


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the texts between which no match of the pattern crosses: starts, ends, text index."""
    if data.size == 0:
        return (np.zeros(0, np.int64),) * 3
    # white space beyond ASCII may join a run of spaces: no cut beside a byte that can be part of it
    odd = (data >= 0x1C) & (data <= 0x1F)
    lead = np.flatnonzero(np.isin(data[:-1], [0xC2, 0xE1, 0xE2, 0xE3]))
    lead = lead[((data[lead] == 0xC2) & np.isin(data[lead + 1], [0x85, 0xA0])) | ((data[lead] == 0xE1) & (data[lead + 1] == 0x9A)) | ((data[lead] == 0xE2) & np.isin(data[lead + 1], [0x80, 0x81])) | ((data[lead] == 0xE3) & (data[lead + 1] == 0x80))]
    for k in range(3):
        odd[np.minimum(lead + k, data.size - 1)] = True
    other = ~T.SPACE[data] & ~odd
    cut = np.zeros(data.size + 1, bool)
    cut[1:-2] = (data[1:-1] == 0x20) & other[:-2] & other[2:]
    cut[offsets] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], data.size)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def encode_decode(docs: DataFrame, path: str, split: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded bytes for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, split)
        for batch in batches:
            for part in T.slices(batch, "text"):
                n, ids, decoded = codec.run(*T.buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: ids and decoded bytes of every document, as digests."""
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary(), pattern())
