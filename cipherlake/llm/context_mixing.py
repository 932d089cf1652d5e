"""Language-model scoring by online logistic context mixing over bits.

A text is its lower-cased words and one end mark, and these are a sequence of bits: for each
token one bit says whether training knows it; a known token is the ``CODE`` bits of its word code
(a class by its last two bytes, then bits of its hash), a new one the bits of its bytes. Every bit
is predicted by several contexts whose log-odds are summed with gated weights:

* the bits of the code so far, from exact counts of all training tokens;
* the same with the class of the token before, with the classes of the two before, and with the
  token before, hashed, for the bits of the class;
* the token that most often followed the two tokens before, from exact counts of every such
  context in all training texts: it foretells each bit as long as it agrees with those before.

Weights are refined online while a text is read: each text starts from ``first_weights`` and after
32, 128, 512, ... tokens takes a damped Newton step on what it has just read, so a token is always
scored with weights of earlier ones only. The gate is the part of the code and how far the
foretold token has come true of late. Words that share a whole code are told apart by their exact
counts. New words are spelled by byte contexts (the last one to four bytes, the word so far),
taught by the words that training has once; their weights are refined online over these words.

The score is the base-10 logarithm of the product of all bits; minus its value over log10(2) and
the bytes (one at least) is bits per byte.

Training covers all training rows (crc32 of the id modulo 7 is not 2; a null id is training).
Counts of tokens and of contexts grow with the corpus and are exact, but for equal 64-bit hashes of
words and equal hashes of contexts, which get 12 bits more than there are tokens. Texts are cut
into slices; each slice sends its keys, sorted, to buckets by hash and gets the counts back, so no
table that grows is broadcast or joined row by row. What is broadcast has a fixed size (some
30 MB). A training row's own occurrence does not count in its history. Sums are of integers and
weights belong to texts or hash buckets, so scores do not depend on how rows fall into tasks.

A slice holds whole texts; a text longer than a slice is one of its own.

The base score adds add-one unigram probabilities of tokens from exact counts. Null and empty
texts are one end mark. Each input row gives one row, equal rows equal ones; an empty table none.
Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from .shared import table, written

FOLDS, HELD = 7, 2
#: Bits of a word code, and those of its class among them.
CODE, CLASS = 20, 8
#: Bits of the hashed contexts of a class: the class before, the two before, the token before.
CONTEXTS = (8, 10, 12)
#: What a class context is drawn to the counts without it by, and the least mass of a code.
STRENGTH, LEAST_MASS = 4.0, 1e-3
#: Gates: parts of the code (first bit of each) and states of the foretold token (none, just come up, come true before).
PARTS, STATES = (0, CLASS, CODE - 6), 3
#: Positions in a text at which weights are refined: the first, then each four times as far.
FIRST_STEP, DAMPING = 32, 30.0
#: Trust in a foretold token, by how often it followed (once, twice, more) and how many of the last came true (0 to 3).
TRUST = np.array([[0.25, 0.85, 0.97, 0.99], [0.3, 0.85, 0.97, 0.99], [0.35, 0.85, 0.97, 0.99]])
#: Texts by which the share of new words in a text is drawn to that of the corpus.
NEW_PRIOR = 20.0
#: Bytes of text in a slice, and bytes of text whose keys share a bucket, and buckets at least.
SLICE = 4 << 20
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 32

#: Bits of each spelling context's table (one to four bytes, the word so far).
BITS = (16, 18, 18, 18, 18)
WORD = len(BITS) - 1
OFFSET = np.concatenate([[0], np.cumsum([1 << b for b in BITS])]).astype(np.int64)
#: Slots that travel as one row, and tables that are added up at once.
BLOCK, FAN = 1 << 16, 64
BUCKETS, PLACES, STEP = 8, 4, 1 << 14
K = len(BITS)
PRIOR, CHUNK = 0.4, 1 << 16
SPACE, END = 0x20, 0x0A
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_END_HASH = T.hash_runs(np.array([END], np.uint8), np.array([0]), np.array([1]))[0]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


class Stream:
    """Bytes of tokens, each closed by a space, laid flat, with what the contexts need."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        sizes = lengths + 1
        first = np.cumsum(sizes) - sizes
        self.count = sizes.size
        self.owner = np.repeat(np.arange(sizes.size), sizes)
        self.place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        inside = self.place < lengths[self.owner]
        self.byte = np.full(self.place.size, SPACE, np.uint8)
        self.byte[inside] = data[(starts[self.owner] + self.place)[inside]]
        value = T._BYTE[self.byte] * T.powers(int(sizes.max()) + 1 if sizes.size else 1)[self.place]
        total = np.cumsum(value) - value
        self.so_far = T.mix(total - total[first][self.owner] + self.place.astype(np.uint64))

    def take(self, chosen: np.ndarray) -> list[np.ndarray]:
        """The context hashes of the chosen positions."""
        place, history, out = self.place[chosen], np.zeros(chosen.size, np.uint64), []
        for back in range(1, WORD + 1):
            last = np.where(place >= back, self.byte[np.maximum(chosen - back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            history = history * np.uint64(257) + last
            out.append(history * _SALT[back - 1])
        return [*out, self.so_far[chosen] * _SALT[4]]


def slots(hashes: list[np.ndarray], byte: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each of the eight bits: the bit, and the slot of each context.

    Slots of half a byte of a short context lie side by side; those of a word are spread bit by bit, so none is wasted."""
    byte = byte.astype(np.int64)
    for half in (0, 1):
        nibble = (byte >> 4) if half == 0 else (byte & 15)
        bases = []
        for k, h in enumerate(hashes):
            h = h if half == 0 else h + (np.uint64(16) + (byte >> 4).astype(np.uint64)) * _SALT[2]
            bases.append(h if k == WORD else OFFSET[k] + ((T.mix(h) >> np.uint64(64 - (BITS[k] - 4))).astype(np.int64) << 4))
        node = np.ones(byte.size, np.int64)
        for shift in (3, 2, 1, 0):
            bit = (nibble >> shift) & 1
            h = (bases[WORD] + node.astype(np.uint64) * _SALT[0]) * _SALT[1]
            h = (h ^ (h >> np.uint64(29))) * _SALT[3]
            yield bit, [*(base + node for base in bases[:WORD]), OFFSET[WORD] + (h >> np.uint64(64 - BITS[WORD])).astype(np.int64)]
            node = node * 2 + bit


class Mixer:
    """Frozen context counts and the weights that mix them."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray):
        self.zeros, self.ones = counts[0], counts[1]
        zero, one = self.zeros.astype(np.float32), self.ones.astype(np.float32)
        self.logit = np.log((one + np.float32(PRIOR)) / (zero + np.float32(PRIOR)))
        self.bucket = np.minimum(np.log2(zero + one + 1), BUCKETS - 1).astype(np.uint8)
        self.weights = weights.astype(np.float32)

    def cells(self, k: int, bucket: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return (gate * K + k) * BUCKETS + bucket

    def log10(self, stream: Stream) -> np.ndarray:
        """log10 probability of the spelling of each token."""
        total, flat = np.zeros(stream.count), self.weights.ravel()
        for start in range(0, stream.byte.size, CHUNK):
            part = np.arange(start, min(start + CHUNK, stream.byte.size))
            place = np.minimum(stream.place[part], PLACES - 1)
            loss = np.zeros(part.size, np.float32)
            for bit, at in slots(stream.take(part), stream.byte[part]):
                gate = self.bucket[at[WORD]].astype(np.int64) * PLACES + place
                z = np.zeros(part.size, np.float32)
                for k, slot in enumerate(at):
                    z += flat[self.cells(k, self.bucket[slot], gate)] * self.logit[slot]
                z = np.clip(z, -14, 14)
                loss += np.logaddexp(np.float32(0), np.where(bit == 1, -z, z))
            total -= np.bincount(stream.owner[part], loss, total.size)
        return total / np.log(10)

    def refine(self, stream: Stream, state: np.ndarray) -> float:
        """Online steps over all bytes, each token left out of the counts in turn; the bits seen."""
        flat = self.weights.ravel()
        for start in range(0, stream.byte.size, STEP):
            part = np.arange(start, min(start + STEP, stream.byte.size))
            place = np.minimum(stream.place[part], PLACES - 1)
            slope, bend = np.zeros(flat.size), np.zeros(flat.size)
            for bit, at in slots(stream.take(part), stream.byte[part]):
                inputs, cells, gate = [], [], None
                for k in (WORD, *range(WORD)):
                    one, zero = self.ones[at[k]].astype(np.float32), self.zeros[at[k]].astype(np.float32)
                    one, zero = np.maximum(one - bit, 0), np.maximum(zero - 1 + bit, 0)
                    bucket = np.minimum(np.log2(one + zero + 1), BUCKETS - 1).astype(np.int64)
                    gate = bucket * PLACES + place if gate is None else gate
                    inputs.append(np.log((one + np.float32(PRIOR)) / (zero + np.float32(PRIOR))))
                    cells.append(self.cells(k, bucket, gate))
                z = np.clip(sum(flat[c] * x for c, x in zip(cells, inputs)), -14, 14)
                p = 1 / (1 + np.exp(-z))
                err, curve = bit - p, np.maximum(p * (1 - p), 1e-4)
                for c, x in zip(cells, inputs):
                    slope += np.bincount(c, err * x, flat.size)
                    bend += np.bincount(c, curve * x * x, flat.size)
            state *= 0.9
            state += bend
            flat += (0.3 * slope / (state + 20)).astype(np.float32)
            np.clip(flat, -1, 2.5, out=flat)
        self.weights = flat.reshape(self.weights.shape)
        return 8.0 * stream.byte.size


def first_weights() -> np.ndarray:
    """Before training: longer contexts count more."""
    w = np.zeros((BUCKETS * PLACES, K, BUCKETS))
    w += np.array([0.05, 0.1, 0.25, 0.35, 0.25])[None, :, None]
    return w


class Tokens:
    """The tokens of a slice of texts in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = offsets.size - 1
        low = T.LOWER[data]
        starts, ends, doc = T.runs(~T.SPACE[low], offsets)
        keys = np.concatenate([T.hash_runs(low[a:b], starts[i:j] - a, ends[i:j] - a) for i, j, a, b in _parts(starts, ends)] or [np.zeros(0, np.uint64)])
        self.data = np.append(low, np.uint8(END))
        # each text's words, then its end: a word moves on by one for each text before its own
        at = np.arange(doc.size) + doc
        size = doc.size + self.n
        self.doc = np.zeros(size, np.int64)
        is_end = np.ones(size, bool)
        is_end[at] = False
        self.doc[at], self.doc[is_end] = doc, np.arange(self.n)
        self.hash = np.full(size, _END_HASH)
        self.hash[at] = keys
        self.starts, self.lengths = np.full(size, low.size), np.ones(size, np.int64)
        self.starts[at], self.lengths[at] = starts, ends - starts
        self.count = np.bincount(self.doc, minlength=self.n)
        self.place = np.arange(size) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        last = self.data[self.starts + self.lengths - 1].astype(np.uint64)
        other = np.where(self.lengths > 1, self.data[np.maximum(self.starts + self.lengths - 2, 0)], 0).astype(np.uint64)
        self.kind = (((last * np.uint64(256) + other + np.uint64(1)) * _SALT[0]) >> np.uint64(64 - CLASS)).astype(np.int64)
        self.code = self.kind << (CODE - CLASS) | (self.hash >> np.uint64(64 - CODE + CLASS)).astype(np.int64)

    def before(self, values: np.ndarray, back: int) -> np.ndarray:
        """The value so many tokens earlier in the same text, else 0."""
        out = np.zeros_like(values)
        out[back:] = values[:-back]
        out[self.place < back] = 0
        return out

    def contexts(self) -> list[np.ndarray]:
        """The hashed contexts of each token's class."""
        one, two = (self.before(self.kind + 1, back).astype(np.uint64) for back in (1, 2))
        mixed = (one, one * np.uint64(257) + two, self.before(self.hash, 1))
        return [((x * _SALT[1 + k]) >> np.uint64(64 - bits)).astype(np.int64) for k, (x, bits) in enumerate(zip(mixed, CONTEXTS))]

    def history(self, bits: int) -> np.ndarray:
        """Of each token: a hash of so many bits of the two before it."""
        return T.mix(self.before(self.hash, 1) * _SALT[0] + self.before(self.hash, 2) * _SALT[1]) >> np.uint64(64 - bits)


def _parts(starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, int, int]]:
    i = 0
    while i < starts.size:
        j = max(int(np.searchsorted(starts, starts[i] + limit)), i + 1)
        yield i, j, int(starts[i]), int(ends[j - 1])
        i = j


def _flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def _pack(values: np.ndarray) -> bytes:
    """64-bit values as differences and byte by byte, so that leading zeros take no room."""
    return _squeeze(np.ascontiguousarray(np.diff(values.astype(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T))


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_spread(packed, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _spread(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


SLICED = "slice long, ids array<long>, held array<boolean>, sizes array<long>, texts binary"


def sliced(docs: DataFrame) -> DataFrame:
    """One row for each slice of texts: ids, folds, sizes in bytes, and the texts, squeezed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                data, offsets = T.buffers(part.column("text"))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), x) for x in (part.column("doc_id"), part.column("held_out"), pa.array(np.diff(offsets)))]
                yield pa.RecordBatch.from_arrays([pa.array([at]), *lists, pa.array([_squeeze(data)], pa.binary())], names=["slice", "ids", "held", "sizes", "texts"])
                at += 1

    return docs.mapInArrow(run, SLICED)


def _tokens(row: dict) -> tuple[Tokens, np.ndarray]:
    """The tokens of a slice, and whether each text is held out."""
    offsets = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
    return Tokens(_spread(row["texts"], np.uint8), offsets), np.asarray(row["held"], bool)


#: Kinds of rows: counts of tokens, of histories, of class contexts, words seen once, masses of codes.
COUNTS, HISTORY, CLASSES, ONCE, MASSES = range(5)
ASKED = "kind int, bucket long, slice long, keys binary, n binary, names binary, sizes binary"
ANSWERED = "kind int, bucket long, slice long, found binary, value binary, tokens long, types long, once long, twice long"


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), values.size) if values.size else np.zeros(1, np.int64)


def ask(slices: DataFrame, bits: int, wide: int) -> DataFrame:
    """The keys of each slice by bucket, with their training counts; and each task's class contexts."""

    def rows(kind, bucket, slice_, keys, n, names=None, sizes=None):
        m = len(bucket)
        columns = [pa.array(np.full(m, kind, np.int32)), pa.array(bucket), pa.array(np.full(m, slice_)), *(pa.array(x if x is not None else [None] * m, pa.binary()) for x in (keys, n, names, sizes))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ASKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(sum(1 << b for b in CONTEXTS) << CLASS, np.int64)
        first = np.cumsum([0, *(1 << b for b in CONTEXTS)]) << CLASS
        for batch in batches:
            for row in batch.to_pylist():
                t, held = _tokens(row)
                own = ~held[t.doc]
                for k, context in enumerate(t.contexts()):
                    seen[first[k] : first[k + 1]] += np.bincount((context[own] << CLASS) | t.kind[own], minlength=int(first[k + 1] - first[k]))
                keys, at, back = np.unique(t.hash, return_index=True, return_inverse=True)
                n, kind = np.bincount(back, own, keys.size).astype(np.int64), t.kind[at]
                cuts = _cuts(keys >> np.uint64(64 - bits))
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                raw, names, sizes = t.data.tobytes(), [], []
                for i, j in spans:
                    single = np.flatnonzero(n[i:j] == 1) + i
                    begin, size = t.starts[at[single]], t.lengths[at[single]]
                    names.append(zstandard.compress(b"".join([raw[x : x + y] for x, y in zip(begin.tolist(), size.tolist())]), 1))
                    sizes.append(_squeeze(size))
                yield rows(COUNTS, (keys[cuts[:-1]] >> np.uint64(64 - bits)).astype(np.int64), row["slice"], [_pack(keys[i:j]) for i, j in spans], [_squeeze(n[i:j] << CLASS | kind[i:j]) for i, j in spans], names, sizes)
                key = np.sort(t.history(wide) << np.uint64(CODE + 1) | t.code.astype(np.uint64) << np.uint64(1) | own)
                pair = key >> np.uint64(1)
                first_of = _cuts(pair)
                n = np.add.reduceat((key & np.uint64(1)).astype(np.int64), first_of[:-1]) if pair.size else np.zeros(0, np.int64)
                n = n << 1 | (n < np.diff(first_of))  # and whether a held-out text asks too
                pair = pair[first_of[:-1]]
                bucket = pair >> np.uint64(wide + CODE - bits)
                cuts = _cuts(bucket)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield rows(HISTORY, bucket[cuts[:-1]].astype(np.int64), row["slice"], [_pack(pair[i:j]) for i, j in spans], [_squeeze(n[i:j]) for i, j in spans])
        part, blocks = TaskContext.get().partitionId(), seen.reshape(-1, BLOCK)
        full = np.flatnonzero(blocks.any(1))
        yield rows(CLASSES, (full << 32) + part // FAN, -1, [b""] * full.size, [_squeeze(blocks[b]) for b in full.tolist()])

    return slices.mapInArrow(run, ASKED)


def _runs(rows: pa.Table, name: str, unpack) -> list[np.ndarray]:
    return [unpack(x) for x in rows.column(name).to_pylist()]


def answer(rows: pa.Table) -> pa.Table:
    """What a bucket knows of the keys that slices ask for."""
    kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
    out: list[tuple] = []
    if kind == CLASSES:
        out.append((kind, bucket, -1, b"", _squeeze(sum(_spread(x, np.int64) for x in rows.column("n").to_pylist())), 0, 0, 0, 0))
    else:
        keys, ns = _runs(rows, "keys", _unpack), _runs(rows, "n", lambda x: _spread(x, np.int64))
        sizes = np.array([x.size for x in keys])
        key, n, of = np.concatenate(keys), np.concatenate(ns), rows.column("slice").to_numpy()
        if kind == COUNTS:
            word_kind, n = n & ((1 << CLASS) - 1), n >> CLASS
        else:
            asked, n = n & 1, n >> 1
        row = np.repeat(np.arange(sizes.size), sizes)
        ends = np.cumsum(sizes)
        order = np.argsort(key)
        ranked = key[order]
        first = _cuts(ranked)[:-1]
        times = np.add.reduceat(n[order], first)
        each = np.empty(key.size, np.int64)  # of each asked key, its place among the distinct ones
        each[order] = np.repeat(np.arange(first.size), np.diff(np.append(first, key.size)))
        if kind == COUNTS:
            got = times[each]
            stats = (int(times.sum()), *(int(x.sum()) for x in (times > 0, times == 1, times == 2)))
            for i, (a, b) in enumerate(zip(ends - sizes, ends)):
                out.append((kind, bucket, int(of[i]), b"", _squeeze(got[a:b]), *(stats if i == 0 else (0, 0, 0, 0))))
            code = word_kind[order[first]] << (CODE - CLASS) | (ranked[first] >> np.uint64(64 - CODE + CLASS)).astype(np.int64)
            sums = np.concatenate([np.bincount(code, x, 1 << CODE).astype(np.int64) for x in (times, times > 0)]).reshape(-1, BLOCK)
            out += [(MASSES, b << 32 | bucket, -1, b"", _squeeze(sums[b]), 0, 0, 0, 0) for b in np.flatnonzero(sums.any(1)).tolist()]
            names = []
            for i, (packed, much) in enumerate(zip(rows.column("names").to_pylist(), _runs(rows, "sizes", lambda x: _spread(x, np.int64)))):
                here = slice(int(ends[i] - sizes[i]), int(ends[i]))
                hapax = (got[here] == 1)[n[here] == 1]
                raw, stop = zstandard.decompress(packed), np.cumsum(much)
                names += [(int(h), raw[e - m : e]) for h, e, m in zip(key[here][n[here] == 1][hapax].tolist(), stop[hapax].tolist(), much[hapax].tolist())]
            names.sort()
            lengths = np.array([len(x) for _, x in names], np.int64)
            out.append((ONCE, bucket, -1, zstandard.compress(b"".join(x for _, x in names), 1), _squeeze(lengths), 0, 0, 0, 0))
        else:
            context = ranked[first] >> np.uint64(CODE)
            start = _cuts(context)[:-1]
            total = np.add.reduceat(times, start)
            top = np.maximum.reduceat(times << CODE | (ranked[first] & np.uint64((1 << CODE) - 1)).astype(np.int64), start)
            group = np.repeat(np.arange(start.size), np.diff(np.append(start, context.size)))[each]
            here = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])))
            mine, g = np.add.reduceat(n, here), group[here]
            often, whole = top[g] >> CODE, total[g]
            # a context that one training token has in all foretells nothing to that token itself
            kept = (often > 0) & ~((whole == 1) & (mine > 0) & (np.maximum.reduceat(asked, here) == 0))
            scale = np.maximum(whole / 63, 1)
            value = ((top[g] & ((1 << CODE) - 1)) | np.rint(often / scale).astype(np.int64) << CODE | np.rint(whole / scale).astype(np.int64) << (CODE + 6)).astype(np.uint32)
            cut = np.searchsorted(row[here], np.arange(sizes.size + 1))
            for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                out.append((kind, bucket, int(of[i]), np.packbits(kept[a:b]).tobytes(), _squeeze(value[a:b][kept[a:b]]), 0, 0, 0, 0))
    return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in ANSWERED.split(", ")])


def merged(rows: DataFrame, salts: int, size: int) -> np.ndarray:
    """The sum of tables that come in (block, salt, value) rows, at most FAN at a time. Its size is fixed."""

    def add(part: pa.Table) -> pa.Table:
        total = _squeeze(sum(_spread(x, np.int64) for x in part.column("value").to_pylist()))
        return pa.Table.from_arrays([part.column("block").slice(0, 1), part.column("salt").slice(0, 1), pa.array([total], pa.binary())], names=["block", "salt", "value"])

    rows = rows.select("block", "salt", "value")
    while True:
        salts = -(-salts // FAN)
        rows = rows.withColumn("salt", F.floor(F.col("salt") / FAN)).groupBy("block", "salt").applyInArrow(add, "block long, salt long, value binary")
        if salts <= 1:
            break
    out = np.zeros((size // BLOCK, BLOCK), np.int64)
    for row in rows.collect():
        out[row["block"]] = _spread(row["value"], np.int64)
    return out.ravel()


def heap(leaves: np.ndarray) -> np.ndarray:
    """Sums of leaves over a binary tree, by heap index, on the last axis."""
    levels = [leaves]
    while levels[-1].shape[-1] > 1:
        levels.append(levels[-1][..., ::2] + levels[-1][..., 1::2])
    return np.concatenate([np.zeros_like(levels[-1]), *levels[::-1]], axis=-1)


def log_odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of the nodes of trees, at their heap index: the log-odds of a one."""
    return np.insert(np.clip(np.log(one / zero), -14, 14), 0, 0, axis=-1).astype(np.float32)


class Tables:
    """What every task needs, of fixed size: log-odds of the bits of codes, and the spelling mixer."""

    def __init__(self, codes: np.ndarray, types: np.ndarray, classes: np.ndarray, spelling: np.ndarray, weights: np.ndarray, total: int, kinds: int, once: int, twice: int):
        self.total, self.kinds = total, kinds
        self.discount = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
        self.new = min(max(self.discount * kinds / max(total, 1), 1e-6), 0.5)
        leaves = np.maximum(codes - self.discount * types, 0) + LEAST_MASS
        self.mass = np.log(leaves).astype(np.float32)
        tree = heap(leaves)
        self.plain = log_odds(tree[2::2], tree[3::2])
        self.classes, at = [], 0
        share = tree[3 : 2 << CLASS : 2] / (tree[2 : 2 << CLASS : 2] + tree[3 : 2 << CLASS : 2])
        for b in CONTEXTS:
            seen = heap(classes[at : at + (1 << b + CLASS)].reshape(-1, 1 << CLASS).astype(float))
            at += 1 << b + CLASS
            self.classes.append(log_odds(seen[:, 2::2] + STRENGTH * (1 - share), seen[:, 3::2] + STRENGTH * share).ravel())
        self.spelling, self.weights = spelling, weights

    def speller(self) -> "Mixer":
        if not hasattr(self, "_speller"):
            self._speller = Mixer(self.spelling, self.weights)
        return self._speller


def first_mix() -> np.ndarray:
    """Weights before any text is read, by part of the code, state of the foretold token, and input: the code so far, three contexts, the foretold token."""
    w = np.zeros((len(PARTS), STATES, 5), np.float32)
    w[0, 0] = (0.05, 0.35, 0.35, 0.3, 0)
    w[1:, 0, 0] = 1
    w[:, 1:, 4] = 1
    return w


def known(answers: pa.Table, keys: np.ndarray, bits: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the contexts (in order) of a slice: the foretold code, how often it followed, and how often any did; 0 times if none."""
    code, often, whole = (np.zeros(keys.size, np.int64) for _ in range(3))
    if keys.size:
        answers = answers.sort_by("bucket")
        size = np.diff(_cuts(keys >> np.uint64(wide - bits)))
        given = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(m)) for x, m in zip(answers.column("found").to_pylist(), size, strict=True)]).astype(bool)
        value = np.concatenate(_runs(answers, "value", lambda x: _spread(x, np.uint32))).astype(np.int64)
        code[given], often[given], whole[given] = value & ((1 << CODE) - 1), value >> CODE & 63, value >> (CODE + 6)
    return code, often, whole


def foretold(t: Tokens, held: np.ndarray, answers: pa.Table, bits: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: the code that its history foretells, the trust in it (0 if none), and its state."""
    keys, back = np.unique(t.history(wide), return_inverse=True)
    code, often, whole = (x[back] for x in known(answers, keys, bits, wide))
    own = ~held[t.doc]
    true = code == t.code
    often, whole = often - (own & true), whole - own
    made = often > 0
    hit = made & true
    run, so = np.zeros(hit.size, np.int64), np.ones(hit.size, bool)
    for back_by in (1, 2, 3):
        so &= t.before(hit, back_by)
        run += so
    trust = TRUST[np.minimum(often, 3) - 1, run] * np.minimum(often / np.maximum(whole, 1), 1)
    return code, np.where(made, trust, 0.0).astype(np.float32), np.where(made, 1 + (run > 0), 0)


def steps(longest: int) -> Iterator[tuple[int, int]]:
    begin, end = 0, FIRST_STEP
    while begin < longest:
        yield begin, end
        begin, end = end, end * 4


def mix(t: Tokens, code: np.ndarray, trust: np.ndarray, state: np.ndarray, chosen: np.ndarray, tables: Tables) -> np.ndarray:
    """Natural log of the probability of the code bits of the chosen tokens, text by text, weights refined on the way; 0 for others."""
    loss, start_mix, one = np.zeros(t.code.size), first_mix(), np.float32(1)
    # by part and input, the weights of each text and state
    weights = np.repeat(start_mix.transpose(0, 2, 1)[:, :, None, :], t.n, axis=2)
    slope, bend = np.zeros(weights.shape), np.full(weights.shape, DAMPING)
    contexts = [(x << CLASS).astype(np.int32) for x in t.contexts()]
    codes, guesses, states = (x.astype(np.int32) for x in (t.code, code, state))
    for begin, end in steps(int(t.count.max()) if t.n else 0):
        block = np.flatnonzero((t.place >= begin) & (t.place < end) & chosen)
        for start in range(0, block.size, CHUNK):
            at = block[start : start + CHUNK]
            doc, target, guess = t.doc[at], codes[at], guesses[at]
            low, high = int(doc[0]), int(doc[-1]) + 1  # texts are in order
            q, cell = trust[at], (doc * STATES + states[at]).astype(np.int32)
            on = np.flatnonzero(states[at])
            q, path = q[on], np.ones(on.size, np.float32)
            teach = np.flatnonzero(t.count[doc] > end)
            all_teach = teach.size == at.size
            base = [c[at] for c in contexts]
            got, odds = np.zeros(at.size, np.float32), np.empty(at.size, np.float32)
            for j in range(CODE):
                part = sum(j >= p for p in PARTS) - 1
                w, first = weights[part].reshape(5, -1), start_mix[part, 0]
                node = target >> (CODE - j) | 1 << j
                bit = target >> (CODE - 1 - j) & 1
                x = [tables.plain.take(node)]
                if part == 0:
                    x += [table.take(b + node) for table, b in zip(tables.classes, base)]
                z = w[0].take(cell)
                z *= x[0]
                for k in range(1, len(x)):
                    more = w[k].take(cell)
                    more *= x[k]
                    z += more
                gone = None
                if on.size:
                    plain = x[0].take(on)
                    plain *= first[0]
                    for k in range(1, len(x)):
                        plain += first[k] * x[k].take(on)
                    up = guess.take(on) >> (CODE - 1 - j) & 1
                    sign = (2 * up - 1).astype(np.float32)
                    whole = q + (one - q) * path
                    path = path / (one + np.exp(-sign * plain))
                    right = (q + (one - q) * path) / whole
                    np.minimum(np.maximum(right, 1e-4, out=right), 1 - 1e-4, out=right)
                    hint = sign * np.log(right / (one - right))
                    z[on] += w[4].take(cell.take(on)) * hint
                    gone = up != bit.take(on)
                np.minimum(np.maximum(z, -14, out=z), 14, out=z)
                np.exp(np.negative(z, out=odds), out=odds)
                odds += one
                got -= np.log(odds)
                z *= 1 - bit
                got -= z
                if teach.size:
                    p = one / odds
                    err = bit - p
                    curve = p * (one - p)
                    if on.size:
                        x.append(np.zeros(at.size, np.float32))
                        x[-1][on] = hint
                    cells, size = (cell if all_teach else cell.take(teach)) - low * STATES, (high - low) * STATES
                    if not all_teach:
                        err, curve = err.take(teach), curve.take(teach)
                    for k, v in zip((*range(len(x) - 1), 4) if on.size else range(len(x)), x):
                        v = v if all_teach else v.take(teach)
                        step = err * v
                        slope[part, k, low:high] += np.bincount(cells, step, size).reshape(-1, STATES)
                        np.multiply(curve, v, out=step)
                        step *= v
                        bend[part, k, low:high] += np.bincount(cells, step, size).reshape(-1, STATES)
                if gone is not None and gone.any():
                    cell[on[gone]] = doc[on[gone]] * STATES
                    on, q, path = on[~gone], q[~gone], path[~gone]
            loss[at] = got
        weights += (slope / bend).astype(np.float32)
        np.clip(weights, -0.5, 2, out=weights)
        slope[:] = 0
    return loss


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_slices(slices: DataFrame, answers: DataFrame, bits: int, wide: int, shared) -> DataFrame:
    """op1's columns of every text."""

    def run(part: pa.Table, theirs: pa.Table) -> pa.Table:
        tables, row = shared.value, part.to_pylist()[0]
        t, held = _tokens(row)
        kind = theirs.column("kind").to_numpy()
        counts = theirs.take(np.flatnonzero(kind == COUNTS)).sort_by("bucket")
        n = np.concatenate(_runs(counts, "value", lambda x: _spread(x, np.int64)))[np.unique(t.hash, return_inverse=True)[1]]
        is_known = n > 0
        code, trust, state = foretold(t, held, theirs.take(np.flatnonzero(kind == HISTORY)), bits, wide)
        got = mix(t, code, trust, state, is_known, tables)
        # new or known: the share of new words in the text so far, drawn to the corpus's
        fresh = np.cumsum(~is_known) - ~is_known
        fresh -= np.repeat(fresh[np.cumsum(t.count) - t.count], t.count)
        share = (fresh + NEW_PRIOR * tables.new) / (t.place + NEW_PRIOR)
        got += np.log(np.where(is_known, 1 - share, share))
        got[is_known] += np.log(np.maximum(n[is_known] - tables.discount, 1e-9)) - tables.mass[t.code[is_known]]
        others = np.flatnonzero(~is_known)
        if others.size:
            _, at, back = np.unique(t.hash[others], return_index=True, return_inverse=True)
            got[others] += tables.speller().log10(Stream(t.data, t.starts[others[at]], t.lengths[others[at]]))[back] * np.log(10)
        scale = np.log10(tables.total + tables.kinds + 1)
        score = np.bincount(t.doc, got, t.n) / np.log(10)
        base = np.bincount(t.doc, np.log10(n + 1.0) - scale, t.n)
        size = np.maximum(np.asarray(row["sizes"]), 1)
        columns = [pa.array(row["ids"], pa.int64()), pa.array(held), pa.array(t.count), pa.array(np.bincount(t.doc, is_known, t.n).astype(np.int64)), pa.array(np.full(t.n, tables.total)), pa.array(base), pa.array(score), pa.array(-score / np.log10(2) / size)]
        return pa.Table.from_arrays(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    both = answers.where(F.col("kind").isin(COUNTS, HISTORY)).select("kind", "bucket", "slice", "found", "value")
    return slices.groupBy("slice").cogroup(both.groupBy("slice")).applyInArrow(run, SCORED)


def _spelled(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = _spread(row["value"], np.int64)
    return np.frombuffer(zstandard.decompress(row["found"]), np.uint8), np.cumsum(lengths) - lengths, lengths


def spelling_counts(once: DataFrame, buckets: int) -> np.ndarray:
    """int64[2, slots]: zeros and ones that the words seen once show in each slot."""
    size = int(OFFSET[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen, words = np.zeros((2, size), np.int64), _spelled(row)
                flat = seen.ravel()  # the same memory, one index
                for begin in range(0, words[1].size, 20_000):
                    stream = Stream(words[0], *(x[begin : begin + 20_000] for x in words[1:]))
                    for start in range(0, stream.byte.size, CHUNK):
                        part = np.arange(start, min(start + CHUNK, stream.byte.size))
                        for bit, at in slots(stream.take(part), stream.byte[part]):
                            for slot in at:
                                np.add.at(flat, slot + bit * size, 1)
                blocks = seen.reshape(-1, BLOCK)
                for b in np.flatnonzero(blocks.any(1)).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([row["bucket"]]), pa.array([_squeeze(blocks[b])], pa.binary())], names=["block", "salt", "value"])

    rows = once.select("bucket", "found", "value").mapInArrow(run, "block long, salt long, value binary")
    return merged(rows, buckets, 2 * size).reshape(2, size)


def spelling_weights(once: DataFrame, shared) -> np.ndarray:
    """Weights refined online over the words seen once, in each bucket for itself, and averaged by the bits seen."""
    shape = first_weights().shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _spelled(row)
                if words[1].size:
                    mixer = Mixer(shared.value, first_weights())
                    seen = mixer.refine(Stream(*words), np.zeros(int(np.prod(shape))))
                    yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([np.rint(mixer.weights.ravel() * 1e4 * seen).astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["seen", "w"])

    each = once.select("found", "value").mapInArrow(run, "seen double, w array<long>")
    # sums of whole numbers are the same in any order
    mean = each.select("seen", F.posexplode("w").alias("i", "w")).groupBy("i").agg((F.sum("w") / F.sum("seen")).alias("w")).toPandas()
    out = first_weights().ravel()
    out[mean["i"].to_numpy(int)] = mean["w"].to_numpy(float) / 1e4
    return out.reshape(shape)


def score(docs: DataFrame) -> DataFrame:
    """op1's columns for every row of docs."""
    share = docs.sparkSession.sparkContext.broadcast
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    slices = written(sliced(docs), "slices")
    size = slices.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, b) -> a + b)")).alias("bytes"), F.max("slice").alias("last")).first()
    bits = int(np.ceil(np.log2(max(LEAST_BUCKETS, (size["bytes"] or 0) / BUCKET_BYTES))))
    wide = min(43, max(bits + 8, int(np.ceil(np.log2(max(size["bytes"] or 0, 1 << 16)))) + 10))
    parts = ((size["last"] or 0) >> 24) + 1
    answers = written(ask(slices, bits, wide).groupBy("kind", "bucket").applyInArrow(answer, ANSWERED), "answers", by="kind")
    stats = answers.where(F.col("kind") == COUNTS).agg(*(F.sum(c) for c in ("tokens", "types", "once", "twice"))).first()
    total, kinds, once, twice = (int(x or 0) for x in stats)
    tables = answers.withColumn("block", F.shiftright("bucket", 32)).withColumn("salt", F.col("bucket") % (1 << 32))
    classes = merged(tables.where(F.col("kind") == CLASSES), parts // FAN + 1, sum(1 << b for b in CONTEXTS) << CLASS)
    codes = merged(tables.where(F.col("kind") == MASSES), 1 << bits, 2 << CODE).reshape(2, -1)
    words = answers.where(F.col("kind") == ONCE)
    spelling = spelling_counts(words, 1 << bits)
    weights = spelling_weights(words, share(spelling))
    shared = share(Tables(codes[0], codes[1], classes, spelling, weights, total, kinds, once, twice))
    return score_slices(slices, answers, bits, wide, shared)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: model and base score of every document."""
    return score(table(spark, sf_dir, "documents"))
