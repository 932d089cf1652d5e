"""MinHash near-duplicates by a multi-index Hamming join.

Every document has the set of its distinct four-word shingles. Documents with equal sets form a
class, and one of them stands for it. A class has a signature of ``HASHES`` minima, each kept
to 16 bits. Two sets of similarity 0.8 differ in about a fifth of the places; signatures that
differ in at most ``DISTANCE`` places are all found: of ``CHUNKS`` chunks one has at most one
wrong place (pigeonhole), so a signature is indexed under each chunk with each single place
masked. With 48 places and a distance of 23, a pair at the threshold is missed with a
probability of about one in a million. Candidates are confirmed on full sets.

Large groups of near copies are not paired out. First every document is compared with the most
central member of its buckets only, then with one of each other component that it meets, and
linked documents are merged; then only members outside their bucket's largest component are
compared with the members of other components, each pair once, if bitmaps of their sets allow the
similarity. Large buckets are divided by set size and dealt out in parts. No pair that could
still join two components is left out. Of the texts only those to be compared are shuffled; a bit
filter of fixed size keeps most others back.

Null, empty and word-free texts have empty sets and link with nothing; fewer than four words
are one shingle. Each input row gives one row. An id with several texts reaches what any text of
which it is the least id is linked with. A row without id is linked like any other, but has no id to lend: its
component is the least id of those it is linked with, null if none has one, and it is kept only
if none has one and its set stands for the component. ``keep`` leaves one of equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from .shared import table, written

SHINGLE, PERCENT = 4, 80
HASHES, CHUNKS, DISTANCE = 48, 12, 23
#: Longs in the bitmap of a set.
BITMAP = 16
#: Parts that the members of a hub are dealt into.
SALTS = 16
#: Members from which on a bucket is large, and its compared members in one part.
LARGE = 128
#: Rounds that compare documents with the most central members of their buckets.
HUB_ROUNDS = 2
#: Bytes of text that a worker takes at once: arrays over their bytes and words take many times as much.
SLICE = 1 << 19
#: Bits of the filter that keeps back texts that are not wanted, and of each bitmap it consists of: its size is fixed.
FILTER_BITS, BITMAP_BITS = 22, 15

_ROUND = np.random.RandomState(9)
_MUL = _ROUND.randint(1, 2**62, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _ROUND.randint(0, 2**62, HASHES, dtype=np.int64).astype(np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their offsets."""
    n = offsets.size - 1
    low = T.LOWER[data]
    starts, ends, doc = T.runs(~T.SPACE[low], offsets)
    keys = T.hash_runs(low, starts, ends)
    count = np.bincount(doc, minlength=n)
    # texts with fewer words than a shingle: padded by a hash that no word has
    short = (count > 0) & (count < size)
    if short.any():
        pad = np.repeat(np.flatnonzero(short), size - count[short])
        doc = np.concatenate([doc, pad])
        keys = np.concatenate([keys, np.zeros(pad.size, np.uint64)])
        order = np.argsort(doc, kind="stable")
        doc, keys = doc[order], keys[order]
    if doc.size < size:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    m = doc.size - size + 1
    value = np.zeros(m, np.uint64)
    for k in range(size):
        value = T.mix(value * np.uint64(0x9E3779B97F4A7C15) + keys[k : k + m])
    whole = doc[:m] == doc[size - 1 :]
    value, owner = value[whole], doc[:m][whole]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(value.size, bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[first], owner[first]
    return value, np.searchsorted(owner, np.arange(n + 1))


#: From here on numbers stand for sets that only rows without id have.
NAMELESS = 1 << 62

SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, signature array<int>"


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, a 128-bit digest of the set, and the signature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                value, at = shingles(*T.buffers(part.column("text")))
                size = np.diff(at)
                full = np.flatnonzero(size > 0)
                begin = at[:-1][full]
                sums = [np.zeros(size.size, np.uint64) for _ in range(2)]
                sign = np.zeros((size.size, HASHES), np.int32)
                if full.size:
                    sums[0][full] = np.add.reduceat(T.mix(value + np.uint64(0x1234567)), begin)
                    sums[1][full] = np.add.reduceat(T.mix(value ^ np.uint64(0x7654321ABCDEF)), begin)
                    for k in range(HASHES):
                        least = np.minimum.reduceat((value ^ (value >> np.uint64(32))) * _MUL[k] + _ADD[k], begin)
                        sign[full, k] = (T.mix(least) & np.uint64(0xFFFF)).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(size.size + 1, dtype=np.int32) * HASHES), pa.array(sign.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(size.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), flat], names=[c.split()[0] for c in SIGNED.split(", ")])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, SIGNED)


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, at, rep): each chunk of a signature with each single place masked, as one 64-bit key; ``at`` numbers chunk and place."""
    width = HASHES // CHUNKS
    place = lambda c, k: F.get("signature", F.lit(c * width + k))
    keys = [F.xxhash64(F.lit(c * width + m), *(place(c, k) for k in range(width) if k != m)) for c in range(CHUNKS) for m in range(width)]
    return classes.select("rep", F.posexplode(F.array(*keys)).alias("at", "key")).select("key", "at", "rep")


def _first_shared(a: str, b: str) -> str:
    """SQL: the first chunk and masked place under which both signatures are indexed alike, so a pair is made once."""
    width = HASHES // CHUNKS
    differ = lambda i: f"int({a}.signature[{i}] <> {b}.signature[{i}])"
    cases = []
    for c in range(CHUNKS):
        places = range(c * width, c * width + width)
        wrong = " + ".join(map(differ, places))
        mask = " ".join(f"when {a}.signature[{i}] <> {b}.signature[{i}] then {i}" for i in places)
        cases.append(f"when {wrong} = 0 then {c * width} when {wrong} = 1 then case {mask} end")
    return f"case {' '.join(cases)} end"


def _near(a: str, b: str) -> str:
    """SQL: sizes allow the similarity, and signatures are within the distance."""
    return (
        f"least({a}.n, {b}.n) * 100 >= greatest({a}.n, {b}.n) * {PERCENT} and "
        f"aggregate(zip_with({a}.signature, {b}.signature, (x, y) -> if(x = y, 0, 1)), 0, (s, x) -> s + x) <= {DISTANCE}"
    )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(rep, shingles, bits): sorted distinct shingle hashes of each document, and a bitmap of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                value, at = shingles(*T.buffers(part.column("text")))
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
                bits = np.zeros((at.size - 1, 64 * BITMAP), bool)
                bits[np.repeat(np.arange(at.size - 1), np.diff(at)), (value % np.uint64(64 * BITMAP)).astype(np.int64)] = True
                packed = pa.array(np.packbits(bits, axis=1).view(np.int64).ravel())
                maps = pa.ListArray.from_arrays(pa.array(np.arange(at.size, dtype=np.int32) * BITMAP), packed)
                yield pa.RecordBatch.from_arrays([part.column("rep"), sets, maps], names=["rep", "shingles", "bits"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, shingles array<long>, bits array<long>")


def _allowed(a: str, b: str) -> str:
    """SQL: the bitmaps allow the similarity. A bit of one set that the other lacks stands for a shingle or more that it lacks."""
    lacks = lambda p, q: f"{p}.n - (" + " + ".join(f"bit_count({p}.b{i} & ~{q}.b{i})" for i in range(BITMAP)) + ")"
    return f"least({lacks(a, b)}, {lacks(b, a)}) * {100 + PERCENT} >= ({a}.n + {b}.n) * {PERCENT}"


def texts_of(docs: DataFrame, stands: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the wanted representatives; stands (id, text_hash, rep) says which rows of docs they are.

    A text goes into the join only if its slot in a bit filter of the wanted ones is set."""
    chosen = written(stands.join(wanted, "rep", "left_semi"), "wanted")
    slot = F.xxhash64("id", "text_hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    slots = {"__map": F.shiftright(slot, BITMAP_BITS), "__bit": slot.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))}
    held = chosen.withColumns(slots).groupBy("__map").agg(F.bitmap_construct_agg("__bit").alias("__held"))
    is_set = "shiftright(int(conv(hex(substring(__held, int(__bit div 8) + 1, 1)), 16, 10)), int(__bit % 8)) & 1 = 1"
    rows = docs.withColumn("id", F.coalesce("doc_id", F.lit(NAMELESS))).withColumns(slots).join(F.broadcast(held), "__map").where(is_set)
    return rows.select("id", "text_hash", "text").join(chosen, ["id", "text_hash"]).select("rep", "text")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the candidate pairs (a, b), those whose full sets are similar enough."""
    left, right = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * PERCENT).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of the links (a, b): comp is the least node reachable.

    Alternating large-star and small-star steps; the number of rounds grows with the logarithm
    of the longest chain, and each round's links are written to the shared folder."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
        before = state


def label(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with the component of each representative."""
    comps = components(links)
    return classes.drop("comp").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def analyse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, set_a, set_b) of every row, and (set_a, set_b, n, rep, comp) of every class of equal sets."""
    docs = narrow(docs)
    signed = written(signatures(docs), "signatures")
    filled = signed.where("n_shingles > 0")
    # the row that stands for a class: the least id, then the least text
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NAMELESS)).alias("id"), "text_hash")).alias("first")
    named = F.when(F.col("first.id") < NAMELESS, F.col("first.id")).otherwise(F.lit(NAMELESS) + F.pmod(F.xxhash64("set_a", "set_b"), F.lit(1 << 61)))
    classes = filled.groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(first, F.first("signature").alias("signature"))
    classes = written(classes.withColumn("rep", named), "classes")
    keys = index_keys(classes)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # a member that meets many others, over all its keys, is central
    keys = written(keys.join(sizes, "key"), "keys")
    central = keys.groupBy("rep").agg(F.sum("members").alias("met"))
    members = keys.select("key", "at", "rep")
    about = classes.join(central, "rep").select("rep", "n", "signature", "met")
    stands = classes.select(F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"), "rep")
    sets_of = lambda wanted: written(shingle_sets(texts_of(docs, stands, wanted)), "sets")
    classes = classes.drop("first")
    links, current = None, about.withColumn("comp", F.col("rep"))
    for turn in range(HUB_ROUNDS):
        placed = members.select("key", "rep").join(current.select("rep", "met", "comp"), "rep")
        hub = F.max(F.struct("met", (-F.col("rep")).alias("back"), "comp")).alias("h")
        hubs = placed.groupBy("key").agg(hub, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "h")
        star = placed.select("key", "rep", "comp").join(hubs, "key").where("comp <> h.comp")
        # a member tries one hub at first, then one of each other component that it meets
        best = star.groupBy("rep", *([] if turn == 0 else ["h.comp"])).agg(F.max("h").alias("h"))
        pairs = _candidates(best.select("rep", (-F.col("h.back")).alias("hub")), current)
        links = _more(links, confirm(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())))
        current = written(label(about, links), "labels")
    placed = members.join(current.select("rep", "comp"), "rep")
    sized = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = sized.groupBy("key").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"), F.count(F.lit(1)).alias("parts"), (F.sum("c") - F.max("c")).alias("others"), F.sum("c").alias("all")).where("parts > 1").drop("parts")
    open_members = written(placed.join(main, "key"), "open")
    sets = sets_of(open_members.select("rep").distinct())
    bits = sets.select("rep", *(F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(BITMAP)))
    rest = open_members.join(current.select("rep", "n", "signature"), "rep").join(bits, "rep")
    # a large bucket is divided: by set size, as similar sets are of the same or the next band, and its compared members into parts
    large, band = F.col("all") > LARGE, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)))
    parts = F.ceil(F.col("others") / LARGE)
    whole = F.lit(0).cast("long")
    x = rest.where("comp <> main").withColumns({"band": F.when(large, band).otherwise(whole), "salt": F.when(large, F.pmod("rep", parts)).otherwise(whole)}).alias("x")
    bands = F.when(large, F.array(band - 1, band, band + 1)).otherwise(F.array(whole))
    y = rest.withColumn("band", F.explode(bands)).withColumn("salt", F.explode(F.when(large, F.sequence(whole, parts - 1)).otherwise(F.array(whole)))).alias("y")
    other = f"x.key = y.key and x.band = y.band and x.salt = y.salt and x.comp <> y.comp and (y.comp = y.main or x.rep < y.rep) and {_allowed('x', 'y')} and {_near('x', 'y')} and x.at = {_first_shared('x', 'y')}"
    pairs = x.join(y, F.expr(other)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    links = _more(links, confirm(written(pairs, "pairs"), sets))
    final = label(classes, links).select("set_a", "set_b", "n", "rep", "comp")
    return signed, final


def _candidates(star: DataFrame, current: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components whose signatures are near."""
    x = current.select(F.col("rep"), F.struct("n", "signature", "comp").alias("x"))
    # a hub may be met by a large part of all members: its row is there once for each salt
    hubs = current.join(star.select(F.col("hub").alias("rep")).distinct(), "rep").select(F.col("rep").alias("hub"), F.struct("n", "signature", "comp").alias("y"))
    y = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = star.join(x, "rep").withColumn("salt", F.pmod("rep", F.lit(SALTS)).cast("int")).join(y, ["hub", "salt"]).where("x.comp <> y.comp").where(_near("x", "y"))
    return written(near.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "pairs")


def _more(links: DataFrame | None, new: DataFrame) -> DataFrame:
    new = written(new, "links")
    return new if links is None else links.unionByName(new)


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of every row."""
    signed, final = analyse(docs)
    rows = signed.drop("signature").join(final.withColumnRenamed("n", "n_shingles"), ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).when(F.col("comp") < NAMELESS, F.col("comp"))
    kept = F.when(F.col("comp").isNull(), F.lit(True)).when(F.col("doc_id").isNull(), (F.col("comp") >= NAMELESS) & (F.col("comp") == F.col("rep"))).otherwise(F.col("comp") == F.col("doc_id"))
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return judged(docs).drop("text_hash")


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component, that of least id, with all its columns; texts without words all stay, but for equal rows."""
    rows = written(judged(docs), "judged")
    key = ["__id", "__text"]
    ids = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS)).alias(key[0]), F.col("text_hash").alias(key[1])]
    gone = rows.where(~F.col("kept")).select(*ids).distinct()
    # rows with equal id and text are equal to this operator: the few that come again are thinned out apart
    again = rows.where("kept").groupBy(*ids).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*key)
    keyed = docs.withColumns({key[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS)), key[1]: F.xxhash64(F.col("text").cast("string"))}).join(gone, key, "left_anti")
    if again.isEmpty():
        return keyed.select(*docs.columns)
    once = keyed.join(again, key, "left_anti").unionByName(keyed.join(again, key, "left_semi").dropDuplicates(key))
    return once.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: near-duplicate component of every document."""
    return report(table(spark, sf_dir, "documents"))


#: Links over all pairs that share a shingle; a component is named by the least id that reaches its members over greater ones.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(root, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.node AND e.y > r.root)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
