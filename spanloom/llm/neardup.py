"""Near-duplicate documents by MinHash bands, odd sketches and an exact check.

A document is the set of its distinct five-word shingles. Per document, one pass computes

* ``BANDS`` x ``BAND_ROWS`` MinHash values, hashed into one key per band;
* an odd sketch: the samples of a one-permutation MinHash, folded into a bitmap by parity. Two bitmaps' XOR
  has a population count from which the samples that differ, and so the similarity, follow precisely when
  it is high (Mitzenmacher, Pagh and Pham, 2014).

Documents with equal sets are one class, known by a mark of its own, so any rows may share a key. Within each
band bucket, every class is tried against one pivot, the member that shares most buckets with others; the pairs
whose sketches allow the threshold are confirmed on full sets and joined into components. A pivot with many
pairs meets them in several tasks. Buckets whose members still lie in different components are then searched for
the pairs that cross components, in blocks of ``BLOCK`` members that meet two by two, the sketches being part of
the join's condition, so that a group of near copies gives rows in proportion to its members and no link between
different texts is passed over. The sketch limit leaves 5.5 standard deviations to a pair at the threshold.

Defined results: texts that are null, empty or without words have the empty set, no links and themselves
as component; a text of fewer than five words is one shingle. Rows with equal texts share a component.
A null key makes a null component, and is kept. Rows that share a key but differ in text each have the component
of their text. Keys may be of any type that has an order. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import sliced, stash, texts_of

SHINGLE = 5
LINK_PERCENT = 75
BANDS, BAND_ROWS = 48, 5
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS
#: Bins of the one-permutation MinHash below and from LARGE shingles: few samples are masked in small sets,
#: and the bitmap isn't saturated by large ones.
SMALL_BINS, LARGE_BINS, LARGE = 4096, 1024, 1024
#: Members of a bucket in one block, and pairs of a pivot in one task.
BLOCK, PIVOT_PAIRS = 500, 200

_random = np.random.default_rng(20240229)
_XOR = _random.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)
_MULTIPLY = _random.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
_PLACE = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _random.integers(0, 1 << 63, (BANDS, BAND_ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text, A-Z lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    if len(found) < SHINGLE:
        return _mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], np.uint64))
    n = len(found) - SHINGLE + 1
    total = hashes[:n] * _PLACE[0]
    for i in range(1, SHINGLE):
        total += _mix(hashes[i : i + n] + _PLACE[i]) * _PLACE[i]
    return np.unique(_mix(total))


def min_hashes(items: np.ndarray, block: int = 1024) -> np.ndarray:
    """The least of each of the hash functions over a set that isn't empty."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_XOR), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), block):
        part = x[None, at : at + block] ^ _XOR[:, None]
        part *= _MULTIPLY[:, None]
        np.minimum(best, part.min(1), out=best)
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    return _mix((_mix(rows + _BAND[:, :BAND_ROWS]) * _BAND[:, 1:]).sum(1, dtype=np.uint64) + _BAND[:, 0]).astype(np.int64)


def odd_sketch(items: np.ndarray, count: int) -> np.ndarray:
    """Parity bitmap of the one-permutation MinHash samples of a set in ``count`` bins."""
    mixed = np.sort(_mix(items ^ np.uint64(0x9E3779B97F4A7C15)))
    bins = mixed >> np.uint64(64 - count.bit_length() + 1)
    first = np.ones(len(mixed), bool)
    first[1:] = bins[1:] != bins[:-1]
    bits = (_mix(mixed[first]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
DIGEST = "__digest"


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``__id``, a digest of the text, ``n_shingles``, and for sets that aren't empty ``fp``, ``bands``, the sketch
    ``s0`` .. ``s15``, and ``small``: a second sketch of sets that may be linked with ones of fewer than ``LARGE``."""
    source = docs.select(F.col(key).alias("__id"), F.xxhash64(text).alias(DIGEST), F.col(text).alias("__text"))
    names = ["__id", DIGEST, "n_shingles", "fp", "bands", *SKETCH, "small"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(SKETCH_WORDS, np.int64)
        for batch in sliced(batches):
            counts, prints, bands, sketches, small = [], [], [], [], []
            for text in texts_of(batch.column("__text")):
                items = shingles(text)
                n = len(items)
                counts.append(n)
                prints.append(xxhash.xxh3_128_digest(items.tobytes()) if n else None)
                bands.append(band_keys(min_hashes(items)) if n else None)
                sketches.append(odd_sketch(items, SMALL_BINS if n < LARGE else LARGE_BINS) if n else zero)
                small.append(odd_sketch(items, SMALL_BINS) if LARGE <= n and LINK_PERCENT * n <= 100 * LARGE else None)
            words = np.array(sketches, np.int64).reshape(len(counts), SKETCH_WORDS)
            lists = pa.list_(pa.int64())
            columns = [batch.column("__id"), batch.column(DIGEST), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, lists), *(pa.array(words[:, i]) for i in range(SKETCH_WORDS)), pa.array(small, lists)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"__id {dict(source.dtypes)['__id']}, {DIGEST} long, n_shingles long, fp binary, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH) + ", small array<long>"
    return source.mapInArrow(run, schema)


def _limit(a: Column, b: Column, bins: int) -> Column:
    """The most bits in which two sketches at the threshold differ, with 5.5 standard deviations to spare.

    At a similarity of 3/4 a quarter of the bins that the union fills have different samples, of one set or
    of both. One bit differs for an odd number of different samples in it.
    """
    union = (a + b) * (4.0 / 7.0)
    filled = bins * (1 - F.exp(-union / bins))
    both = 1 - F.exp(-F.greatest(a, b) / bins)
    m = 0.25 * filled * (1 + both)
    slope = F.exp(-2.0 * m / SKETCH_BITS)
    sampled = 0.1875 * filled * (1 + both) * (1 + both) * F.least(F.lit(1.0), 2 * both) * slope * slope
    merged = F.least(F.lit(SKETCH_BITS / 4.0), 2.0 * m * m / SKETCH_BITS)
    return SKETCH_BITS / 2.0 * (1 - slope) + 5.5 * F.sqrt(sampled + merged + 1)


def _may_link(x: str, y: str) -> Column:
    """Whether two rows' sizes and sketches allow the threshold; of sets on both sides of ``LARGE`` the small ones' bins are compared."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    mixed = (F.least(a, b) < LARGE) & (F.greatest(a, b) >= LARGE)
    word = lambda t, i: F.when(mixed & (F.col(f"{t}.n") >= LARGE), F.col(f"{t}.small")[i]).otherwise(F.col(f"{t}.s{i}"))
    apart = sum((F.bit_count(word(x, i).bitwiseXOR(word(y, i))) for i in range(SKETCH_WORDS)), F.lit(0))
    most = F.when(F.least(a, b) >= LARGE, _limit(a, b, LARGE_BINS)).otherwise(_limit(a, b, SMALL_BINS))
    return (100 * F.least(a, b) >= LINK_PERCENT * F.greatest(a, b)) & (apart <= most)


def _confirm(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose sketches allow the threshold and whose full sets reach it.

    ``known`` holds the classes' marks, sizes, sketches and texts, by ``rep``. A class that is ``b`` of many
    pairs is copied to as many tasks as its pairs need.
    """
    parts = stash(pairs.groupBy("b").agg(F.ceil(F.count("*") / PIVOT_PAIRS).cast("int").alias("parts")), "parts")
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    hosts = known.join(parts, F.col("rep") == F.col("b")).drop("b").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    x, y = known.alias("x"), hosts.alias("y")
    both = dealt.join(x, F.col("a") == F.col("x.rep")).join(y, (F.col("b") == F.col("y.rep")) & (F.col("part") == F.col("y.at")) & _may_link("x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in sliced(batches):
            linked = []
            for a, b, s, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if len(sets) > 256:
                    sets.clear()
                p, q = (sets[k] if k in sets else sets.setdefault(k, shingles(text)) for k, text in ((a, s), (b, t)))
                common = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * common >= LINK_PERCENT * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "x.text", F.col("y.text").alias("other")).mapInArrow(run, "a long, b long")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Members of buckets (``band``, ``rep`` ...) once for each two blocks of their bucket, ``lo`` and ``hi``; ``own`` is the member's block."""
    blocks = rows.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = rows.join(stash(blocks, "blocks"), "band").withColumn("own", own)
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")


def classes_and_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with ``__id``, digest, ``n_shingles``, ``fp``; classes with ``fp``, ``rep``, and the ``id`` and digest
    of their least row; components of linked reps)."""
    signed = stash(signatures(docs, key, text).withColumn("mark", F.monotonically_increasing_id()), "signatures")
    # one row for each class: that of its least id
    least = F.min(F.struct("__id", DIGEST, "mark", "n_shingles", "bands", *SKETCH, "small")).alias("r")
    classes = signed.where("fp is not null and __id is not null").groupBy("fp").agg(least)
    classes = stash(classes.select("fp", F.col("r.mark").alias("rep"), F.col("r.__id").alias("id"), f"r.{DIGEST}", F.col("r.n_shingles").alias("n"), "r.bands", *(f"r.{s}" for s in SKETCH), "r.small"), "classes")
    pairs_of = classes.select("rep", F.explode("bands").alias("band"))

    # Buckets of two classes or more; how many others a class meets in them; the pivot is who meets most.
    shared = pairs_of.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    members = stash(pairs_of.join(stash(shared.where("lo < hi").select("band", "size"), "buckets"), "band"), "members")
    popular = stash(members.groupBy("rep").agg(F.sum("size").alias("met")), "popular")
    most = members.join(popular, "rep").groupBy("band").agg(F.max(F.struct("met", (-F.col("rep")).alias("k"))).alias("top"))
    members = stash(members.select("band", "rep").join(stash(most.select("band", (-F.col("top.k")).alias("pivot")), "pivots"), "band"), "pivoted")

    met = popular.select("rep")
    sketches = stash(classes.select("rep", "id", DIGEST, "n", "bands", *SKETCH, "small").join(met, "rep", "left_semi"), "sketches")
    bodies = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias(DIGEST), F.col(text).alias("text")).where("id is not null")
    known = stash(bodies.join(sketches.drop("bands"), ["id", DIGEST]).drop("id", DIGEST).dropDuplicates(["rep"]), "known")
    tried = stash(members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "tried")
    starred = stash(_confirm(tried, known), "star-links")
    found = stash(components(starred), "star-components")
    done = signed.select("__id", DIGEST, "n_shingles", "fp"), classes.select("fp", "rep", "id", DIGEST)

    # Buckets with classes of several components left: every pair across components that the sketches allow.
    # Pairs with the bucket's pivot have been tried; a pair of several buckets counts in one of them.
    placed = members.join(found, members["rep"] == found["node"], "left").select("band", "rep", "pivot", F.coalesce("root", "rep").alias("root"))
    placed = stash(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    left = placed.where("rep <> pivot").join(stash(mixed, "mixed"), "band", "left_semi").select("band", "rep", "root")
    left = stash(_in_blocks(left).join(sketches.drop("id", DIGEST), "rep"), "open")
    x, y = left.alias("x"), left.alias("y")
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & ((F.col("x.lo") == F.col("x.hi")) | (F.col("x.own") != F.col("y.own")))
    crossing = x.join(y, meet & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y") & once)
    crossing = stash(crossing.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")), "crossing")
    more = stash(_confirm(crossing, known), "cross-links")
    if more.isEmpty():
        return *done, found
    # each star component stands for its members
    ends = more.join(found.alias("p"), F.col("a") == F.col("p.node"), "left").join(found.alias("q"), F.col("b") == F.col("q.node"), "left")
    over = ends.select(F.coalesce("p.root", "a").alias("a"), F.coalesce("q.root", "b").alias("b")).distinct()
    merged = stash(components(over), "components")
    inner = found.join(merged.withColumnsRenamed({"node": "part", "root": "whole"}), F.col("root") == F.col("part"), "left")
    inner = inner.select("node", F.coalesce("whole", "root").alias("root"))
    return *done, inner.unionByName(merged).distinct()


def _components(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents as above; classes with ``component`` and ``keeper``: the id and digest of the component's least row)."""
    signed, classes, linked = classes_and_links(docs, key, text)
    placed = stash(classes.join(linked, classes["rep"] == linked["node"], "left").select("fp", "id", DIGEST, F.coalesce("root", "rep").alias("root")), "placed-classes")
    least = placed.groupBy("root").agg(F.min(F.struct("id", DIGEST)).alias("keeper"))
    return signed, stash(placed.join(least, "root").select("fp", "keeper"), "roots")


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ``n_shingles``, ``component_id`` and ``kept``."""
    signed, roots = _components(docs, key, text)
    component = F.when(F.col("__id").isNull(), None).otherwise(F.coalesce("keeper.id", "__id"))
    placed = signed.join(roots, "fp", "left").select(F.col("__id").alias(key), "n_shingles", component.alias("component_id"))
    return placed.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row for each component, that of the least key; rows without a key or without words stay."""
    signed, roots = _components(docs, key, text)
    keepers = roots.select(F.col("keeper.id").alias("__id"), F.col(f"keeper.{DIGEST}").alias(DIGEST)).distinct()
    counted = stash(signed.where("fp is not null").groupBy("__id", DIGEST).agg(F.count("*").alias("__n")).join(keepers, ["__id", DIGEST], "left_semi"), "keepers")
    alone = F.col(key).isNull() | ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rest = docs.where(~alone)
    on = lambda kept: (rest[key] == kept["__id"]) & (F.xxhash64(rest[text]) == kept[DIGEST])
    single, repeated = counted.where("__n = 1"), counted.where("__n > 1")
    out = docs.where(alone).unionByName(rest.join(single, on(single), "left_semi"))
    if not repeated.isEmpty():
        # a keeper that is there several times, row for row, is shuffled by itself
        out = out.unionByName(rest.join(repeated, on(repeated), "left_semi").dropDuplicates([key, text]))
    return out
