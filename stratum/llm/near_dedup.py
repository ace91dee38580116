"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

1. Each whole text becomes its set of 5-word shingles (64-bit hashes), K MinHash samples, and an odd sketch: a bitmap in
   which each sample flips one bit. Texts with equal sets are one class from here on.
2. Samples are hashed in bands of ROWS; classes with an equal band are a bucket. At a similarity of 0.75 all BANDS bands
   miss with a probability of 5e-6.
3. In a bucket, the bits in which two sketches differ estimate the similarity. Of the pairs that may reach 0.75 (the
   bound is five standard deviations wide), the spanning forest of the closest is taken. A bucket of many classes is cut
   in blocks, and pairs of blocks are tasks; no pair is given that the sketches rule out.
4. Pairs are confirmed on full sets: the texts of a pair meet, those of a class with many pairs in salted groups.
5. Confirmed links give components. Components that still meet in a bucket make a family; all pairs of a family between
   different components that the sketches allow are confirmed too, in pairs of blocks that texts are sent to and links
   alone leave, so that no link between different components remains untested.

Defined results: a text without words has an empty set and is linked with nothing; a text of fewer than 5 words is one
shingle; rows of one doc_id are one document; a row without doc_id stands alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Substrings, buffers, mixed, quoted, slices, small_side, staged, tidy, word_bounds

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
BANDS, ROWS = 32, 4
K = BANDS * ROWS
BITS = 512
#: Sketches that differ in more bits are of less similar sets: 56.6 bits are expected at 0.75, with a deviation of 8.6.
MOST_BITS = 100
BLOCK = 512
#: Pairs of one class that are confirmed in one group.
GROUP = 256
BATCH_BYTES = 1 << 20

_RANDOM = np.random.default_rng(97)
_A = _RANDOM.integers(1, 1 << 32, K, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, K, dtype=np.uint64).astype(np.uint32)
_PLACE = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    data = _LOWER[data]
    first, last = word_bounds(data, off)
    words = Substrings(data).of(first, last)
    bounds = np.searchsorted(first, off)
    counts = np.diff(bounds)
    grams = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE if len(grams) else 0):
        grams += words[k : k + len(grams)] * _PLACE[k]
    grams = mixed(grams)
    out = []
    for start, n in zip(bounds[:-1], counts):
        if n >= SHINGLE:
            out.append(np.unique(grams[start : start + n - SHINGLE + 1]))
        elif n:
            whole = (words[start : start + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mixed(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def samples(hashes: np.ndarray) -> np.ndarray:
    """K MinHash samples of a set that isn't empty."""
    low = np.full(K, 0xFFFFFFFF, np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 512):
        np.minimum(low, (h[i : i + 512, None] * _A + _B).min(0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    parts = low.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mixed(key + parts[:, :, k] * _PLACE[k])
    return key.astype(np.int64)


def odd_sketches(low: np.ndarray) -> np.ndarray:
    """Bitmaps (BITS / 8 bytes a row): the parity of how many samples fall on each bit."""
    n = len(low)
    bit = mixed(low.astype(np.uint64) + np.arange(K, dtype=np.uint64) * np.uint64(1 << 32)) % np.uint64(BITS)
    flat = (bit + np.arange(n, dtype=np.uint64)[:, None] * np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(flat.ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def estimate(differing: int) -> float:
    """The similarity that a number of differing sketch bits speaks for."""
    share = min(2 * differing / BITS, 1 - 1e-9)
    return 1 + BITS / (4 * K) * float(np.log(1 - share))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b.column("text"))
        for i, j in slices(off, BATCH_BYTES):
            sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
            low = np.stack([samples(s) if len(s) else np.zeros(K, np.uint32) for s in sets])
            keys, sketches = bands(low), odd_sketches(low)
            yield pa.record_batch([
                b.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array(list(keys), pa.list_(pa.int64())), pa.array([s.tobytes() for s in sketches], pa.binary()),
            ], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])


def _differing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ many).sum(1, dtype=np.int64)


def _forest(sketches: np.ndarray) -> list[tuple[int, int]]:
    """Prim's spanning forest over the pairs of sketches that differ little."""
    n = len(sketches)
    best, link = np.full(n, BITS + 1), np.zeros(n, int)
    left, out, at = np.ones(n, bool), [], 0
    for _ in range(n - 1):
        left[at] = False
        d = _differing(sketches[at], sketches)
        closer = left & (d < best)
        best[closer], link[closer] = d[closer], at
        at = int(np.argmin(np.where(left, best, BITS + 2)))
        if best[at] <= MOST_BITS:
            out.append((int(link[at]), at))
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket (or of two of its blocks) follow each other; the pairs of its forest."""
    held: dict[str, np.ndarray] | None = None

    def pairs(rows: dict[str, np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        ids = rows["id"]
        for p, q in zip(bounds[:-1], bounds[1:]):
            if q - p > 1:
                for i, j in _forest(rows["sketch"][p:q]):
                    left.append(min(ids[p + i], ids[p + j]))
                    right.append(max(ids[p + i], ids[p + j]))
        return pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        rows = {c: batch.column(c).to_numpy() for c in ("key", "one", "two", "id")}
        rows["sketch"] = _sketch_array(batch.column("sketch"))
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        new = np.flatnonzero((np.diff(rows["key"]) != 0) | (np.diff(rows["one"]) != 0) | (np.diff(rows["two"]) != 0)) + 1
        if len(new):
            yield pairs(rows, np.concatenate([[0], new]))
            rows = {c: v[new[-1] :] for c, v in rows.items()}
        held = rows
    if held is not None:
        yield pairs(held, np.array([0, len(held["id"])]))


def _sketch_array(column: pa.Array) -> np.ndarray:
    return buffers(column)[0].reshape(len(column), BITS // 8).view(np.uint64)


def _in_blocks(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """rows (id, n: members of the key) for each pair of blocks of BLOCK members that a row is in: key, one, two, block, id, columns."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return own.select(key, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", *columns)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "one", "two").sortWithinPartitions(key, "one", "two", "id")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if DENOMINATOR * min(len(a), len(b)) < NUMERATOR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _links_of(rows: list[tuple]) -> list[tuple[int, int]]:
    """Links between different components of rows (block, id, component, sketch, set), until those are one."""
    blocks, ids, component = (np.array([r[i] for r in rows]) for i in range(3))
    sketches, sets = np.stack([r[3] for r in rows]), [r[4] for r in rows]
    two = len(np.unique(blocks)) > 1
    out = []
    for i in range(len(rows) - 1):
        near = _differing(sketches[i], sketches[i + 1 :]) <= MOST_BITS
        if two:
            near &= blocks[i + 1 :] != blocks[i]
        for j in np.flatnonzero(near) + i + 1:
            if component[j] != component[i] and _similar(sets[i], sets[j]):
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                component[component == component[j]] = component[i]
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, held = None, []
    give = lambda links: pa.record_batch([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], names=["a", "b"])
    for b in batches:
        data, off = buffers(b.column("text"))
        columns = [b.column(c).to_numpy() for c in ("root", "one", "two", "block", "id", "component")]
        sketches = _sketch_array(b.column("sketch"))
        for i, j in slices(off, BATCH_BYTES):
            for k, own in zip(range(i, j), shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])):
                at = tuple(c[k] for c in columns[:3])
                if at != group:
                    if len(held) > 1:
                        yield give(_links_of(held))
                    group, held = at, []
                held.append((*(c[k] for c in columns[3:]), sketches[k], own))
    if len(held) > 1:
        yield give(_links_of(held))


def _across(mixed_up: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components that share a bucket (mixed_up: key, id, component, sketch; staged).

    Components that meet in buckets make a family. Each text goes once to each pair of blocks of its family that it is in,
    where pairs that the sketches allow are confirmed on full sets; what leaves the task is links only.
    """
    met = mixed_up.join(mixed_up.groupBy("key").agg(F.min("component").alias("low")), "key").select(F.col("component").alias("a"), F.col("low").alias("b")).distinct()
    families = components(met)
    members = mixed_up.select("id", "component", "sketch").dropDuplicates(["id"]).join(families, F.col("component") == F.col("node"), "left").withColumn("root", F.coalesce("root", "component"))
    sizes = members.groupBy(F.col("root").alias("of")).agg(F.count("*").alias("n"))
    placed = staged(_in_blocks(members.join(sizes, F.col("root") == F.col("of")), "root", "component", "sketch"), "near-families")
    texts = docs.join(small_side(placed, 48 + BITS // 8), docs["doc_id"] == F.col("id")).select("root", "one", "two", "block", "id", "component", "sketch", "text")
    return staged(_dealt(texts, "root").mapInArrow(tidy(_linked), "a long, b long").distinct(), "near-across")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    center, sets = None, []
    for b in batches:
        data, off = buffers(b.column("text"))
        centers, salts, member, ids = (b.column(c).to_numpy() for c in ("center", "salt", "member", "doc_id"))
        for i, j in slices(off, BATCH_BYTES):
            links = []
            for k, own in zip(range(i, j), shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])):
                if (centers[k], salts[k]) != center:
                    center, sets = (centers[k], salts[k]), []
                if not member[k]:
                    sets.append(own)
                    continue
                if any(_similar(own, other) for other in sets):
                    links.append((centers[k], ids[k]))
            yield pa.record_batch([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], names=["a", "b"])


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (staged; a, b) whose full sets are similar enough; staged."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "groups").cast("int"))
    members = salted.select(F.col("b").alias("id"), F.col("a").alias("center"), "salt", F.lit(1).alias("member"))
    centers = many.select(F.col("a").alias("id"), F.col("a").alias("center"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("member"))
    wanted = small_side(staged(members.unionByName(centers), "near-wanted"), 24)
    texts = docs.select("doc_id", "text").join(wanted, docs["doc_id"] == F.col("id")).select("center", "salt", "member", "doc_id", "text")
    ordered = texts.repartition("center", "salt").sortWithinPartitions("center", "salt", "member")
    return staged(ordered.mapInArrow(tidy(_confirmed), "a long, b long").distinct(), "near-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    docs = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"))
    signed = staged(docs.mapInArrow(tidy(_signed), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"), "near-signed")
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(some.groupBy("digest").agg(F.min("doc_id").alias("id")), "near-classes")
    firsts = some.join(classes.select(F.col("id"), F.col("digest").alias("d")), (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("d"))).select("id", "bands", "sketch")
    members = firsts.select("id", F.explode("bands").alias("key")).withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    buckets = staged(members.join(firsts.select("id", "sketch"), "id"), "near-buckets")
    pairs = staged(_dealt(_in_blocks(buckets, "key", "sketch"), "key").mapInArrow(tidy(_pairs), "a long, b long").distinct(), "near-pairs")
    links = confirm(pairs, docs)
    found = components(links)
    rooted = lambda rows: rows.join(found, rows["id"] == found["node"], "left").withColumn("component", F.coalesce("root", "id")).drop("node", "root")
    whole = Window.partitionBy("key")
    mixed_up = rooted(buckets).withColumn("low", F.min("component").over(whole)).withColumn("high", F.max("component").over(whole)).filter("low <> high").drop("low", "high", "n")
    mixed_up = staged(mixed_up, "near-mixed")
    if not mixed_up.isEmpty():
        found = components(links.unionByName(_across(mixed_up, docs)))
    by_class = rooted(classes).select("digest", F.col("component").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(by_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without those that aren't the first of their group."""
    gone = staged(near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "near-gone")
    return docs.join(small_side(gone, 8), docs["doc_id"] == gone["gone"], "left_anti")
