"""An exact join of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more.

1. Each whole text becomes its set of shingles (64-bit hashes, sorted). Texts with equal sets are one class from here on.
2. Candidates. Two sets of at most n shingles that link differ in 2n/19 of them at most. Classes whose sizes fall in one
   band cut the range of hashes in the same number of parts, of which there are more than may differ: linked sets have an
   equal part. A class whose partners may be of the next band is cut by that too. Parts meet by their hash; those
   that stand alone go.
3. In each bucket of equal parts the class of the least id is the hub. A pair of hub and member goes on if the bits that
   one bitmap signature has and the other hasn't leave room for the overlap that a link needs; it is checked on full sets.
4. Linked classes are components. Where a bucket still holds several components, its classes meet in tiles: blocks of
   classes of one size band, cut by bytes, against each other and against blocks of the next band. In a tile, bitmaps bound
   each overlap from above, and what passes is intersected as sorted arrays, unless the two are one component by then. Only
   links leave a tile.

Bitmaps never rule out a pair that links: a bit that only one has stands for a shingle that only one has. Nothing is drawn
by chance, so that no link is missed.

Defined results: a text without words has an empty set and is linked with nothing; a text of fewer than 3 words is one
shingle; rows of one doc_id are one document, which has the links of all its texts; a row without doc_id stands alone; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Substrings, buffers, mixed, quoted, slices, small_side, staged, tidy, word_bounds

SHINGLE, NUMERATOR, DENOMINATOR = 3, 90, 100
#: A band's number of parts is some power of GROWTH; a tenth more parts than may differ leaves room for empty ones.
GROWTH, ROOM = 1.5, 1.1
#: Bits of a signature for each shingle, before rounding up to a power of two.
BITS_EACH = 2
#: Shingles of a block of a tile, about: 4 MB.
BLOCK_SHINGLES = 1 << 19
#: Members that are checked against one hub in one group.
GROUP = 256
BATCH_BYTES = 1 << 20
#: Sizes of linked sets differ by less than the width of a band.
BAND = -log(NUMERATOR / DENOMINATOR - 0.01)

_RANDOM = np.random.default_rng(311)
_PLACE = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    data = _LOWER[data]
    first, last = word_bounds(data, off)
    words = Substrings(data).of(first, last)
    bounds = np.searchsorted(first, off)
    grams = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE if len(grams) else 0):
        grams += words[k : k + len(grams)] * _PLACE[k]
    grams = mixed(grams)
    out = []
    for start, n in zip(bounds[:-1], np.diff(bounds)):
        if n >= SHINGLE:
            out.append(np.unique(grams[start : start + n - SHINGLE + 1]))
        else:
            whole = (words[start : start + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
            out.append(mixed(np.array([whole] if n else [], np.uint64)))
    return out


def most_differing(n: int) -> int:
    """In how many shingles two linked sets of at most n may differ: i / (a + b - i) is N / D where i is N (a + b) / (N + D)."""
    return 2 * n * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


@cache
def _edges(parts: int) -> np.ndarray:
    """Where parts of the range of hashes end, but for the last."""
    return np.array([(1 << 64) * p // parts for p in range(1, parts)], np.uint64)


def parts_of(n: int) -> int:
    """How many parts sets are cut in for pairs whose larger set has n shingles; 0 if linked sets are equal."""
    wanted = most_differing(n)
    if not wanted:
        return 0
    parts = 2.0
    while round(parts) < ROOM * (wanted + 1):
        parts *= GROWTH
    return round(parts)


def part_keys(own: np.ndarray, sums: np.ndarray, parts: int) -> np.ndarray:
    """The key of each part of a sorted set. sums: n + 1 prefix sums of its hashes, mixed once more.

    Empty parts have keys only where there are more of them than parts to spare: else some other part is equal as well.
    """
    at = np.concatenate([[0], np.searchsorted(own, _edges(parts)), [len(own)]])
    which = np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(parts << 40)
    keys = mixed(sums[at[1:]] - sums[at[:-1]] + which)
    empty = at[1:] == at[:-1]
    return keys if empty.sum() > parts - int(parts / ROOM) else keys[~empty]


def keys_of(own: np.ndarray) -> np.ndarray:
    n = len(own)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    schemes = {parts_of(n), parts_of(DENOMINATOR * n // NUMERATOR)} - {0}
    return np.concatenate([part_keys(own, sums, p) for p in sorted(schemes)] or [np.zeros(0, np.uint64)]).view(np.int64)


def bitmap(own: np.ndarray) -> np.ndarray:
    """A signature of a power of two of bits (words of 64, by the set's size): each shingle sets one."""
    words = 1 << max(0, (BITS_EACH * max(1, len(own)) - 1).bit_length() - 6)
    bits = np.zeros(words * 64, np.uint8)
    bits[(own & np.uint64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def folded(signature: np.ndarray, words: int) -> np.ndarray:
    """The signature that a set has with fewer words: bits fall together."""
    return np.bitwise_or.reduce(signature.reshape(-1, words), axis=0)


def may_link(n: int, m: np.ndarray | int, one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Whether bit counts leave room for a link between a set of n shingles and signature one and sets of m and many."""
    lacking = np.bitwise_count(one & ~many).sum(-1, dtype=np.int64)
    over = np.bitwise_count(many & ~one).sum(-1, dtype=np.int64)
    return _enough(np.minimum(n - lacking, m - over), n + m)


def _enough(both: np.ndarray | int, together: np.ndarray | int) -> np.ndarray | bool:
    return (DENOMINATOR + NUMERATOR) * both >= NUMERATOR * together


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if DENOMINATOR * min(len(a), len(b)) < NUMERATOR * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return bool(len(a) and _enough(both, len(a) + len(b)))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b.column("text"))
        for i, j in slices(off, BATCH_BYTES):
            sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.record_batch([
                b.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([keys_of(s) for s in sets], pa.list_(pa.int64())), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
            ], names=["doc_id", "n_shingles", "digest", "keys", "signature"])


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of key and id: those that aren't their key's first id, with that as hub."""
    key, hub = None, 0
    for b in batches:
        if not len(b):
            continue
        keys, ids = b.column("key").to_numpy(), b.column("id").to_numpy()
        new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        hubs = np.where(at >= 0, ids[at], hub)
        key, hub = int(keys[-1]), int(hubs[-1])
        some = ids != hubs
        yield pa.record_batch([pa.array(keys[some]), pa.array(ids[some]), pa.array(hubs[some])], names=["key", "id", "hub"])


def _signature(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint64)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures leave room for a link."""
    for b in batches:
        sizes = [b.column(c).to_numpy() for c in ("n", "m")]
        keep = []
        for n, m, one, two in zip(*sizes, b.column("one").to_pylist(), b.column("two").to_pylist()):
            one, two = _signature(one), _signature(two)
            words = min(len(one), len(two))
            fits = DENOMINATOR * min(n, m) >= NUMERATOR * max(n, m)
            keep.append(bool(fits and may_link(n, m, folded(one, words), folded(two, words))))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a hub and its members, the hub's texts first: the links among them."""
    center, sets = None, []
    for b in batches:
        data, off = buffers(b.column("text"))
        hubs, salts, member, ids = (b.column(c).to_numpy() for c in ("hub", "salt", "member", "id"))
        for i, j in slices(off, BATCH_BYTES):
            links = []
            for k, own in zip(range(i, j), shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])):
                if (hubs[k], salts[k]) != center:
                    center, sets = (hubs[k], salts[k]), []
                if not member[k]:
                    sets.append(own)
                elif any(linked(own, other) for other in sets):
                    links.append((hubs[k], ids[k]))
            yield _pairs(links)


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[s] for x in links], pa.int64()) for s in (0, 1)], names=["a", "b"])


def _tile(rows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between unlike components of rows (side, id, component, set): of both sides, or of all if there is one side."""
    side, ids, component = (np.array([r[i] for r in rows]) for i in range(3))
    sets = [r[3] for r in rows]
    sizes = np.array([len(s) for s in sets])
    maps = [bitmap(s) for s in sets]
    words = min(len(m) for m in maps)
    maps = np.stack([folded(m, words) for m in maps])
    two = side[0] != side[-1]
    first_of_two = int(np.searchsorted(side, 1)) if two else 0
    out = []
    for i in range(first_of_two if two else len(rows) - 1):
        start = first_of_two if two else i + 1
        at = start + np.flatnonzero((component[start:] != component[i]) & (DENOMINATOR * np.minimum(sizes[start:], sizes[i]) >= NUMERATOR * np.maximum(sizes[start:], sizes[i])))
        at = at[may_link(sizes[i], sizes[at], maps[i], maps[at])]
        for j in at:
            if component[j] != component[i] and linked(sets[i], sets[j]):
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                component[component == component[j]] = component[i]
    return out


TILE = ["root", "band", "kind", "one", "two"]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a tile follow each other, one side after the other."""
    tile, held = None, []
    for b in batches:
        data, off = buffers(b.column("text"))
        keys, columns = [b.column(c).to_numpy() for c in TILE], [b.column(c).to_numpy() for c in ("side", "id", "component")]
        for i, j in slices(off, BATCH_BYTES):
            for k, own in zip(range(i, j), shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])):
                at = tuple(c[k] for c in keys)
                if at != tile:
                    if len(held) > 1:
                        yield _pairs(_tile(held))
                    tile, held = at, []
                held.append((*(c[k] for c in columns), own))
    if len(held) > 1:
        yield _pairs(_tile(held))


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (staged; a: hubs, b) that link; staged. A hub of many members is checked in salted groups."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    members = pairs.join(many, "a").select(F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "groups").cast("int").alias("salt"), F.lit(1).alias("member"))
    hubs = many.select(F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("member"))
    wanted = small_side(staged(members.unionByName(hubs), "ngram-wanted"), 24)
    texts = docs.join(wanted, F.col("doc_id") == F.col("id")).select("hub", "salt", "member", "id", "text")
    ordered = texts.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return staged(ordered.mapInArrow(tidy(_checked), "a long, b long").distinct(), "ngram-links")


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(shingles / BLOCK_SHINGLES, rows / 4096)).cast("int")


def _placed(members: DataFrame) -> DataFrame:
    """members (root, id, component, n) in each tile that they are in: also TILE and side."""
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / BAND).cast("int"))
    sizes = members.groupBy("root", "band").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    near = lambda step, name: sizes.select(F.col("root").alias("r" + name), (F.col("band") - step).alias("b" + name), F.col("blocks").alias(name))
    for step, name in ((0, "own"), (1, "above"), (-1, "below")):
        members = members.join(near(step, name), (F.col("root") == F.col("r" + name)) & (F.col("band") == F.col("b" + name)), "left").drop("r" + name, "b" + name)
    block = F.pmod(F.xxhash64("id"), F.col("own")).cast("int")
    upto = lambda n: F.when(F.col(n).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda band, kind, one, two, side: F.struct(F.expr(band).alias("band"), F.lit(kind).alias("kind"), one.alias("one"), two.alias("two"), side.cast("int").alias("side"))
    own = F.transform(upto("own"), lambda o: place("band", 0, F.least("block", o), F.greatest("block", o), F.col("block") > o))
    above = F.transform(upto("above"), lambda o: place("band", 1, F.col("block"), o, F.lit(0)))
    below = F.transform(upto("below"), lambda o: place("band - 1", 1, o, F.col("block"), F.lit(1)))
    return members.withColumn("block", block).select("root", "id", "component", F.inline(F.concat(own, above, below)))


def _across(starred: DataFrame, docs: DataFrame, sizes: DataFrame, component: DataFrame) -> DataFrame | None:
    """Links between unlike components that share a bucket of starred (staged), or None; staged."""
    known = lambda df, id: df.join(component.select(F.col("node").alias("of"), F.col("root").alias("to")), F.col(id) == F.col("of"), "left").withColumn(f"{id}_in", F.coalesce("to", id)).drop("of", "to")
    inside = staged(known(known(starred, "id"), "hub"), "ngram-inside")
    meets = inside.filter("id_in <> hub_in")
    if meets.isEmpty():
        return None
    mixed_keys = small_side(staged(meets.select(F.col("key").alias("mixed")).distinct(), "ngram-keys"), 8)
    rows = staged(inside.join(mixed_keys, F.col("key") == F.col("mixed"), "left_semi"), "ngram-mixed")
    families = components(meets.select(F.col("id_in").alias("a"), F.col("hub_in").alias("b")).distinct())
    members = rows.select("id", F.col("id_in").alias("component")).unionByName(rows.select(F.col("hub").alias("id"), F.col("hub_in").alias("component"))).distinct()
    members = members.join(families, F.col("component") == F.col("node"), "left").withColumn("root", F.coalesce("root", "component")).drop("node")
    sized = members.join(sizes.select(F.col("id").alias("of"), "n"), F.col("id") == F.col("of")).groupBy("root", "id", "component").agg(F.max("n").alias("n"))
    placed = small_side(staged(_placed(sized), "ngram-placed"), 48)
    texts = docs.join(placed, F.col("doc_id") == F.col("id")).select(*TILE, "side", "id", "component", "text")
    ordered = texts.repartition(*TILE).sortWithinPartitions(*TILE, "side", "id")
    return staged(ordered.mapInArrow(tidy(_tiles), "a long, b long").distinct(), "ngram-across")


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    docs = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"))
    signed = staged(docs.mapInArrow(tidy(_signed), "doc_id long, n_shingles long, digest binary, keys array<long>, signature binary"), "ngram-signed")
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(some.groupBy("digest").agg(F.min("doc_id").alias("id")), "ngram-classes")
    own = small_side(classes.select("id", F.col("digest").alias("d")), 24)
    firsts = some.join(own, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("d"))).select("id", F.col("n_shingles").alias("n"), "keys", "signature").filter("size(keys) > 0")
    keyed = firsts.select("id", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key", "id")
    starred = staged(keyed.mapInArrow(tidy(_starred), "key long, id long, hub long"), "ngram-buckets")
    signatures = firsts.select("id", "n", "signature")
    pairs = starred.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(signatures.select(F.col("id").alias("a"), "n", F.col("signature").alias("one")), "a").join(signatures.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("signature").alias("two")), "b")
    bounded = staged(pairs.select("a", "b", "n", "m", "one", "two").mapInArrow(tidy(_bounded), "a long, b long").distinct(), "ngram-pairs")
    links = _confirmed(bounded, docs)
    # a document of several texts is in the class of each
    unlike = some.groupBy(F.col("doc_id").alias("of")).agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high")
    several = some.join(unlike, F.col("doc_id") == F.col("of"), "left_semi").join(own, F.col("digest") == F.col("d"))
    links = links.unionByName(several.select(F.least("doc_id", "id").alias("a"), F.greatest("doc_id", "id").alias("b")).filter("a <> b").distinct())
    links = staged(links, "ngram-found")
    found = components(links)
    more = _across(starred, docs, firsts.select("id", "n"), found)
    if more is not None and not more.isEmpty():
        found = components(links.unionByName(more))
    rooted = classes.join(found, F.col("id") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("root", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    out = out.join(small_side(staged(rooted, "ngram-rooted"), 24), F.col("digest") == F.col("d"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
