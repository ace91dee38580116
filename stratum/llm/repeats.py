"""Repeated passages: every byte that a 50-byte string of an earlier document covers is removed, exactly.

The method is a run-compressed Burrows-Wheeler index with sampled run ends, through which texts stream for their matching
statistics (run_index); long matches in earlier documents are marked. One index over all texts would meet in one task, so
the texts are dealt by content first, and only what can repeat is indexed:

1. Anchors. Of every 50 bytes, the 19 bytes with the least hash are an anchor, so that equal strings of 50 bytes hold equal
   anchors at equal places; that is one position in 16. Hashes meet by range, and those that stand twice are flagged.
2. Contexts. Around each flagged anchor, the 31 bytes before and after hold all 32 strings of 50 bytes that the anchor
   stands for. Contexts are dealt by anchor, so that all occurrences of a string that repeats meet in one part.
3. Index. In a part, equal contexts are one string, of the smallest doc_id that has it. Strings whose anchor has others are
   indexed in blocks of whole anchors, and stream through the index of their block: where a match is 50 bytes long or
   longer, the run tells the smallest doc_id of those 50 bytes, and if that is smaller than the string's own, they are marked.
4. Marks of a document, 32 bits for each anchor, become byte ranges.

Hot keys. Before a shuffle each task drops what it can settle itself: anchors it has seen before are flagged at once and go
once; equal contexts are classed and go once. An anchor that stands HOT times or more (the end of a very frequent line has
another context in nearly every document) isn't dealt by itself: its context is cut into eight of 53 bytes, for four
places each, and these are dealt by the 47 bytes that their four strings share, so that unlike continuations part. The list
of hot anchors is bounded: at most one for HOT anchors of text, and HOT grows so that they are MOST_HOT at most.

Defined results: a null text is empty; a text below 50 bytes loses nothing; equal rows of one doc_id lose the same; unlike
rows of one doc_id are documents with one id, each with marks of its own, and take nothing from each other; a row without
doc_id loses nothing and takes nothing from others; other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .run_index import RunIndex
from .shared import _BASE, _VALUE, Substrings, boxed, buffers, mixed, quoted, slices, small_side, staged, tidy, tidy_group, unboxed

SPAN, GRAM = 50, 19
#: Places of an anchor in a string, and the bytes on each side of one in a context.
PLACES = SPAN - GRAM + 1
SIDE = PLACES - 1
WIDTH = GRAM + 2 * SIDE
#: Bytes that arrays are made of at once; text of which a task settles what it can before it sends; text for each part of the hashes.
BATCH_BYTES, CHUNK_BYTES, PART_BYTES = 1 << 19, 4 << 20, 6 << 20
HASH_BYTES = 5
ROWS = 1 << 14
#: Strings of an index, about: a block takes whole anchors.
INDEXED = 1 << 12
#: Occurrences from which an anchor is hot, hot anchors at most, places of a hot anchor's contexts, and what stands for no such narrowing.
HOT, MOST_HOT, FEW, WIDE = 1 << 15, 1 << 18, 4, 255

_COLUMN_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(WIDTH)], np.uint64)
_TO_FRONT = np.array([pow(_BASE, -i, 1 << 64) for i in range(WIDTH)], np.uint64)
_BITS = np.uint32(1) << np.arange(PLACES, dtype=np.uint32)
_BLOB = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary()), ("raw", pa.binary())])
_BLOB_DDL = "part int, kind int, packed binary, raw binary"
#: Columns of packed numbers: of an anchor (doc_id, which of its unlike rows, place, occurrences in the chunk), and of a context (also its first place and its bits).
_ANCHOR, _CONTEXT = (np.int64, np.int64, np.uint32, np.uint32), (np.int64, np.int64, np.uint32, np.uint8, np.uint32)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, by differences, compressed."""
    parts = [np.diff(c, prepend=c.dtype.type(0)).tobytes() for c in columns]
    return len(columns[0]).to_bytes(8, "little") + zlib.compress(b"".join(parts), 1)


def unpack(blob: bytes | pa.Buffer, *kinds: type) -> list[np.ndarray]:
    view = memoryview(blob)
    n, data, at, out = int.from_bytes(view[:8], "little"), zlib.decompress(view[8:]), 0, []
    for kind in kinds:
        out.append(np.cumsum(np.frombuffer(data, kind, n, at), dtype=kind))
        at += n * np.dtype(kind).itemsize
    return out


def _cells(table: pa.Table, name: str, kind: int | None = None) -> Iterator[pa.Buffer]:
    """A binary column's values (of the rows of a kind), where they stand."""
    kinds = table.column("kind").to_numpy() if kind is not None else np.zeros(len(table))
    values = (v for chunk in table.column(name).chunks for v in chunk)
    return (v.as_buffer() for v, k in zip(values, kinds) if kind is None or k == kind)


def _joined(blobs: Iterator[pa.Buffer], *kinds: type) -> list[np.ndarray]:
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def _sliding(a: np.ndarray, best: np.ufunc) -> np.ndarray:
    """best over PLACES (a power of two) neighbours."""
    step = 1
    while step < PLACES:
        a = best(a[:-step], a[step:])
        step *= 2
    return a


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all texts in a buffer; one text may be of any length."""
    if len(data) > 2 * BATCH_BYTES and len(off) == 2:
        parts = [(i, anchors(d := data[i : i + BATCH_BYTES + SPAN - 1], np.array([0, len(d)]))) for i in range(0, len(data), BATCH_BYTES)]
        at, which = np.unique(np.concatenate([p + i for i, (p, _) in parts]), return_index=True)
        return at, np.concatenate([h for _, (_, h) in parts])[which]
    if len(data) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = Substrings(data).grams(GRAM) | np.uint64(1)
    low = _sliding(h, np.minimum)
    cross = np.zeros(len(low) + 1, np.int32)
    edges = off[1:-1]
    np.add.at(cross, np.clip(edges - SPAN + 1, 0, len(low)), 1)
    np.add.at(cross, np.clip(edges, 0, len(low)), -1)
    low[np.cumsum(cross[:-1]) > 0] = 0
    edge = np.zeros(SIDE, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), np.maximum) == h)
    return at, h[at]


def _split(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with its rows in order."""
    order = np.argsort(key, kind="stable")
    bounds = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, bounds):
        if len(rows):
            yield int(key[rows[0]]), rows


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    return order, np.flatnonzero(np.append(len(s) > 0, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)


def _least(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row, the least value of the rows with its key."""
    order, starts = _groups(key)
    out = np.empty_like(value)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(value[order], starts), np.diff(np.append(starts, len(order))))
    return out


def _dest(doc: np.ndarray, which: np.ndarray, parts: int) -> np.ndarray:
    return (mixed((doc ^ which).astype(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _blobs(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOB)], schema=_BLOB)


def _dealt(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each hash, and the bytes that tell hashes of a part apart."""
    return ((h >> np.uint64(8 * HASH_BYTES)) % np.uint64(parts)).astype(np.int32), h.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]


def _sent_anchors(parts: int) -> Callable:
    def flush(doc: np.ndarray, which: np.ndarray, at: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        order, starts = _groups(h)
        sizes = np.diff(np.append(starts, len(order)))
        send, count = order[starts], sizes.astype(np.uint32)
        again = order[np.repeat(sizes > 1, sizes)]
        part, raw = _dealt(h, parts)
        rows = []
        for p, own in _split(part[send]):
            rows.append((p, 0, pack(doc[send[own]], which[send[own]], at[send[own]], count[own]), raw[send[own]].tobytes()))
        for p, own in _split(_dest(doc[again], which[again], parts)):
            rows.append((p, 1, pack(doc[again[own]], which[again[own]], at[again[own]]), b""))
        return _blobs(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            data, off = buffers(b.column("text"))
            ids, rows = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "which"))
            for i, j in slices(off, BATCH_BYTES):
                own = off[i : j + 1] - off[i]
                at, h = anchors(data[off[i] : off[j]], own)
                doc = np.searchsorted(own, at, "right") - 1
                held.append((ids[i + doc], rows[i + doc], (at - own[doc]).astype(np.uint32), h))
                size += int(off[j] - off[i])
                if size >= CHUNK_BYTES:
                    yield flush(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield flush(*map(np.concatenate, zip(*held)))

    return run


def _flagged(parts: int, hot: int) -> Callable:
    """Rows of one part -> anchors that stand twice, by document; and (dest -1) the hashes of those that stand `hot` times."""

    def run(table: pa.Table) -> pa.Table:
        doc, which, at, count = _joined(_cells(table, "packed", 0), *_ANCHOR)
        h = np.zeros((len(doc), 8), np.uint8)
        h[:, :HASH_BYTES] = np.frombuffer(b"".join(_cells(table, "raw", 0)), np.uint8).reshape(-1, HASH_BYTES)
        h = h.view(np.uint64).ravel()
        order, starts = _groups(h)
        sizes = np.diff(np.append(starts, len(order)))
        # one that stands several times in a chunk is flagged there already
        found = order[np.repeat(sizes > 1, sizes)] if len(order) else order
        often = h[order[starts]][np.add.reduceat(count[order].astype(np.int64), starts) >= hot] if len(order) else h
        known = _joined(_cells(table, "packed", 1), *_ANCHOR[:3])
        flags = _by_document(*[np.concatenate([c[found], k]) for c, k in zip((doc, which), known)], parts, np.concatenate([at[found], known[2]]))
        part = table.column("part")[0].as_py() if len(table) else 0
        listed = pa.table({"dest": pa.array([-1 - part], pa.int32()), "packed": pa.array([often.tobytes()], pa.binary())})
        return pa.concat_tables([flags, listed]) if len(often) else flags

    return run


def _by_document(doc: np.ndarray, which: np.ndarray, parts: int, *columns: np.ndarray) -> pa.Table:
    rows = []
    for part, own in _split(_dest(doc, which, parts)):
        own = own[np.lexsort((columns[0][own], which[own], doc[own]))]
        rows.append((part, pack(doc[own], which[own], *[c[own] for c in columns])))
    return pa.table({"dest": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})


def _documents(*kinds: type) -> Callable:
    """Rows of one dest -> a row for each document: doc_id, which, the places of anchors and, if there are any, their marks."""

    def run(table: pa.Table) -> pa.Table:
        doc, which, *columns = _joined(_cells(table, "packed"), np.int64, np.int64, *kinds)
        order = np.lexsort((columns[0], which, doc))
        doc, which, columns = doc[order], which[order], [c[order] for c in columns]
        change = lambda a: np.append(True, a[1:] != a[:-1])[: len(a)]
        starts = np.flatnonzero(change(doc) | change(which) | change(columns[0]))
        if len(columns) > 1 and len(starts):
            columns[1] = np.bitwise_or.reduceat(columns[1], starts)
        doc, which, columns = doc[starts], which[starts], [columns[0][starts], *columns[1:]]
        bounds = np.flatnonzero(change(doc) | change(which))
        ends = np.append(bounds[1:], len(doc))
        out = {"doc_id": pa.array(doc[bounds], pa.int64()), "which": pa.array(which[bounds], pa.int64())}
        for name, c in zip(("places", "marks"), columns):
            out[name] = pa.array([c[i:j].tobytes() for i, j in zip(bounds, ends)], pa.binary())
        return pa.table(out)

    return run


def contexts(data: np.ndarray, off: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """WIDTH symbols (a byte and one) around each anchor (zero beyond its text), and the bits of the strings that lie within the text."""
    index = at[:, None] + np.arange(-SIDE, GRAM + SIDE)
    inside = (index >= off[doc][:, None]) & (index < off[doc + 1][:, None])
    text = (data[np.clip(index, 0, len(data) - 1)] + np.uint8(1)) * inside.astype(np.uint8)
    start, end = inside[:, :PLACES], inside[:, SPAN - 1 :]
    return text, ((start & end) * _BITS).sum(1, dtype=np.uint32)


def _sums(text: np.ndarray) -> np.ndarray:
    out = np.zeros((len(text), WIDTH + 1), np.uint64)
    np.cumsum(_VALUE[text - np.uint8(1)] * _COLUMN_POWERS, axis=1, out=out[:, 1:])
    return out


def _hashes(text: np.ndarray, first: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of what the strings of each context share (an anchor's as in anchors()), and of each context with its bits."""
    core, whole = np.empty(len(text), np.uint64), np.empty(len(text), np.uint64)
    for i in range(0, len(text), ROWS):
        sums, wide = _sums(text[i : i + ROWS]), first[i : i + ROWS] == WIDE
        anchor, few = (sums[:, SIDE + GRAM] - sums[:, SIDE]) * _TO_FRONT[SIDE], sums[:, SPAN] - sums[:, FEW - 1]
        core[i : i + ROWS] = mixed(np.where(wide, anchor, few)) | np.uint64(1)
        whole[i : i + ROWS] = mixed(sums[:, -1] + (bits[i : i + ROWS].astype(np.uint64) << np.uint64(8) | first[i : i + ROWS]) * np.uint64(0x9E3779B97F4A7C15))
    return core, mixed(whole + core)


def narrowed(text: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Contexts of hot anchors as contexts for FEW places each: which rows, the first place, their symbols and bits."""
    for first in range(0, PLACES, FEW):
        own = (bits >> np.uint32(first)) & np.uint32((1 << FEW) - 1)
        rows = np.flatnonzero(own)
        few = np.zeros((len(rows), WIDTH), np.uint8)
        few[:, : SPAN + FEW - 1] = text[rows, first : first + SPAN + FEW - 1]
        yield rows, first, few, own[rows]


def _sent_contexts(parts: int, hot: np.ndarray) -> Callable:
    """hot: hashes of hot anchors as a sorted array of their last HASH_BYTES bytes and their part."""

    def split(doc: np.ndarray, which: np.ndarray, at: np.ndarray, text: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
        first = np.full(len(doc), WIDE, np.uint8)
        if not len(hot):
            return [doc, which, at, first, bits, text]
        part, low = _dealt(_hashes(text, first, bits)[0], parts)
        own = np.zeros((len(doc), 8), np.uint8)
        own[:, :HASH_BYTES] = low
        often = np.isin(own.view(np.uint64).ravel() | part.astype(np.uint64) << np.uint64(8 * HASH_BYTES), hot)
        cold, rows = np.flatnonzero(~often), np.flatnonzero(often)
        out = [[doc[cold], which[cold], at[cold], first[cold], bits[cold], text[cold]]]
        for r, place, few, few_bits in narrowed(text[rows], bits[rows]):
            own = rows[r]
            out.append([doc[own], which[own], at[own], np.full(len(own), place, np.uint8), few_bits, few])
        return [np.concatenate(c) for c in zip(*out)]

    def flush(*held: np.ndarray) -> pa.RecordBatch:
        doc, which, at, first, bits, text = split(*held)
        core, whole = _hashes(text, first, bits)
        later = doc > _least(whole, doc)
        send, known = np.flatnonzero(~later), np.flatnonzero(later)
        send = send[np.argsort(core[send], kind="stable")]
        rows = []
        for part, own in _split((core[send] % np.uint64(parts)).astype(np.int32)):
            own = send[own]
            rows.append((part, 0, pack(doc[own], which[own], at[own], first[own], bits[own]), zlib.compress(text[own].tobytes(), 1)))
        for part, own in _split(_dest(doc[known], which[known], parts)):
            own = known[own]
            rows.append((part, 1, pack(doc[own], which[own], at[own], _placed(bits[own], first[own])), b""))
        return _blobs(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            data, off = buffers(b.column("text"))
            ids, variants = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "which"))
            places = b.column("places").to_pylist()
            for i, j in slices(off, BATCH_BYTES):
                own = [np.frombuffer(p, np.uint32) for p in places[i:j]]
                doc = np.repeat(np.arange(i, j), [len(p) for p in own])
                rel = np.concatenate(own)
                fits = off[doc] + rel + GRAM <= off[doc + 1]
                doc, rel = doc[fits], rel[fits]
                for k in range(0, len(doc), ROWS):
                    d, r = doc[k : k + ROWS], rel[k : k + ROWS]
                    text, bits = contexts(data, off, d, off[d] + r)
                    held.append((ids[d], variants[d], r, text, bits))
                    size += text.nbytes
                    if size >= CHUNK_BYTES:
                        yield flush(*map(np.concatenate, zip(*held)))
                        held, size = [], 0
        if held:
            yield flush(*map(np.concatenate, zip(*held)))

    return run


def _placed(bits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits of the places of an anchor, of bits from a first place on."""
    return bits << np.where(first == WIDE, 0, first).astype(np.uint32)


def _indexed(doc: np.ndarray, text: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each context of a block, the bits of its strings that a context of a smaller doc_id has."""
    order = np.argsort(doc, kind="stable")
    doc, text, bits = doc[order], text[order], bits[order]
    # to the left: what stands before a text's beginning goes
    begin = (text != 0).argmax(1)
    length = (text != 0).sum(1)
    at = begin[:, None] + np.arange(WIDTH)
    symbols = np.where(at < WIDTH, np.take_along_axis(text, np.minimum(at, WIDTH - 1), 1), 0).astype(np.uint8)
    _, least = RunIndex(symbols, length, doc, SPAN).matches(symbols, length)
    out = np.zeros(len(doc), np.uint32)
    for place in range(PLACES):
        rows = np.flatnonzero(bits & _BITS[place])
        earlier = least[rows, place - begin[rows]] < doc[rows]
        out[rows[earlier]] |= _BITS[place]
    back = np.empty_like(out)
    back[order] = out
    return back


def _may_match(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which contexts share the bytes that all strings of a quarter of their places hold with another: the others match nothing."""
    keep = np.zeros(len(text), bool)
    wide = np.flatnonzero(first == WIDE)
    keep[first != WIDE] = True
    for begin in range(0, PLACES, PLACES // 4):
        h = np.empty(len(wide), np.uint64)
        for i in range(0, len(wide), ROWS):
            sums = _sums(text[wide[i : i + ROWS]])
            h[i : i + ROWS] = sums[:, begin + SPAN] - sums[:, begin + PLACES // 4 - 1]
        order, starts = _groups(h)
        sizes = np.diff(np.append(starts, len(order)))
        keep[wide[order[np.repeat(sizes > 1, sizes)]]] = True
    return keep


def marked(doc: np.ndarray, first: np.ndarray, text: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each context, the bits of its strings that a context of a smaller doc_id has."""
    core, whole = _hashes(text, first, bits)
    least = _least(whole, doc)
    out = np.where(doc > least, bits, np.uint32(0))
    if not len(doc):
        return out
    # equal contexts are one string of the smallest doc_id, and what is found holds for its rows
    ordered = np.lexsort((doc, whole))
    starts = np.flatnonzero(np.append(True, whole[ordered][1:] != whole[ordered][:-1]))
    one = np.empty(len(doc), np.int64)
    one[ordered] = np.repeat(ordered[starts], np.diff(np.append(starts, len(doc))))
    rows = ordered[starts]
    rows = rows[_may_match(text[rows], first[rows])]
    order, starts = _groups(core[rows])
    sizes = np.diff(np.append(starts, len(order)))
    rows, sizes = rows[order[np.repeat(sizes > 1, sizes)]], sizes[sizes > 1]
    block = np.repeat((np.cumsum(sizes) - sizes) // INDEXED, sizes)
    for _, own in _split(block):
        own = rows[own]
        out[own] |= _indexed(doc[own], text[own], bits[own])
    beside = np.flatnonzero(doc == doc[one])
    out[beside] |= out[one[beside]]
    return out


def _marked(parts: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        doc, which, at, first, bits = _joined(_cells(table, "packed", 0), *_CONTEXT)
        text = np.frombuffer(b"".join(map(zlib.decompress, _cells(table, "raw", 0))), np.uint8).reshape(-1, WIDTH)
        marks = _placed(marked(doc, first, text, bits), first)
        known = _joined(_cells(table, "packed", 1), np.int64, np.int64, np.uint32, np.uint32)
        some = marks > 0
        both = [np.concatenate([c[some], k]) for c, k in zip((doc, which, at, marks), known)]
        return _by_document(both[0], both[1], parts, *both[2:])

    return run


def removed_bytes(off: np.ndarray, doc: np.ndarray, at: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which bytes of a buffer of texts the marked strings cover; at: places of anchors in their texts."""
    n = int(off[-1])
    depth = np.zeros(n + 1, np.int64)
    for place in range(PLACES):
        own = np.flatnonzero(marks & _BITS[place])
        start = off[doc[own]] + at[own].astype(np.int64) - SIDE + place
        start = start[(start >= off[doc[own]]) & (start + SPAN <= off[doc[own] + 1])]
        depth += np.bincount(start, minlength=n + 1) - np.bincount(start + SPAN, minlength=n + 1) if len(start) else 0
    return np.cumsum(depth[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch], give: Callable) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b.column("text"))
        places, marks = b.column("places").to_pylist(), b.column("marks").to_pylist()
        for i, j in slices(off, BATCH_BYTES):
            at = [np.frombuffer(p or b"", np.uint32) for p in places[i:j]]
            bits = np.concatenate([np.frombuffer(m or b"", np.uint32) for m in marks[i:j]])
            own = off[i : j + 1] - off[i]
            gone = removed_bytes(own, np.repeat(np.arange(j - i), [len(p) for p in at]), np.concatenate(at), bits)
            yield give(b.slice(i, j - i), data[off[i] : off[j]], own, gone)


def _digests(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    begins = gone.copy()
    inner = np.ones(len(data), bool)
    inner[off[:-1][off[:-1] < len(data)]] = False
    begins[1:] &= ~(gone[:-1] & inner[1:])
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    kept, kept_off = data[~gone], np.concatenate([[0], np.cumsum(~gone)])[off]
    digests = [hashlib.sha256(kept[p:q]).hexdigest() for p, q in zip(kept_off[:-1], kept_off[1:])]
    return pa.record_batch([rows.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(sums(gone), pa.int64()), pa.array(sums(begins), pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    kept, kept_off = data[~gone], np.concatenate([[0], np.cumsum(~gone)])[off]
    # a removed run may end within a character; what is left of it goes too
    texts = [kept[p:q].tobytes().decode("utf-8", "ignore") for p, q in zip(kept_off[:-1], kept_off[1:])]
    return pa.record_batch([rows.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and which: 0, or the hash of the text where one doc_id has unlike texts."""
    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= SPAN))
    hashed = F.xxhash64("text")
    unlike = rows.groupBy("doc_id").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high")).filter("low <> high").select(F.col("doc_id").alias("of"))
    told = rows.join(small_side(staged(unlike, "repeats-unlike"), 8), rows["doc_id"] == F.col("of"), "left")
    return told.select("doc_id", F.when(F.col("of").isNull(), 0).otherwise(hashed).cast("long").alias("which"), "text")


def repeat_marks(docs: DataFrame) -> DataFrame:
    """doc_id, which, places, marks of the documents of which something repeats an earlier one; staged."""
    rows = _numbered(docs)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(12, -(-size // PART_BYTES))
    hot = max(HOT, size * 2 // (PLACES + 1) // MOST_HOT)
    sent = rows.mapInArrow(tidy(_sent_anchors(parts)), _BLOB_DDL)
    flags = staged(sent.groupBy("part").applyInArrow(tidy_group(_flagged(parts, hot)), "dest int, packed binary"), "repeats-anchors")
    # MOST_HOT numbers of 8 bytes at most
    often = [np.frombuffer(r.packed, np.uint64) | np.uint64((-1 - r.dest) << 8 * HASH_BYTES) for r in flags.filter("dest < 0").collect()]
    hot_anchors = np.sort(np.concatenate(often)) if often else np.zeros(0, np.uint64)
    places = flags.filter("dest >= 0").groupBy("dest").applyInArrow(tidy_group(_documents(np.uint32)), "doc_id long, which long, places binary").toDF("of", "variant", "places")
    flagged = rows.join(places, (rows["doc_id"] == F.col("of")) & (rows["which"] == F.col("variant"))).select("doc_id", "which", "text", "places")
    around = flagged.mapInArrow(tidy(_sent_contexts(parts, hot_anchors)), _BLOB_DDL)
    marks = around.groupBy("part").applyInArrow(tidy_group(_marked(parts)), "dest int, packed binary").groupBy("dest").applyInArrow(tidy_group(_documents(np.uint32, np.uint32)), "doc_id long, which long, places binary, marks binary")
    return staged(marks, "repeats-marks")


def _with_marks(docs: DataFrame, row) -> DataFrame:
    """row, doc_id, text of docs, with their places and marks."""
    marks = repeat_marks(docs).toDF("of", "which", "places", "marks")
    rows = docs.select(row, quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"))
    own = (rows["doc_id"] == F.col("of")) & ((F.col("which") == 0) | (F.col("which") == F.xxhash64(rows["text"])))
    return rows.join(marks, own, "left").select("row", "doc_id", "text", "places", "marks")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _with_marks(docs, F.lit(None).cast("int").alias("row"))
    return rows.mapInArrow(tidy(lambda batches: _cut(batches, _digests)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with what is left of each text, and its length as n_chars if docs has that column."""
    columns = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = _with_marks(docs, boxed(docs, columns))
    schema = StructType([rows.schema["row"], StructField("text", StringType()), StructField("n_chars", LongType())])
    cut = rows.mapInArrow(tidy(lambda batches: _cut(batches, _texts)), schema)
    given = {"text": F.col("text"), "n_chars": F.col("n_chars").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    kept = dict(zip(columns, unboxed(columns)))
    return cut.select(*[(given[c] if c in given else kept[c]).alias(c) for c in docs.columns])
