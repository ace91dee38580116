"""SentencePiece encoding with N-best segmentations, and decoding.

A text is cut before each run of spaces and around line ends, which no piece crosses, so that its piece lattice is a chain
of small ones. In each, the forward Viterbi pass gives the best segmentation, and with a backward pass what the second best
loses. Only the few parts of a text that lose least can differ in its N best segmentations; for these, A* searches backward
from the part's end with the forward scores, which are exact, as its heuristic, so that complete paths leave the queue best
first.

The forward and backward passes run in numpy over all unlike parts of a batch that have the same length; a part of more
than LONG characters (a text without spaces is one part) goes alone, in time and memory (some 200 bytes a character) that
grow with its length. Parts are kept between batches, up to CACHE. Pieces come from the vocabulary's file; a merge vocabulary ranks pieces instead of giving
their probabilities, so that the log-probability of rank r is by Zipf's and Mandelbrot's law. Characters without a piece,
and the space mark itself where a text has it, become byte pieces, so that decoding gives every text back.

Defined results: a null or empty text has no pieces and one segmentation of score 0; its decoding is empty; segmentations
of equal score come in an order that depends on the text alone; repeated rows are encoded alike; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import boxed, buffers, quoted, slices, tidy, unboxed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
#: Parts, and their characters, that a task keeps; above LONG characters, a part goes through its lattice alone.
CACHE, CACHE_CHARS, LONG = 300_000, 8 << 20, 64
BATCH_BYTES = 4 << 20
MARK = "▁"
PARTS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
ZIPF_SHIFT, BYTE_COST = 2.7, 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: An alternative: its score, and (first piece, end, pieces instead) of each part that differs from the best.
NBEST_DDL = "array<struct<score: double, changes: array<struct<start: int, end: int, ids: array<int>>>>>"


class Vocabulary:
    """Pieces with scores; spaces stand for the space mark."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.ids = {model.id_to_piece(i).replace(MARK, " "): i for i in plain}
        total = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(plain))))
        self.score = np.full(n + 1, -np.inf)  # the last is that of no piece
        self.score[plain] = [-math.log(r + ZIPF_SHIFT) - total for r in range(len(plain))]
        self.of_byte = float(self.score[plain].min()) - BYTE_COST
        self.longest = max(map(len, self.ids))
        self.value = self.score.tolist()
        lengths: dict[str, set[int]] = {}
        for text in self.ids:
            lengths.setdefault(text[-1], set()).add(len(text))
        #: Of each character, the lengths of the pieces that end with it, the longest first.
        self.ending = {c: sorted(k, reverse=True) for c, k in lengths.items()}
        self.bytes = [b""] * n
        for text, i in self.ids.items():
            self.bytes[i] = text.encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)
        keys = np.zeros(len(self.ids), np.uint64)
        for k, text in enumerate(self.ids):
            h = 0
            for c in text:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        order = np.argsort(keys)
        self.keys, self.of_key = keys[order], np.array(list(self.ids.values()))[order]
        self.none = n

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.of_key[at], self.none)

    def into(self, part: str, j: int) -> list[tuple[int, float, int]]:
        """(start, score, piece) of what ends at j in the part, the longest first; a character without a piece is `none`."""
        found = [(j - k, self.value[p], p) for k in self.ending.get(part[j - 1], ()) if k <= j and (p := self.ids.get(part[j - k : j])) is not None]
        if part[j - 1] not in self.ids:
            found.append((j - 1, self.of_byte * len(part[j - 1].encode("utf-8", "surrogatepass")), self.none))
        return found

    def spelled(self, part: str, at: int, piece: int) -> tuple[int, ...]:
        """A piece, or the byte pieces of the character before `at`."""
        return (piece,) if piece != self.none else tuple(self.byte[b] for b in part[at - 1].encode("utf-8", "surrogatepass"))

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        text = self.data[np.repeat(self.starts[ids] - before, lengths) + np.arange(lengths.sum())]
        return text[1:].tobytes()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """The forward Viterbi pass over a part of any length: a score and the best last piece for each place, no edges are kept."""

    def __init__(self, vocab: Vocabulary, part: str):
        self.vocab, self.part = vocab, part
        self.forward, self.back, self.piece = array("d", [0.0]), array("i", [0]), array("i", [0])
        forward = self.forward
        for j in range(1, len(part) + 1):
            best, start, last = -math.inf, 0, 0
            for i, s, p in vocab.into(part, j):
                # of equal scores the longest last piece counts
                if (total := forward[i] + s) > best + 1e-9:
                    best, start, last = total, i, p
            forward.append(best)
            self.back.append(start)
            self.piece.append(last)

    def best(self) -> list[int]:
        ids, at = [], len(self.part)
        while at:
            ids += reversed(self.vocab.spelled(self.part, at, self.piece[at]))
            at = self.back[at]
        return ids[::-1]

    def losses(self, at: int) -> list[tuple[float, int, int]]:
        """(loss, start, piece) of all last pieces of what ends at `at`, against the best."""
        return [(self.forward[at] - self.forward[i] - s, i, p) for i, s, p in self.vocab.into(self.part, at)]

    def least(self, n: int) -> list[float]:
        """The n least losses of leaving the best segmentation once: each is that of another segmentation."""
        at, found = len(self.part), []
        while at:
            found += [x for x, i, _ in self.losses(at) if i != self.back[at]]
            if len(found) > 64 * n:
                found = heapq.nsmallest(n, found)
            at = self.back[at]
        return heapq.nsmallest(n, found)

    def nbest(self, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, by backward A*: what is left before a place costs what the forward pass says.

        No path above the bound that leaving the best one sets is followed, and paths share their ends.
        """
        least = self.least(n - 1) if n > 1 else []
        bound = max(least, default=0.0) + 1e-9 if len(least) == n - 1 else math.inf
        steps: list[tuple[int, int, int]] = [(-1, 0, 0)]  # what follows, place, piece
        queue: list[tuple[float, int, int]] = [(0.0, len(self.part), 0)]
        found = []
        while queue and len(found) < n:
            lost, at, last = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while last:
                    last, place, piece = steps[last]
                    ids += self.vocab.spelled(self.part, place, piece)
                found.append((self.forward[-1] - lost, tuple(ids)))
                continue
            for x, i, p in self.losses(at):
                if lost + x <= bound:
                    steps.append((last, at, p))
                    heapq.heappush(queue, (round(lost + x, 9), i, len(steps) - 1))
        return found


def nbest_part(vocab: Vocabulary, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    return Lattice(vocab, part).nbest(n)


class Parts:
    """Segmentations of parts met so far: pieces, score, and what the second best loses."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.size = 0  # characters
        self.words: list[str] = []
        self.alternatives: dict[int, list[tuple[float, tuple[int, ...]]]] = {}  # by code, of parts that were asked for
        self.ids, self.starts, self.score, self.loss = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), np.zeros(0)

    def codes(self, texts: list[str]) -> list[np.ndarray]:
        """The codes of the parts of each text; new parts are segmented."""
        if len(self.code) > CACHE or self.size > CACHE_CHARS:
            self.clear()
        code, known = self.code, len(self.code)
        out = [np.array([code.setdefault(p, len(code)) for p in PARTS.findall(" " + t)] if t else [], np.int64) for t in texts]
        new = list(code)[known:] if known else list(code)
        if new:
            self._add(new)
        return out

    def _add(self, words: list[str]) -> None:
        pieces: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        counts, score, loss = np.zeros(len(words), np.int64), np.zeros(len(words)), np.zeros(len(words))
        lengths = np.array([len(w) for w in words])
        self.size += int(lengths.sum())
        for k in np.flatnonzero(lengths > LONG):
            lattice = Lattice(self.vocab, words[k])
            pieces[k] = np.array(lattice.best(), np.int32)
            counts[k], score[k], loss[k] = len(pieces[k]), lattice.forward[-1], max(0.0, (lattice.least(1) or [math.inf])[0])
        for length in np.unique(lengths[lengths <= LONG]):
            rows = np.flatnonzero(lengths == length)
            step = max(1, 200_000 // int(length * min(length, self.vocab.longest)))
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                flat, n, score[own], loss[own] = self._segment([words[i] for i in own], int(length))
                counts[own] = n
                for i, p in zip(own, np.split(flat, np.cumsum(n)[:-1])):
                    pieces[i] = p
        self.words += words
        self.ids = np.concatenate([self.ids, *pieces])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])

    def _segment(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        vocab, n = self.vocab, len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length)
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + chars[:, j] + np.uint64(1)
        power = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(vocab.longest + 1)]
        spans = [(i, j) for j in range(1, length + 1) for i in range(max(0, j - vocab.longest), j)]
        piece = {(i, j): vocab.find(prefix[j] - prefix[i] * power[j - i]) for i, j in spans}
        value = {s: vocab.score[p] for s, p in piece.items()}
        for j in range(1, length + 1):  # byte pieces where a character has none
            c = chars[:, j - 1]
            wide = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            value[j - 1, j] = np.where(piece[j - 1, j] == vocab.none, vocab.of_byte * wide, value[j - 1, j])
        forward, back = np.full((length + 1, n), -np.inf), np.zeros((length + 1, n), np.int64)
        forward[0] = 0
        for i, j in spans:
            total = forward[i] + value[i, j]
            better = total > forward[j] + 1e-9
            forward[j], back[j] = np.where(better, total, forward[j]), np.where(better, i, back[j])
        backward = np.full((length + 1, n), -np.inf)
        backward[length] = 0
        for i, j in reversed(spans):
            np.maximum(backward[i], value[i, j] + backward[j], out=backward[i])
        on_path = np.zeros((length + 1, n), bool)
        at, each = np.full(n, length), np.arange(n)
        for _ in range(length):
            on_path[at, each] = True
            at = back[at, each]
        second = np.full(n, -np.inf)
        for i, j in spans:
            through = forward[i] + value[i, j] + backward[j]
            np.maximum(second, np.where(on_path[j] & (back[j] == i), -np.inf, through), out=second)
        on_path[0] = False
        end, row = np.nonzero(on_path)
        order = np.lexsort((end, row))
        end, row = end[order], row[order]
        start = back[end, row]
        ids = np.empty(len(end), np.int64)
        for i, j in spans:
            own = (start == i) & (end == j)
            ids[own] = piece[i, j][row[own]]
        counts = np.bincount(row, minlength=n)
        if (missing := np.flatnonzero(ids == vocab.none)).size:
            raw = [[vocab.byte[b] for b in chr(chars[row[k], end[k] - 1]).encode("utf-8", "surrogatepass")] for k in missing]
            wide = np.ones(len(ids), np.int64)
            wide[missing] = [len(r) for r in raw]
            counts = np.bincount(row, weights=wide, minlength=n).astype(np.int64)
            ids = np.repeat(ids, wide)
            ids[ids == vocab.none] = np.concatenate(raw)
        with np.errstate(invalid="ignore"):
            loss = np.where(np.isfinite(second), forward[length] - second, np.inf)
        return ids.astype(np.int32), counts, forward[length], np.maximum(loss, 0)

    def pieces(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces of a row of parts, and where each part begins."""
        n = self.starts[codes + 1] - self.starts[codes]
        begin = np.cumsum(n) - n
        return self.ids[np.repeat(self.starts[codes] - begin, n) + np.arange(n.sum())], begin


def nbest(parts: Parts, codes: np.ndarray, begin: np.ndarray, n: int) -> list[dict]:
    """The n best segmentations of a text."""
    total = float(parts.score[codes].sum()) if len(codes) else 0.0
    loss = parts.loss[codes]
    few = np.argpartition(loss, n - 1)[: n - 1] if len(loss) > n - 1 else np.arange(len(loss))
    if len(loss) > n - 1:  # of equal losses the first parts count
        bound = loss[few].max()
        few = np.concatenate([np.flatnonzero(loss < bound), np.flatnonzero(loss == bound)])[: n - 1]
    few = [int(k) for k in np.sort(few) if np.isfinite(loss[k])]
    lists = []
    for k in few:
        c = int(codes[k])
        if c not in parts.alternatives:
            parts.alternatives[c] = nbest_part(parts.vocab, parts.words[c], n)
        lists.append(parts.alternatives[c])
    # best first over the choices for these parts; a choice worsens one part at or after the last that was worsened
    queue, found = [(0.0, (0,) * len(few), 0)], []
    while queue and len(found) < n:
        lost, choice, last = heapq.heappop(queue)
        found.append((lost, choice))
        for p in range(last, len(few)):
            if choice[p] + 1 < len(lists[p]):
                step = lists[p][choice[p]][0] - lists[p][choice[p] + 1][0]
                heapq.heappush(queue, (round(lost + step, 9), choice[:p] + (choice[p] + 1,) + choice[p + 1 :], p))
    out = []
    for lost, choice in found:
        changes = []
        for k, options, c in zip(few, lists, choice):
            if c:
                start = int(begin[k])
                changes.append({"start": start, "end": start + int(parts.starts[codes[k] + 1] - parts.starts[codes[k]]), "ids": list(options[c][1])})
        out.append({"score": total - lost, "changes": changes})
    return out


def encode(docs: DataFrame, *columns: str, model: str = MODEL, n: int = NBEST, back: bool = False) -> DataFrame:
    """row (a struct of those columns of docs), ids, and nbest (NBEST_DDL), the best first; with back, decoded too: the text that ids stand for.

    model: path of the vocabulary's file, which each executor reads.
    """
    rows = docs.select(boxed(docs, list(columns)), quoted("text").cast("string").alias("text"))
    own = StructType.fromDDL(f"ids array<int>, nbest {NBEST_DDL}" + (", decoded string" if back else ""))
    changes = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(changes))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        parts = Parts(vocab)
        for b in batches:
            _, off = buffers(b.column("text"))
            for i, j in slices(off, BATCH_BYTES):
                codes = parts.codes([t or "" for t in b.column("text").slice(i, j - i).to_pylist()])
                ids, best = [], []
                for c in codes:
                    own, begin = parts.pieces(c)
                    ids.append(own)
                    best.append(nbest(parts, c, begin, n))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                told = [b.column("row").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(best, kind)]
                if back:
                    told.append(pa.array([vocab.decode(x).decode() for x in ids], pa.string()))
                yield pa.record_batch(told, names=["row", "ids", "nbest", "decoded"][: len(told)])

    return rows.mapInArrow(tidy(run), StructType([rows.schema["row"], *own.fields]))


def decode(rows: DataFrame, ids: str, *columns: str, model: str = MODEL) -> DataFrame:
    """row (a struct of those columns of rows), and decoded: the text that the pieces in column ids stand for."""
    boxes = rows.select(boxed(rows, list(columns)), quoted(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for b in batches:
            lists = b.column("ids")
            flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [vocab.decode(flat[p:q]).decode() for p, q in zip(off[:-1], off[1:])]
            yield pa.record_batch([b.column("row"), pa.array(texts, pa.string())], names=["row", "decoded"])

    return boxes.mapInArrow(tidy(run), StructType([boxes.schema["row"], StructField("decoded", StringType())]))


def encoded_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the pieces as text, comma-separated), nbest_scores, decoded_sha256."""
    coded = encode(docs, "doc_id", model=model, back=True)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select(*unboxed(["doc_id"]), F.size("ids").cast("long").alias("n_pieces"), digest(F.array_join("ids", ",")).alias("ids_sha256"), F.transform("nbest", lambda x: F.round(x["score"], 6)).alias("nbest_scores"), digest(F.col("decoded")).alias("decoded_sha256"))
