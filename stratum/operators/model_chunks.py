"""Chunks of texts by the tokens of a model's vocabulary, as slices of the text.

A text's tokens are an array of offsets, made once; blocks (fenced parts whole, else paragraphs) are packed on that array up to
the budget, and a longer block is cut at offsets of tokens. A chunk is a slice from its first block's start to its last block's
end, so that offsets lead back to the text. A slice alone may have other tokens at its ends than within the text: each is
counted once more, alone, and cut again if it is above the budget. No chunk is.

Defined results: null and blank texts have no chunks; a budget below one token counts as one; a character that alone has more
tokens than the budget is a chunk by itself, the one case above it; null ids stay null.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SIZE, OVERLAP = 160, 32
#: Characters that the vocabulary sees at once: a text of one long word would take it time by the square.
PIECE = 4096
_FENCED = re.compile(r"\[(CODE|TABLE)[^\]\n]*\].*?\[/\1\]", re.S)
_GAP = re.compile(r"\n\s*\n")


@cache
def _vocabulary(name: str):
    # a task has one core: threads of the vocabulary's own would take those of other tasks
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(SparkFiles.get(name) if "/" not in name else name)
    made.encode_special_tokens = True
    return made


class Tokens:
    """Texts as offsets of tokens."""

    def __init__(self, name: str):
        self.vocabulary = _vocabulary(name)

    def offsets(self, text: str) -> np.ndarray:
        """Where tokens begin, ascending; a character of several tokens stands once for each."""
        edges = [0]
        while len(text) - edges[-1] > PIECE:
            at = edges[-1]
            cut = max(text.rfind(c, at + PIECE // 2, at + PIECE) for c in " \n")
            edges.append(cut if cut > at else at + PIECE)
        parts = [text[a:b] for a, b in zip(edges, [*edges[1:], len(text)])]
        found = [np.array([o[0] for o in e.offsets], np.int64) + at for e, at in zip(self.vocabulary.encode_batch(parts, add_special_tokens=False), edges)]
        return np.maximum.accumulate(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def count(self, text: str) -> int:
        return len(self.offsets(text))


def blocks(text: str) -> list[tuple[int, int]]:
    """Where blocks begin and end: fenced parts, and paragraphs between blank lines."""
    out = []

    def paragraphs(start: int, end: int) -> None:
        at = start
        for gap in [*_GAP.finditer(text, start, end), None]:
            stop = gap.start() if gap else end
            own = text[at:stop]
            if own.strip():
                out.append((at + len(own) - len(own.lstrip()), at + len(own.rstrip())))
            at = gap.end() if gap else end

    at = 0
    for fence in _FENCED.finditer(text):
        paragraphs(at, fence.start())
        out.append(fence.span())
        at = fence.end()
    paragraphs(at, len(text))
    return out


def _cut(text: str, start: int, end: int, begins: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A span in parts of up to size tokens, at offsets where a character begins."""
    out = []
    while start < end:
        i = int(np.searchsorted(begins, start))
        at = int(begins[i + size]) if i + size < len(begins) and begins[i + size] < end else end
        if at <= start:  # tokens of one character
            at = start + 1
        if text[start:at].strip():
            out.append((start, at))
        start = at
    return out


def packed(text: str, tokens: Tokens, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """start, end, own tokens of each chunk; a chunk begins with the last blocks of the one before, of up to overlap tokens together."""
    size = max(1, size)
    begins = tokens.offsets(text)
    n = lambda a, b: int(np.searchsorted(begins, b) - np.searchsorted(begins, a))
    units = [part for a, b in blocks(text) for part in ([(a, b)] if n(a, b) <= size else _cut(text, a, b, begins, size))]
    spans, first = [], 0
    for k in range(1, len(units) + 1):
        if k == len(units) or n(units[first][0], units[k][1]) > size:
            spans.append((units[first][0], units[k - 1][1]))
            back = k
            while back - 1 > first and k < len(units) and n(units[back - 1][0], units[k - 1][1]) <= overlap and n(units[back - 1][0], units[k][1]) <= size:
                back -= 1
            first = back
    out = []
    while spans:
        a, b = spans.pop(0)
        own = tokens.offsets(text[a:b])
        if len(own) <= size or b - a == 1:
            out.append((a, b, len(own)))
        else:  # alone it has more tokens than within the text
            spans[:0] = _cut(text, a, b, own + a, size)
    return out


def model_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ordinal, start, end, n_tokens, text. The vocabulary's file goes to the executors with the job."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(name)
        for f in frames:
            rows = [(i, k, a, b, n, text[a:b]) for i, text in zip(f["doc_id"], f["text"]) for k, (a, b, n) in enumerate(packed(text, tokens, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "start", "end", "n_tokens", "text"]).astype({"doc_id": "Int64"})

    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, "doc_id long, ordinal int, start int, end int, n_tokens int, text string")
