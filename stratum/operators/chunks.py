"""Texts into blocks and chunks. A text is one row, so that packing needs no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.normalise import block_texts
from stratum.functions.text import uuid5

SIZE, OVERLAP = 160, 32


def packed(blocks: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Blocks packed greedily up to size tokens; a chunk begins with the last blocks before it, of overlap tokens or more.

    A block that is longer than size is cut into pieces of size tokens first. Sums run along, so that a text takes time in
    proportion to its length.
    """
    units: list[tuple[str, int]] = []
    for block in blocks:
        words = block.split()
        if len(words) > size:
            units += [(" ".join(words[i : i + size]), len(words[i : i + size])) for i in range(0, len(words), size)]
        elif words:
            units.append((block.strip(), len(words)))
    out: list[str] = []
    first, held = 0, 0  # the chunk's first unit, and its tokens
    for k, (_, n) in enumerate(units):
        if k > first and held + n > size:
            out.append("\n".join(t for t, _ in units[first:k]))
            tail, back = 0, k
            while back > first and tail < overlap:
                back -= 1
                tail += units[back][1]
            first, held = (back, tail) if overlap and tail + n <= size else (k, 0)
        held += n
    if units:
        out.append("\n".join(t for t, _ in units[first:]))
    return out


def pieces_of(text: str, most: int) -> list[str]:
    """A text in pieces of most characters: cut at the last line end, or else space, of a piece's second half, or else hard."""
    out, at = [], 0
    while most > 0 and len(text) - at > most:
        least = at + max(1, most // 2)
        cut = max(text.rfind("\n", least, at + most + 1), -1)
        cut = cut if cut >= 0 else text.rfind(" ", least, at + most + 1)
        cut = cut if cut >= 0 else at + most
        piece = text[at:cut].strip()
        if not piece:
            piece, cut = text[at : at + most], at + most
        out.append(piece)
        at = cut
        while at < len(text) and text[at].isspace():
            at += 1
    rest = text[at:].strip() if out else text
    return out + [rest] if rest or not out else out


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ordinal, chunk_id, n_tokens, text; blocks end at blank lines, and fenced code and tables are blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, len(c.split()), c) for i, blocks in zip(f["doc_id"], f["blocks"]) for k, c in enumerate(packed(list(blocks), size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "n_tokens", "text"])

    out = docs.select("doc_id", block_texts(F.col("text")).alias("blocks")).mapInPandas(run, "doc_id long, ordinal int, n_tokens int, text string")
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"), "text")
    return out.select("doc_id", "ordinal", uuid5(name).alias("chunk_id"), "n_tokens", "text")
