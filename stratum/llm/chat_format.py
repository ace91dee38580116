"""Chat formatting: turns become one marked-up text per conversation, with a loss mask over what the assistant says.

Bytes are assembled by column: segment lengths give offsets, offsets give scatter indices, and headers and contents are
copied into one Arrow buffer allocated before. Rows of a conversation are brought together by a shuffle and an external
sort; a task then reads them as a stream, so that a conversation of any length needs the memory of one piece.

Defined results: a null role or text is empty; a null conversation id is a conversation of its own; a null turn comes
first; rows that tie in a turn are ordered by role and text, and repeated rows are repeated turns; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffers, tidy

START, END = "<|im_start|>", "<|im_end|>\n"
#: A conversation of more bytes than this is given in several pieces, in order.
PIECE_BYTES = 64 << 20
FORMATTED = "conv_id long, piece long, n_turns long, formatted string, loss_starts array<int>, loss_ends array<int>"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array) -> pa.Array:
    """No escaped text holds '<|': a backslash is added within each '<', backslashes, '|'."""
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def escape_role(roles: pa.Array) -> pa.Array:
    """A role ends at the line's end, so that its line ends are escaped too."""
    return pc.replace_substring(pc.replace_substring(escape(roles), "\\", "\\\\"), "\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)) if "\\" in role else role


def _put(out: np.ndarray, at: np.ndarray, source: np.ndarray, off: np.ndarray) -> None:
    out[np.repeat(at - off[:-1], np.diff(off)) + np.arange(len(source))] = source


def _put_same(out: np.ndarray, at: np.ndarray, text: str) -> None:
    source = np.frombuffer(text.encode(), np.uint8)
    out[at[:, None] + np.arange(len(source))] = source


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, list[list[int]], list[list[int]]]:
    """The formatted texts of conversations that begin at the rows first, and the starts and ends of loss spans in code points."""
    n = len(roles)
    said = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)
    role, role_off = buffers(escape_role(roles))
    text, text_off = buffers(escape(texts))
    lengths = len(START) + np.diff(role_off) + 1 + np.diff(text_off) + len(END)
    off = np.zeros(n + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    buffer = pa.allocate_buffer(int(off[-1]))
    out = np.frombuffer(buffer, np.uint8)
    at_role = off[:-1] + len(START)
    at_text = at_role + np.diff(role_off) + 1
    at_end = at_text + np.diff(text_off)
    _put_same(out, off[:-1], START)
    _put(out, at_role, role, role_off)
    out[at_text - 1] = 10
    _put(out, at_text, text, text_off)
    _put_same(out, at_end, END)
    points = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])
    bounds = np.append(first, n)
    group = np.searchsorted(bounds, np.arange(n), "right") - 1
    base = points[off[first]][group]
    starts, ends = points[at_text] - base, points[at_end] - base
    loss = [np.flatnonzero(said[i:j]) + i for i, j in zip(bounds[:-1], bounds[1:])]
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(off[bounds]), buffer])
    return formatted.cast(pa.string()), [starts[x].tolist() for x in loss], [ends[x].tolist() for x in loss]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))])
    last: tuple[object, int] = ("none yet", 0)

    def emit(rows: pa.Table) -> pa.RecordBatch:
        nonlocal last
        rows = rows.combine_chunks()
        ids = rows.column("conv_id").combine_chunks()
        values, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (null[1:] != null[:-1])))
        texts = [rows.column(c).combine_chunks().fill_null("") for c in ("role", "text")]
        formatted, starts, ends = assemble(*texts, first)
        names = ids.take(pa.array(first)).to_pylist()
        pieces = [last[1] + 1 if names[0] == last[0] else 0] + [0] * (len(names) - 1)
        last = (names[-1], pieces[-1])
        return pa.record_batch([pa.array(names, pa.int64()), pa.array(pieces, pa.int64()), pa.array(np.diff(np.append(first, len(ids))), pa.int64()), formatted, pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], schema=schema)

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not len(rows):
            continue
        held = rows if held is None else pa.concat_tables([held, rows])
        ids = held.column("conv_id")
        if ids[0].as_py() != ids[len(ids) - 1].as_py():
            same = pc.equal(ids, ids[len(ids) - 1]) if ids[len(ids) - 1].is_valid else ids.is_null()
            cut = pc.index(pc.fill_null(same, False), True).as_py()
            yield emit(held.slice(0, cut))
            held = held.slice(cut)
        if held.nbytes > PIECE_BYTES:
            yield emit(held)
            held = None
    if held is not None and len(held):
        yield emit(held)


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, or per piece of a very long one: FORMATTED. Pieces of a conversation follow each other in a partition."""
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(tidy(_formatted), FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    turns = [x.removesuffix(END).split("\n", 1) for x in formatted.split(START)[1:]]
    return [(unescape_role(r), unescape(t)) for r, t in turns]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now: list | None = None
    done = lambda x: [x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now is None or row["piece"] == 0:
                if now is not None:
                    out.append(done(now))
                now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            whole = row["formatted"]
            for r, t in parse(whole):
                now[1] += 1
                now[2].update(f"{r}\n{t}\n".encode())
            for a, b in zip(row["loss_starts"], row["loss_ends"]):
                said = unescape(whole[a:b])
                now[3] += len(said)
                now[4].update(said.encode())
            now[5] += len(whole)
        yield pa.record_batch([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)
    if now is not None:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip(done(now), schema)], schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of what is under the loss mask, from the output of format_chat alone."""
    return formatted.mapInArrow(tidy(_read_back), READ_BACK)
