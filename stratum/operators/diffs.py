"""Line differences of two texts as unified patches, and patches applied.

Lines are numbers first (equal lines, equal numbers). What both texts begin and end with, and lines that only one of them has,
are settled at once; of the rest, Myers' search for a shortest edit script goes from both ends towards the middle and then
into both halves, in memory that grows with the texts alone; where there are so many edits that it takes longer than a row
of bits for each line, the subsequence is read from such rows. Rows of a table are independent: no shuffle.

Defined results: a null text has no lines, an empty one neither; lines end at \\n, and whether the last one does counts;
equal texts give an empty patch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CONTEXT = 3
NO_END = "\\ No newline at end of file"


def lines_of(text: str | None) -> list[str]:
    return [x for x in re.split(r"(?<=\n)", text or "") if x]


#: Bytes of bit rows that are kept to read pairs from; a larger box is halved first.
ROWS_BYTES = 16 << 20


def _middle(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int] | None:
    """The snake in the middle of a shortest script of a[a0:a1] and b[b0:b1]: where it begins and ends. None if there are so many edits that rows of bits take less."""
    n, m = a1 - a0, b1 - b0
    odd, most = (n - m) & 1, (n + m + 1) // 2
    # a row of bits takes about as long as three steps of the search, and one more for each 7000 bits
    steps, allowed = 0, m * (n + 21_000) // 7000 + 64
    ahead, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        steps += 2 * (d + 1)
        if steps > allowed:
            return None
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            x = ahead.get(k + 1, -1) if k == -d or (k != d and ahead.get(k - 1, -1) < ahead.get(k + 1, -1)) else ahead.get(k - 1, -1) + 1
            y = x - k
            at = x
            while x < n and y < m and a[a0 + x] == b[b0 + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            r = n - m - k
            if odd and -(d - 1) <= r <= d - 1 and r in back and x + back[r] >= n:
                return a0 + at, b0 + at - k, a0 + x, b0 + y
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            x = back.get(k + 1, -1) if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back.get(k - 1, -1) + 1
            y = x - k
            at = x
            while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            r = n - m - k
            if not odd and -d <= r <= d and r in ahead and x + ahead[r] >= n:
                return a1 - x, b1 - y, a1 - at, b1 - (at - k)
    return None


def _bit_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each number of b, a row of bits: the k-th is 0 where the longest common subsequence with the first k + 1 of a is longer than with the first k."""
    places: dict[int, list[int]] = {}
    for k, x in enumerate(a):
        places.setdefault(x, []).append(k)
    masks = {}
    for x in set(b) & places.keys():
        bits = np.zeros(len(a) + 7 & ~7, np.uint8)
        bits[places[x]] = 1
        masks[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if y in masks:
            hit = row & masks[y]
            row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Of the longest common subsequences of b and each beginning of a."""
    row = (1 << len(a)) - 1
    for row in _bit_rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _by_rows(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, by rows of bits: for texts of many edits."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            continue
        if m > 1 and m * (n // 8 + 1) > ROWS_BYTES:
            half = (b0 + b1) // 2
            at = a0 + int(np.argmax(_lengths(a[a0:a1], b[b0:half]) + _lengths(a[a0:a1][::-1], b[half:b1][::-1])[::-1]))
            work += [(a0, at, b0, half), (at, a1, half, b1)]
            continue
        rows = [row.to_bytes(n // 8 + 1, "little") for row in _bit_rows(a[a0:a1], b[b0:b1])]
        i, j = n - 1, m - 1
        while i >= 0 and j >= 0:
            if a[a0 + i] == b[b0 + j]:
                out.append((a0 + i, b0 + j))
                i, j = i - 1, j - 1
            elif rows[j][i >> 3] >> (i & 7) & 1:
                i -= 1
            else:
                j -= 1
    return out


def matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, ascending."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            if snake := _middle(a, b, a0, a1, b0, b1):
                x, y, u, v = snake
                out += zip(range(x, u), range(y, v))
                work += [(a0, x, b0, y), (u, a1, v, b1)]
            else:
                out += [(a0 + i, b0 + j) for i, j in _by_rows(a[a0:a1], b[b0:b1])]
    return sorted(out)


def common(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """matches() of lines: those that only one side has are left out of the search."""
    number: dict[str, int] = {}
    a, b = [number.setdefault(x, len(number)) for x in old], [number.setdefault(x, len(number)) for x in new]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    i = [k for k in range(head, len(a) - tail) if a[k] in both]
    j = [k for k in range(head, len(b) - tail) if b[k] in both]
    inside = [(i[x], j[y]) for x, y in matches([a[k] for k in i], [b[k] for k in j])]
    return [(k, k) for k in range(head)] + inside + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def unified(old: str | None, new: str | None, context: int = CONTEXT) -> tuple[str, int, int, int]:
    """The patch from old to new, and its hunks, removed and added lines."""
    a, b = lines_of(old), lines_of(new)
    steps, x, y = [], 0, 0  # (sign, place in a, place in b)
    for i, j in [*common(a, b), (len(a), len(b))]:
        steps += [("-", k, y) for k in range(x, i)] + [("+", i, k) for k in range(y, j)]
        if i < len(a):
            steps.append((" ", i, j))
        x, y = i + 1, j + 1
    changed = [k for k, s in enumerate(steps) if s[0] != " "]
    out, hunks, k = [], 0, 0
    while k < len(changed):
        last = k
        while last + 1 < len(changed) and changed[last + 1] - changed[last] <= 2 * context + 1:
            last += 1
        part = steps[max(0, changed[k] - context) : changed[last] + context + 1]
        olds, news = [s for s in part if s[0] != "+"], [s for s in part if s[0] != "-"]
        at = lambda place, size: f"{place + 1 if size else place},{size}" if size != 1 else str(place + 1)
        out.append(f"@@ -{at(part[0][1], len(olds))} +{at(part[0][2], len(news))} @@\n")
        for sign, i, j in part:
            line = b[j] if sign == "+" else a[i]
            out.append(sign + (line if line.endswith("\n") else f"{line}\n{NO_END}\n"))
        hunks, k = hunks + 1, last + 1
    minus = sum(s[0] == "-" for s in steps)
    return ("--- before\n+++ after\n" + "".join(out) if out else ""), hunks, minus, len(changed) - minus


def patched(old: str | None, patch: str) -> str:
    """What the patch makes of the text; an error if the text isn't the one it was made for."""
    a, out, at = lines_of(old), [], 0
    rows = re.split(r"(?<=\n)", patch)[2:] if patch else []
    for k, row in enumerate(rows):
        if head := re.match(r"@@ -(\d+)(?:,(\d+))? \+", row):
            start = int(head[1]) - (head[2] != "0")
            out += a[at:start]
            at = start
        elif row[:1] in (" ", "-", "+") and row:
            line = row[1:-1] if k + 1 < len(rows) and rows[k + 1].startswith(NO_END) else row[1:]
            if row[0] != "+":
                if at >= len(a) or a[at] != line:
                    raise ValueError(f"the patch doesn't fit line {at + 1}")
                at += 1
            if row[0] != "-":
                out.append(line)
    return "".join(out + a[at:])


def diffs(pairs: DataFrame, id: str, old: str = "old", new: str = "new", context: int = CONTEXT) -> DataFrame:
    """id, patch, hunks, removed, added of each row."""
    kind = pairs.select(id).schema[0].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = [unified(a, b, context) for a, b in zip(f["_old"], f["_new"])]
            yield pd.DataFrame([(i, *t) for i, t in zip(f["_id"], told)], columns=["_id", "patch", "hunks", "removed", "added"])

    rows = pairs.select(pairs[id].alias("_id"), pairs[old].alias("_old"), pairs[new].alias("_new"))
    return rows.mapInPandas(run, f"_id {kind}, patch string, hunks int, removed int, added int").withColumnRenamed("_id", id)


def patches_applied(rows: DataFrame, id: str, old: str = "old", patch: str = "patch") -> DataFrame:
    """id, text: what each row's patch makes of its old text."""
    kind = rows.select(id).schema[0].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"_id": f["_id"], "text": [patched(a, p) for a, p in zip(f["_old"], f["_patch"])]})

    return rows.select(rows[id].alias("_id"), rows[old].alias("_old"), rows[patch].alias("_patch")).mapInPandas(run, f"_id {kind}, text string").withColumnRenamed("_id", id)
