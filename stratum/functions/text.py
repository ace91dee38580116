"""Column functions over text and quantities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is a run of Hangul syllables, or of ASCII letters, digits, dots, dashes and underscores.
TOKEN = r"[가-힣]+|[A-Za-z0-9_.-]+"
LOWER_TOKEN = r"[가-힣]+|[a-z0-9_.-]+"


def tokens(text: Column) -> Column:
    """Tokens in order, in lower case: the Kelvin sign and the dotted capital I, which alone would become ASCII letters, part tokens."""
    return F.regexp_extract_all(F.lower(F.translate(text, "\u212a\u0130", "  ")), F.lit(LOWER_TOKEN), F.lit(0))


_ASCII = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-", np.uint8)
_KIND = np.zeros(256, np.uint8)
_KIND[_ASCII] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same tokens inside a task: those of all texts (null: none) one after the other, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if off[0] == off[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
    off -= off[0]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    kind = _KIND[data]
    # Hangul syllables take three bytes, EA B0 80 to ED 9E A3
    at = np.flatnonzero((data >= 0xEA) & (data <= 0xED))
    at = at[at < len(data) - 2]
    if len(at):
        second, third = data[at + 1], data[at + 2]
        code = ((data[at] & 15).astype(np.int32) << 12) | ((second & 63).astype(np.int32) << 6) | (third & 63)
        at = at[(second >> 6 == 2) & (third >> 6 == 2) & (code >= 0xAC00) & (code <= 0xD7A3) & ~edge[at + 1] & ~edge[at + 2]]
        for k in range(3):
            kind[at + k] = 2
    edge[1:-1] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(edge)  # the last one is the end
    own = kind[runs[:-1]] > 0
    starts, lengths = runs[:-1][own], np.diff(runs)[own]
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    found = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(_LOWER[data[kind > 0]]))
    return found, np.diff(np.searchsorted(starts, off))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def strip_section_prefix(path: Column) -> Column:
    """The last part of 'a > b > 1.2. c' without its number; the part itself if nothing is left."""
    last = F.trim(F.element_at(F.split(path, ">"), -1))
    bare = F.trim(F.regexp_replace(last, r"^[0-9]+([.][0-9]+)*+[.]?", ""))
    return F.when(bare == "", last).otherwise(bare)


def slugify(text: Column, default: str = "workspace") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(slug == "", default).otherwise(slug)


def is_missing(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def cpu_millicores(quantity: Column) -> Column:
    """'250m', '500u', '7n' or plain cores as millicores."""
    number = F.regexp_extract(quantity, r"^([0-9.]+)", 1).cast("double")
    unit = F.regexp_extract(quantity, r"^[0-9.]+([a-z]*)$", 1)
    return F.when(unit == "n", number / 1e6).when(unit == "u", number / 1e3).when(unit == "m", number).otherwise(number * 1000)


def memory_mib(quantity: Column) -> Column:
    """'64Ki', '512Mi', '1Gi', '2Ti' or plain bytes as MiB."""
    number = F.regexp_extract(quantity, r"^([0-9.]+)", 1).cast("double")
    unit = F.regexp_extract(quantity, r"^[0-9.]+([A-Za-z]*)$", 1)
    return F.when(unit == "Ki", number / 1024).when(unit == "Mi", number).when(unit == "Gi", number * 1024).when(unit == "Ti", number * 1024 * 1024).otherwise(number / (1024 * 1024))


#: Fixed value: the namespace of name-based ids for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based (SHA-1) UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def ordered_unique(values: Column) -> Column:
    """Trimmed values, the first of those that differ in case only, in order."""
    kept = lambda a, x: F.when((F.trim(x) == "") | F.exists(a, lambda y: F.lower(y) == F.lower(F.trim(x))), a).otherwise(F.concat(a, F.array(F.trim(x))))
    return F.aggregate(values, F.array().cast("array<string>"), kept)


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is empty, without length, or not as long as the other."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))
