"""Column functions over the scripts of a text: runs of one script, the main one, and filters on terms and headings by script."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratum.functions.normalise import bound, spaced, text_of

#: Scripts that are told apart, in the order in which ties go, and their letters.
SCRIPTS: dict[str, str] = {"hangul": "가-힣ᄀ-ᇿㄱ-ㆎ", "latin": "A-Za-zÀ-ÖØ-öø-ʯ", "han": "㐀-䶿一-鿿", "kana": "ぁ-ヿ", "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽ", "digit": "0-9"}
#: Numbers before a heading; headings that are commands, and such as name an extension point.
NUMBERING = r"(?i)^\s*(?:chapter\s+\d+\.?\s*|(?:\d+|[A-Za-z])(?:\.\d+)*+\.?\s*)"
COMMAND = r"(?i)^(?:oc|kubectl)\s+[A-Za-z0-9._:/-]+(?:\s+[A-Za-z0-9._:/-]+)*+$"
EXTENSION_POINT = r"^[A-Za-z0-9_-]+(?:[./][A-Za-z0-9_-]+)++$"
#: Fixed value: characters that make a term a technical one.
TECHNICAL = r"[-/_.<>]"


def script_runs(text: Column, scripts: Mapping[str, str] = SCRIPTS) -> Column:
    """array<struct<script, run>>: the runs of one script each, in order; what is of no script parts them and is left out."""
    runs = F.regexp_extract_all(text_of(text), F.lit("(" + "|".join(f"[{letters}]+" for letters in scripts.values()) + ")"), F.lit(1))

    def script(run: Column) -> Column:
        return F.coalesce(*[F.when(run.rlike(f"^[{letters}]"), name) for name, letters in scripts.items()])

    return F.transform(runs, lambda r: F.struct(script(r).alias("script"), r.alias("run")))


def _counted(text: Column, scripts: Mapping[str, str], told: Callable[[list[tuple[str, Column]]], Column]) -> Column:
    """told() of the characters of each script that a text has. ASCII is looked through for scripts with such letters alone, the rest of the text, mostly short, for all."""
    ascii_of = {name: "".join(c for c in map(chr, range(128)) if re.match(f"[{letters}]", c)) for name, letters in scripts.items()}
    left = lambda x, letters: F.length(F.regexp_replace(x, f"[^{letters}]+", ""))

    def counts(x: Column) -> Column:
        count = lambda name: left(x["rest"], scripts[name]) + (left(x["text"], "".join(f"\\x{ord(c):02x}" for c in ascii_of[name])) if ascii_of[name] else F.lit(0))
        return bound(F.struct(*[count(name).alias(name) for name in scripts]), lambda c: told([(name, c[name]) for name in scripts]))

    whole = F.struct(text_of(text).alias("text"), F.regexp_replace(text_of(text), r"[\x00-\x7f]+", "").alias("rest"))
    return bound(whole, counts)


def script_letters(text: Column, scripts: Mapping[str, str] = SCRIPTS) -> Column:
    """How many characters of each script a text has, as a map; scripts that it hasn't are left out."""
    entries = lambda counts: F.array(*[F.struct(F.lit(name).alias("k"), c.cast("long").alias("v")) for name, c in counts])
    return F.map_from_entries(F.filter(_counted(text, scripts, entries), lambda c: c["v"] > 0))


def main_script(text: Column, scripts: Mapping[str, str] = SCRIPTS) -> Column:
    """The script of the most characters, digits aside; of several the first of the ladder; null without any."""

    def first(counts: list[tuple[str, Column]]) -> Column:
        most = F.greatest(*[c for _, c in counts], F.lit(0))
        return F.when(most > 0, F.coalesce(*[F.when(c == most, name) for name, c in counts]))

    return _counted(text, {name: letters for name, letters in scripts.items() if name != "digit"}, first)


def has_script(text: Column, script: str) -> Column:
    return text_of(text).rlike(f"[{SCRIPTS[script]}]")


def filtered_terms(query: Column, terms: Column, allowed: Sequence[str], script: str = "hangul") -> Column:
    """Of a query's terms those that fit a query in the script: terms in it, terms that the query has, allowed ones, and technical ones (with a capital, a digit or one of TECHNICAL). In order, spaces collapsed, blanks left out."""
    known = F.array(*[F.lit(a.lower()) for a in allowed]).cast("array<string>")
    clean = F.filter(F.transform(terms, spaced), lambda t: t != "")
    # what one look at a term tells comes first
    fits = rf"[{SCRIPTS[script]}\p{{Lu}}\p{{Nd}}]|{TECHNICAL}"
    return bound(F.lower(text_of(query)), lambda lowered: F.filter(clean, lambda t: t.rlike(fits) | lowered.contains(F.lower(t)) | F.array_contains(known, F.lower(t))))


def bare_heading(heading: Column) -> Column:
    """A heading without its number, spaces collapsed."""
    return spaced(F.regexp_replace(text_of(heading), NUMBERING, ""))


def counts_as_english(heading: Column, script: str = "hangul") -> Column:
    """Whether a heading is in Latin letters alone and neither a command nor the name of an extension point."""
    bare = bare_heading(heading)
    return bare.rlike("[A-Za-z]") & ~bare.rlike(f"[{SCRIPTS[script]}]") & ~bare.rlike(COMMAND) & ~bare.rlike(EXTENSION_POINT)


def is_reference_heavy(slug: Column, named: Sequence[str] = (), suffix: str = "_apis") -> Column:
    """Whether a book is mostly reference: by its slug's end, or by name."""
    bare = F.trim(text_of(slug))
    return bare.endswith(suffix) | bare.isin(*named) if named else bare.endswith(suffix)
