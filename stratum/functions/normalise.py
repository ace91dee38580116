"""Column functions that clean headings, code, paragraphs, citations, commands and queries.

All are built from Spark's own functions, folds over arrays included, so that they stay in the JVM. A null counts as an empty
text unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths below which a paragraph stays whole, and up to which sentences share one; lengths of excerpts.
WHOLE_PARAGRAPH, FULL_PARAGRAPH, SENTENCES = 210, 200, 2
LONG_EXCERPT, SHORT_EXCERPT = 900, 240
#: The words that open a note, and its kind.
NOTES = {"주의": "warning", "경고": "warning", "중요": "important", "참고": "note", "팁": "tip", "warning": "warning", "caution": "caution", "important": "important", "note": "note", "tip": "tip"}
#: Beginnings of a list of prerequisites.
PREREQUISITES = ("사전 요구 사항", "사전 요구사항", "Prerequisites")
#: Fixed value: fenced parts of a marked text.
FENCED = r"(?s)(\[CODE(?:\s+[^\]]+)?\].*?\[/CODE\]|\[TABLE(?:\s+[^\]]+)?\].*?\[/TABLE\])"
EPOCH = "1970-01-01T00:00:00Z"
_CUT = "\u001e"


def text_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def spaced(value: Column) -> Column:
    """Trimmed, with each run of white space as one space."""
    return F.trim(F.regexp_replace(text_of(value), r"\s+", " "))


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def without_blank(values: Column) -> Column:
    return F.filter(values, lambda x: x.rlike(r"\S"))


def distinct_in_order(values: Column, key=lambda x: x) -> Column:
    """The first of those that share a key, in order."""
    step = lambda kept, x: F.when(F.exists(kept, lambda y: key(y) == key(x)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.aggregate(values, F.array().cast("array<string>"), step)


# headings, code, paragraphs


def clean_heading(text: Column, suffix: str = r"\s*(?:Copy link\s*Link copied to clipboard!|링크 복사\s*링크가 클립보드에 복사되었습니다!)\s*") -> Column:
    """Without what a copy button leaves."""
    return spaced(F.regexp_replace(text_of(text), suffix, ""))


def clean_code(code: Column) -> Column:
    """One kind of line end, tabs as spaces to the next fourth column, no spaces at line ends, no blank lines at the edges."""
    lines = F.split(F.regexp_replace(text_of(code), r"\r\n?", "\n"), "\n", -1)

    def widened(line: Column) -> Column:
        step = lambda a, part: F.concat(a, F.repeat(F.lit(" "), (4 - F.length(a) % 4).cast("int")), part)
        parts = F.split(line, "\t", -1)
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.element_at(parts, 1), step)

    ended = F.transform(lines, lambda x: F.regexp_replace(widened(x), r"\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(ended, "\n"), r"^(?:[ ]*\n)++", ""), r"\n+$", "")


def sentences(text: Column) -> Column:
    return without_blank(F.split(spaced(text), r"(?<=[.!?])\s+", -1))


def paragraphs(text: Column) -> Column:
    """A paragraph as short ones: of SENTENCES sentences at most, and no further one where they would be above FULL_PARAGRAPH characters."""
    whole, parts = spaced(text), sentences(text)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"), F.lit(0).alias("size"))

    def step(a: Column, s: Column) -> Column:
        full = (a["n"] > 0) & ((a["size"] + F.length(s) > FULL_PARAGRAPH) | (a["n"] >= SENTENCES))
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(full | (a["n"] == 0), s).otherwise(F.concat(a["open"], F.lit(" "), s)).alias("open"),
            F.when(full, 1).otherwise(a["n"] + 1).alias("n"),
            (F.when(full, 0).otherwise(a["size"]) + F.length(s) + 1).alias("size"),
        )

    split = F.aggregate(parts, empty, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return F.when(whole == "", F.array().cast("array<string>")).when((F.length(whole) < WHOLE_PARAGRAPH) | (F.size(parts) < 2), F.array(whole)).otherwise(split)


def prose(text: Column) -> Column:
    """Prose as short paragraphs with blank lines between: no space before closing marks or after opening brackets."""
    plain = F.regexp_replace(F.translate(F.regexp_replace(text_of(text), r"\r\n?", "\n"), " ", " "), r"[ \t]+", " ")

    def cleaned(x: Column) -> Column:
        x = F.trim(F.regexp_replace(x, r"\s*\n\s*", " "))
        return F.regexp_replace(F.regexp_replace(x, r"\s+([,.:;!?%)\]])", "$1"), r"([(\[])\s+", "$1")

    return F.array_join(F.flatten(F.transform(without_blank(F.split(plain, r"\n\s*\n+", -1)), lambda x: paragraphs(cleaned(x)))), "\n\n")


def fence_parts(text: Column) -> Column:
    """The text in parts, in order: fenced code and tables whole, and what stands between."""
    return without_blank(F.split(F.regexp_replace(text_of(text), FENCED, _CUT + "$1" + _CUT), _CUT, -1))


def is_fenced(part: Column) -> Column:
    return F.trim(part).startswith("[CODE") | F.trim(part).startswith("[TABLE")


def prose_around_fences(text: Column) -> Column:
    """prose(), with fenced code and tables left as they are."""
    done = F.transform(fence_parts(text), lambda x: F.when(is_fenced(x), F.trim(x)).otherwise(prose(x)))
    return F.array_join(without_blank(done), "\n\n")


def trim_leading(text: Column, patterns: Sequence[str]) -> Column:
    """Without what the patterns match at the beginning, as often as they do."""
    return F.trim(F.regexp_replace(F.trim(text_of(text)), r"\A(?:(?:" + "|".join(patterns) + r")\s*)++", ""))


def code_marker(code: Column, language: Column | None = None, caption: Column | None = None) -> Column:
    """Code between marks that carry its attributes; blank attributes are left out."""
    attributes = [("language", language), ("caption", caption)]
    plain = lambda v: spaced(F.translate(v, '"', "'"))
    shown = [F.when(plain(v) != "", F.concat(F.lit(f' {k}="'), plain(v), F.lit('"'))).otherwise("") for k, v in attributes if v is not None]
    return F.concat(F.lit("\n\n[CODE"), *shown, F.lit("]\n"), code, F.lit("\n[/CODE]\n\n"))


def marker_attributes(mark: Column) -> Column:
    """key="value" pairs of a mark as a map; the last of equal keys counts."""
    pairs = F.regexp_extract_all(text_of(mark), F.lit(r'([a-z_]+="(?:[^"\\]++|\\.)*+")'), F.lit(1))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.trim(F.regexp_extract(p, r'(?s)^[a-z_]+="(.*)"$', 1)).alias("v")))
    last = F.filter(entries, lambda e: e == F.element_at(F.filter(entries, lambda o: o["k"] == e["k"]), -1))
    return F.map_from_entries(F.array_distinct(last))


# sections and blocks


def block_texts(text: Column) -> Column:
    """Blocks of a marked text in order: each fenced part whole, and paragraphs at blank lines."""
    return without_blank(F.flatten(F.transform(fence_parts(text), lambda x: F.when(is_fenced(x), F.array(stripped(x))).otherwise(F.transform(F.split(x, r"\n\s*\n+", -1), stripped)))))


def note_word(block: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(block), r"(?is)^(" + "|".join(NOTES) + r")\s*[:：]\s*.+$", 1))


def procedure_lines(block: Column) -> Column:
    return without_blank(F.transform(F.split(text_of(block), "\n", -1), lambda x: F.trim(x)))


def is_procedure(block: Column) -> Column:
    """All lines are numbered steps, or points below one."""
    lines = procedure_lines(block)
    return F.coalesce((F.size(lines) > 0) & F.element_at(F.when(F.size(lines) > 0, lines), 1).rlike(r"^\d+\.\s+\S") & F.forall(lines, lambda x: x.rlike(r"^(?:\d+\.|[-*])\s+\S")), F.lit(False))


def block_kind(block: Column) -> Column:
    kinds = F.when(F.trim(block).startswith("[CODE"), "code").when(F.trim(block).startswith("[TABLE"), "table").when(note_word(block) != "", "note")
    begins = F.lit(False)
    for p in PREREQUISITES:
        begins = begins | (F.trim(block).startswith(p) & (F.length(F.trim(block)) > len(p) + 1))
    return kinds.when(begins, "prerequisite").when(is_procedure(block), "procedure").otherwise("paragraph")


def steps(block: Column) -> Column:
    """Of a procedure: its steps (ordinal, text) with their points."""
    begin = F.struct(F.array().cast("array<struct<ordinal:int,text:string,points:array<string>>>").alias("steps"))

    def step(a: Column, line: Column) -> Column:
        own = F.struct(F.regexp_extract(line, r"^(\d+)\.", 1).cast("int").alias("ordinal"), F.trim(F.regexp_replace(line, r"^\d+\.\s+", "")).alias("text"), F.array().cast("array<string>").alias("points"))
        last = F.element_at(a["steps"], -1)
        more = F.struct(last["ordinal"].alias("ordinal"), last["text"].alias("text"), F.concat(last["points"], F.array(F.trim(F.regexp_replace(line, r"^[-*]\s+", "")))).alias("points"))
        return F.struct(F.when(line.rlike(r"^\d+\."), F.concat(a["steps"], F.array(own))).otherwise(F.concat(F.slice(a["steps"], F.lit(1), F.size(a["steps"]) - 1), F.array(more))).alias("steps"))

    return F.when(is_procedure(block), F.aggregate(procedure_lines(block), begin, step, lambda a: a["steps"]))


def unique_anchors(anchors: Column) -> Column:
    """Anchors in order; the nth of equal ones ends in -n. A blank one is 'section'."""
    named = F.transform(anchors, lambda a: F.when(F.trim(text_of(a)) == "", "section").otherwise(F.trim(a)))
    nth = lambda i: F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda x: x == F.element_at(named, i + 1)))
    return F.transform(named, lambda a, i: F.when(nth(i) > 1, F.concat(a, F.lit("-"), nth(i).cast("string"))).otherwise(a))


def markdown_anchors(text: Column) -> Column:
    """Anchors of a Markdown text's headings."""
    titles = F.regexp_extract_all(text_of(text), F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$"), F.lit(1))
    plain = F.transform(titles, lambda t: F.trim(F.translate(F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1"), "`", "")))
    slug = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s-]", " "), r"\s+", "-"), r"^-+|-+$", "")
    return unique_anchors(F.transform(without_blank(plain), slug))


def section_prefix(title: Column, path: Column) -> Column:
    """What a chunk's text begins with: title, path, a blank line."""
    joined = F.array_join(without_blank(path), " > ")
    return F.concat(text_of(title), F.when(joined != "", F.concat(F.lit("\n"), joined)).otherwise(""), F.lit("\n\n"))


def first_role(text: Column, ladder: Sequence[tuple[str, Sequence[str]]], default: str = "unknown") -> Column:
    """The first role of a ladder (role, words) of which a word stands in the text."""
    lowered, role = F.lower(text_of(text)), None
    for name, words in ladder:
        hit = F.lit(False)
        for w in words:
            hit = hit | lowered.contains(w.lower())
        role = F.when(hit, name) if role is None else role.when(hit, name)
    return F.lit(default) if role is None else role.otherwise(default)


# citations and excerpts


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.lower(text_of(text)).contains(w))


def citation_identity(path: Column, url: Column, anchor: Column) -> Column:
    """Where a citation leads, however it is written: its viewer path, or else url#anchor."""
    own = lambda c: F.lower(F.trim(text_of(c)))
    return F.when(own(path) != "", own(path)).otherwise(F.concat(own(url), F.lit("#"), own(anchor)))


def excerpt(text: Column, length: int = LONG_EXCERPT) -> Column:
    return F.substring(spaced(text), 1, length)


def section_core(section: Column) -> Column:
    return F.regexp_replace(F.lower(spaced(section)), r"^\d+(?:\.\d+)*+\.?\s*", "")


def anchor_root(anchor: Column) -> Column:
    return F.substring_index(F.lower(F.trim(text_of(anchor))), "_", 1)


def cited_numbers(answer: Column, last: Column) -> Column:
    """Numbers in [n] marks from 1 to last, in the order of their first use."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text_of(answer), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")), lambda n: (n >= 1) & (n <= last)))


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value computed once a row, however often it is named inside."""
    return F.element_at(F.transform(F.array(value), made), 1)


def renumbered(answer: Column, identities: Column) -> Column:
    """struct(text, kept): [n] marks by first use, one number for each identity, no doubled marks; kept: which citations stay, in their new order."""

    def done(text: Column, ids: Column, used: Column, whose: Column) -> Column:
        # the first mark of each identity stays
        own = F.array_distinct(whose)
        kept = F.transform(own, lambda o: F.element_at(used, F.array_position(whose, o).cast("int")))
        pairs = F.arrays_zip(used.alias("n"), F.transform(whose, lambda o: F.array_position(own, o)).alias("number"))
        # numbers are marked while they are set, so that none is set twice
        marked = F.aggregate(pairs, text, lambda a, p: F.replace(a, F.concat(F.lit("["), p["n"].cast("string"), F.lit("]")), F.concat(F.lit("[\u0001"), p["number"].cast("string"), F.lit("]"))))
        known = F.translate(F.regexp_replace(marked, r"\[\d{1,9}\]", ""), "\u0001", "")
        single = F.regexp_replace(known, r"(\[\d+\])(?:\s*\1)++", "$1")
        return F.when(F.size(used) == 0, F.struct(text.alias("text"), F.array().cast("array<int>").alias("kept"))).otherwise(F.struct(F.trim(F.regexp_replace(single, r"[ \t]+", " ")).alias("text"), kept.alias("kept")))

    given = F.struct(text_of(answer).alias("text"), identities.alias("ids"))
    used = lambda g: bound(cited_numbers(g["text"], F.size(g["ids"])), lambda u: bound(F.transform(u, lambda n: F.element_at(g["ids"], n)), lambda w: done(g["text"], g["ids"], u, w)))
    return bound(given, used)


# commands, signals and queries


def clean_command(text: Column) -> Column:
    """Without the prompt before it."""
    return F.trim(F.regexp_replace(F.trim(text_of(text)), r"^(?:[$#]\s*)++", ""))


def signal(value: Column) -> Column:
    return F.lower(spaced(value))


def structured_keys(text: Column, key: str = r"[a-z0-9.-]+/[a-z0-9._-]+(?:=[a-z0-9._-]*)?") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(text)), F.lit(f"({key})"), F.lit(1)))


def inline_commands(text: Column, programs: Sequence[str]) -> Column:
    """Commands between backticks that begin with one of the programs, first of each kept."""
    found = F.transform(F.regexp_extract_all(text_of(text), F.lit("`([^`\n]+)`"), F.lit(1)), clean_command)
    return F.array_distinct(F.filter(found, lambda c: c.rlike(r"^(?:" + "|".join(programs) + r")\s")))


def replaced_in_order(text: Column, terms: Mapping[str, str]) -> Column:
    for old, new in terms.items():
        text = F.replace(text_of(text), F.lit(old), F.lit(new))
    return text


def appended_terms(base: Column, terms: Column) -> Column:
    """The words of a query, then those of the terms that it hasn't, without regard to case."""
    words = F.filter(F.split(F.concat_ws(" ", base, F.array_join(terms, " ")), r"\s+"), lambda x: x != "")
    return F.array_join(distinct_in_order(words, F.lower), " ")


def rewritten(query: Column, *hints: tuple[str, Column]) -> Column:
    """The query, and 'label value' for each hint that isn't blank, with ' | ' between."""
    shown = [F.when(spaced(v) != "", F.concat(F.lit(label + " "), spaced(v))) for label, v in hints]
    return F.concat_ws(" | ", spaced(query), *shown)


def sub_queries(query: Column, conjunctions: Sequence[str] = ("그리고", "and then", "and also")) -> Column:
    """A query, then its questions and its clauses around conjunctions, where those have two words at least; none twice."""
    whole = spaced(query)
    cut = lambda q, pattern: F.filter(F.transform(F.split(q, pattern, -1), lambda x: F.trim(x)), lambda x: F.size(F.split(x, " ")) >= 2)
    questions = cut(whole, r"[?？]")
    clauses = F.flatten(F.transform(questions, lambda q: cut(q, r"\s(?:" + "|".join(conjunctions) + r")\s")))
    parts = F.when((F.size(questions) > 1) | (F.size(clauses) > F.size(questions)), F.concat(questions, clauses)).otherwise(F.array().cast("array<string>"))
    return without_blank(distinct_in_order(F.concat(F.array(whole), parts), F.lower))


def counts_in(query: Column) -> Column:
    return F.transform(F.regexp_extract_all(text_of(query), F.lit(r"(\d{1,9})"), F.lit(1)), lambda x: x.cast("int"))


def manifest_kind(manifest: Column, default: str) -> Column:
    kind = F.lower(F.regexp_extract(text_of(manifest), r"(?m)^kind:[ \t]*([A-Za-z]+)[ \t]*$", 1))
    return F.when(kind == "", default).otherwise(kind)


# numbers, times, JSON, terms


def round_score(value: Column) -> Column:
    return F.round(value.cast("double"), 4)


def safe_rate(matched: Column, total: Column) -> Column:
    return F.round(matched / F.greatest(total, F.lit(1)), 4)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def known_time(value: Column) -> Column:
    """A time as text; blank is the epoch, so that it comes first."""
    return F.when(F.trim(text_of(value)) == "", EPOCH).otherwise(F.trim(value))


def http_time(value: Column) -> Column:
    """'Tue, 15 Nov 1994 08:12:31 GMT' as an ISO time in UTC; null if it isn't one."""
    parts = F.regexp_extract(text_of(value), r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.date_format(F.try_to_timestamp(F.when(parts != "", parts), F.lit("d MMM yyyy HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unfenced_json(text: Column) -> Column:
    """What stands between ``` fences, or else from the first to the last brace."""
    inner = F.regexp_extract(text_of(text), r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    plain = F.when(inner != "", inner).otherwise(text_of(text))
    return F.regexp_extract(plain, r"(?s)(\{.*\}|\[.*\])", 1)


def absent(text: Column, terms: Column) -> Column:
    """Terms that the text hasn't, without regard to case and spacing."""
    return F.filter(terms, lambda t: ~signal(text).contains(signal(t)))


def present(text: Column, terms: Column) -> Column:
    return F.filter(terms, lambda t: signal(text).contains(signal(t)))
