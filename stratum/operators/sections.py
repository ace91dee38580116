"""Pages and texts as sections, blocks, manuals and search rows.

A page's content part is marked up by built-in functions: code and tables between marks, headings as marked lines. Marked
texts are cut at headings, paths are windows over one document's headings, and all further shapes are projections. No step
runs in Python, and no group is larger than one document's sections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import normalise as n
from stratum.operators.retrieval import kept

#: Elements that hold the content, best first, and elements that hold none.
ROOTS = ("article", "main", "body")
NOISE = ("script", "style", "nav", "header", "footer", "noscript", "button", "svg")
#: Headings of sections that are left out.
NOISE_HEADINGS = r"(?i)^(?:legal notice|법적 고지|이 콘텐츠는 선택한 언어로 제공되지 않습니다\.?|this content is not available in (?:the )?selected language\.?)$"
#: Character references with a name that pages use most.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}
_HEAD, _TITLE, _BODY = "\u0001", "\u0002", "\u0003"
LEVELS = 6


def _element(html: Column, tag: str) -> Column:
    """What the elements of a tag hold, one after the other; what stands between two of them isn't theirs, nested ones are."""
    one = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1)
    parts = F.split(html, rf"(?i)(?=</?{tag}\b)", -1)
    after = lambda p: F.when(F.instr(p, ">") > 0, F.substring(p, F.instr(p, ">") + 1, F.lit(1 << 30))).otherwise("")
    opens, ends = (lambda p: p.rlike(rf"(?i)^<{tag}\b")), (lambda p: p.rlike(rf"(?i)^</{tag}\b"))
    none = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("held"))

    def step(a: Column, p: Column) -> Column:
        depth = F.when(opens(p), a["depth"] + 1).when(ends(p), F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        own = F.when(opens(p) | ends(p), after(p)).otherwise(p)
        # the end of one element parts what it holds from what the next one does
        kept = F.when(depth > 0, F.concat(a["held"], F.array(own))).when(ends(p), F.concat(a["held"], F.array(F.lit("\n\n")))).otherwise(a["held"])
        return F.struct(depth.alias("depth"), kept.alias("held"))

    several = n.stripped(F.array_join(F.aggregate(parts, none, step, lambda a: a["held"]), ""))
    return F.when(F.size(F.filter(parts, opens)) > 1, several).otherwise(one)


def content_root(html: Column, roots: Sequence[str] = ROOTS) -> Column:
    """What the first of the roots holds that the page has, or the page."""
    return F.coalesce(*[F.nullif(_element(html, t), F.lit("")) for t in roots], n.text_of(html))


def page_title(html: Column) -> Column:
    """The first heading of level 1 or 2, or what the title says before a bar, or 'Untitled'."""
    plain = lambda c: n.clean_heading(unescaped(F.regexp_replace(c, r"<[^>]*>", "")))
    heads = [plain(F.regexp_extract(n.text_of(html), rf"(?is)<h{k}\b[^>]*>(.*?)</h{k}\s*>", 1)) for k in (1, 2)]
    title = n.spaced(F.substring_index(plain(F.regexp_extract(n.text_of(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), "|", 1))
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (*heads, title)], F.lit("Untitled"))


def unescaped(text: Column) -> Column:
    """Character references as characters: those of NAMED, and all that are numbers."""
    number = lambda r: F.coalesce(F.conv(F.regexp_extract(r, r"(?i)^&#x([0-9a-f]{1,6});$", 1), 16, 10).cast("int"), F.regexp_extract(r, r"^&#([0-9]{1,7});$", 1).try_cast("int"))
    valid = lambda c: (c > 0) & (c < 0x110000) & ~c.between(0xD800, 0xDFFF)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)(&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});)"), F.lit(1)))
    put = lambda a, r: F.when(valid(number(r)), F.replace(a, r, F.decode(F.unhex(F.lpad(F.hex(number(r)), 8, "0")), "UTF-32"))).otherwise(a)
    text = F.aggregate(found, text, put)
    for name, char in NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def marked_text(html: Column) -> Column:
    """The content part as text: headings between control characters, [CODE] and [TABLE] parts, blank lines between blocks."""
    x = F.translate(content_root(html), _HEAD + _TITLE + _BODY, "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    for tag in NOISE:
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    x = F.regexp_replace(x, r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>", f"\n\n{_HEAD}$1{_TITLE}$2{_BODY}\n\n")
    x = F.regexp_replace(x, r"(?is)<pre\b[^>]*>(.*?)</pre\s*>", "\n\n[CODE]\n$1\n[/CODE]\n\n")
    x = F.regexp_replace(x, r"(?is)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ")
    x = F.regexp_replace(x, r"(?is)\s*<tr\b[^>]*>\s*", "\n")
    x = F.regexp_replace(x, r"(?is)<table\b[^>]*>", "\n\n[TABLE]")
    x = F.regexp_replace(x, r"(?is)\s*</table\s*>", "\n[/TABLE]\n\n")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?is)</?(?:p|div|section|article|ul|ol|li|dl|dt|dd|blockquote|figure|aside|main|body)\b[^>]*>", "\n\n")
    return unescaped(F.regexp_replace(x, r"<[^>]*>", ""))


def marked_markdown(text: Column) -> Column:
    """A Markdown text in the same form: fences become [CODE] parts, tables [TABLE] parts, # lines headings outside of fences."""
    x = F.translate(F.regexp_replace(n.text_of(text), r"\r\n?", "\n"), _HEAD + _TITLE + _BODY, "")
    x = F.regexp_replace(x, r"(?sm)^[ ]{0,3}(```|~~~)([^\n]*)\n(.*?)^[ ]{0,3}\1[`~]*[ ]*$", "\n\n[CODE]\n$3[/CODE]\n\n")
    x = F.regexp_replace(x, r"(?m)((?:^\|.*\|[ ]*$\n?)++)", "\n\n[TABLE]\n$1\n[/TABLE]\n\n")
    parts = F.transform(n.fence_parts(x), lambda p: F.when(n.is_fenced(p), F.concat(F.lit("\n\n"), _rows(p), F.lit("\n\n"))).otherwise(F.regexp_replace(p, r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", f"\n\n{_HEAD}$1{_TITLE}$2{_BODY}\n\n")))
    return F.array_join(parts, "")


def _rows(part: Column) -> Column:
    """A fenced part; of a table, rows without outer bars and without the line below its head."""
    lines = F.transform(F.filter(F.split(part, "\n"), lambda x: ~x.rlike(r"^\s*\|[\s|:-]*-[\s|:-]*\|\s*$") & (F.trim(x) != "")), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\|\s*|\s*\|$", ""), r"\s*\|\s*", " | "))
    return F.when(F.trim(part).startswith("[TABLE"), F.array_join(lines, "\n")).otherwise(F.trim(part))


def marked_asciidoc(text: Column) -> Column:
    """An AsciiDoc text in the same form: = lines are headings, ---- listings [CODE] parts, |=== tables [TABLE] parts; attributes and comments go."""
    x = F.translate(F.regexp_replace(n.text_of(text), r"\r\n?", "\n"), _HEAD + _TITLE + _BODY, "")
    x = F.regexp_replace(x, r"(?m)^(?:-{4,}|\.{4,})[ ]*\n((?s:.*?))^(?:-{4,}|\.{4,})[ ]*$", "\n\n[CODE]\n$1[/CODE]\n\n")
    x = F.regexp_replace(x, r"(?m)^\|={3,}[ ]*\n((?s:.*?))^\|={3,}[ ]*$", "\n\n[TABLE]\n$1[/TABLE]\n\n")

    def plain(p: Column) -> Column:
        p = F.regexp_replace(p, r"(?m)^(?://.*|:[\w-]+:.*|\[[^\]\n]*\])$\n?", "")
        p = F.regexp_replace(p, r"(?m)^(={1,6})[ \t]+(.+?)[ \t]*$", f"\n\n{_HEAD}$1{_TITLE}$2{_BODY}\n\n")
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(?:link|xref):\S*?\[([^\]\n]*)\]", "$1"), r"<<[^,>\n]*,([^>\n]*)>>", "$1"), r"(?m)^[ ]*([*.]+)[ ]+", "- ")

    cells = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?m)^\|[ ]*", ""), r"[ ]*\|[ ]*", " | ")
    return F.array_join(F.transform(n.fence_parts(x), lambda p: F.when(n.is_fenced(p), F.concat(F.lit("\n\n"), F.when(F.trim(p).startswith("[TABLE"), cells(F.trim(p))).otherwise(F.trim(p)), F.lit("\n\n"))).otherwise(plain(p))), "")


def expanded_attributes(text: Column) -> Column:
    """AsciiDoc attributes (:name: value) in place of {name}; an unknown {name} stays."""
    found = F.regexp_extract_all(n.text_of(text), F.lit(r"(?m)^(:[\w-]+:[ \t]*.*)$"), F.lit(1))
    return F.aggregate(found, n.text_of(text), lambda a, d: F.replace(a, F.concat(F.lit("{"), F.regexp_extract(d, r"^:([\w-]+):", 1), F.lit("}")), F.trim(F.regexp_replace(d, r"^:[\w-]+:", ""))))


def sections(docs: DataFrame, id: str, marked: Column, title: Column) -> DataFrame:
    """id, ordinal, level, heading, anchor, section_path, text of each section with text, in order.

    Headings of level 1 name the document and open no section; what stands before the first deeper heading is a section
    called after the document. A path holds the last heading of each level below which the section stands.
    """
    cut = docs.select(F.col(id), title.alias("title"), F.posexplode(F.split(marked, _HEAD, -1)).alias("pos", "part"))
    level = F.when(F.col("pos") > 0, F.length(F.regexp_extract("part", rf"^(#+|=+|\d){_TITLE}", 1)))
    digit = F.regexp_extract("part", rf"^(\d){_TITLE}", 1)
    body = F.when(F.col("pos") == 0, F.col("part")).otherwise(F.regexp_extract("part", rf"(?s){_BODY}(.*)$", 1))
    heading = n.clean_heading(F.regexp_extract("part", rf"(?s){_TITLE}(.*?){_BODY}", 1))
    rows = cut.select(id, "title", "pos", F.when(digit != "", digit.cast("int")).otherwise(F.coalesce(level, F.lit(1))).alias("level"), heading.alias("heading"), n.prose_around_fences(body).alias("text"))
    # preambles and the other sections both read these rows: pages are marked up and cut once
    rows = kept(rows, "sections")
    before = Window.partitionBy(id).orderBy("pos")
    seen = rows
    for k in range(2, LEVELS + 1):
        own = F.max(F.when((F.col("level") == k) & (F.col("pos") > 0), F.struct("pos", "heading"))).over(before)
        # a heading ends the deeper ones
        above = F.max(F.when(F.col("level") < k, F.col("pos"))).over(before)
        seen = seen.withColumn(f"at{k}", F.when((F.col("level") >= k) & (own["pos"] > F.coalesce(above, F.lit(-1))), own["heading"]))
    path = F.filter(F.array(*[f"at{k}" for k in range(2, LEVELS + 1)]), lambda x: x.isNotNull())
    # texts under headings of level 1 join the preamble
    intro = seen.filter("level = 1").groupBy(id).agg(F.min("pos").alias("pos"), F.first("title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text")))), lambda x: x["text"]), "\n\n").alias("text"))
    intro = intro.select(id, F.lit(-1).alias("pos"), F.lit(1).alias("level"), F.col("title").alias("heading"), F.lit("overview").alias("anchor"), F.array("title").alias("section_path"), "text")
    deeper = seen.filter("level > 1").select(id, "pos", "level", "heading", F.replace(F.lower("heading"), F.lit(" "), F.lit("-")).alias("anchor"), path.alias("section_path"), "text")
    filled = intro.unionByName(deeper).filter((F.col("text") != "") & ~F.col("heading").rlike(NOISE_HEADINGS))
    anchor = F.when(F.trim("anchor") == "", "section").otherwise(F.trim("anchor"))
    nth = F.row_number().over(Window.partitionBy(id, "anchor").orderBy("pos"))
    named = filled.withColumn("anchor", anchor).withColumn("nth", nth).withColumn("anchor", F.when(F.col("nth") > 1, F.concat_ws("-", "anchor", F.col("nth").cast("string"))).otherwise(F.col("anchor")))
    return named.select(id, F.row_number().over(Window.partitionBy(id).orderBy("pos")).alias("ordinal"), "level", "heading", "anchor", "section_path", "text")


def blocks(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, block (from 1), kind, text, attributes, steps, cells of each block of a section."""
    each = rows.select(*keys, F.posexplode(n.block_texts(F.col(text))).alias("at", "block_text"))
    kind, mark = n.block_kind(F.col("block_text")), F.regexp_extract("block_text", r"^\[(?:CODE|TABLE)([^\]]*)\]", 1)
    body = F.trim(F.regexp_replace("block_text", r"(?s)^\[(?:CODE|TABLE)[^\]]*\]\s*|\s*\[/(?:CODE|TABLE)\]$", ""))
    told = each.withColumn("kind", kind)
    cells = F.transform(n.without_blank(F.split(body, "\n")), lambda r: F.transform(F.split(r, r"\|", -1), lambda c: F.trim(c)))
    shown = F.when(F.col("kind").isin("code", "table"), body).when(F.col("kind") == "note", F.trim(F.regexp_replace("block_text", r"^[^:：]*[:：]\s*", ""))).otherwise(F.col("block_text"))
    return told.select(*keys, (F.col("at") + 1).alias("block"), "kind", shown.alias("text"), n.marker_attributes(mark).alias("attributes"), n.steps(F.col("block_text")).alias("steps"), F.when(F.col("kind") == "table", cells).alias("cells"))


def flat_block(kind: Column, text: Column) -> Column:
    """A block as text: code and tables between marks again."""
    return F.when(kind == "code", F.concat(F.lit("[CODE]\n"), text, F.lit("\n[/CODE]"))).when(kind == "table", F.concat(F.lit("[TABLE]\n"), text, F.lit("\n[/TABLE]"))).otherwise(text)


def section_rows(rows: DataFrame, parts: DataFrame, id: str, roles: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """Sections with their block kinds, their blocks as one text, and a role; rows of sections(), parts of blocks() by id and ordinal.

    roles: a role and the words that tell it, in the order in which they count; the first goes before a procedure among
    the blocks, the others after it. What none tells is 'unknown'.
    """
    joined = parts.groupBy(id, "ordinal").agg(F.array_sort(F.collect_list(F.struct("block", "kind", flat_block(F.col("kind"), F.col("text")).alias("flat")))).alias("own"))
    told = rows.join(joined, [id, "ordinal"], "left")
    kinds = F.array_distinct(F.transform("own", lambda b: b["kind"]))
    words = F.concat_ws(" ", F.array_join("section_path", " "), "heading", "text")
    first, others = n.first_role(words, roles[:1]), n.first_role(words, roles[1:])
    role = F.when(first != "unknown", first).when(F.array_contains(kinds, "procedure"), "procedure").otherwise(others)
    return told.select(*rows.columns, kinds.alias("block_kinds"), F.array_join(F.transform("own", lambda b: b["flat"]), "\n\n").alias("flat_text"), role.alias("semantic_role"))


def manuals(rows: DataFrame, id: str) -> DataFrame:
    """id, section_count, anchor_map, sections (nested, in order): one row for each document."""
    own = F.array_sort(F.collect_list(F.struct("ordinal", "level", "heading", "anchor", "section_path", "semantic_role", "block_kinds", "flat_text")))
    nested = rows.groupBy(id).agg(own.alias("sections"))
    return nested.select(id, F.size("sections").alias("section_count"), F.map_from_entries(F.transform("sections", lambda s: F.struct(s["anchor"], s["heading"]))).alias("anchor_map"), "sections")


def manual_sections(books: DataFrame, id: str) -> DataFrame:
    """The inverse of manuals()."""
    return books.select(id, F.inline("sections"))


def derived_sections(books: DataFrame, id: str, slug: Column, base: str) -> DataFrame:
    """Manuals under another slug: each section's viewer path leads to the derived book."""
    to = lambda s: s.withField("viewer_path", F.concat(F.lit(base.rstrip("/") + "/"), slug, F.lit("#"), s["anchor"]))
    return books.select(id, slug.alias("slug"), F.transform("sections", to).alias("sections"))


def search_rows(rows: DataFrame, id: str) -> DataFrame:
    """What word search indexes: chunk_id, book, chapter, section, anchor, text, chunk type and role, which the type decides."""
    kind = F.when(F.col("semantic_role") == "procedure", F.when(F.array_contains("block_kinds", "code"), "command").otherwise("procedure")).when(F.col("semantic_role").isin("concept", "overview"), "concept").when(F.col("semantic_role") == "reference", "reference").when(F.array_contains("block_kinds", "note"), "warning").otherwise("reference")
    role = F.when(F.col("chunk_type").isin("procedure", "command"), "procedure").when(F.col("chunk_type") == "concept", "concept").otherwise("reference")
    told = rows.withColumn("chunk_type", kind)
    return told.select(F.concat_ws("-", F.col(id).cast("string"), F.col("ordinal").cast("string")).alias("chunk_id"), F.col(id), F.element_at("section_path", 1).alias("chapter"), F.element_at("section_path", -1).alias("section"), "anchor", F.col("flat_text").alias("text"), "chunk_type", role.alias("semantic_role"))


def preview(rows: DataFrame, *keys: str, length: int = 320) -> DataFrame:
    return rows.select(*keys, "ordinal", n.excerpt(F.col("flat_text"), length).alias("preview"), "block_kinds")


def operational_signals(text: Column, patterns: dict[str, str]) -> list[Column]:
    """For each named pattern, what it finds in the text, first of each kept; commands without their prompt."""
    return [n.distinct_in_order(n.without_blank(F.transform(F.regexp_extract_all(n.text_of(text), F.lit(f"({p})"), F.lit(1)), n.clean_command)), F.lower).alias(k) for k, p in patterns.items()]
