"""Translation units of nested books and their way back, and where a translation stands.

A book is id, title, sections; each section has a heading, a path and blocks (SECTION). A unit is a text with an address that
tells its place: `doc.title`, `s0.heading`, `s0.path.1`, `s0.b2.procedure.1.substep.0`. Texts are listed and replaced by the same
visit of the nested columns. To translate, sections are taken apart, each meets its own translations, and books are put
together again in their order, so that no lookup is longer than one section.

Defined results: blank texts are no units; what has no translation, or a blank one, stays as it is, byte for byte; of several
translations of one unit the greatest counts; null arrays have no units and stay null; translations that meet no unit go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BLOCK = "kind string, text string, caption string, title string, label string, items array<string>, steps array<struct<text string, substeps array<string>>>, headers array<string>, cells array<array<string>>"
SECTION = f"heading string, path array<string>, blocks array<struct<{BLOCK}>>"
UNITS = "array<struct<unit_id string, text string>>"
#: What texts are trimmed of.
SPACES = " \t\n\x0b\f\r"
#: Which texts a kind of block has, by the name that stands in the address.
KINDS: dict[str, tuple[tuple[str, str], ...]] = {
    "paragraph": (("paragraph", "text"),), "code": (("code.caption", "caption"),), "note": (("note.title", "title"), ("note.text", "text")), "anchor": (("anchor.label", "label"),), "table": (("table.caption", "caption"),),
}
LISTS = {"prerequisite": ("prerequisite", "items"), "table": ("table.header", "headers")}

Visit = Callable[[Column, Column], Column]


def _name(*parts: Column | str | int) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _each(values: Column, prefix: Column, visit: Visit) -> Column:
    return F.transform(values, lambda x, k: visit(_name(prefix, ".", k), x))


def _step(prefix: Column, visit: Visit) -> Callable[[Column, Column], Column]:
    def at(step: Column, k: Column) -> Column:
        own = _name(prefix, ".", k)
        return F.struct(visit(_name(own, ".text"), step["text"]).alias("text"), _each(step["substeps"], _name(own, ".substep"), visit).alias("substeps"))

    return at


def _visited_block(prefix: Column, block: Column, visit: Visit) -> Column:
    """The block with what the visit makes of each of its texts."""
    is_ = lambda kind: block["kind"] == kind
    columns = {c: block[c] for c in ("kind", "text", "caption", "title", "label", "items", "steps", "headers", "cells")}
    for kind, texts in KINDS.items():
        for name, column in texts:
            columns[column] = F.when(is_(kind), visit(_name(prefix, "." + name), block[column])).otherwise(columns[column])
    for kind, (name, column) in LISTS.items():
        columns[column] = F.when(is_(kind), _each(block[column], _name(prefix, "." + name), visit)).otherwise(columns[column])
    columns["steps"] = F.when(is_("procedure"), F.transform(block["steps"], _step(_name(prefix, ".procedure"), visit))).otherwise(block["steps"])
    row = lambda cells, r: _each(cells, _name(prefix, ".table.cell.", r), visit)
    columns["cells"] = F.when(is_("table"), F.transform(block["cells"], row)).otherwise(block["cells"])
    return F.struct(*[v.alias(k) for k, v in columns.items()])


def _listed_block(prefix: Column, block: Column) -> Column:
    """The texts of a block with their addresses, in order."""
    one = lambda name, text: F.struct(name.alias("unit_id"), text.alias("text"))
    none = F.array().cast(UNITS)
    some = lambda values, name: F.coalesce(F.transform(values, lambda x, k: one(_name(prefix, name, k), x)), none)
    steps = F.flatten(F.transform(block["steps"], lambda s, k: F.concat(F.array(one(_name(prefix, ".procedure.", k, ".text"), s["text"])), F.coalesce(F.transform(s["substeps"], lambda x, m: one(_name(prefix, ".procedure.", k, ".substep.", m), x)), none))))
    cells = F.flatten(F.transform(block["cells"], lambda row, r: F.transform(F.coalesce(row, F.array().cast("array<string>")), lambda x, c: one(_name(prefix, ".table.cell.", r, ".", c), x))))
    out = F.lit(None).cast(UNITS)
    for kind in ("paragraph", "prerequisite", "procedure", "code", "note", "table", "anchor"):
        own = [F.array(one(_name(prefix, "." + name), block[column])) for name, column in KINDS.get(kind, ())]
        own += [some(block[LISTS[kind][1]], f".{LISTS[kind][0]}.")] if kind in LISTS else []
        own += [F.coalesce({"procedure": steps, "table": cells}[kind], none)] if kind in ("procedure", "table") else []
        out = F.when(block["kind"] == kind, F.concat(*own)).otherwise(out)
    return F.coalesce(out, none)


def section_units(section: Column, number: Column) -> Column:
    """unit_id and text of each text of a section, blank ones too."""
    prefix = _name("s", number)
    none = F.array().cast(UNITS)
    head = F.array(F.struct(_name(prefix, ".heading").alias("unit_id"), section["heading"].alias("text")))
    path = F.transform(section["path"], lambda x, k: F.struct(_name(prefix, ".path.", k).alias("unit_id"), x.alias("text")))
    blocks = F.flatten(F.transform(section["blocks"], lambda b, k: _listed_block(_name(prefix, ".b", k), b)))
    return F.concat(head, F.coalesce(path, none), F.coalesce(blocks, none))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def units(books: DataFrame, id: str, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, section (-1: the book itself), ordinal (within the section, from 0), unit_id, text of each text that isn't blank, trimmed; of all units or of those whose address is wanted."""
    title = books.select(id, F.lit(-1).alias("section"), F.lit(0).alias("ordinal"), F.lit("doc.title").alias("unit_id"), F.col("title").alias("text"))
    cut = books.select(id, F.posexplode("sections").alias("section", "own"))
    listed = section_units(F.col("own"), F.col("section"))
    if only is None:
        rows = cut.select(id, "section", F.posexplode(listed).alias("ordinal", "unit"))
    else:
        title = title.filter(only(F.col("unit_id")))
        # what isn't wanted goes before it is a row
        numbered = F.filter(F.transform(listed, lambda x, k: F.struct(k.alias("ordinal"), x.alias("unit"))), lambda x: only(x["unit"]["unit_id"]))
        rows = cut.select(id, "section", F.inline(numbered))
    each = title.unionByName(rows.select(id, "section", "ordinal", "unit.unit_id", "unit.text"))
    return each.filter(F.col("text").rlike(r"\S")).withColumn("text", _trimmed(F.col("text")))


def translated(books: DataFrame, translations: DataFrame, id: str, polish: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """books with the texts of translations (id, unit_id, text) in their places; polish is laid on every text. Columns beside id, title, sections stay.

    A book goes once through the shuffles: its sections, and before them a part (-1) with its other columns, meet their translations and are gathered by book.
    """
    given = translations.groupBy(F.col(id).alias("of"), "unit_id").agg(F.max("text").alias("text")).filter(r"unit_id IS NOT NULL AND text RLIKE '\\S'")
    given = given.withColumn("at", F.coalesce(F.regexp_extract("unit_id", r"^s(\d+)\.", 1).try_cast("int"), F.lit(-1)))
    # one section's translations
    maps = given.groupBy("of", "at").agg(F.map_from_entries(F.collect_list(F.struct("unit_id", _trimmed(F.col("text"))))).alias("known"))
    visit = lambda name, text: polish(F.coalesce(F.element_at("known", name), text))
    section, row = books.schema["sections"].dataType.elementType, F.struct(*[F.col(c) for c in books.columns if c != "sections"])
    parts = F.concat(F.array(F.lit(None).cast(section)), F.coalesce("sections", F.array().cast(books.schema["sections"].dataType)))
    whole = books.select(F.monotonically_increasing_id().alias("key"), F.col(id).alias("book"), row.alias("row"), F.col("sections").isNull().alias("none"), parts.alias("parts"))
    cut = whole.select("key", "book", "row", "none", F.posexplode("parts").alias("place", "own"))
    cut = cut.select("key", "book", (F.col("place") - 1).alias("section"), F.when(F.col("place") == 0, F.struct("row", "none")).alias("head"), "own")
    met = cut.join(maps, (F.col("book") == F.col("of")) & (F.col("section") == F.col("at")), "left")
    prefix = _name("s", F.col("section"))
    made = F.struct(
        visit(_name(prefix, ".heading"), F.col("own.heading")).alias("heading"), _each(F.col("own.path"), _name(prefix, ".path"), visit).alias("path"), F.transform("own.blocks", lambda b, k: _visited_block(_name(prefix, ".b", k), b, visit)).alias("blocks")
    )
    head = F.when(F.col("section") < 0, F.struct("head.row", "head.none", F.element_at("known", "doc.title").alias("title")))
    own = met.select("key", head.alias("head"), F.when(F.col("section") >= 0, F.struct("section", made.alias("made"))).alias("own"))
    out = own.groupBy("key").agg(F.max_by("head", F.col("head").isNotNull()).alias("head"), F.transform(F.array_sort(F.collect_list("own")), lambda x: x["made"]).alias("made"))
    shown = {"title": polish(F.coalesce("head.title", "head.row.title")), "sections": F.when(~F.col("head.none"), F.col("made"))}
    return out.select(*[shown.get(c, F.col("head.row").getField(c)).alias(c) for c in books.columns])


# where a translation stands

#: A status, the stage it is, the status that follows, and how books of it are given out.
STAGES = {
    "approved_ko": ("approved_ko", "approved_ko", "runtime"), "translated_ko_draft": ("translated_ko_draft", "approved_ko", "draft_review"), "en_only": ("en_only", "translated_ko_draft", "translation_required"),
    "mixed": ("mixed_review", "translated_ko_draft", "mixed_review"), "blocked": ("blocked", "blocked", "blocked"),
}


def translation_state(status: Column, stages: dict[str, tuple[str, str, str]] = STAGES) -> list[Column]:
    """stage, next_status, output_mode, requires_translation, requires_review, runtime_eligible of a status; an unknown one is followed by itself, a blank one by 'blocked'."""
    status = F.trim(F.coalesce(status, F.lit("")))
    pick = lambda i, other: F.coalesce(*[F.when(status == k, v[i]) for k, v in stages.items()], other)
    unknown, follows = F.lit("unknown"), F.coalesce(F.nullif(status, F.lit("")), F.lit("blocked"))
    return [
        pick(0, unknown).alias("stage"), pick(1, follows).alias("next_status"), pick(2, unknown).alias("output_mode"), status.isin("en_only", "mixed").alias("requires_translation"), (status == "translated_ko_draft").alias("requires_review"),
        (status == "approved_ko").alias("runtime_eligible"),
    ]


def approved(rows: DataFrame, books: DataFrame, key: str, trust: float = 0.98) -> DataFrame:
    """Rows of approved books (key, title, source_id), rewritten as such: a trust score that a row has stays unless it is zero."""
    own = books.select(F.col(key).alias("unit_book"), F.col("title").alias("new_title"), F.col("source_id").alias("new_source"))
    met = rows.join(own, F.col(key) == F.col("unit_book"))
    score = F.coalesce(F.nullif(F.col("trust_score").cast("double"), F.lit(0.0)), F.lit(trust)) if "trust_score" in rows.columns else F.lit(trust)
    put = {
        "book_title": F.col("new_title"), "source_id": F.col("new_source"), "source_lane": F.lit("applied_playbook"), "source_type": F.lit("manual_synthesis"), "translation_status": F.lit("approved_ko"), "translation_stage": F.lit("approved_ko"),
        "review_status": F.lit("approved"), "trust_score": score,
    }
    return met.select(*[F.col(c) for c in rows.columns if c not in put], *[v.alias(k) for k, v in put.items()])
