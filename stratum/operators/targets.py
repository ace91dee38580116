"""What overlays point at: one join of references of several kinds with one union of the keys of all that can be pointed at.

A reference names its kind before a colon: book:slug, entity:slug, section:slug#anchor, figure:slug:asset. Each kind's table
becomes rows of kind, two keys and what is shown; several rows of one key count by their precedence, so that a deleted or
repeated target costs no overlay its row. Overlays that lead nowhere stay, with the reason.

Defined results: a kind that doesn't fit the reference, or is unknown, is shown as the reference itself; a reference without
its second key is malformed; a target that is gone is shown by its name; null references are malformed; keys are trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of targets, the word before the colon, and what parts the two keys (None: one key).
KINDS: dict[str, tuple[str, str | None]] = {"book": ("book", None), "entity_hub": ("entity", None), "section": ("section", "#"), "figure": ("figure", ":")}
KEY = "kind string, one string, two string, precedence int, path string, title string, summary string"


def keys(kind: str, rows: DataFrame, one: Column, two: Column | None, path: Column, title: Column, summary: Column, precedence: Column | int = 0) -> DataFrame:
    """Rows of a table as KEY rows. Of several rows of a key the one with the least precedence counts, then the one with the least path and title."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    rank = F.lit(precedence) if isinstance(precedence, int) else precedence.cast("int")
    return rows.select(F.lit(kind).alias("kind"), text(one).alias("one"), (F.lit("") if two is None else text(two)).alias("two"), F.coalesce(rank, F.lit(1 << 30)).alias("precedence"), text(path).alias("path"), text(title).alias("title"), text(summary).alias("summary"))


def split_reference(kind: Column, reference: Column) -> Column:
    """struct(one, two, fits): the keys that a reference names; fits: whether it is of its kind and whole."""
    ref = F.trim(F.coalesce(reference, F.lit("")))
    out = F.struct(F.lit("").alias("one"), F.lit("").alias("two"), F.lit(False).alias("fits"))
    for name, (word, mark) in KINDS.items():
        rest = F.substring(ref, len(word) + 2, 1 << 30)
        one = F.trim(rest) if mark is None else F.trim(F.substring_index(rest, mark, 1))
        two = F.lit("") if mark is None else F.trim(F.when(F.instr(rest, mark) > 0, F.substring(rest, F.instr(rest, mark) + 1, F.lit(1 << 30))).otherwise(""))
        whole = (one != "") & (F.lit(True) if mark is None else two != "")
        out = F.when((F.trim(kind) == name) & ref.startswith(word + ":"), F.struct(one.alias("one"), two.alias("two"), whole.alias("fits"))).otherwise(out)
    return out


def named(slug: Column) -> Column:
    """A slug as a title."""
    return F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))


def resolved(overlays: DataFrame, targets: DataFrame, base: str = "/books/{0}", section: str = "/books/{0}#{1}", figure: str = "/figures/{0}/{1}", entity: str = "/entities/{0}") -> DataFrame:
    """overlays (target_kind, target_ref, viewer_path and others) with target_book, target_path, target_title, target_summary and target_state: found, missing, malformed or unknown_kind.

    targets: KEY rows. An overlay's own path comes first, then the target's, then the one that its kind has by form.
    """
    best = targets.groupBy("kind", "one", "two").agg(F.min(F.struct("precedence", "path", "title", "summary")).alias("shown"))
    keyed = overlays.withColumn("target_keys", split_reference(F.col("target_kind"), F.col("target_ref")))
    met = keyed.join(best, (F.trim(F.col("target_kind")) == F.col("kind")) & (F.col("target_keys.one") == F.col("one")) & (F.col("target_keys.two") == F.col("two")) & F.col("target_keys.fits"), "left")
    fits, ref, one, two = F.col("target_keys.fits"), F.trim(F.coalesce("target_ref", F.lit(""))), F.col("target_keys.one"), F.col("target_keys.two")
    of = F.trim(F.coalesce("target_kind", F.lit("")))
    form = lambda text: F.replace(F.replace(F.lit(text), F.lit("{0}"), one), F.lit("{1}"), two)
    by_kind = F.when(of == "book", form(base)).when(of == "entity_hub", form(entity)).when(of == "section", form(section)).when(of == "figure", form(figure))
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    fallback = F.when(of == "book", named(one)).when(of == "entity_hub", one).otherwise(two)
    own = some(F.trim(F.coalesce("viewer_path", F.lit(""))))
    state = F.when(F.col("shown").isNotNull(), "found").when(fits, "missing").when(of.isin(*KINDS), "malformed").otherwise("unknown_kind")
    return met.select(
        *[F.col(c) for c in overlays.columns], F.when(fits & (of != "entity_hub"), one).otherwise("").alias("target_book"), F.when(fits, some(own, F.col("shown.path"), by_kind)).otherwise(own).alias("target_path"),
        F.when(fits, some(F.col("shown.title"), fallback)).otherwise(ref).alias("target_title"), F.coalesce("shown.summary", F.lit("")).alias("target_summary"), state.alias("target_state"),
    )
