"""Tables about the same books put side by side: titles, manifests, registries, relations, histograms and verdicts.

All are outer joins and aggregates by key; what several sources say of one book is a row, and a map from source to value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import normalise as n
from stratum.operators.retrieval import bounded, kept


def aligned(sources: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """key, values (source -> value), missing (sources without the key), conflict: whether two sources differ, spacing and case aside.

    One union and one aggregate, whatever the number of sources. Of several values of a source the first in order counts.
    """
    each = reduce(DataFrame.unionByName, [df.select(F.col(key), F.lit(name).alias("origin"), F.col(value).cast("string").alias("value")) for name, df in sources.items()])
    one = each.filter(F.col(key).isNotNull()).groupBy(key, "origin").agg(F.min("value").alias("value"))
    told = one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("origin", "value")))).alias("values"))
    names = F.array(*[F.lit(s) for s in sources])
    said = F.array_distinct(F.transform(F.filter(F.map_values("values"), lambda v: v.isNotNull()), n.signal))
    return told.select(key, "values", F.filter(names, lambda s: ~F.map_contains_key("values", s)).alias("missing"), (F.size(said) > 1).alias("conflict"))


def merged(layers: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of several registries by key: of each column, the first layer's value that isn't blank."""
    each = reduce(DataFrame.unionByName, [df.select(F.col(key), *columns, F.lit(i).alias("layer")) for i, df in enumerate(layers)])
    first = lambda c: F.min(F.when(~n.text_of(F.col(c).cast("string")).rlike(r"^\s*$"), F.struct("layer", F.col(c).alias("value"))))["value"].alias(c)
    return each.filter(F.col(key).isNotNull()).groupBy(key).agg(*[first(c) for c in columns], F.min("layer").alias("layer"))


def overlaid(base: DataFrame, overlay: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """base with the overlay's values where it has any; rows that only the overlay has stay out."""
    own = overlay.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = base.join(own, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def histogram(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """by, name: a map from each value to its count, in the order of values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(value), F.col("n"))))).alias(name))


def checked(row: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row of counters with a boolean for each rule, which of them fail, and whether none does."""
    told = row.select("*", *[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in rules.items()])
    failed = F.filter(F.array(*[F.when(~F.col(name), name) for name in rules]), lambda x: x.isNotNull())
    return told.withColumn("failed", failed).withColumn("ok", F.size(failed) == 0)


def corpus_counters(chunks: DataFrame, id: str, text: str, required: Sequence[str], other_ids: Mapping[str, DataFrame] = {}) -> DataFrame:
    """One row: rows, ids, repeated ids and texts, empty texts, blank values of required columns, and ids that are in one store only."""
    blank = lambda c: F.sum((n.text_of(F.col(c).cast("string")).rlike(r"^\s*$")).cast("long"))
    counts = chunks.agg(F.count("*").alias("n_rows"), *[F.coalesce(blank(c), F.lit(0)).alias(f"blank_{c}") for c in required])
    again = lambda c, name: chunks.select(c.alias("again")).filter("again IS NOT NULL").groupBy("again").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") - 1)), F.lit(0)).cast("long").alias(name))
    # digests, not texts, are shuffled
    parts = [counts, again(F.col(id), "repeated_ids"), again(F.unhex(F.sha2(F.col(text).cast("string"), 256)), "repeated_texts")]
    for name, other in other_ids.items():
        ids, own = other.select(F.col(id)).distinct(), chunks.select(F.col(id)).distinct()
        parts += [own.join(ids, id, "left_anti").agg(F.count("*").alias(f"not_in_{name}")), ids.join(own, id, "left_anti").agg(F.count("*").alias(f"only_in_{name}"))]
    # each part is one row
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)


def reader_grade(rows: DataFrame, by: str, text: str, long: int = 1200) -> DataFrame:
    """by, n_sections, n_long, n_flat (long, without a blank line), longest, grade: how readable a book's sections are."""
    size, flat = F.length(n.text_of(F.col(text))), ~n.text_of(F.col(text)).contains("\n\n")
    told = rows.groupBy(by).agg(F.count("*").alias("n_sections"), F.sum((size > long).cast("long")).alias("n_long"), F.sum(((size > long) & flat).cast("long")).alias("n_flat"), F.max(size).alias("longest"))
    share = F.col("n_flat") / F.col("n_sections")
    return told.withColumn("grade", F.when(share == 0, "good").when(share < 0.1, "fair").otherwise("poor"))


def related_or_fallback(hits: DataFrame, relations: DataFrame, fallback: DataFrame) -> DataFrame:
    """hits (query_id, doc_id, book) with the books related to theirs (source, target, weight); those without any get the fallback's of their book."""
    own = hits.join(relations.select(F.col("source").alias("book"), "target", "weight"), "book").withColumn("origin", F.lit("relation"))
    without = hits.join(relations.select(F.col("source").alias("book")).distinct(), "book", "left_anti")
    other = without.join(fallback.select(F.col("source").alias("book"), "target", "weight"), "book").withColumn("origin", F.lit("fallback"))
    return own.unionByName(other)


def entity_backlinks(pages: DataFrame, page: str, text: str, entities: DataFrame) -> DataFrame:
    """entity, page: which pages name each entity (entities: entity, one row each; words are matched whole, without regard to case).

    A page is looked through where it is: while names are few enough to be broadcast, its words are held against the first
    words of all names inside the row, and only those that are one of them meet names. No text is shuffled. With more names
    words, without the text, meet names in a join, and pages that have a longer name's first word are looked through for it.
    """
    named = kept(entities.select("entity", n.signal(F.col("entity")).alias("name")).withColumn("word", F.element_at(F.split("name", " "), 1)), "named")
    near = bounded(named)
    words = F.array_distinct(F.split(n.signal(F.col(text)), r"[^\p{L}\p{N}-]+"))
    said = F.concat(F.lit(" "), F.regexp_replace(n.signal(F.col(text)), r"[^\p{L}\p{N}-]+", " "), F.lit(" "))
    # made once a page, not once a name
    whole = F.col("said").contains(F.concat(F.lit(" "), F.col("name"), F.lit(" ")))
    if near is not named:
        firsts = named.agg(F.collect_set("word").alias("firsts"))
        cut = pages.select(F.col(page), said.alias("said"), words.alias("words")).join(F.broadcast(firsts))
        own = cut.select(page, "said", F.explode(F.array_intersect("words", "firsts")).alias("word")).join(near, "word")
        return own.filter((F.col("name") == F.col("word")) | whole).select("entity", page).distinct()
    met = pages.select(F.col(page), F.explode(words).alias("word")).join(named, "word")
    longer = met.filter("name <> word").select(F.col(page).alias("of"), "entity", "name").distinct()
    found = pages.select(F.col(page), said.alias("said")).join(longer, F.col(page) == F.col("of")).filter(whole)
    return met.filter("name = word").select("entity", page).unionByName(found.select("entity", page)).distinct()


def nearest_section(figures: DataFrame, sections: DataFrame, doc: str) -> DataFrame:
    """figures (doc, at) with the last section that begins at or before them (sections: doc, at, anchor): one sort by document, no pairs."""
    both = sections.select(doc, "at", F.lit(0).alias("kind"), "anchor", F.lit(None).cast("string").alias("figure")).unionByName(figures.select(doc, "at", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("anchor"), F.col("figure").cast("string").alias("figure")))
    last = F.last("anchor", ignorenulls=True).over(Window.partitionBy(doc).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("anchor", last).filter("kind = 1").select(doc, "figure", "at", "anchor")


def family_verdict(winners: DataFrame, share: float = 0.6, margin: float = 0.01) -> DataFrame:
    """winners (book, family, score, margin: one row a section's best family) -> book, family, n_won, mean_score, share, ready."""
    by = winners.groupBy("book", "family").agg(F.count("*").alias("n_won"), F.round(F.avg("score"), 6).alias("mean_score"), F.avg("margin").alias("margin"))
    told = by.withColumn("share", F.col("n_won") / F.sum("n_won").over(Window.partitionBy("book")))
    first = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n_won"), F.desc("mean_score"), "family"))
    best = told.withColumn("nth", first).filter("nth = 1")
    return best.select("book", "family", "n_won", "mean_score", F.round("share", 6).alias("share"), ((F.col("share") >= share) & (F.col("margin") >= margin)).alias("ready"))


#: What an issue of each severity takes off its axis, and from which total on a verdict is given.
SEVERITIES = {"low": 1, "medium": 3, "high": 6, "critical": 10}
VERDICTS = (("gold", 90), ("silver", 78), ("bronze", 60))


def quality_gate(issues: DataFrame, axes: Mapping[str, int], severities: Mapping[str, int] = SEVERITIES) -> DataFrame:
    """issues (book, axis, severity, fails) -> book, a score for each axis, total and verdict.

    An axis has 100 less what its issues take, and 0 if one of them fails the gate; the total weighs the axes (axis -> weight).
    A book with an issue that fails the gate is blocked, whatever its total.
    """
    loss = F.create_map(*[x for k, v in severities.items() for x in (F.lit(k), F.lit(v))])

    def score(axis: str) -> Column:
        own = F.col("axis") == axis
        fails = F.max(F.when(own & F.col("fails"), 1).otherwise(0)) == 1
        return F.when(fails, 0).otherwise(F.greatest(F.lit(0), 100 - F.sum(F.when(own, F.coalesce(loss[F.col("severity")], F.lit(0))).otherwise(0)))).cast("int").alias(axis)

    told = issues.groupBy("book").agg(*[score(a) for a in axes], F.max(F.col("fails").cast("int")).alias("failed"))
    total = reduce(Column.__add__, [F.col(a) * w for a, w in axes.items()]) / sum(axes.values())
    verdict = F.when(F.col("failed") == 1, "blocked")
    for name, least in VERDICTS:
        verdict = verdict.when(F.col("total") >= least, name)
    return told.withColumn("total", F.round(total, 4)).withColumn("verdict", verdict.otherwise("review")).drop("failed")
