"""Mixing sources to target weights.

Each document gets a hash-random key. Within each source documents are ordered by key in ranges of the key; the words of
each range are summed, prefix sums over the ranges find the one where the source's budget ends, and only that range is
sorted to find the very document. There are about as many ranges as rows in one, so that each window sees some square root
of a source's rows. A source whose budget is above its size begins again with its first document (another
epoch). What comes of it is a few numbers a source, so that neither texts nor a hot source meet in one task.

Defined results: a null text has size 0; a null source is a source and comes last; sizes of 0 are taken 0 times; rows
of one doc_id (or with none) share a key, and share evenly what is left for them at the cut; an empty table gives none.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, boxed, small_side, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def word_count(text: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def random_key(doc_id: str) -> Column:
    return F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> also target: shares by weight of share x all sizes, none above most x its size.

    A share is above its bound if bound / weight is below the common level; in the order of that ratio, the level is the
    first at which what the sources before leave, by weight, is not above the next one's ratio.
    """
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select("source", "source_size", F.element_at(kinds, ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).alias("weight"))
    capped = ranked.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything, before = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    shared = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = capped.withColumn("at", left / shared)
    level = F.min(F.when(F.col("at") <= F.col("ratio"), F.struct("ratio", "at"))).over(everything)["at"]
    return levels.withColumn("level", level).select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("level", "ratio")).alias("target"))


def cuts(sized: DataFrame, **how: object) -> DataFrame:
    """Per source: source_size, target, epochs (whole passes), cut_key, and cut_left and cut_rows of the documents at the cut.

    sized: staged rows of source, size, key.
    """
    # about as many ranges as rows in one: both windows below see some root of the rows of a source
    digits = max(1, min(7, round(log(max(1, sized.count()), 16) / 2)))
    sized = sized.withColumn("range", F.substring("key", 1, digits))
    ranges = staged(sized.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    sources = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), **how)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = staged(sources.withColumn("epochs", whole).withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-sources")
    up_to = lambda by, words: F.sum(words).over(Window.partitionBy("source").orderBy(by))
    rest = sources.filter("rest > 0").select(F.col("source").alias("of"), "rest")
    same = lambda a: a["source"].eqNullSafe(F.col("of"))
    running = ranges.withColumn("upto", up_to("range", "words"))
    cut = running.join(small_side(rest, 64), same(running)).filter("upto >= rest AND upto - words < rest").select("of", F.col("range").alias("cut_range"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    inside = sized.join(small_side(staged(cut, "mix-cuts"), 64), same(sized) & (F.col("range") == F.col("cut_range")))
    keys = inside.groupBy("source", "key", "left").agg(F.sum("size").alias("words"), F.count("*").alias("cut_rows")).withColumn("upto", up_to("key", "words"))
    keys = keys.filter("upto >= left AND upto - words < left").select(F.col("source").alias("of"), F.col("key").alias("cut_key"), (F.col("left") - F.col("upto") + F.col("words")).alias("cut_left"), "cut_rows")
    return sources.join(keys, same(sources), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_left", "cut_rows")


def with_taken(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """docs (source, size, key and others) with source_size, target, epochs and taken; more: words of the last, partial pass."""
    cut = small_side(cut.withColumnRenamed("source", "of"), 128)
    at_cut = F.least(F.col("size"), F.floor(F.col("cut_left") / F.col("cut_rows")))
    more = F.when(F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), F.lit(0)).when(F.col("key") < F.col("cut_key"), F.col("size")).otherwise(at_cut).cast("long")
    out = docs.join(cut, docs["source"].eqNullSafe(F.col("of"))).withColumn("more", more)
    return out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("more")).drop("of", "cut_key", "cut_left", "cut_rows")


def sized(docs: DataFrame, *others: str) -> DataFrame:
    return docs.select("doc_id", "source", word_count("text").alias("size"), random_key("doc_id").alias("key"), *others)


def mix(docs: DataFrame, **how: object) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document that the mix takes, repeats counted."""
    rows = staged(sized(docs), "mix-sizes")
    return with_taken(rows, staged(cuts(rows, **how), "mix-cut")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **how: object) -> DataFrame:
    """The mix itself: a row of docs for each pass that takes it; of the document at a source's cut, the last row has its first words."""
    rows = staged(sized(docs), "mix-sizes")
    cut = staged(cuts(rows, **how), "mix-cut")
    taken = with_taken(sized(docs, *[boxed(docs)]), cut)
    passes = F.flatten(F.array(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(F.col("more") > 0, F.array("more")).otherwise(F.array().cast("array<bigint>"))))
    # a document without words costs nothing and goes once
    passes = F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).otherwise(passes)
    rows = taken.select("row", "size", F.explode(passes).alias("words"))
    spaced = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(spaced, F.lit(1), F.col("words").cast("int")), ""))
    rows = rows.select("row", text.alias("text"), (F.col("words") < F.col("size")).alias("part"))
    given = {"text": F.col("text"), "n_chars": F.when(F.col("part"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return rows.select(*[given.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sized GROUP BY source
), levels AS (
  SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lvl
  FROM sources WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (SELECT arg_min(lvl, ratio) AS level FROM levels WHERE lvl <= ratio
), targets AS (
  SELECT source, source_size, least(cap, weight * level) AS target FROM levels, level
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM targets
), run AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) - d.size AS before
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM run
"""
