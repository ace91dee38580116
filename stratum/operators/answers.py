"""What stands behind an answer: citations that stay, whether they ground the commands that were asked for, and what a user looked at last.

Citations are rows of query_id, ordinal, book, identity, text. Rules are tables that the user makes; a question's citations are
few, so that they are folded over its rules in one row.

Defined results: citations of one identity are one, the first; a rule that would leave none is passed over; a question
without citations is not grounded; null books and identities are like any other value; equal ordinals go by book, then identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import normalise as n
from stratum.operators.rules import hand_made

FALLBACK = 3
#: Recent targets that count, the score of the first, by how much the next ones and each kind have less, the least.
RECENT, FIRST, STEP, LEAST = 12, 80, 6, 10
KIND_LESS = {"book": 0, "section": 8, "figure": 16, "entity": 0}


def fallback_citations(citations: DataFrame, limit: int = FALLBACK) -> DataFrame:
    """The first `limit` citations of unlike identities of each question, numbered anew as index."""
    first = F.row_number().over(Window.partitionBy("query_id", "identity").orderBy("ordinal", "book"))
    kept = citations.withColumn("nth", first).filter("nth = 1").drop("nth")
    return kept.withColumn("index", F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal", "book", "identity"))).filter(F.col("index") <= limit)


def pruned_citations(citations: DataFrame, asked: DataFrame, preferences: DataFrame) -> DataFrame:
    """citations without those that a preference puts behind. preferences: ordinal, intent, tiers (arrays of books, best first).

    In their order, each preference of a question's intents keeps the citations of its first tier of which any is left; if
    none of any tier is, all stay.
    """
    own = asked.join(hand_made(preferences), "intent").groupBy(F.col("query_id").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "tiers"))), lambda p: p["tiers"]).alias("wanted"))
    books = citations.groupBy("query_id").agg(F.collect_set(F.coalesce("book", F.lit(""))).alias("books")).join(own, F.col("query_id") == F.col("of"))

    def after(left: Column, tiers: Column) -> Column:
        by_tier = F.filter(F.transform(tiers, lambda tier: F.array_intersect(left, tier)), lambda b: F.size(b) > 0)
        return F.coalesce(F.get(by_tier, F.lit(0)), left)

    left = books.select("of", F.aggregate("wanted", F.col("books"), after).alias("left"))
    return citations.join(left, F.col("query_id") == F.col("of"), "left").filter(F.col("left").isNull() | F.array_contains("left", F.coalesce("book", F.lit("")))).drop("of", "left")


def grounded(queries: DataFrame, citations: DataFrame, rules: DataFrame, commands: str) -> DataFrame:
    """query_id, commands (asked for, in lower case), missing (names of what isn't there), grounded.

    One of the commands that a question names (the pattern's matches) must stand in some citation. rules: rule, asks and
    unless (patterns on the question; null: no such), any_of (words of which a citation must have one).
    """
    text = F.lower(n.text_of(F.col("query")))
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({commands})"), F.lit(1)), n.spaced))
    said = citations.groupBy(F.col("query_id").alias("of")).agg(F.collect_list(F.lower(n.text_of(F.col("text")))).alias("texts"))
    rows = queries.select("query_id", text.alias("asked"), found.alias("commands")).join(said, F.col("query_id") == F.col("of"), "left")
    wanted = F.collect_list(F.struct("rule", "asks", "unless", "any_of"))
    table = hand_made(rules.agg(F.array_sort(wanted).alias("rules")))
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    in_some = lambda word: F.exists(texts, lambda t: t.contains(word))
    due = lambda r: F.regexp_like(F.col("asked"), r["asks"]) & ~F.coalesce(F.regexp_like(F.col("asked"), r["unless"]), F.lit(False))
    lacks = F.transform(F.filter("rules", lambda r: due(r) & ~F.exists(r["any_of"], lambda w: in_some(F.lower(w)))), lambda r: r["rule"])
    command = F.when((F.size("commands") > 0) & ~F.exists("commands", in_some), F.array(F.lit("command"))).otherwise(F.array().cast("array<string>"))
    none = F.when(F.size(texts) == 0, F.array(F.lit("citation")))
    out = rows.join(table).withColumn("missing", F.coalesce(none, F.concat(command, lacks)))  # table: one row
    return out.select("query_id", "commands", "missing", (F.size("missing") == 0).alias("grounded"))


def recent_preferences(targets: DataFrame) -> DataFrame:
    """user_id, kind (book or entity), name, score: what a user's last targets prefer. targets: user_id, target_ref, updated, id (ties).

    The first of the RECENT last targets scores FIRST, each next one STEP less; a section or figure speaks for its book, with
    less; the best score of a name counts.
    """
    order = Window.partitionBy("user_id").orderBy(F.col("updated").desc_nulls_last(), "id")
    last = targets.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= RECENT)
    kind, rest = F.substring_index("target_ref", ":", 1), F.expr("substring(target_ref, instr(target_ref, ':') + 1)")
    less = F.coalesce(*[F.when(kind == k, v) for k, v in KIND_LESS.items()])
    name = F.trim(F.when(kind == "section", F.substring_index(rest, "#", 1)).when(kind == "figure", F.when(F.instr(rest, ":") > 0, F.substring_index(rest, ":", 1))).otherwise(rest))
    told = last.filter(F.instr("target_ref", ":") > 0).select("user_id", F.when(kind == "entity", "entity").otherwise("book").alias("kind"), name.alias("name"), (F.greatest(F.lit(LEAST), F.lit(FIRST) - STEP * (F.col("place") - 1)) - less).alias("score"))
    return told.filter("name <> '' AND score IS NOT NULL").groupBy("user_id", "kind", "name").agg(F.max("score").alias("score"))
