"""Rules as tables: intents of queries, term expansion, score adjustments, rebalancing, ambiguity, and the choice of contexts.

No rule stands in code. A rule table is small and made by hand; it is broadcast after its rows are counted. Rules meet
queries once, and what they say meets hits by query, so that no step is larger than hits times the rules of their query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import normalise as n
from stratum.operators.retrieval import bounded, kept

#: Rows of a rule table that is broadcast; a longer one fails, as it isn't made by hand.
MOST_RULES = 20_000


def hand_made(rules: DataFrame) -> DataFrame:
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"a rule table has {MOST_RULES} rows at most")
    return F.broadcast(rules)


def _holds(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: text.contains(F.lower(w)))


def intents(queries: DataFrame, detectors: DataFrame, text: str = "query") -> DataFrame:
    """query_id, intent: the intents of each query.

    detectors: intent, any_of, all_of, none_of (arrays of words; null or empty asks nothing) and pattern (a regular expression
    or null). A row says that all its conditions hold; several rows of an intent are alternatives.
    """
    q = n.signal(F.col(text))
    asked = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    holds = (~asked("any_of") | _holds(q, F.col("any_of"))) & (~asked("all_of") | F.forall("all_of", lambda w: q.contains(F.lower(w)))) & (~asked("none_of") | ~_holds(q, F.col("none_of"))) & F.when(F.col("pattern").isNull(), True).otherwise(F.regexp_like(q, F.col("pattern")))
    return queries.join(hand_made(detectors), F.coalesce(holds, F.lit(False))).select("query_id", "intent").distinct()


def expanded(queries: DataFrame, asked: DataFrame, expansions: DataFrame) -> DataFrame:
    """query_id, query: each query with the terms of its intents behind it (expansions: intent, ordinal, terms), none twice."""
    own = asked.join(hand_made(expansions), "intent").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "terms"))).alias("found"))
    terms = F.coalesce(F.transform("found", lambda x: x["terms"]), F.array().cast("array<string>"))
    return queries.join(own, "query_id", "left").select("query_id", n.appended_terms(F.col("query"), terms).alias("query"))


def adjusted(hits: DataFrame, asked: DataFrame, rules: DataFrame, digits: int = 8) -> DataFrame:
    """hits with the score that rules leave, and the names of those that fired, in order.

    rules: rule, ordinal, intent (null: of any query), field (book, section or text), words (any of them), absent (true: none
    of them), factor, bonus. All factors of the rules that fire multiply the score, then their bonuses are added.
    hits: query_id, doc_id, book, section, text, score.
    """
    every = hits.select("query_id").distinct().withColumn("intent", F.lit(None).cast("string"))
    table = hand_made(rules)
    own = asked.unionByName(every).withColumnRenamed("intent", "of").join(table, F.col("of").eqNullSafe(F.col("intent"))).select("query_id", "rule", "ordinal", "field", "words", "absent", "factor", "bonus").distinct()
    of_query = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rule", "field", "words", "absent", "factor", "bonus"))).alias("rules"))
    # a row for each query: hits, with their texts, stay where they are, as a query may have most of them
    of_query = bounded(kept(of_query, "rules"))
    value = {f: F.lower(n.text_of(F.col(f))) for f in ("book", "section", "text")}

    def fires(r: Column) -> Column:
        chosen = F.when(r["field"] == "book", value["book"]).when(r["field"] == "section", value["section"]).otherwise(value["text"])
        return _holds(chosen, r["words"]) != F.coalesce(r["absent"], F.lit(False))

    fired = F.filter(F.coalesce("rules", F.array().cast(of_query.schema["rules"].dataType)), fires)
    factor = F.aggregate(fired, F.lit(1.0), lambda a, r: a * F.coalesce(r["factor"].cast("double"), F.lit(1.0)))
    bonus = F.aggregate(fired, F.lit(0.0), lambda a, r: a + F.coalesce(r["bonus"].cast("double"), F.lit(0.0)))
    told = hits.join(of_query, "query_id", "left").withColumn("score", F.round(F.col("score") * factor + bonus, digits)).withColumn("fired", F.transform(fired, lambda r: r["rule"]))
    return told.drop("rules", "rank")


def ranked(hits: DataFrame, k: int, *tie: str) -> DataFrame:
    order = [F.desc("score"), *[F.col(c) for c in tie or ("book", "doc_id")]]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def rebalanced(hits: DataFrame, pool: DataFrame, asked: DataFrame, rules: DataFrame, k: int) -> DataFrame:
    """The first k hits of each query after the first rule, in their order, that applies to it; with that rule's name.

    rules: rule, ordinal, intent, books (which it prefers), reach (how far down it looks), rescue (also among all of pool).
    A rule applies if the query has its intent and a preferred book stands within reach, or in pool if it rescues. The best
    such hit goes to the front; the others keep their order. hits and pool: query_id, doc_id, book, score, rank (hits).
    """
    own = bounded(kept(asked.join(hand_made(rules), "intent").select("query_id", "rule", "ordinal", "books", "reach", "rescue"), "rebalancing"))
    listed = hits.select("query_id", "doc_id", "book", "score", "rank", F.lit(False).alias("rescued"))
    rest = pool.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    # what isn't listed stands behind, by score: only its best is looked for, so that it isn't numbered
    rest = rest.select("query_id", "doc_id", "book", "score", F.lit(0).alias("rank"), F.lit(True).alias("rescued"))
    reached = listed.unionByName(rest).join(own, "query_id").filter(F.array_contains("books", F.col("book")) & F.when(F.col("rescued"), F.coalesce("rescue", F.lit(False))).otherwise(F.col("rank") <= F.col("reach")))
    chosen = reached.groupBy("query_id").agg(F.min(F.struct("ordinal", "rescued", "rank", (-F.col("score")).alias("behind"), "book", "doc_id", "score", "rule")).alias("to"))
    front = chosen.select("query_id", "to.doc_id", "to.book", "to.score", F.lit(0).alias("rank"))
    others = hits.select("query_id", "doc_id", "book", "score", "rank").join(front.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    placed = front.unionByName(others).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)
    return placed.join(chosen.select("query_id", F.col("to.rule").alias("rule")), "query_id", "left")


def companions(chosen: DataFrame, pool: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """chosen, and behind it the best hit of each book that pairs (book, companion) ask for and it hasn't; k at most."""
    have = chosen.select("query_id", "book").distinct()
    wanted = have.join(hand_made(pairs), "book").select("query_id", F.col("companion").alias("book")).distinct().join(have, ["query_id", "book"], "left_anti")
    best = pool.join(wanted, ["query_id", "book"]).withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "book").orderBy(F.desc("score"), "doc_id"))).filter("nth = 1")
    more = best.select("query_id", "doc_id", "book", "score", (F.lit(1 << 20) + F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "book"))).cast("int").alias("rank"))
    both = chosen.select("query_id", "doc_id", "book", "score", "rank").unionByName(more)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)


def contexts(hits: DataFrame, shapes: DataFrame, families: DataFrame) -> DataFrame:
    """The hits that an answer is given as contexts, by query, with their place.

    shapes: query_id, limit, cutoff (share of the best score), per_book, near (share that a book with two hits needs).
    families: query_id, book, mode (lock: only these books, if any has a hit; add: beside the first book, from `factor` of the
    best score on), factor. Of the first max(2 * limit, 6) hits, those of allowed books count; a book gives per_book hits.
    """
    first = hits.join(shapes, "query_id").filter(F.col("rank") <= F.greatest(F.col("limit") * 2, F.lit(6)))
    own = Window.partitionBy("query_id")
    best = F.max("score").over(own)
    window = first.withColumn("top", best).withColumn("top_book", F.min(F.struct("rank", "book")).over(own)["book"])
    by_book = Window.partitionBy("query_id", "book")
    window = window.withColumn("of_book", F.max("score").over(by_book)).withColumn("hits_of_book", F.count("*").over(by_book))
    told = window.join(families.select("query_id", F.col("book").alias("family"), "mode", "factor"), (window["query_id"] == families["query_id"]) & (F.col("book") == F.col("family")), "left").drop(families["query_id"])
    locked = F.max(F.when((F.col("mode") == "lock") & (F.col("of_book") > 0), 1).otherwise(0)).over(own) == 1
    added = (F.col("mode") == "add") & (F.col("of_book") >= F.col("factor") * F.col("top"))
    several = (F.col("hits_of_book") >= 2) & (F.col("of_book") >= F.col("near") * F.col("top"))
    told = told.withColumn("locked", locked)
    allowed = F.when(F.col("locked"), F.col("mode") == "lock").otherwise((F.col("book") == F.col("top_book")) | F.coalesce(added, F.lit(False)) | several)
    kept = told.filter(F.coalesce(allowed, F.lit(False)) & (F.col("score") >= F.col("cutoff") * F.col("top")))
    nth = kept.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "book").orderBy("rank"))).filter(F.col("nth") <= F.col("per_book"))
    placed = nth.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= F.col("limit"))
    return placed.select("query_id", "doc_id", "book", "score", "rank", "place")


def matched_citations(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """citations (query_id, number, book, viewer_path, source_url, anchor) with the best hit of the same identity, if there is one."""
    keyed = lambda df: df.withColumn("identity", n.citation_identity(F.col("viewer_path"), F.col("source_url"), F.col("anchor")))
    best = keyed(hits).groupBy("query_id", "book", "identity").agg(F.max(F.struct("score", F.col("doc_id"))).alias("best"))
    return keyed(citations).join(best, ["query_id", "book", "identity"], "left").select("query_id", "number", "book", "identity", F.col("best.doc_id").alias("doc_id"), F.col("best.score").alias("score"))


def eval_terms(cases: DataFrame) -> DataFrame:
    """cases (answer, must, must_not, expected, cited: arrays of books) with missing and forbidden terms, precision of citations, and whether the case passes."""
    right = F.size(F.filter("cited", lambda b: F.array_contains("expected", b)))
    told = cases.withColumn("missing", n.absent(F.col("answer"), F.col("must"))).withColumn("forbidden", n.present(F.col("answer"), F.col("must_not")))
    told = told.withColumn("precision", n.safe_rate(right, F.size("cited")))
    return told.withColumn("passed", (F.size("missing") == 0) & (F.size("forbidden") == 0) & ((F.size("expected") == 0) | (right > 0)))
