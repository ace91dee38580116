"""A whole retrieval for a batch of questions: a plan for each, the searches it asks for, their fusion, and a row that says how it went.

The plan tells each question's sub-queries, whether it follows up on another, how many candidates it gets, and whether the
corpus can answer it at all. All questions are searched together; what differs between them are columns. Scores of the fusion
are whole points, so that ties are ties everywhere.

Defined results: a question without words has a plan, no hits and an empty trace; one that is out of the corpus has no hits
and the reason; a list that isn't asked for is empty; equal points go by book, then id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import normalise as n
from stratum.functions.text import tokens
from stratum.operators.retrieval import RRF_K, bounded, kept

CANDIDATES, WIDE, HITS, PER_BOOK, SUPPORT_RANK, TRACED = 20, 40, 8, 2, 10, 5
POINTS = 100_000_000


def plan(queries: DataFrame, asked: DataFrame | None = None, wide: Sequence[str] = (), outside: Sequence[str] = (), follow_up: str | None = None, candidates: int = CANDIDATES, most: int = WIDE) -> DataFrame:
    """query_id, query, rewritten, parts (sub-queries), follow_up, candidates, outside (the intent that rules the corpus out, or null).

    queries: query_id, query, and hint (what a follow-up is about; may be null). asked: query_id, intent. A question of several
    parts, of a wide intent, or one that follows up gets `most` candidates; a follow-up is also asked with its hint.
    """
    text = n.spaced(F.col("query"))
    follows = F.lit(False) if follow_up is None else F.regexp_like(F.lower(text), F.lit(follow_up))
    rows = queries.select("query_id", text.alias("query"), F.coalesce(follows, F.lit(False)).alias("follow_up"), n.sub_queries(F.col("query")).alias("parts"), n.spaced(F.col("hint")).alias("hint"))
    resolved = F.when(F.col("follow_up") & (F.col("hint") != ""), F.concat_ws(" ", "query", "hint")).otherwise(F.col("query"))
    rows = rows.withColumn("rewritten", resolved).withColumn("parts", F.array_distinct(F.concat("parts", F.when(F.col("rewritten") != F.col("query"), F.array("rewritten")).otherwise(F.array().cast("array<string>")))))
    if asked is not None:
        of = lambda names: F.min(F.when(F.col("intent").isin(*names), F.col("intent"))) if names else F.lit(None).cast("string")
        told = asked.groupBy(F.col("query_id").alias("of")).agg(of(list(wide)).alias("wide"), of(list(outside)).alias("outside"))
        rows = rows.join(told, F.col("query_id") == F.col("of"), "left").drop("of")
    else:
        rows = rows.withColumn("wide", F.lit(None).cast("string")).withColumn("outside", F.lit(None).cast("string"))
    many = (F.size("parts") > 1) | F.col("follow_up") | F.col("wide").isNotNull()
    return rows.select("query_id", "query", "rewritten", "parts", "follow_up", F.when(many, max(candidates, most)).otherwise(candidates).alias("candidates"), "outside")


def part_queries(plans: DataFrame) -> DataFrame:
    """query_id, sub, terms of all parts that the corpus may answer: what search() takes."""
    each = plans.filter("outside IS NULL").select("query_id", F.posexplode("parts").alias("sub", "part"))
    return each.select("query_id", F.col("sub").cast("long").alias("sub"), tokens(F.col("part")).alias("terms"))


def within_budget(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """hits (query_id, rank, ...) up to the rank that their question's plan gives; none of questions that are out of the corpus."""
    own = bounded(plans.filter("outside IS NULL").select(F.col("query_id").alias("of"), "candidates"))
    return hits.join(own, F.col("query_id") == F.col("of")).filter(F.col("rank") <= F.col("candidates")).drop("of", "candidates")


def _ordered(*more: Column) -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc("points"), *more, F.col("book").asc_nulls_first(), "doc_id")


def fused(lists: dict[str, tuple[DataFrame, int]], noise: Column | None = None, raised: int = 11) -> DataFrame:
    """query_id, doc_id, book, points, origins, rank: reciprocal ranks of lists (query_id, doc_id, book, rank; weight in hundredths) in whole points, times 10, or `raised` for books that several lists have among their first ones."""
    each = None
    for name, (hits, weight) in lists.items():
        part = F.floor(F.lit(weight * POINTS // 100) / (RRF_K + F.col("rank"))).cast("long")
        own = hits.select("query_id", "doc_id", "book", F.lit(name).alias("origin"), "rank", part.alias("part"))
        each = own if each is None else each.unionByName(own)
    if noise is not None:
        each = each.filter(~F.coalesce(noise, F.lit(False)))
    each = kept(each, "fused")
    support = each.filter(F.col("rank") <= SUPPORT_RANK).groupBy(F.col("query_id").alias("q"), F.col("book").alias("b")).agg(F.count_distinct("origin").alias("support"))
    merged = each.groupBy("query_id", "doc_id", "book").agg(F.sum("part").alias("sum"), F.array_sort(F.collect_set("origin")).alias("origins"))
    met = merged.join(support, (F.col("query_id") == F.col("q")) & F.col("book").eqNullSafe(F.col("b")), "left")
    points = F.col("sum") * F.when(F.col("support") > 1, raised).otherwise(10)
    return met.select("query_id", "doc_id", "book", points.alias("points"), "origins").withColumn("rank", F.row_number().over(_ordered()))


def diverse(hits: DataFrame, cap: int = PER_BOOK, k: int = HITS) -> DataFrame:
    """At most cap hits of a book, then the first k, ranked anew."""
    own = F.row_number().over(Window.partitionBy("query_id", "book").orderBy("rank"))
    few = hits.withColumn("in_book", own).filter(F.col("in_book") <= cap).drop("in_book")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)


def _books(hits: DataFrame, name: str, first: int) -> DataFrame:
    """of, <name>: the books of the first hits in the order of their first."""
    top = hits.filter((F.col("rank") <= first) & F.col("book").isNotNull()).groupBy(F.col("query_id").alias("of"), "book").agg(F.min("rank").alias("at"))
    return top.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "book"))), lambda x: x["book"]).alias(name))


def traced(plans: DataFrame, lists: dict[str, DataFrame], final: DataFrame, first: int = TRACED) -> DataFrame:
    """One row a question: query_id, candidates, n_parts, outside, n_<list> hits and <list>_books of each list, final_books, overlap (books that all lists have), support (the lists of the first hit)."""
    out = plans.select("query_id", "candidates", F.size("parts").alias("n_parts"), "outside")
    for name, hits in {**lists, "final": final}.items():
        sizes = hits.groupBy(F.col("query_id").alias("of")).agg(F.count("*").alias(f"n_{name}"))
        out = out.join(sizes, F.col("query_id") == F.col("of"), "left").drop("of").join(_books(hits, f"{name}_books", first), F.col("query_id") == F.col("of"), "left").drop("of").na.fill(0, [f"n_{name}"])
    none = F.array().cast("array<string>")
    shown = [F.coalesce(f"{name}_books", none).alias(f"{name}_books") for name in (*lists, "final")]
    both = None
    for name in lists:
        own = F.coalesce(f"{name}_books", none)
        both = own if both is None else F.array_intersect(both, own)
    leader = final.filter("rank = 1").select(F.col("query_id").alias("of"), F.array_join("origins", "+").alias("support"))
    met = out.join(leader, F.col("query_id") == F.col("of"), "left")
    return met.select("query_id", "candidates", "n_parts", "outside", *[f"n_{name}" for name in (*lists, "final")], *shown, both.alias("overlap"), F.coalesce("support", F.lit("none")).alias("support"))
