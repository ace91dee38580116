"""Lexical, vector and fused retrieval over batches of queries.

A table of queries is the small side; it is broadcast only up to QUERY_ROWS rows and BROADCAST_BYTES, beyond that joins shuffle. Ranks are
partitioned by query, so that no query's hits pass through another's task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.functions.text import cosine, tokens
from stratum.sources.tables import FREED, reread  # noqa: F401

K1, B = 1.5, 0.75
RRF_K = 60
QUERY_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
#: Asked terms up to which a row's tokens are filtered inside the row.
FEW_TERMS = 32
DIGITS = 6
#: Queries that meet a batch of vectors in one row, and those of them that are compared with it at once.
QUERY_BLOCK, QUERY_SLICE = 256, 32
#: Pairs of an asked term of a query and a document that one task adds up, about.
PAIRS = 1 << 20


def bounded(queries: DataFrame) -> DataFrame:
    """queries, marked for broadcast if they are few and take BROADCAST_BYTES at most as text."""
    size = F.sum(F.length(F.to_json(F.struct("*"))).cast("long"))
    n, taken = queries.limit(QUERY_ROWS + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(queries) if n <= QUERY_ROWS and taken <= BROADCAST_BYTES else queries


def term_statistics(docs: DataFrame) -> DataFrame:
    """term, df, cf: in how many documents a term stands, and how often."""
    each = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def document_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("n_terms"))


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank. queries: query_id, terms (array).

    The texts are cut into tokens once: of each document its length and how often each asked term stands in it leave the
    scan. Where few terms are asked, other tokens are dropped inside the row, before anything is exploded.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).filter(F.col("term").isNotNull()).distinct()
    terms = asked.select("term").distinct()
    few = [r.term for r in terms.limit(FEW_TERMS + 1).collect()]
    scanned = docs.select("doc_id", tokens(F.col("text")).alias("all")).select("doc_id", F.size("all").alias("n"), "all")
    if len(few) <= FEW_TERMS:
        wanted = F.array(*[F.lit(t) for t in few]).cast("array<string>")
        own = scanned.select("doc_id", "n", F.filter("all", lambda x: F.array_contains(wanted, x)).alias("all"))
        counts = F.transform(F.array_distinct("all"), lambda t: F.struct(t.alias("term"), F.size(F.filter("all", lambda x: x == t)).cast("long").alias("tf")))
        found = own.select("doc_id", "n", F.explode_outer(counts).alias("c")).select("doc_id", "n", "c.term", "c.tf")
    else:
        own = scanned.select("doc_id", "n", F.explode_outer("all").alias("term")).join(bounded(terms.withColumn("hit", F.lit(True))), "term", "left")
        found = own.groupBy("doc_id", "n", F.when(F.col("hit"), F.col("term")).alias("term")).agg(F.count("*").alias("tf"))
        # a row without a term keeps the document's length
        found = found.select("doc_id", "n", "term", F.when(F.col("term").isNotNull(), F.col("tf")).alias("tf"))
    found = kept(found, "bm25")
    totals = found.groupBy("doc_id").agg(F.first("n").alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean"))
    tf = found.filter(F.col("term").isNotNull())
    df = kept(tf.groupBy("term").agg(F.count("*").alias("df")), "bm25-df")
    pairs = df.join(asked.groupBy("term").agg(F.count("*").alias("asks")), "term").agg(F.sum(F.col("df") * F.col("asks"))).first()[0] or 0
    weighted = tf.join(bounded(df), "term").join(F.broadcast(totals))  # totals: one row
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.greatest("mean", F.lit(1.0))))
    # dealt by document before queries multiply the rows: a task adds up its own documents' scores, and only their first k go by query
    dealt = weighted.select("term", "doc_id", part.alias("part")).repartition(max(1, -(-pairs // PAIRS)), "doc_id")
    scored = dealt.join(bounded(asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return top(scored.filter("score > 0"), k, F.desc("score"), F.col("doc_id"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine in local mode only; elsewhere none ('')."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ("file:///tmp/checkpoints" if spark.sparkContext.master.startswith("local[") else "")
    return root.rstrip("/")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names, read back: it is made once, and a lost executor loses none of it.

    Without such a folder (as in local tests) one is taken in local mode only; elsewhere df stays as it is. The shuffle files
    that made the table go with the statement that writes it.
    """
    root = shared_folder(df.sparkSession)
    if not root:
        return df
    return reread(df, f"{root}/{tag}-{uuid.uuid4().hex}")


def top(hits: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k of each query, with their rank."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank by cosine over zero. queries: query_id, vector."""
    pairs = vectors.select(F.col("vec_id").alias("doc_id"), "embedding").join(bounded(queries))
    scored = pairs.select("query_id", "doc_id", F.round(cosine(F.col("embedding"), F.col("vector")), DIGITS).alias("score"))
    return top(scored.filter("score > 0"), k, F.desc("score"), F.col("doc_id"))


def _packed(rows: int):
    """id, vector -> dim, ids and unit vectors as bytes, rows of them at once, however they come in batches; null, unequal and zero vectors score nothing."""

    def part(dim: int, own: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ids, data = np.array([i for i, _ in own], np.int64).tobytes(), np.stack([x for _, x in own]).tobytes()
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([ids], pa.binary()), pa.array([data], pa.binary())], names=["dim", "ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("vector")):
                if i is not None and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy().astype(np.float64)
                    if 0 < (norm := np.sqrt(x @ x)) < np.inf:
                        own = by_dim.setdefault(len(x), [])
                        own.append((i, x / norm))
                        if len(own) == rows:
                            yield part(len(x), by_dim.pop(len(x)))
        yield from (part(dim, own) for dim, own in by_dim.items())

    return run


def cosine_top_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same as cosine_top for many queries: blocks of queries meet batches of vectors, and only the k best of each pair leave a task."""
    packed = lambda df, id, vector, rows: df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector")).mapInArrow(_packed(rows), "dim int, ids binary, data binary")
    asked = packed(queries, "query_id", "vector", QUERY_BLOCK).toDF("q_dim", "q_ids", "q_data")
    if queries.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS:
        asked = F.broadcast(asked)

    def best(ids: np.ndarray, rows: np.ndarray, q_ids: np.ndarray, asked_rows: np.ndarray) -> pa.RecordBatch:
        s = asked_rows @ rows.T
        s *= 10**DIGITS
        s += 0.5
        np.floor(s, out=s)
        s /= 10**DIGITS
        least = np.partition(s, len(ids) - k, axis=1)[:, [len(ids) - k]] if len(ids) > k else -np.inf
        q, v = np.nonzero((s >= least) & (s > 0))
        order = np.lexsort((ids[v], -s[q, v], q))
        q, v = q[order], v[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, v = q[first], v[first]
        return pa.record_batch([pa.array(q_ids[q]), pa.array(ids[v]), pa.array(s[q, v])], names=["query_id", "doc_id", "score"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim, ids, data, q_ids, q_data = (b.column(c)[r].as_buffer() if c != "dim" else b.column(c)[r].as_py() for c in ("dim", "ids", "data", "q_ids", "q_data"))
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                rows, asked_rows = np.frombuffer(data).reshape(-1, dim), np.frombuffer(q_data).reshape(-1, dim)
                for at in range(0, len(q_ids), QUERY_SLICE):
                    yield best(ids, rows, q_ids[at : at + QUERY_SLICE], asked_rows[at : at + QUERY_SLICE])

    pairs = packed(vectors, "vec_id", "embedding", 1 << 13).crossJoin(asked).filter("dim = q_dim")
    hits = pairs.mapInArrow(scored, "query_id long, doc_id long, score double")
    return top(hits, k, F.desc("score"), F.col("doc_id"))


def rrf(lists: dict[str, tuple[DataFrame, float]], k: int, noise: Column | None = None) -> DataFrame:
    """query_id, doc_id, score, n_sources: weighted reciprocal ranks added up. Ranks count noise, which is dropped afterwards."""
    each = None
    for name, (hits, weight) in lists.items():
        own = hits.select("query_id", "doc_id", F.lit(name).alias("origin"), (F.lit(weight) / (RRF_K + F.col("rank"))).alias("part"))
        each = own if each is None else each.unionByName(own)
    if noise is not None:
        each = each.filter(~noise)
    merged = each.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 8).alias("score"), F.countDistinct("origin").alias("n_sources"))
    return top(merged, k, F.desc("score"), F.col("doc_id"))


def fuse(lists: dict[str, tuple[DataFrame, float]], books: DataFrame, k: int, both: float = 1.1) -> DataFrame:
    """Reciprocal ranks, raised for books that several lists have among their first ten. books: doc_id, book."""
    lists = {name: (kept(hits, "hits"), weight) for name, (hits, weight) in lists.items()}
    ranked = None
    for name, (hits, _) in lists.items():
        own = hits.filter("rank <= 10").select("query_id", "doc_id", F.lit(name).alias("origin"))
        ranked = own if ranked is None else ranked.unionByName(own)
    support = ranked.join(books, "doc_id").groupBy("query_id", "book").agg(F.countDistinct("origin").alias("support"))
    merged = rrf(lists, 1 << 30).drop("rank").join(books, "doc_id").join(support, ["query_id", "book"], "left")
    raised = F.round(F.col("score") * F.when(F.col("support") >= 2, both).otherwise(1.0), 8)
    return top(merged.select("query_id", "doc_id", "book", raised.alias("score")), k, F.desc("score"), F.col("book"), F.col("doc_id"))


def diversify(hits: DataFrame, cap: int, k: int) -> DataFrame:
    """At most cap hits of a book, then the first k."""
    order = (F.desc("score"), F.col("book"), F.col("doc_id"))
    own = F.row_number().over(Window.partitionBy("query_id", "book").orderBy(*order))
    return top(hits.drop("rank").withColumn("in_book", own).filter(F.col("in_book") <= cap), k, *order)
