"""Searches of several sub-queries and overlays: blocks of postings with bounds, and two levels of rank fusion.

An index has a row for each block of some BLOCK documents of like length and each term in it, so that no row grows with
the corpus: which documents have the term and how often, the most that stands in one, and the least length. It is made
where the documents are, without a shuffle; one that is made for given queries has their terms alone. From the last two numbers comes a bound of what the term adds to a score in
that block; a search adds up the bounds of each block, reads the postings of the block that promises most, and then those
of the blocks alone whose bound reaches the kth score found there. So it gives what scoring all documents would.

Each user query may have several sub-queries; their lists are merged by reciprocal ranks, and so are the lists of a core
corpus and of an overlay. Ranks count hits that noise rules out, which are dropped afterwards; ties go by book, then id.

Defined results: null texts have no terms but count as documents; null ids and null terms are left out; terms that stand
twice in a sub-query count once; no documents or no queries give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.text import token_arrays
from stratum.operators.retrieval import DIGITS, K1, RRF_K, B, bounded, kept

#: Documents of a block.
BLOCK = 512
#: Sub-queries that meet a block in one group, about.
TOGETHER = 4096
#: Terms of sub-queries that are added up at once, each as a row of a block's documents.
ADDED = 4096
INDEX = "block long, term string, ids array<long>, counts array<int>, most int, least int"


def _blocks(size: int):
    """doc_id, text -> INDEX rows: a block's documents and lengths under the null term, then each term's places and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get(), 0
        for b in batches:
            for at in range(0, len(b), size):
                part = b.slice(at, size)
                block, number = ((task.partitionId() if task else 0) << 32) + number, number + 1
                docs = part.column("doc_id").to_numpy()
                found, lengths = token_arrays(part.column("text"))
                coded = found.dictionary_encode()
                place = np.repeat(np.arange(len(part)), lengths)
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                pairs, counts = np.unique(code * size + place, return_counts=True)
                term, place = pairs // size, pairs % size
                starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
                most = np.maximum.reduceat(counts, starts) if len(starts) else starts
                least = np.minimum.reduceat(lengths[place], starts) if len(starts) else starts
                names = pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.take(pa.array(term[starts])).cast(pa.string())])
                ids = pa.ListArray.from_arrays(np.concatenate([[0, len(docs)], len(docs) + np.append(starts[1:], len(term))[: len(starts)]]).astype(np.int32), np.concatenate([docs, place]))
                values = pa.ListArray.from_arrays(ids.offsets, np.concatenate([lengths, counts]).astype(np.int32))
                yield pa.record_batch([pa.array(np.full(len(names), block)), names, ids, values, pa.array(np.append(0, most), pa.int32()), pa.array(np.append(0, least), pa.int32())], names=["block", "term", "ids", "counts", "most", "least"])

    return run


def index(docs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """INDEX rows of docs (doc_id, text), staged; given queries (terms), of those terms alone that they ask for. Documents of a task are put in the order of their lengths first."""
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.sortWithinPartitions(F.octet_length("text"), "doc_id").mapInArrow(_blocks(BLOCK), INDEX)
    if queries is not None:
        asked = queries.select(F.explode("terms").alias("asked")).filter("asked IS NOT NULL").distinct()
        made = made.join(bounded(asked), F.col("term") == F.col("asked"), "left").filter("term IS NULL OR asked IS NOT NULL").drop("asked")
    return kept(made, "postings")


def weights(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """term, idf, mean of the asked terms (term) that stand in the corpus."""
    totals = postings.filter("term IS NULL").agg(F.sum(F.size("ids")).alias("n_docs"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n_tokens"))
    totals = totals.select("n_docs", F.greatest(F.col("n_tokens") / F.col("n_docs"), F.lit(1.0)).alias("mean"))
    df = postings.join(bounded(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
    return df.join(F.broadcast(totals)).select("term", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")  # totals: one row


def block_bounds(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, sub, block, bound: the most that a document of the block can score. asked: query_id, sub, term, idf, mean."""
    part = F.col("idf") * F.col("most") * (K1 + 1) / (F.col("most") + K1 * (1 - B + B * F.col("least") / F.col("mean")))
    met = postings.select("term", "block", "most", "least").join(bounded(asked), "term")
    return met.groupBy("query_id", "sub", "block").agg(F.sum(part).alias("bound"))


def _scored(k: int):
    def run(postings: pa.Table, wanted: pa.Table) -> pa.Table:
        names, types = ("query_id", "sub", "doc_id", "score"), (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        terms = postings.column("term").combine_chunks()
        base = pc.index(terms.is_null(), True).as_py()
        if not wanted.num_rows or base < 0:
            return pa.table([pa.array([], t) for t in types], names=names)
        # each posting's part of a score is made once a block, whatever number of queries asks for it
        lists = postings.column("ids").combine_chunks()
        place, tf, off = lists.values.to_numpy().copy(), postings.column("counts").combine_chunks().values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        docs, lengths = place[off[base] : off[base + 1]].copy(), tf[off[base] : off[base + 1]]
        place[off[base] : off[base + 1]] = 0
        size = np.diff(off)
        idf, mean = (np.repeat(postings.column(c).fill_null(1.0).to_numpy(), size) for c in ("idf", "mean"))
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[place] / mean))

        asked = wanted.column("terms").combine_chunks()
        row = pc.index_in(asked.flatten(), terms)
        owner = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())[row.is_valid().to_numpy(zero_copy_only=False)]
        row = row.drop_null().to_numpy().astype(np.int64)
        score = np.zeros((len(asked), len(docs)))
        for at in range(0, len(row), ADDED):
            own, mine = row[at : at + ADDED], owner[at : at + ADDED]
            some, line = np.unique(own, return_inverse=True)
            n = size[some]
            of = np.repeat(np.arange(len(some)), n)
            source = np.arange(len(of)) + (off[some] - np.cumsum(n) + n)[of]
            dense = np.zeros((len(some), len(docs)))
            dense[of, place[source]] = part[source]
            edges = np.flatnonzero(np.diff(mine, prepend=-1, append=len(asked)))
            for i, j in zip(edges[:-1], edges[1:]):
                score[mine[i]] += dense[line[i:j]].sum(axis=0)
        score *= 10**DIGITS
        score += 0.5
        np.floor(score, out=score)
        score /= 10**DIGITS

        least = wanted.column("least").to_numpy()[:, None]
        if len(docs) > k:
            least = np.maximum(least, np.partition(score, len(docs) - k, axis=1)[:, [len(docs) - k]])
        q, d = np.nonzero((score > 0) & (score >= least))
        order = np.lexsort((docs[d], -score[q, d], q))
        q, d = q[order], d[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, d = q[first], d[first]
        found = (wanted.column("query_id").to_numpy()[q], wanted.column("sub").to_numpy()[q], docs[d], score[q, d])
        return pa.table([pa.array(c, t) for c, t in zip(found, types)], names=names)

    return run


def _hits(postings: DataFrame, wanted: DataFrame, k: int, groups: int) -> DataFrame:
    """The k best of each block of wanted (query_id, sub, block, least, terms). postings: block, term, ids, counts, idf, mean."""
    part = F.pmod(F.xxhash64("query_id", "sub"), F.lit(groups)).cast("int")
    wanted = wanted.withColumn("part", part)
    blocks = wanted.select("block", "part").distinct().select(F.col("block").alias("of"), F.col("part").alias("for"))
    # each block's rows: its documents, and its terms that are asked for at all
    rows = postings.join(blocks, F.col("block") == F.col("of")).select("block", F.col("for").alias("part"), "term", "ids", "counts", "idf", "mean")
    return rows.groupBy("block", "part").cogroup(wanted.groupBy("block", "part")).applyInArrow(_scored(k), "query_id long, sub long, doc_id long, score double")


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "sub").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def plan_blocks(postings: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of queries (query_id, sub, terms): their terms as lists, the bounds of their blocks, and the weighted postings of asked terms. Staged."""
    asked = queries.select("query_id", "sub", F.explode(F.array_distinct("terms")).alias("term")).filter("term IS NOT NULL AND query_id IS NOT NULL").distinct()
    weighted = kept(weights(postings, asked), "weights")
    asked = kept(asked.join(bounded(weighted), "term"), "asked")
    lists = asked.groupBy("query_id", "sub").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    none = F.lit(None).cast("double")
    only = postings.join(bounded(weighted), "term").unionByName(postings.filter("term IS NULL").withColumns({"idf": none, "mean": none}))
    return lists, kept(block_bounds(postings, asked), "bounds"), only


def search(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, sub, doc_id, score, rank: the k best of each sub-query by BM25, as if all documents were scored. queries: query_id, sub, terms (array)."""
    lists, bounds, only = plan_blocks(postings, queries)
    groups = max(1, -(-lists.count() // TOGETHER))
    order = Window.partitionBy("query_id", "sub").orderBy(F.desc("bound"), "block")
    best = bounds.withColumn("place", F.row_number().over(order)).filter("place = 1").select("query_id", "sub", "block")
    keys = ["query_id", "sub"]
    first = kept(_hits(only, best.withColumn("least", F.lit(0.0)).join(lists, keys), k, groups), "first-hits")
    kth = _first(first, k).filter(F.col("rank") == k).select(*keys, F.col("score").alias("least"))
    left = bounds.join(best.withColumn("done", F.lit(True)), [*keys, "block"], "left").filter("done IS NULL").join(kth, keys, "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    # scores are rounded: a bound may be below its document's score by half of the last digit
    left = left.filter(F.col("bound") >= F.col("least") - 10.0**-DIGITS).select(*keys, "block", "least").join(lists, keys)
    return _first(first.unionByName(_hits(only, left, k, groups)), k)


def merge_lists(lists: dict[str, tuple[DataFrame, float]], k: int, noise: Column | None = None, digits: int = 8) -> DataFrame:
    """query_id, doc_id, book, score, rank, and <name>_rank of each list: weighted reciprocal ranks added up. Lists: query_id, doc_id, book, rank; a document may stand in a list several times."""
    each = None
    for name, (hits, weight) in lists.items():
        own = hits.select("query_id", "doc_id", "book", F.lit(name).alias("origin"), "rank", (F.lit(weight) / (RRF_K + F.col("rank"))).alias("part"))
        each = own if each is None else each.unionByName(own)
    if noise is not None:
        each = each.filter(~F.coalesce(noise, F.lit(False)))
    ranks = [F.min(F.when(F.col("origin") == name, F.col("rank"))).alias(f"{name}_rank") for name in lists]
    merged = each.groupBy("query_id", "doc_id", "book").agg(F.round(F.sum("part"), digits).alias("score"), *ranks)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("book").asc_nulls_first(), "doc_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def of_selection(hits: DataFrame, contexts: DataFrame) -> DataFrame:
    """hits (query_id, draft, ...) of the drafts that their query selects; contexts: query_id, restricted, selected (array). Queries that aren't restricted keep all."""
    own = contexts.select("query_id", "restricted", "selected")
    allowed = ~F.coalesce("restricted", F.lit(False)) | F.array_contains(F.transform(F.coalesce("selected", F.array().cast("array<string>")), lambda d: F.trim(d)), F.col("draft"))
    return hits.join(bounded(own), "query_id", "left").filter(allowed).drop("restricted", "selected")


def with_overlay(core: DataFrame, overlay: DataFrame, k: int, weight: float, names: tuple[str, str] = ("core", "overlay"), noise: Column | None = None) -> DataFrame:
    """Both lists merged where a query has hits in the overlay; where it has none, the core list as it is."""
    core, overlay = kept(core, names[0]), kept(overlay, names[1])
    has = overlay.select("query_id").distinct()
    both = merge_lists({names[0]: (core.join(has, "query_id", "left_semi"), 1.0), names[1]: (overlay, weight)}, k, noise)
    alone = core.join(has, "query_id", "left_anti").select("query_id", "doc_id", "book", "score", "rank")
    return both.select("query_id", "doc_id", "book", "score", "rank").unionByName(alone)


def multi_search(core: DataFrame, overlay: DataFrame | None, k: int, weight: float = 1.35, noise: Column | None = None) -> DataFrame:
    """query_id, doc_id, book, score, rank from hits of sub-queries (query_id, sub, doc_id, book, rank): first over sub-queries, then with the overlay."""
    over = lambda hits, name: merge_lists({name: (hits, 1.0)}, k, noise).select("query_id", "doc_id", "book", "score", "rank")
    return over(core, "core") if overlay is None else with_overlay(over(core, "core"), over(overlay, "overlay"), k, weight, noise=noise)


def multi_vector_search(official: DataFrame, private: DataFrame, k: int, weight: float = 1.15, noise: Column | None = None) -> DataFrame:
    """The same columns from hits of sub-queries by vectors: each sub-query's two lists are merged where both have hits, then the sub-queries."""
    keyed = lambda hits: hits.withColumn("asked", F.col("query_id")).withColumn("query_id", F.struct("asked", "sub")).select("query_id", "doc_id", "book", "score", "rank")
    official, private = kept(keyed(official), "official"), kept(keyed(private), "private")
    has = official.select("query_id").distinct().join(private.select("query_id").distinct(), "query_id")
    both = merge_lists({"official": (official.join(has, "query_id", "left_semi"), 1.0), "private": (private.join(has, "query_id", "left_semi"), weight)}, k, noise)
    alone = official.unionByName(private).join(has, "query_id", "left_anti")
    lists = both.select("query_id", "doc_id", "book", "rank").unionByName(alone.select("query_id", "doc_id", "book", "rank"))
    return merge_lists({"vector": (lists.withColumn("query_id", F.col("query_id.asked")), 1.0)}, k, noise).select("query_id", "doc_id", "book", "score", "rank")
