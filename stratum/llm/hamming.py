"""Exact top-k search among binary codes, by incremental multi-index hashing.

A vector's code has one bit for each dimension: whether it is above zero. Codes are cut into segments, and equal codes are
one entry with its k smallest ids. A search radius grows segment by segment: a step probes the values at just that many bits
from the query's own in one segment (or, while they are few, in all). All codes that a probe meets are verified in full,
and the k best so far are kept. If segments 0 to t have been probed up to radius r, and the others up to r - 1, a code that
no probe has met differs from the query in more than segments * r + t bits. So a query is done as soon as its kth verified
distance is within that; its steps end, and nothing else ends them.

A pair of codes is met once: in the step of the least distance that a segment of theirs has, in the first such segment.
Candidates farther than a query's kth distance so far are dropped where they are met. Segments get longer as codes get more,
so that a probed value stands for a few codes. Probes are made in tasks from the queries' codes, a step at a time, and
meet the codes in a join by segment and value; equal query codes are searched once.

Defined results: a null vector, or one of another length, has no code and is in no result; ids tie-break equal distances;
rows of one id and code are one; with fewer than k codes there are fewer results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, staged, tidy

BITS, TOP = 64, 10
QUERY_EVERY = 100
#: Probes of a query in a segment up to which all segments grow in one step.
TOGETHER = 400
#: Rows of probes that a task makes at once, about.
PROBE_ROWS = 1 << 16


def code_of(vector: str) -> Column:
    bits = [F.when(F.get(quoted(vector), F.lit(k)) > 0, F.lit((1 << k) if k < 63 else -(1 << 63))).otherwise(F.lit(0)) for k in range(BITS)]
    code = F.lit(0).cast("long")
    for b in bits:
        code = code.bitwiseOR(b.cast("long"))
    return F.when(F.size(quoted(vector)) == BITS, code)


def _bounds(segments: int) -> list[tuple[int, int]]:
    edges = [round(BITS * k / segments) for k in range(segments + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _segment(code: Column, start: int, end: int) -> Column:
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << (end - start)) - 1))


@cache
def _changes(width: int, radius: int) -> np.ndarray:
    """All values of width bits of which radius are set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)


def _probes(group: list[tuple[int, int, int]], radius: int) -> Callable:
    """Rows q, bound -> also s and v: the values at radius bits from the query's in each segment of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, bound = b.column("q").to_numpy(), b.column("bound").to_numpy()
            for s, start, end in group:
                changes = _changes(end - start, radius)
                own = (q.view(np.uint64) >> np.uint64(start) & np.uint64((1 << (end - start)) - 1)).astype(np.int64)
                step = max(1, PROBE_ROWS // max(1, len(changes)))
                for i in range(0, len(q), step):
                    part = own[i : i + step]
                    values = (part[:, None] ^ changes).ravel()
                    columns = [np.repeat(q[i : i + step], len(changes)), np.repeat(bound[i : i + step], len(changes)), np.full(len(values), s, np.int32), values]
                    yield pa.record_batch([pa.array(c) for c in columns], names=["q", "bound", "s2", "v2"])

    return run


def _steps(bounds: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int, int]], int, int]]:
    """Each step's segments and radius, and the distance within which all codes have been met after it."""
    longest = max(b - a for a, b in bounds)
    whole = [(s, a, b) for s, (a, b) in enumerate(bounds)]
    for radius in range(longest + 1):
        together = comb(longest, radius) <= TOGETHER
        for t, one in enumerate(whole):
            last = t == len(whole) - 1
            if not together or last:
                yield (whole if together else [one]), radius, BITS if last and radius == longest else len(bounds) * radius + t


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: the k nearest codes to each query's, itself included if it is a row."""
    coded = lambda df: df.select(quoted(id).cast("long").alias("id"), code_of(vector).alias("code")).filter("id IS NOT NULL AND code IS NOT NULL").distinct()
    ranked = coded(vectors).withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("n") <= k)
    index = staged(ranked.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "hamming-codes")
    size = index.count()
    asked = staged(coded(queries).select(F.col("id").alias("query_id"), F.col("code").alias("q")), "hamming-queries")
    bounds = _bounds(max(2, min(BITS // 4, ceil(BITS / max(4.0, log2(max(2, size)))))))
    open_ = staged(asked.select("q", F.lit(BITS).alias("bound")).distinct(), "hamming-open")
    best = vectors.sparkSession.createDataFrame([], "q long, vec_id long, distance int, rank int, bound int")
    done = best
    for group, radius, near in _steps(bounds):
        if not size or open_.isEmpty():
            break
        met = _met(index, open_, bounds, group, radius)
        best = staged(_best(best.select("q", "vec_id", "distance").unionByName(met), k), "hamming-best")
        done = done.unionByName(best.filter(F.col("bound") <= near))
        best = best.filter(F.col("bound") > near)
        kth = best.filter("rank = 1").select(F.col("q").alias("of"), F.col("bound").alias("now"))
        # a query that has met nothing yet stays open
        over = done.filter("rank = 1").select(F.col("q").alias("of"))
        open_ = staged(open_.join(over, F.col("q") == F.col("of"), "left_anti").join(kth, F.col("q") == F.col("of"), "left").select("q", F.coalesce("now", "bound").alias("bound")), "hamming-open")
    return asked.join(done, "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))


def _met(index: DataFrame, queries: DataFrame, bounds: list[tuple[int, int]], group: list[tuple[int, int, int]], radius: int) -> DataFrame:
    """q, vec_id, distance of all codes that the step's probes meet and no earlier probe has met."""
    values = index.select("code", "ids", F.inline(F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col("code"), a, b).alias("v")) for s, a, b in group])))
    probed = queries.mapInArrow(tidy(_probes(group, radius)), "q long, bound int, s2 int, v2 long")
    differ = F.col("code").bitwiseXOR(F.col("q"))
    first = F.lit(True)
    for s, (a, b) in enumerate(bounds):
        own = F.bit_count(_segment(differ, a, b))
        first = first & F.when(F.col("s") > s, own > radius).when(F.col("s") < s, own >= radius).otherwise(F.lit(True))
    joined = probed.join(values, (F.col("s") == F.col("s2")) & (F.col("v") == F.col("v2")) & (F.bit_count(differ) <= F.col("bound")) & first)
    return joined.select("q", F.explode("ids").alias("vec_id"), F.bit_count(differ).cast("int").alias("distance"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank and the kth distance (BITS if there are fewer) as bound."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.withColumn("bound", F.coalesce(F.max(F.when(F.col("rank") == k, F.col("distance"))).over(Window.partitionBy("q")), F.lit(BITS)).cast("int"))


def every_hundredth(vectors: DataFrame, k: int = TOP) -> DataFrame:
    return top_k(vectors, vectors.filter(quoted("vec_id") % QUERY_EVERY == 0), k)


SQL = f"""
WITH coded AS (
  SELECT DISTINCT vec_id, list_sum(list_transform(range({BITS}), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i) ELSE 0::HUGEINT END))::UBIGINT AS code
  FROM embeddings WHERE len(embedding) = {BITS}
), found AS (
  SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.code, v.code))::INT AS distance FROM coded q, coded v WHERE q.vec_id % {QUERY_EVERY} = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank, vec_id, distance FROM found
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {TOP}
"""
