"""A corpus as a graph: its books, chunks and shared signals, edges of any kind between them, and what a reader needs of it alone.

From one table of what each chunk signals come the hyperedges (a signal and the chunks and books that share it) and, through
them, edges between books. A signal that many books share makes as many pairs as the square of their number: its books are
dealt to blocks, and pairs of blocks are tasks of their own, so that no task makes more than BLOCK * BLOCK pairs of a signal.
The full graph and the compact one are made of the same edges, which are checked for ends that aren't there.

What books share over all kinds (`related`) is made in rounds of some of the books: lists of a signal's books go to each of
them, are counted there and leave as what is asked (the first few, or their number), so that disk holds one round's lists.
Books are numbered in the order of their names, so that lists are arrays of numbers, which a task sorts and counts at once.

Defined results: blank and null signals, books and chunks are left out; a chunk that has a signal twice has it once; a
signal of one chunk is no hyperedge, one within a single book makes no pair; books are compared by their names as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.normalise import signal
from stratum.operators.retrieval import bounded, kept

#: Books of a signal that one task pairs with as many others at most, about.
BLOCK = 512
#: Entries of lists that a round deals at least, and for each book of a signal; and those of one task, about.
ROUND, ROUND_SHARE, TASK = 1 << 25, 4, 1 << 20
#: Rows that Python looks at at once, at least, and entries of lists.
ROWS, SPAN = 1 << 15, 1 << 17


def chunk_signals(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """book, chunk, kind, value, shown of each signal of each chunk, once. chunks: book, chunk and arrays; fields: kind -> column."""
    told = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), signal(v).alias("value"), F.trim(v).alias("shown"))
    each = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), told(k)) for k, c in fields.items()]
    rows = chunks.filter("book <> '' AND chunk IS NOT NULL").select("book", "chunk", F.inline(F.concat(*each)))
    return rows.filter("value <> ''").groupBy("book", "chunk", "kind", "value").agg(F.min("shown").alias("shown"))


def hyperedges(signals: DataFrame, least: int = 2) -> DataFrame:
    """kind, value, shown, n_chunks, n_books of signals that `least` chunks share."""
    by_book = signals.groupBy("kind", "value", "book").agg(F.count("*").alias("n"), F.min("shown").alias("shown"))
    return by_book.groupBy("kind", "value").agg(F.min("shown").alias("shown"), F.sum("n").alias("n_chunks"), F.count("*").alias("n_books")).filter(F.col("n_chunks") >= least)


def book_pairs(signals: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b (a < b), kind, shared, chunks: how many signals of a kind two books share, and the chunks that have them in both."""
    by_book = kept(signals.groupBy("kind", "value", "book").agg(F.count("*").alias("n")), "graph-books")
    sizes = by_book.groupBy("kind", "value").agg(F.count("*").alias("books")).filter("books > 1")
    # two parts of one signal's blocks meet once; a book is in each pair that its own block is in
    own = by_book.join(sizes, ["kind", "value"]).withColumn("blocks", F.ceil(F.col("books") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("book"), "blocks").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("kind", "value", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "book", "n")
    left = dealt.select("kind", "value", "one", "two", F.col("part").alias("left_part"), F.col("book").alias("a"), F.col("n").alias("n_a"))
    right = dealt.select("kind", "value", "one", "two", F.col("part").alias("right_part"), F.col("book").alias("b"), F.col("n").alias("n_b"))
    met = left.join(right, ["kind", "value", "one", "two"]).filter((F.col("a") < F.col("b")) & ((F.col("one") == F.col("two")) | (F.col("left_part") != F.col("right_part"))))
    return met.groupBy("a", "b", "kind").agg(F.count("*").alias("shared"), F.sum(F.col("n_a") + F.col("n_b")).alias("chunks"))


def _numbered(rows: DataFrame, ordered: bool = True) -> DataFrame:
    """rows with id: the numbers of their books, if ordered in the order of the names. A book's rows are in one task, sorted and spilled like any rows."""
    placed = (rows.repartitionByRange("book") if ordered else rows.repartition("book")).sortWithinPartitions("book").withColumn("row", F.monotonically_increasing_id())
    return placed.withColumn("id", F.min("row").over(Window.partitionBy("book"))).drop("row")


def _value(told: Column) -> Column:
    """`signal`, by its pattern only where there is white space beside single spaces."""
    rare = reduce(Column.__or__, [F.contains(told, F.lit(x)) for x in ("  ", "\t", "\n", "\x0b", "\f", "\r")])
    return F.when(rare, signal(told)).otherwise(F.lower(F.trim(told)))


def numbered_signals(chunks: DataFrame, fields: dict[str, str | Column], ordered: bool = True) -> DataFrame:
    """id, book, chunk, kind, value of each signal of each chunk, with the books' numbers: one shuffle, of the chunks.

    fields: kind -> an array, as a column's name or what makes it of the chunks' columns, which are then shuffled in its place.
    Where a chunk has a signal twice its row may come twice; what counts them counts it once.
    """
    told = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("told"))
    each = [F.transform(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")), told(k)) for k, c in fields.items()]
    rows = _numbered(chunks.filter("book <> '' AND chunk IS NOT NULL"), ordered)
    # a value is made plain beside the explode: inside an array's lambda it would be interpreted
    own = rows.select("id", "book", "chunk", F.inline(F.concat(*each))).select("id", "book", "chunk", "kind", _value(F.col("told")).alias("value"))
    return own.filter("value <> ''")


def numbered(signals: DataFrame) -> DataFrame:
    """id, book, chunk, kind, value: signals with the numbers of their books, in the order of the names; those that have them stay as they are."""
    if "id" in signals.columns:
        return signals
    return kept(_numbered(signals.select("book", "chunk", "kind", "value")), "graph-ids")


def _runs(batches: Iterable[pa.RecordBatch], key: str, once: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows again, in tables that end where a run of equal keys does, and where each run starts. Of a run that grows long, rows with the same once may be left out but one."""
    held, n, most = [], 0, ROWS
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t[key].to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            if len(starts) > 1:
                yield t.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            rest = t.slice(starts[-1])
            if rest.num_rows >= ROWS:
                rest = rest.append_column("first", pa.array(np.arange(rest.num_rows)))
                rest = rest.take(rest.group_by(list(once)).aggregate([("first", "min")])["first_min"]).drop_columns("first")
            held = rest.combine_chunks().to_batches()
            n = rest.num_rows
            most = max(ROWS, 2 * n)
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t[key].to_numpy()
        yield t, np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a list of the numbers of a signal's books, sorted, and of how many chunks have it. Rows come by a hash of the signal and part, which several signals may have."""
    for t, starts in _runs(batches, "h", ("signal", "id", "chunk")):
        ids, chunks, names = t["id"].to_numpy(), t["chunk"].to_numpy(), t["signal"].chunk(0)
        run = np.zeros(t.num_rows, np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        if (pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False) & (run[1:] == run[:-1])).any():
            codes = names.dictionary_encode().indices.to_numpy()
            run = np.unique(run * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        order = np.lexsort((chunks, ids, run))
        run, ids, chunks = run[order], ids[order], chunks[order]
        start = np.append(True, run[1:] != run[:-1])
        book = start | np.append(True, ids[1:] != ids[:-1])
        pair = book | np.append(True, chunks[1:] != chunks[:-1])
        starts = np.flatnonzero(start)
        ends = np.append(np.cumsum(book)[starts] - 1, book.sum()).astype(np.int32)
        own = t.select(["signal", "blocks"]).take(pa.array(order[starts])).combine_chunks()
        yield pa.record_batch([*(c.chunk(0) for c in own.columns), pa.array(np.add.reduceat(pair.astype(np.int64), starts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[book]))], names=["signal", "blocks", "chunks", "books"])


def _listed(signals: DataFrame, block: int = BLOCK) -> DataFrame:
    """signal, blocks, chunks (how many), books (numbers, sorted): the books of each signal that two chunks have, a signal of more than `block` rows in several lists."""
    keyed = signals.select(F.xxhash64("kind", "value").alias("h"), F.concat("kind", F.lit("\0"), "value").alias("signal"), "id", "chunk")
    hot = kept(keyed.groupBy("h").agg(F.ceil(F.count("*") / block).alias("n")).filter("n > 1"), "graph-hot")
    rows = keyed.join(bounded(hot), "h", "left").withColumn("blocks", F.coalesce("n", F.lit(1)).cast("long"))
    # sorted by one number: signals that have the same are told apart in the task
    dealt = rows.select(F.xxhash64("h", F.pmod(F.xxhash64("id"), "blocks")).alias("h"), "signal", "id", "chunk", "blocks").repartition("h").sortWithinPartitions("h")
    return kept(dealt.mapInArrow(_lists, "signal string, blocks long, chunks long, books array<long>").filter("blocks > 1 OR chunks > 1"), "graph-lists")


def related(signals: DataFrame, ids: DataFrame, block: int = BLOCK, entries: int = ROUND, both: bool = True) -> Iterator[DataFrame]:
    """id, others: lists of books that share a signal with the book of that number, itself included, or (not both) at least those of greater numbers.

    ids: `numbered` of signals. Each table is a round and has all lists of its books, each book's in one task, sorted by id.
    """
    return _dealt(_listed(ids, block), entries, both)


def _dealt(listed: DataFrame, entries: int, both: bool) -> Iterator[DataFrame]:
    size = F.size("books").cast("long")
    lists = listed.filter("blocks > 1 OR size(books) > 1")
    own = size * size if both else (size * (size - 1) / 2).cast("long")
    by = lists.groupBy(F.when(F.col("blocks") > 1, F.col("signal")).alias("hot")).agg(F.sum(size).alias("n"), F.sum(own).alias("own"))
    total, members, hot = by.agg(F.coalesce(F.sum(F.when(F.col("hot").isNull(), F.col("own")).otherwise(F.col("n") * F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("hot")).first()
    rounds = max(1, -(-total // max(entries, ROUND_SHARE * members)))
    tasks = max(1, -(-total // rounds // TASK))
    for k in range(rounds):
        mine = F.pmod(F.xxhash64("id"), F.lit(rounds)) == k
        met = lists.filter("blocks = 1").select(F.posexplode("books").alias("at", "id"), "books").filter(mine)
        if not both:  # lists are sorted
            met = met.filter(F.col("at") + 1 < F.size("books")).withColumn("books", F.slice("books", F.col("at") + 2, F.size("books")))
        met = met.select("id", F.col("books").alias("others"))
        if hot:
            many = lists.filter("blocks > 1")
            met = met.unionByName(many.select("signal", F.col("books").alias("own")).join(many.select("signal", F.col("books").alias("others")), "signal").select(F.explode("own").alias("id"), "others").filter(mine))
        yield met.repartition(tasks, "id").sortWithinPartitions("id")


def _weighed(batches: Iterable[pa.RecordBatch], span: int = SPAN) -> Iterator[tuple[np.ndarray, ...]]:
    """own, at, other, weight of whole books: in how many lists of own[at] the other is, by at and other. Rows come by id; about span entries are counted at once, and a book of more bit by bit."""

    def counted(ids: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
        new = np.append(True, ids[1:] != ids[:-1])
        own, at = ids[new], np.repeat(np.cumsum(new) - 1, sizes)
        bits = int(others.max(initial=0)).bit_length()
        if bits + len(own).bit_length() < 64:
            key = at << bits
            key |= others
            key.sort()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            first = key[starts]
            at, others = first >> bits, first & ((1 << bits) - 1)
        else:
            order = np.lexsort((others, at))
            at, others = at[order], others[order]
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (others[1:] != others[:-1]))[: len(at)])
            at, others = at[starts], others[starts]
        return own, at, others, np.diff(np.append(starts, sizes.sum()))

    def merged(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
        """What left, a single book, and right say, where both may be of the same book."""
        if left[0][0] != right[0][0]:
            yield left
            yield right
            return
        n = np.searchsorted(right[1], 1)
        other, back = np.unique(np.append(left[2], right[2][:n]), return_inverse=True)
        weight = np.bincount(back, np.append(left[3], right[3][:n])).astype(np.int64)
        yield right[0], np.append(np.zeros(len(other), np.int64), right[1][n:]), np.append(other, right[2][n:]), np.append(weight, right[3][n:])

    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                lists = b.column("others")
                held.append((b.column("id").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()))
                n += len(held[-1][2])
            if n >= span:
                yield counted(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if held:
            yield counted(*(np.concatenate(x) for x in zip(*held)))

    last = None
    for part in parts():
        for whole in merged(last, part) if last else (part,):
            own, at, other, weight = whole
            n = np.searchsorted(at, len(own) - 1)
            if len(own) > 1:
                yield own[:-1], at[:n], other[:n], weight[:n]
            if last is not None and whole is last:
                yield last
            last = own[-1:], at[n:] - len(own) + 1, other[n:], weight[n:]
    if last:
        yield last


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pairs of a book and one of a greater number there are."""
    n = sum(int((other > own[at]).sum()) for own, at, other, _ in _weighed(batches))
    yield pa.record_batch([pa.array([n])], names=["n"])


def related_count(signals: DataFrame, block: int = BLOCK, entries: int = ROUND) -> DataFrame:
    """measure, n: how many edges between books the full graph has."""
    return _pair_count(_listed(numbered(signals), block), entries)


def _pair_count(lists: DataFrame, entries: int = ROUND) -> DataFrame:
    counts = [kept(dealt.mapInArrow(_later, "n long"), "graph-count") for dealt in _dealt(lists, entries, both=False)]
    return reduce(DataFrame.unionByName, counts).agg(F.lit("edges:related").alias("measure"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _first(top: int):
    """id, place, other, weight: of each book the `top` others of most weight, equal ones by their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, at, other, weight in _weighed(batches):
            there = other != own[at]
            at, other, weight = at[there], other[there], weight[there]
            begins = lambda: np.searchsorted(at, np.arange(len(own)))  # noqa: B023, E731
            # others come in their order: of those with a weight of one, a book's first `top` are enough
            ones = np.append(0, np.cumsum(weight == 1))
            some = (weight > 1) | (ones[1:] - ones[begins()][at] <= top)
            at, other, weight = at[some], other[some], weight[some]
            order = np.lexsort((other, -weight, at))
            at, other, weight = at[order], other[order], weight[order]
            place = np.arange(len(at)) - begins()[at] + 1
            some = place <= top
            yield pa.record_batch([pa.array(x[some]) for x in (own[at], place, other, weight)], names=["id", "place", "other", "weight"])

    return run


def _rows_of_books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """book, relations: a book's name stands at place 0, those of its relations follow. Rows come by id."""
    for t, starts in _runs(batches, "id", ("id", "place")):
        ends = np.append(starts, t.num_rows)
        order = np.lexsort((t["place"].to_numpy(), np.repeat(np.arange(len(starts)), np.diff(ends))))
        rest = np.ones(t.num_rows, bool)
        rest[starts] = False
        names, weights = t["name"].chunk(0), t["weight"].chunk(0)
        relations = pa.StructArray.from_arrays([x.take(pa.array(order[rest])) for x in (names, weights)], names=["other", "weight"])
        found = pa.record_batch([names.take(pa.array(order[starts])), pa.ListArray.from_arrays(pa.array((ends - np.arange(len(ends))).astype(np.int32)), relations)], names=["book", "relations"])
        yield found.filter(pa.array(np.diff(ends) > 1))


def related_first(signals: DataFrame, top: int = 8, block: int = BLOCK, entries: int = ROUND) -> DataFrame:
    """book, relations: what `compact` gives of all edges between books, made in rounds."""
    ids = numbered(signals)
    # numbers are in the order of names; names meet the first few alone, of all rounds at once
    first = reduce(DataFrame.unionByName, [kept(lists.mapInArrow(_first(top), "id long, place long, other long, weight long"), "graph-first") for lists in related(signals, ids, block, entries)])
    names = kept(ids.select("id", F.col("book").alias("name")).distinct(), "graph-names")
    named = first.join(names.withColumnRenamed("id", "other"), "other").select("id", "place", "name", "weight")
    rows = named.unionByName(names.select("id", F.lit(0).cast("long").alias("place"), "name", F.lit(0).cast("long").alias("weight")))
    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(_rows_of_books, "book string, relations array<struct<other: string, weight: long>>")


def counted(signals: DataFrame, books: DataFrame, derived: DataFrame, block: int = BLOCK, entries: int = ROUND) -> DataFrame:
    """measure, n: what `summary` says of the full graph, edges between books included, of `numbered_signals`, without making its vertices and edges.

    Chunks, their books and shared signals are vertices because signals name them, so that of their edges none dangles; derived
    edges (book, origin) have ends of their own, which are looked for among the books.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    told = lambda df, **counts: kept(df.agg(*[zero(c).alias(k) for k, c in counts.items()]), "graph-counts").select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in counts])))
    lists = _listed(numbered(signals), block)
    shared = lists.filter("blocks = 1").select("chunks").unionByName(lists.filter("blocks > 1").groupBy("signal").agg(F.sum("chunks").alias("chunks")).filter("chunks > 1").select("chunks"))
    chunks = signals.groupBy("chunk").agg(F.count_distinct("id").alias("n"))
    edges = derived.filter("book <> '' AND origin <> '' AND book <> origin").select("book", "origin").distinct()
    named = signals.select("book").unionByName(books.filter("book <> ''").select("book")).select("book", F.lit(1).alias("there"), F.lit(0).alias("ends"))
    ends = named.unionByName(edges.select(F.explode(F.array("book", "origin")).alias("book"), F.lit(0).alias("there"), F.lit(1).alias("ends"))).groupBy("book").agg(F.max("there").alias("there"), F.sum("ends").alias("ends"))
    return (
        told(ends, **{"vertices:book": F.sum("there"), "edges:derived": F.sum("ends") / 2, "dangling": F.sum(F.when(F.col("there") == 0, F.col("ends")))})
        .unionByName(told(chunks, **{"vertices:chunk": F.count("*"), "edges:in": F.sum("n")}))
        .unionByName(told(shared, **{"vertices:signal": F.count("*"), "edges:has": F.sum("chunks")}))
        .unionByName(_pair_count(lists, entries))
    )


def vertices(books: DataFrame, signals: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, title of all that the graph has: books (book, title; also those that only chunks name), their chunks, and hyperedges."""
    known = books.filter("book <> ''").groupBy("book").agg(F.min("title").alias("title"))
    named = signals.select("book").distinct().join(known, "book", "full").select(F.concat(F.lit("book:"), "book").alias("id"), F.lit("book").alias("type"), F.coalesce("title", "book").alias("title"))
    chunks = signals.select(F.concat(F.lit("chunk:"), F.col("chunk").cast("string")).alias("id"), F.lit("chunk").alias("type"), F.col("chunk").cast("string").alias("title")).distinct()
    return named.unionByName(chunks).unionByName(edges.select(_signal_id().alias("id"), F.lit("signal").alias("type"), F.col("shown").alias("title")))


def _signal_id() -> Column:
    return F.concat(F.lit("signal:"), "kind", F.lit(":"), "value")


def edges_of(signals: DataFrame, edges: DataFrame, pairs: DataFrame | None, derived: DataFrame | None = None) -> DataFrame:
    """source, target, type, weight: chunks in books, chunks with shared signals, books with books (given pairs), and derived books (book, origin)."""
    inside = signals.select("book", "chunk").distinct().select(F.concat(F.lit("chunk:"), F.col("chunk").cast("string")).alias("source"), F.concat(F.lit("book:"), "book").alias("target"), F.lit("in").alias("type"), F.lit(1).cast("long").alias("weight"))
    shared = signals.join(edges.select("kind", "value"), ["kind", "value"]).select(F.concat(F.lit("chunk:"), F.col("chunk").cast("string")).alias("source"), _signal_id().alias("target"), F.lit("has").alias("type"), F.lit(1).cast("long").alias("weight"))
    out = inside.unionByName(shared)
    if pairs is not None:
        out = out.unionByName(pairs.groupBy("a", "b").agg(F.sum("shared").alias("weight")).select(F.concat(F.lit("book:"), "a").alias("source"), F.concat(F.lit("book:"), "b").alias("target"), F.lit("related").alias("type"), "weight"))
    if derived is not None:
        origin = derived.filter("book <> '' AND origin <> '' AND book <> origin").distinct()
        out = out.unionByName(origin.select(F.concat(F.lit("book:"), "book").alias("source"), F.concat(F.lit("book:"), "origin").alias("target"), F.lit("derived").alias("type"), F.lit(1).cast("long").alias("weight")))
    return out


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no vertex, with that end."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("missing"))
    # ends meet vertices without their edges, once each
    lost = bounded(kept(ends.distinct().join(nodes.select(F.col("id").alias("missing")), "missing", "left_anti"), "graph-lost"))
    at = lambda end: edges.select("source", "target", "type", F.col(end).alias("missing")).join(lost, "missing").select("source", "target", "type", "missing")
    return at("source").unionByName(at("target")).distinct()


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """measure, n: vertices and edges by type, and edges that dangle."""
    counted = lambda df, name: df.groupBy(F.concat(F.lit(name + ":"), "type").alias("measure")).agg(F.count("*").alias("n"))
    lost = dangling(edges, nodes).agg(F.count("*").alias("n")).select(F.lit("dangling").alias("measure"), "n")
    return counted(nodes, "vertices").unionByName(counted(edges, "edges")).unionByName(lost)


def compact(pairs: DataFrame, edges: DataFrame, top: int = 8) -> DataFrame:
    """book, relations: of each book its `top` related books (other, weight) by weight, then name: what a search reads. edges: dangling ends are left out before."""
    total = pairs.groupBy("a", "b").agg(F.sum("shared").alias("weight"))
    both = total.select(F.col("a").alias("book"), F.col("b").alias("other"), "weight").unionByName(total.select(F.col("b").alias("book"), F.col("a").alias("other"), "weight"))
    there = edges.filter("type = 'related'").select(F.explode(F.array("source", "target")).alias("end")).distinct()
    both = both.join(there, F.concat(F.lit("book:"), F.col("other")) == F.col("end"), "left_semi")
    first = both.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("weight"), "other"))).filter(F.col("place") <= top)
    return first.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other", "weight"))), lambda x: F.struct(x["other"].alias("other"), x["weight"].alias("weight"))).alias("relations"))
