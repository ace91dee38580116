"""Drawing documents that resemble a target: importance resampling by hashed word n-grams.

1. A position table: each text's words by position (posexplode), and for each order the words that follow (window lead()
   within the text), joined to a feature, hashed to a bucket. Texts are dealt once, by a number of their own, before they
   are cut: the window and all that follows stay where a text is. Buckets alone are staged.
2. Counts of buckets over all documents and all target texts give each bucket's gain, a table of BUCKETS rows.
3. Gains join the position table by bucket and are summed by text: its weight is their floored mean.
4. A Gumbel number from the doc_id's hash makes the draw: of the texts with LEAST_WORDS words, the highest scores. The draw
   ends at a score that a histogram of scores gives; ranks are counted inside one score, and what stands above is added.

Defined results: a null or empty text, or one without words, has no feature and weight 0, and takes part with its score
only; a null doc_id hashes as empty and comes last among ties; rows of one doc_id are rows of their own, ranked in any order
among themselves; with no target text all t are 0; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, small_side, staged

#: A word is a run of ASCII digits and letters and of anything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, ORDERS = 10_000, 2
SEED, SHARE, LEAST_WORDS = 7, 25, 20
#: Scores are counted in spans of so many, so that a prefix sum sees few rows at once.
SPAN = 128


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORDS), F.lit(0))


def positions(rows: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """key, id, b1 to b<orders>: at each word of a text, the buckets of the features that begin there (null: too few words follow). rows: key (one for each row), id, text.

    A text without words has one row of nulls.
    """
    # texts move once; sorted, the words of a task come to the window nearly in order
    dealt = rows.repartition("key").sortWithinPartitions("key")
    table = dealt.select("key", "id", F.posexplode_outer(words_of(F.col("text"))).alias("pos", "word"))
    here = Window.partitionBy("key").orderBy("pos")
    following = [F.col("word"), *[F.lead("word", k).over(here) for k in range(1, orders)]]
    table = table.select("key", "id", *[w.alias(f"w{k + 1}") for k, w in enumerate(following)])
    bucket = lambda n: F.when(F.col(f"w{n}").isNotNull(), F.crc32(F.concat_ws(" ", *[f"w{k + 1}" for k in range(n)]).cast("binary")) % buckets)
    return table.select("key", "id", *[bucket(n).cast("int").alias(f"b{n}") for n in range(1, orders + 1)])


def _features(table: DataFrame, *columns: str) -> DataFrame:
    return table.select(*columns, F.explode(F.array(*[c for c in table.columns if c[0] == "b"])).alias("bucket")).filter("bucket IS NOT NULL")


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln) of how much likelier the bucket is in the target than in the corpus, one added to each count."""
    counts = lambda table, name: _features(table).groupBy(F.col("bucket").alias(f"of_{name}")).agg(F.count("*").alias(name))
    ids = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = ids.join(counts(corpus, "s"), F.col("bucket") == F.col("of_s"), "left").join(counts(target, "t"), F.col("bucket") == F.col("of_t"), "left").na.fill(0, ["s", "t"])
    everything = Window.partitionBy()  # of `buckets` rows
    d = lambda c: c.cast("double")
    ratio = d(F.col("t") + 1) * d(F.sum("s").over(everything) + buckets) / (d(F.col("s") + 1) * d(F.sum("t").over(everything) + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _floored_mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of docs (doc_id, text); target: text. Staged."""
    keyed = lambda df, id: df.select(F.monotonically_increasing_id().alias("key"), id.alias("id"), quoted("text").cast("string").alias("text"))
    corpus = staged(positions(keyed(docs, quoted("doc_id").cast("long")), orders, buckets), "importance-positions")
    wanted = staged(positions(keyed(target, F.lit(0).cast("long")), orders, buckets), "importance-target")
    gain = F.broadcast(staged(gains(corpus, wanted, buckets), "importance-gains"))  # a row for each bucket
    sums = _features(corpus, "key").join(gain, "bucket").groupBy("key").agg(F.sum("gain").alias("total"), F.count("*").alias("n_features"))
    texts = corpus.groupBy("key", "id").agg(F.count("b1").alias("n_words"))
    sums = sums.withColumnRenamed("key", "of")
    rows = texts.join(sums, F.col("key") == F.col("of"), "left").na.fill(0, ["total", "n_features"])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weight = _floored_mean(F.col("total"), F.col("n_features"))
    return staged(rows.select(F.col("id").alias("doc_id"), "n_words", "n_features", weight.alias("weight"), (weight + gumbel).alias("score")), "importance-scores")


def drawn(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (staged: doc_id, n_words, score and others) with rank: 1, 2, ... of the share (in hundredths) with the highest scores; null beyond."""
    apt = F.col("n_words") >= least_words
    levels = rows.filter(apt).groupBy(F.col("score").alias("level")).agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("level") / SPAN))
    levels = staged(levels, "importance-levels")  # as many rows as there are scores: their span is bounded by the logarithms in it
    up = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    spans = levels.groupBy(F.col("span").alias("in_span")).agg(F.sum("n").alias("in_all"))
    spans = spans.withColumn("above", F.coalesce(F.sum("in_all").over(up(Window.orderBy(F.col("in_span").desc()))), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(up(Window.partitionBy("span").orderBy(F.col("level").desc()))), F.lit(0))
    before = levels.join(spans, F.col("span") == F.col("in_span")).select("level", (F.col("above") + inside).alias("before"))
    most = (levels.agg(F.sum("n")).first()[0] or 0) * share // 100
    reached = small_side(staged(before.filter(F.col("before") < most), "importance-reached"), 16)
    marked = rows.join(reached, (F.col("score") == F.col("level")) & apt, "left").drop("level")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    some = marked.filter("before IS NOT NULL").withColumn("place", place).withColumn("rank", F.when(F.col("place") <= most, F.col("place"))).drop("place", "before")
    rest = marked.filter("before IS NULL").drop("before").withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of each row of docs."""
    return drawn(scored(docs, target, seed), share, least_words).select("doc_id", "n_features", "weight", "score", "rank")


SQL = rf"""
WITH byte_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), words AS (
  SELECT d.rowid_ AS key, d.doc_id, d.kind, list_filter(regexp_extract_all(translate(coalesce(d.text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: true) AS w
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text, 's' AS kind FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, 't' FROM benchmark) d
), features AS (
  SELECT key, kind, unnest(w) AS f FROM words
  UNION ALL SELECT key, kind, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1
), hashed AS (
  SELECT f, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM features), byte_table
), counts AS (
  SELECT r.bucket, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t
  FROM (SELECT range AS bucket FROM range({BUCKETS})) r LEFT JOIN (hashed JOIN features USING (f)) x ON x.bucket = r.bucket GROUP BY r.bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counts
), sums AS (
  SELECT key, count(*) AS n, sum(gain)::BIGINT AS total FROM features JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY key
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM words LEFT JOIN sums USING (key) WHERE kind = 's'
), drawn AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS eligible FROM drawn
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= eligible * {SHARE} // 100 THEN place END::BIGINT AS rank FROM ranked
"""
