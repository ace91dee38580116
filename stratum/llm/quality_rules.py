"""Quality rules in DataFrame functions only: length and repetition rules, then divergence from language references.

Each document gets a histogram of character classes and one of common words. Over all documents that pass the length and
repetition rules, these add up to a reference for each language and one for all. A document is kept if the square root
of the Jensen-Shannon divergence (base 2, so from 0 to 1) to the nearest reference is within a bound, for each of the two
histograms; a histogram of too few characters or words isn't judged.

Nothing is exploded: a document's words stay one array, its repeated 3-word windows are found by sorting them with
their positions, and only rows of a few numbers are shuffled, once, into one row for each language.

Defined results: a null text is empty and fails the base rules; a null or unknown language adds to the common reference
only, and any document is compared with all of them; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, staged

#: Classes of characters beside white space and, all the rest, letters.
CLASSES = {"upper": r"\p{Lu}", "digit": "[0-9]", "punctuation": r"[-.,;:'\"!?()]", "symbol": "[#*$%&|<>]"}
#: Frequent words of each language that has a reference.
COMMON = {
    "en": "the of and to in a is that for it with as was on be by are this".split(),
    "de": "der die und in den von zu das mit sich des dem ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans".split(),
    "es": "de la que el en y a los del se las por un para con".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
MIN_WORDS, MAX_REPEAT = 50, 50
#: Bounds of the distance for histograms of characters and of words, and the least characters and words for each.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.20, 0.30
LEAST_CHARS, LEAST_WORDS = 200, 100
DIGITS = 9


#: Bits that hold a window's place in the text; the rest of a long holds a part of the window's hash.
PLACE_BITS = 24
PLACE, HASH = (1 << PLACE_BITS) - 1, ~((1 << PLACE_BITS) - 1)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, chars, ""))


def _windows(f) -> Column:
    return F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), f)


def _with_repeats(rows: DataFrame) -> DataFrame:
    """rows (an array words) with at: the places of 3-word windows that the array holds twice or more, in order.

    Longs of hash and place are sorted; neighbours with the same hash are repeats. If any such neighbours turn out to be
    different windows, or if places don't fit, the windows of that text are sorted themselves.
    """
    word = lambda i: F.get("words", i)
    rows = rows.withColumn("keys", F.sort_array(_windows(lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)).bitwiseAND(F.lit(HASH)).bitwiseOR(i.cast("long")))))
    near = lambda x, j: x.bitwiseXOR(F.get("keys", j)).bitwiseAND(F.lit(HASH)) == 0
    rows = rows.withColumn("likely", F.filter("keys", lambda x, j: near(x, j + 1) | near(x, j - 1)))
    rows = rows.withColumn("places", F.transform("likely", lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int")))
    unlike = lambda i, k: ~((word(i) == word(k)) & (word(i + 1) == word(k + 1)) & (word(i + 2) == word(k + 2)))
    clash = F.exists(F.transform("places", lambda i, j: (F.get("likely", j - 1).bitwiseXOR(F.get("likely", j)).bitwiseAND(F.lit(HASH)) == 0) & unlike(i, F.get("places", j - 1))), lambda x: F.coalesce(x, F.lit(False)))
    rows = rows.withColumn("clash", clash | (F.size("words") > PLACE))
    spelled = F.sort_array(_windows(lambda w, i: F.struct(F.concat_ws(" ", w, word(i + 1), word(i + 2)).alias("g"), i.alias("i"))))
    rows = rows.withColumn("spelled", F.when(F.col("clash"), spelled))
    same = lambda x, j: F.coalesce(F.get("spelled", j)["g"] == x["g"], F.lit(False))
    exact = F.transform(F.filter("spelled", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])
    return rows.withColumn("at", F.sort_array(F.when(F.col("clash"), exact).otherwise(F.col("places")))).drop("keys", "likely", "places", "clash", "spelled")


def base_features(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, others, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the arrays chars and common."""
    text = F.col("t")
    out = docs.select("doc_id", *others, F.coalesce("text", F.lit("")).alias("t"))
    out = out.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    known = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(WORDS))
    counts = {k: F.length(text) - _without(text, c) for k, c in CLASSES.items()}
    out = _with_repeats(out).select("doc_id", *others, F.size("words").cast("long").alias("n_words"), F.length(text).alias("total"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        *[c.cast("long").alias(k) for k, c in counts.items()], lines.alias("lines"), "at", F.concat(F.lit(" "), F.array_join(known, "  "), F.lit(" ")).alias("joined"))
    covered = F.aggregate(F.transform("at", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    found = F.array(*[((F.octet_length("joined") - F.octet_length(F.replace(F.col("joined"), F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2)).cast("long") for w in WORDS])
    repeated = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")
    out = out.select("doc_id", *others, "n_words", "word_chars", (F.col("total") - F.col("word_chars")).alias("space"), *CLASSES, repeated, covered.cast("long").alias("n_repeat_words"), found.alias("found"))
    letters = F.col("word_chars") - sum((F.col(k) for k in CLASSES), F.lit(0))
    all_found = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", *others, "n_words", "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.array(*CLASSES, "space", letters).alias("chars"), F.concat("found", F.array(F.col("n_words") - all_found)).alias("common"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def references(features: DataFrame, lang: str = "lang") -> DataFrame:
    """One row: for each language with a reference, and for all documents, shares of characters and of words; null where there are none."""
    sums = lambda name, size: F.array(*[F.sum(F.col(name)[i]) for i in range(size)])
    known = F.when(F.col(lang).isin(*COMMON), F.col(lang)).otherwise("")
    by = features.filter(~base_failed()).groupBy(known.alias("of")).agg(sums("chars", len(CLASSES) + 2).alias("chars"), sums("common", len(WORDS) + 1).alias("common"))
    pick = lambda name, lang: F.max(F.when(F.col("of") == lang, F.col(name)))
    return by.agg(*[shares(pick(name, lang)).alias(f"{name}_{lang}") for lang in COMMON for name in ("chars", "common")], *[shares(F.array(*[F.sum(F.col(name)[i]) for i in range(size)])).alias(f"{name}_all") for name, size in (("chars", len(CLASSES) + 2), ("common", len(WORDS) + 1))])


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """Of two arrays of shares; null if one is null."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def distances(features: DataFrame, lang: str = "lang") -> DataFrame:
    """features with char_distance and word_distance to the nearest reference."""
    features = staged(features, "rules-features")
    # one row of fixed width, joined to each document
    with_reference = features.join(F.broadcast(references(features, lang)), F.lit(True), "left")
    own = with_reference.withColumn("char_share", shares(F.col("chars"))).withColumn("word_share", shares(F.col("common")))
    nearest = lambda share, name: F.round(F.least(*[js_distance(F.col(share), F.col(f"{name}_{lang}")) for lang in [*COMMON, "all"]]), DIGITS)
    return own.withColumn("char_distance", nearest("char_share", "chars")).withColumn("word_distance", nearest("word_share", "common"))


def apply_rules(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = distances(base_features(docs, lang), lang)
    far_chars = (F.col("word_chars") >= LEAST_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    far_words = (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    kept = ~base_failed() & ~F.coalesce(far_chars, F.lit(False)) & ~F.coalesce(far_words, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))


def _listed(items: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN ({_listed(list(COMMON))}) THEN lang ELSE '' END AS lang, coalesce(text, '') AS t FROM documents
), w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
), repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), lines AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), classes AS (
  SELECT r, length(t) AS total, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit,
    length(t) - length(regexp_replace(t, '[-.,;:''"!?()]', '', 'g')) AS punctuation, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbol,
    length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS space FROM d
), base AS (
  SELECT d.r, d.doc_id, d.lang, len(ws)::BIGINT AS n_words, (total - space)::BIGINT AS word_chars, symbol::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) JOIN classes USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), named AS (SELECT unnest([{_listed(WORDS)}]) AS bin
), said AS (SELECT r, lower(x) AS bin, count(*) AS n FROM (SELECT r, unnest(ws) AS x FROM w) WHERE lower(x) IN (SELECT bin FROM named) GROUP BY ALL
), counts AS (
  SELECT r, 'word' AS kind, bin, coalesce(n, 0) AS n FROM (SELECT r, bin FROM d, named) LEFT JOIN said USING (r, bin)
  UNION ALL SELECT r, 'word', '', n_words - coalesce(s, 0) FROM base LEFT JOIN (SELECT r, sum(n) AS s FROM said GROUP BY r) USING (r)
  UNION ALL SELECT r, 'char', bin, n FROM (UNPIVOT (SELECT r, upper, digit, punctuation, symbol, space, total - upper - digit - punctuation - symbol - space AS letter FROM classes) ON upper, digit, punctuation, symbol, space, letter INTO NAME bin VALUE n)
), own AS (SELECT r, kind, bin, n / nullif(sum(n) OVER (PARTITION BY r, kind), 0) AS p FROM counts
), sums AS (SELECT lang AS of, kind, bin, sum(n) AS n FROM counts JOIN judged USING (r) WHERE NOT base_failed GROUP BY ALL
), refs AS (
  SELECT of, kind, bin, n / nullif(sum(n) OVER (PARTITION BY of, kind), 0) AS q FROM (SELECT * FROM sums WHERE of <> '' UNION ALL SELECT 'all', kind, bin, sum(n) FROM sums GROUP BY ALL)
), far AS (
  SELECT r, kind, of, sqrt(abs(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js
  FROM own JOIN refs USING (kind, bin) WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ALL
), near AS (SELECT r, round(min(js) FILTER (kind = 'char'), {DIGITS}) AS char_js, round(min(js) FILTER (kind = 'word'), {DIGITS}) AS word_js FROM far GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(word_chars >= {LEAST_CHARS} AND char_js > {MAX_CHAR_DISTANCE}, false) AND NOT coalesce(n_words >= {LEAST_WORDS} AND word_js > {MAX_WORD_DISTANCE}, false) AS kept
FROM judged LEFT JOIN near USING (r)
"""
