"""Benchmark decontamination: find benchmark passages in documents and remove spans or documents.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.  A window is ``window`` consecutive
words of a benchmark item; an item with fewer words, but not none, is one window.  A document word inside any occurrence
of a window is hit.

How: every window of m words holds a whole aligned chunk of c = (m + 1) / 2 words wherever it lies in a document.  So a
document is cut once into chunks of c words, each chunk is looked up in a broadcast hash set of all c-grams of the
benchmark, and only around chunks that are found the exact windows are built and compared as text.  One scan, no Python,
one exchange of a row per document and found window.

Defined cases: NULL text or no words: zero words, nothing hit.  NULL or word-less items never match.  Every row is a
document: rows that repeat are reported each, as are different texts of one doc_id.  Items with equal windows are all
reported.  Other columns are ignored by ``hits`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, small_enough

#: Word separators, before A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WINDOW = 10
#: Above this measured size the benchmark's tables are joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 64 << 20


def spaced(text: Column) -> Column:
    """The words, case kept, each followed by one space."""
    return F.ltrim(F.regexp_replace(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), SEPARATOR + "+", " "))


def chunk_key(chunk: Column) -> Column:
    # lower() folds more than A-Z: equal chunks stay equal, and what it finds too much fails the exact comparison
    return F.xxhash64(F.lower(chunk))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(m, window_text, items): the distinct windows, their length in words and the ids of their items as strings."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"),
                             F.split(F.rtrim(lower_ascii(spaced(F.col("text")))), " ").alias("w")) \
        .filter("w[0] != ''").withColumn("m", F.least(F.lit(window), F.size("w")))
    return words.select("item", "m", F.explode(F.expr("transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))"))
                        .alias("window_text")) \
        .groupBy("m", "window_text").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document and partition that it repeats in: doc_id, text_key, copies (rows of it there), n_words,
    positions (sorted word positions that are hit), items."""
    windows = benchmark_windows(benchmark, window)
    lengths = sorted(r[0] for r in windows.select("m").distinct().collect())  # at most `window` numbers
    fits = small_enough(windows, BROADCAST_BYTES, "window_text", "items")
    hint = F.broadcast if fits else (lambda df: df)
    grams = windows.withColumn("c", F.expr("(m + 1) div 2")).withColumn("w", F.split("window_text", " ")) \
        .select("m", F.explode(F.expr("transform(sequence(1, m - c + 1), i -> concat(array_join(slice(w, i, c), ' '), ' '))")).alias("g")) \
        .select("m", chunk_key(F.col("g")).alias("k")).distinct()

    # the partition keeps rows that repeat apart, so that no task has to give back more copies than one partition holds
    own_key = ["doc_id", "text_key", "part_key"]
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.spark_partition_id().alias("part_key"), spaced(F.col("text")).alias("norm"))
    own = "array(named_struct('m', 0, 'c', 0, 'q', -1, 'before', '', 'chunk', '', 'after', ''))"
    # neighbours by position in the same array; the array is bound once by the inner projection
    cut = [f"transform(a{m}, (x, i) -> named_struct('m', {m}, 'c', {(m + 1) // 2}, 'q', i, 'before', coalesce(get(a{m}, i - 1), ''), "
           f"'chunk', x, 'after', coalesce(get(a{m}, i + 1), '')))" for m in lengths]
    base = base.withColumn("n_words", (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit("")))).cast("long"))
    arrays = base.select(*own_key, "n_words", *(
        F.expr(f"regexp_extract_all(norm, '(?:[^ ]+ ){{1,{(m + 1) // 2}}}', 0)").alias(f"a{m}") for m in lengths))
    rows = arrays.select(*own_key, "n_words", F.explode(F.expr(f"concat({', '.join([own, *cut])})")).alias("x")) \
        .select(*own_key, "n_words", "x.*").withColumn("k", chunk_key(F.col("chunk")))
    found = rows.join(hint(grams.withColumn("found", F.lit(True))), ["m", "k"], "left").filter("found or q < 0")

    around = found.withColumn("w", F.expr("split(rtrim(concat(before, chunk, after)), ' ')")) \
        .withColumn("first", F.expr("greatest(0, c * (q - 1))")) \
        .withColumn("starts", F.expr("filter(sequence(greatest(c * q + c - m, 0), c * q), s -> q >= 0 and s - first + m <= size(w))"))
    tried = around.select(*own_key, "n_words", "m", "q", F.explode_outer(F.expr(
        "transform(starts, s -> named_struct('s', s, 't', array_join(slice(w, s - first + 1, m), ' ')))")).alias("y")) \
        .select(*own_key, "n_words", "m", "q", "y.s", lower_ascii(F.col("y.t")).alias("window_text"))
    met = tried.join(hint(windows), ["m", "window_text"], "left")
    return met.groupBy(*own_key).agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("q") < 0).alias("copies"),
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct("s", "m"))).alias("at"),
        F.collect_set("items").alias("sets")) \
        .select("doc_id", "text_key", "copies", "n_words",
                F.expr("array_sort(array_distinct(flatten(transform(at, x -> sequence(x.s, x.s + x.m - 1)))))").alias("positions"),
                F.expr("array_sort(array_distinct(flatten(sets)))").alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of ``hits``: counts, and the items as a hash."""
    h = hits(docs, benchmark, window).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return h.select("doc_id", "n_words", F.size("positions").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("positions") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """The documents, all columns kept, without contaminated documents or, with remove="spans", without the hit words.

    A removed word goes with the separators that follow it.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    bad = hits(docs, benchmark, window).filter("size(positions) > 0").dropDuplicates(["doc_id", "text_key"]) \
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("positions").alias("__at"))
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    if remove == "documents":
        return keyed.join(bad, same, "left_anti").drop("__text_key")
    lead = F.regexp_extract("text", f"^{SEPARATOR}*", 0)
    units = F.regexp_extract_all("text", F.lit(f"({WORD}+{SEPARATOR}*)"), F.lit(1))
    left = F.concat(lead, F.array_join(F.filter(units, lambda u, i: ~F.array_contains(F.col("__at"), i)), ""))
    return keyed.join(bad, same, "left").withColumn("text", F.when(F.col("__at").isNull(), F.col("text")).otherwise(left)) \
        .select(*docs.columns)


#: The same digest in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
                  lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS t FROM b WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT rid, m, unnest(range(1, len(w) - m + 2)) AS s,
              unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS t FROM d, ms WHERE len(w) >= m),
h AS (SELECT rid, s, m, item_id FROM dw JOIN bw USING (m, t)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""
