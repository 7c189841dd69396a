"""Benchmark decontamination with a distributed positional inverted index (native: DataFrame functions only).

1. The index: one posting (document, term, position) for every training token whose word occurs in the
   benchmark, written once as integers; a closing posting of each document carries its word count.
2. Each benchmark window is looked up from its rarest terms by corpus frequency: the lists of the rarest
   `probes` places, each shifted by its offset in the window, are intersected on (document, start).
3. The starts left are intersected with the lists of all other places of the window: exact phrase matches.
   With slack > 0, rare-term matches whose other terms lie within slack words are proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, named, stored, table

#: Words: ASCII digits and letters after lower-casing A-Z, and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a side counts as small enough to broadcast (a few integers a row: at most some 50 MB).
BROADCAST_ROWS = 1_000_000
END = "\x00"  # never a word


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if its counted rows are within the bound; beyond it, Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", length: int = 10) -> DataFrame:
    """(item_id, gram): every window of `length` consecutive words; a shorter item, not empty, is one window."""
    w = items.select(named(items, id_col).alias("item_id"), words(named(items, text_col)).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - length + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_w", i, length))).alias("gram")).distinct()


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings (rid, doc_id, term, pos) of the terms (word, term); term 0 closes a document at its word count."""
    w = docs.select(F.monotonically_increasing_id().alias("rid"), named(docs, id_col).alias("doc_id"), words(named(docs, text_col)).alias("_w"))
    tokens = w.select("rid", "doc_id", F.posexplode(F.concat("_w", F.array(F.lit(END)))).alias("pos", "word"))
    return stored(tokens.join(small(terms, n_terms), "word").select("rid", "doc_id", "term", "pos"), "postings")


def find_phrases(docs: DataFrame, items: DataFrame, *, length: int = 10, probes: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slack: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, matches, grams) of the windows of items in docs.

    documents: rid, doc_id, n_words, one row for each input row. matches: rid, gram_id, start (0-based word),
    len, exact. grams: gram_id, item_id. Null or wordless texts have no words and no matches; repeated rows are
    matched each; empty tables give empty results; other columns are ignored. slack = 0 gives exact
    phrases; slack = k also gives windows whose terms are all found within k words of their places (exact
    false unless all are in place).
    """
    spark = docs.sparkSession
    pairs = stored(benchmark_windows(items, id_col=item_col, text_col=item_text_col, length=length).withColumn("gram_id", F.xxhash64(F.array_join("gram", " "))), "windows")
    grams = pairs.select("gram_id", "gram").distinct()
    places = grams.select("gram_id", F.size("gram").alias("len"), F.posexplode("gram").alias("off", "word"))
    vocabulary = places.select("word").distinct()
    terms = stored(vocabulary.select("word", F.xxhash64("word").alias("term")).unionByName(spark.range(1).select(F.lit(END).alias("word"), F.lit(0).cast("long").alias("term"))), "terms")
    n_terms = terms.count()
    index = build_index(docs, terms, n_terms, id_col=id_col, text_col=text_col)
    documents = index.filter("term = 0").select("rid", "doc_id", F.col("pos").cast("long").alias("n_words"))

    # rarest places of each window, by the counts of the index
    lists = index.groupBy("term").agg(F.count("*").alias("df"))
    places = places.withColumn("term", F.xxhash64("word")).join(lists, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = Window.partitionBy("gram_id").orderBy("df", "off")
    places = stored(places.withColumn("_r", F.row_number().over(rare)).withColumn("_least", F.min("df").over(Window.partitionBy("gram_id"))).filter("_least > 0").select("gram_id", "len", "off", "term", "_r"), "places")
    n_places = places.count()  # of the benchmark's windows
    probe = places.filter(F.col("_r") <= probes)
    shifts = F.explode(F.sequence(F.lit(-slack), F.lit(slack))) if slack else F.lit(0)
    starts = index.join(small(probe, n_places), "term").withColumn("_shift", shifts)
    starts = starts.select("rid", "gram_id", "len", (F.col("pos") - F.col("off") + F.col("_shift")).alias("start"), "off").filter("start >= 0")
    starts = starts.groupBy("rid", "gram_id", "len", "start").agg((F.count("*") if not slack else F.count_distinct("off")).alias("_n")).filter(F.col("_n") == F.least(F.col("len"), F.lit(probes))).drop("_n")
    starts = stored(starts, "starts")

    # the other places: their postings in the documents that are left
    n_starts = starts.count()
    left = starts.select("rid").distinct()
    rest = starts.join(small(places.filter(F.col("_r") > probes).select("gram_id", "off", "term"), n_places), "gram_id").withColumn("_shift", shifts)
    rest = rest.select("rid", "gram_id", "start", "len", "off", "_shift", "term", (F.col("start") + F.col("off") + F.col("_shift")).cast("int").alias("pos"))
    found = rest.join(index.join(small(left, n_starts), "rid", "left_semi").filter("term <> 0").select("rid", "term", "pos"), ["rid", "term", "pos"])
    found = found.groupBy("rid", "gram_id", "start", "len").agg(F.count_distinct("off").alias("_n"), F.count_if(F.col("_shift") == 0).alias("_in_place"))
    whole = found.filter(F.col("_n") == F.col("len") - probes).withColumn("exact", F.col("_in_place") == F.col("_n")).select("rid", "gram_id", "start", "len", "exact")
    short = starts.filter(F.col("len") <= probes).select("rid", "gram_id", "start", "len", F.lit(True).alias("exact"))
    return documents, whole.unionByName(short), pairs.select("gram_id", "item_id")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated (see find_phrases).

    A word inside any occurrence of a window is hit. items_sha256: hex SHA-256 of the found item_ids, sorted as
    strings and comma-joined (of the empty string if none).
    """
    documents, matches, grams = find_phrases(docs, items, **options)
    matches = stored(matches.filter("exact"), "matches")
    hit = matches.select("rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("_p")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    named_items = matches.select("rid", "gram_id").distinct().join(grams, "gram_id").select("rid", "item_id").distinct()
    per_doc = named_items.groupBy("rid").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"))
    out = documents.join(hit.join(per_doc, "rid"), "rid", "left")
    return out.select("rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of every benchmark item in every whole document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10).drop("rid")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
  SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT DISTINCT rid, i, p.n, item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS q FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
