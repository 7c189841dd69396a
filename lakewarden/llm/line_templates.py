"""Line dedup with a log-template tree of fixed depth (native: DataFrame functions only).

A line goes down the tree by its number of tokens and its first `depth` tokens; tokens with a digit are variable
fields and count as <*>. A leaf has as many templates as it needs: its line of the most documents is the first and takes
in the lines whose share of equal tokens is `similarity` at least; of those left the line of the most documents is the
next, until none joins another. A line of variable fields for more than half is its own template as it
stands, fields and all. Templates that recur across documents are dropped from all of them. Documents with one and the same text count once, so copies
of a whole document (which are the near-duplicate operator's) do not turn its lines into boilerplate.

The texts are written once with a hash of template and leaf for each line; statistics run on the hashes, and only lines of
leaves with several forms are compared as strings, after the first template only those that share a slot of tokens. All grouping is by partial aggregation, so a line that a third of all
documents share costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named, stored, table
from .decontamination import small

BLANK = r"[\x09-\x0D\x20]+"
FIELD = r"(?<![^ ])[^ ]*?[0-9][^ ]*"  # a token with a digit; tried at starts of tokens only
FIRST = 32  # forms of a slot that the others are compared with at once


def spaced(line: Column) -> Column:
    """White space made one blank."""
    return F.trim(F.regexp_replace(line, BLANK, " "))


def masked(line: Column) -> Column:
    """White space made one blank, tokens with a digit made <*>."""
    plain = spaced(line)
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, FIELD, "<*>")).otherwise(plain)


def forms_of(lines: Column, depth: int) -> Column:
    """(key, leaf, n) of each line: hashes of its form and leaf, and its tokens, 0 if blank."""
    sized = F.transform(F.transform(lines, masked), lambda m: F.struct(m.alias("m"), F.size(F.split(m, " ")).alias("n")))
    told = F.transform(sized, lambda x: F.struct(x.m.alias("m"), x.n.alias("n"), (x.m.contains("<*>") & (2 * F.regexp_count(x.m, F.lit(r"<\*>")) > x.n)).alias("own")))

    def form(line: Column, x: Column) -> Column:
        key = F.xxhash64(F.when(x.own, spaced(line)).otherwise(x.m))
        leaf = F.when(x.own, F.xxhash64(F.lit("own"), spaced(line))).otherwise(F.xxhash64(x.n, F.substring_index(x.m, " ", depth)))
        return F.struct(key.alias("key"), leaf.alias("leaf"), F.when(x.m == "", 0).otherwise(x.n).alias("n"))

    return F.zip_with(lines, told, form)


def equal_tokens(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def slots_of(line: Column, n: Column, leaf: Column, depth: int, similarity: float) -> Column:
    """Hashes of parts of a form, one of which at least any two forms of a leaf share that are similar enough.

    Of the tokens behind the leading ones `may` can differ. One: all tokens but each in turn. More: may + 1 runs of
    tokens, of which one has no difference. As many as there are: all forms are similar."""
    may, behind = F.floor(n - F.lit(similarity) * n + F.lit(1e-9)).cast("int"), n - F.lit(depth)
    but_one = F.transform(F.sequence(F.lit(0), behind - 1), lambda i: F.xxhash64(leaf, i, F.slice(line, F.lit(depth + 1), i), F.slice(line, i + (depth + 2), behind - 1 - i)))
    start = lambda i: F.floor(i * behind / (may + 1)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), may), lambda i: F.xxhash64(leaf, i, F.slice(line, start(i) + (depth + 1), start(i + 1) - start(i))))
    return F.when((may < 1) | (behind < 1), F.array().cast("array<bigint>")).when(may >= behind, F.array(F.xxhash64(leaf))).when(may == 1, but_one).otherwise(runs)


def further_templates(rest: DataFrame, depth: int, similarity: float) -> list[DataFrame]:
    """(key, template, n) of the forms in rest (key, leaf, line, n, n_docs) that are or join a template, one table a round.

    The forms in order of their documents, most first, and key: a form joins a template that is similar and comes before
    it, or becomes one. A round settles all forms that have no similar one before them, and those that join
    these. A form whose slots no other has is a template alone and in no table."""
    slots = stored(rest.select("key", "n_docs", F.explode(slots_of(F.col("line"), F.col("n"), F.col("leaf"), depth, similarity)).alias("slot")).distinct(), "line-slots")
    found: list[DataFrame] = []
    while True:
        shared = slots.groupBy("slot").agg(F.count("*").alias("_k")).filter(F.col("_k") > 1).select("slot")
        slots = stored(slots.join(shared, "slot"), "line-slots")
        if slots.isEmpty():
            return found
        order = Window.partitionBy("slot").orderBy(F.desc("n_docs"), "key")
        first = stored(slots.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= FIRST), "line-firsts")
        before = (F.col("to_docs") > F.col("n_docs")) | ((F.col("to_docs") == F.col("n_docs")) & (F.col("to") < F.col("key")))
        pairs = slots.join(first.select("slot", F.col("key").alias("to"), F.col("n_docs").alias("to_docs")), "slot").filter(before).select("key", "to", "to_docs").distinct()
        lines = rest.select("key", "line", "n")
        near = pairs.join(lines, "key").join(lines.select(F.col("key").alias("to"), F.col("line").alias("seed")), "to")
        near = stored(near.filter(equal_tokens("line", "seed") >= F.lit(similarity) * F.col("n")).select("key", "to", "to_docs", "n"), "line-pairs")
        # compared with all before it in each of its slots, and similar to none
        ranked = slots.groupBy("key").agg(F.count("*").alias("_k")).join(first.groupBy("key").agg(F.count("*").alias("_f")), "key").filter("_k = _f").select("key")
        seeds = stored(ranked.join(near.select("key"), "key", "left_anti"), "line-seeds")
        joins = near.join(seeds.select(F.col("key").alias("to")), "to").groupBy("key", "n").agg(F.min_by("to", F.struct(-F.col("to_docs"), F.col("to"))).alias("template"))
        own = seeds.join(rest, "key").select("key", F.col("key").alias("template"), "n")
        settled = stored(own.unionByName(joins.select("key", "template", "n")), "line-templates")
        found.append(settled)
        slots = slots.join(settled.select("key"), "key", "left_anti")


def recurring_lines(docs: DataFrame, *, depth: int = 3, similarity: float = 0.8, min_docs: int = 3, min_tokens: int = 3, long_tokens: int = 50, long_docs: int = 2) -> DataFrame:
    """(key, template, n_docs) of the line forms whose template recurs, from the stored lines of drop_recurring_lines."""
    lines = docs.select("text_key", F.explode("forms").alias("f")).select("text_key", "f.key", "f.leaf", "f.n").filter("n > 0")
    forms = lines.distinct().groupBy("leaf", "key", "n").agg(F.count("*").alias("n_docs"))
    forms = stored(forms, "line-forms")
    several = forms.groupBy("leaf").agg(F.count("*").alias("_k"), F.sum("n_docs").alias("_d")).filter(F.col("_k") > 1).select("leaf")
    # strings of the forms in leaves that have several
    strings = docs.select(F.explode(F.arrays_zip("lines", "forms")).alias("x")).select("x.lines", "x.forms.key", "x.forms.leaf").join(small(several, several.count()), "leaf", "left_semi")
    strings = strings.groupBy("leaf", "key").agg(F.first("lines").alias("line")).withColumn("line", F.split(masked(F.col("line")), " "))
    strings = stored(strings.join(forms, ["leaf", "key"]), "line-strings")
    seeds = strings.groupBy("leaf").agg(F.max(F.struct("n_docs", "line", "key")).alias("s")).select("leaf", F.col("s.line").alias("seed"), F.col("s.key").alias("template"))
    compared = stored(strings.join(seeds, "leaf").withColumn("joins", equal_tokens("line", "seed") >= F.lit(similarity) * F.col("n")), "line-compared")
    joined = compared.filter("joins").select("key", "template", "n")
    for more in further_templates(compared.filter("not joins"), depth, similarity):
        joined = joined.unionByName(more)
    joined = stored(joined, "line-templates")
    # documents of the templates that took in other forms; the rest have the counts of their only form
    taken = joined.filter("key <> template").select("template").distinct()
    wide = joined.join(taken, "template", "left_semi")
    counts = lines.select("key", "text_key").distinct().join(small(wide, wide.count()), "key").groupBy("template", "n").agg(F.count_distinct("text_key").alias("n_docs"))
    single = forms.join(wide.select("key"), "key", "left_anti").select("key", F.col("key").alias("template"), "n", "n_docs")
    every = single.unionByName(wide.join(counts.select("template", "n_docs"), "template").select("key", "template", "n", "n_docs"))
    often = ((F.col("n") >= min_tokens) & (F.col("n_docs") >= min_docs)) | ((F.col("n") >= long_tokens) & (F.col("n_docs") >= long_docs))
    return stored(every.filter(often).select("key", "template", "n_docs"), "recurring")


def drop_recurring_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, **options) -> DataFrame:
    """Texts without the lines whose template recurs across documents.

    Returns rid, id, text, n_lines, n_dropped, one row for each input row. A template recurs if it has min_tokens
    tokens and min_docs different texts hold it, or long_tokens tokens and long_docs texts; a line of variable fields
    for more than half recurs if the very line does. Null text: null text, no lines. Blank lines stay. Repeated rows are one text to the counts and are cleaned each. A text of dropped
    lines only becomes empty. An empty table gives an empty result; other columns are ignored.
    """
    text = named(df, text_col)
    rows = df.select(F.monotonically_increasing_id().alias("rid"), named(df, id_col).alias("id"), F.split(text, "\n", -1).alias("lines"), F.xxhash64(text).alias("text_key"))
    docs = stored(rows.withColumn("forms", forms_of(F.col("lines"), depth)), "lines")
    recurring = recurring_lines(docs, depth=depth, **options)
    places = docs.select("rid", F.posexplode("forms").alias("at", "f")).select("rid", "at", "f.key").join(small(recurring.select("key"), recurring.count()), "key", "left_semi")
    gone = places.groupBy("rid").agg(F.collect_list("at").alias("gone"))
    out = docs.select("rid", "id", "lines").join(gone, "rid", "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    return out.select("rid", "id", F.array_join(kept, "\n").alias("text"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without recurring line templates."""
    out = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "text", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest("n_dropped", F.lit(0)).alias("n_dropped"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS MATERIALIZED (SELECT rid, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
k AS MATERIALIZED (SELECT rid, text, line, pos, list_transform(string_split(trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g')), ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS m FROM l),
f AS MATERIALIZED (SELECT m, len(m) AS n, array_to_string(m[1:3], ' ') AS lead, count(DISTINCT text) AS n_docs FROM k WHERE m <> [''] AND 2 * len(list_filter(m, lambda t: t = '<*>')) <= len(m) GROUP BY m),
s AS (SELECT n, lead, max({'n_docs': n_docs, 'm': m}).m AS seed FROM f GROUP BY n, lead),
t AS MATERIALIZED (SELECT m, n, CASE WHEN len(list_filter(list_zip(m, seed), lambda x: x[1] = x[2])) >= 0.8 * n THEN seed ELSE m END AS template FROM f JOIN s USING (n, lead)),
c AS (SELECT template, count(DISTINCT text) AS n_docs FROM k JOIN t USING (m) GROUP BY template),
r AS (SELECT m FROM t JOIN c USING (template) WHERE (n >= 3 AND n_docs >= 3) OR (n >= 50 AND n_docs >= 2)),
g AS (SELECT k.*, r.m IS NOT NULL AS gone FROM k LEFT JOIN r USING (m)),
o AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*)::INT AS n_lines, count(*) FILTER (gone)::INT AS n_dropped FROM g GROUP BY rid)
SELECT doc_id, o.text, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_dropped, 0)::INT AS n_dropped FROM d LEFT JOIN o USING (rid)
"""
