"""Claims read from texts and held against tables: amounts with units against ranges, codes against the domains that were asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[A-Za-z][A-Za-z0-9/-]*"
AMOUNT = r"\d[\d,]*(?:\.\d+)?"
WORDS = 4  # of a name at most


def _cases(units: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in units.items() for x in (k.lower(), v)])


def amounts_in_text(texts: DataFrame, id_col: str, text_col: str, units: dict[str, str], words: int = WORDS) -> DataFrame:
    """Amounts with a unit beside a name, `item 20 mg` or `20 mg of item`: id, value, unit, names, otherwise. units: spelling (any case) to unit. names: what the
    name may be, the longest first: of the words before an amount those that end there, of the words behind it those that begin there. otherwise: the name if none of them is
    known, the last word before the amount, or all words behind it, as their first alone may be that of many names. Each (value, unit, names) once a text; null texts have none."""
    spelt = "|".join(sorted((u.replace("/", "\\/") for u in units), key=len, reverse=True))
    before = rf"(?i)((?:{WORD}[ \t]+){{1,{words}}})({AMOUNT})[ \t]*({spelt})\b"
    behind = rf"(?i)(?<![\w.,])({AMOUNT})[ \t]*({spelt})[ \t]+(?:of[ \t]+)?({WORD}(?:[ \t]+{WORD}){{0,{words - 1}}})"

    def found(pattern: str, name: int, value: int, unit: int, forward: bool) -> Column:
        def one(m: Column) -> Column:
            tokens = F.split(F.trim(F.lower(F.regexp_extract(m, pattern, name))), r"\s+")
            cut = lambda i: F.array_join(F.slice(tokens, i, F.size(tokens) - i + 1) if forward else F.slice(tokens, F.lit(1), F.size(tokens) - i + 1), " ")
            return F.struct(
                F.regexp_replace(F.regexp_extract(m, pattern, value), ",", "").try_cast("double").alias("value"), F.element_at(_cases(units), F.lower(F.regexp_extract(m, pattern, unit))).alias("unit"),
                F.transform(F.sequence(F.lit(1), F.size(tokens)), cut).alias("names"), (F.element_at(tokens, -1) if forward else F.array_join(tokens, " ")).alias("otherwise"),
            )

        return F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0)), one)

    both = F.array_distinct(F.concat(found(before, 1, 2, 3, True), found(behind, 3, 1, 2, False)))
    return texts.select(id_col, F.explode(both).alias("c")).select(id_col, "c.*").filter("value is not null")


def named_claims(claims: DataFrame, id_col: str, aliases: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """claims (id, value, unit, names, otherwise, as of amounts_in_text) with `name`, that of the longest of its names in aliases (alias, name), null if none is; and `said`, the words of
    it or `otherwise`. Claims of one name, value and unit are one claim of a text. more: named columns of value, unit and what else aliases hold of a name, made where a claim meets its
    name, null where it meets none.

    Of a claim's names only those are looked for that have as many words as an alias has; the longest stands for a claim without any. Claims are dealt twice: by name, then by id."""
    known = aliases.filter("name is not null").groupBy(F.lower("alias").alias("_alias")).agg(F.min(F.struct("name", *[c for c in aliases.columns if c not in ("alias", "name")])).alias("_k"))
    blanks = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit(" ")))
    lengths = [r[0] for r in known.select(blanks(F.col("_alias"))).distinct().collect()]  # of an alias at most as many as words
    numbered = F.transform("names", lambda x, i: F.struct(i.alias("at"), x.alias("alias")))
    # the longest name and `otherwise` tell all names of a claim, which are its ends or its beginnings
    tried = claims.withColumn("_full", F.element_at("names", 1)).withColumn("_tried", F.filter(numbered, lambda s: blanks(s["alias"]).isin(lengths)))
    tried = tried.select(id_col, "value", "unit", "_full", "otherwise", F.explode(F.when(F.size("_tried") > 0, F.col("_tried")).otherwise(F.slice(numbered, 1, 1))).alias("_t"))
    met = tried.withColumn("_alias", F.col("_t.alias")).join(known, "_alias", "left").select(id_col, "value", "unit", "_full", "otherwise", "_alias", F.col("_t.at").alias("_at"), "_k.*")
    hit = F.when(F.col("name").isNotNull(), F.struct("_at", "name", "_alias", *more)).alias("_hit")
    n = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = met.select(id_col, "value", "unit", "_full", "otherwise", hit).repartition(n, id_col).groupBy(id_col, "value", "unit", "_full", "otherwise").agg(F.min("_hit").alias("_b"))
    out = best.withColumn("name", F.col("_b.name")).withColumn("said", F.coalesce("_b._alias", "otherwise"))
    told = out.groupBy(id_col, "name", F.when(F.col("name").isNull(), F.col("said")).alias("_unknown"), "value", "unit").agg(F.min("said").alias("said"), F.min("_b").alias("_b"))
    made = best.schema["_b"].dataType.names[3:]
    return told.select(id_col, "value", "unit", "name", "said", *[F.col(f"_b.{c}").alias(c) for c in made])


def range_claims(texts: DataFrame, id_col: str, text_col: str, reference: DataFrame, aliases: DataFrame, units: dict[str, str], strict: bool = False) -> DataFrame:
    """Each text's claims against the range of their name: id, name, said, value, unit, status (in_range, below, above, unknown), violation.

    reference: name, unit, low, high, a row a name; aliases: alias, name (names are aliases of themselves). A claim in another unit than its name's is left out. Unknown names
    are violations in strict mode only. Aliases are joined with the ranges of their names first, claims with both at once, however large."""
    r = reference.groupBy("name").agg(F.first(F.struct(F.col("unit").alias("u"), "low", "high")).alias("r")).select("name", "r.u", "r.low", "r.high")
    every = aliases.select("alias", "name").unionByName(reference.select(F.col("name").alias("alias"), "name")).join(r, "name", "left")
    within = F.when(F.col("value") < F.col("low"), "below").when(F.col("value") > F.col("high"), "above").otherwise("in_range")
    status = F.when(F.col("u").isNull(), "unknown").when(F.col("u") == F.col("unit"), within)
    c = named_claims(amounts_in_text(texts, id_col, text_col, units), id_col, every, (status.alias("status"),))
    c = c.withColumn("status", F.when(F.col("name").isNull(), "unknown").otherwise(F.col("status"))).filter("status is not null")
    return c.select(id_col, "name", "said", "value", "unit", "status", (F.col("status").isin("below", "above") | ((F.col("status") == "unknown") & F.lit(strict))).alias("violation"))


def codes_in_text(texts: DataFrame, id_col: str, text_col: str, pattern: str, domain: Column) -> DataFrame:
    """Different codes (id, code, domain) of texts; domain: an expression over `code`, null where it is none."""
    codes = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0)))
    return texts.select(id_col, F.explode(codes).alias("code")).select(id_col, "code", domain.alias("domain")).filter("domain is not null").distinct()


def code_claims(requests: DataFrame, responses: DataFrame, id_col: str, text_col: str, pattern: str, domain: Column, keywords: DataFrame, strict: bool = False) -> DataFrame:
    """Responses whose codes are of domains that the request has neither codes nor key words of: id, codes, domains (those, sorted and comma-joined), mismatch.

    A row for each id with codes in its response. Texts of one id count together. Without a code in the request, key words alone make no mismatch unless strict; nor does a
    request of no domain. keywords: keyword (a lower-case word), domain."""
    codes = lambda texts: texts.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(pattern), F.lit(0)))).alias("code")).select(id_col, "code", domain.alias("domain")).filter("domain is not null")
    asking = requests.filter(F.col(id_col).isNotNull())
    said = codes(responses).select(id_col, "domain", "code", F.lit(None).cast("boolean").alias("coded"))
    asked = codes(asking).select(id_col, "domain", F.lit(None).cast("string").alias("code"), F.lit(True).alias("coded"))
    words = asking.select(id_col, F.explode(F.array_distinct(F.split(F.lower(text_col), "[^a-z0-9]+"))).alias("keyword")).join(keywords, "keyword").select(id_col, "domain", F.lit(None).cast("string").alias("code"), F.lit(False).alias("coded"))
    # dealt before they are counted, and counted in three steps of fixed-size state: a task holds its partition's keys once, not a file's
    n = int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = said.unionByName(asked).unionByName(words).repartition(n, id_col, "domain", "code").groupBy(id_col, "domain", "code").agg(F.max("coded").alias("coded"))
    of_domain = each.groupBy(id_col, "domain").agg(F.count("code").alias("codes"), F.max("coded").alias("coded"))
    extra = F.when((F.col("codes") > 0) & F.col("coded").isNull(), F.col("domain"))
    out = of_domain.groupBy(id_col).agg(F.sum("codes").alias("codes"), F.array_join(F.sort_array(F.collect_set(extra)), ",").alias("domains"), F.max("coded").alias("explicit")).filter("codes > 0")
    counts = (F.col("domains") != "") & (F.coalesce("explicit", F.lit(False)) | F.lit(strict))
    return out.select(id_col, "codes", "domains", counts.alias("mismatch"))
