"""Rules of a scan from tables: read, validated, and handed over as plain rows.

A rules table has a row for each rule: rule_id, family, severity (1 to 4), weight (0 to 1), pattern (a regular expression), gate
(lower-case literals of which each match holds one; may be null), tail (only so many last characters count; may be null) and
version. It may be Parquet or JSON, a rule a line. A pattern file is one JSON object instead: {"version": 1, "critical": [patterns],
"soft": [patterns]}.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

SCHEMA = "rule_id string, family string, severity int, weight double, pattern string, gate array<string>, tail int, version int"
MOST_RULES = 100_000  # that are sent to all tasks
#: Severity and weight of the two lists of a pattern file.
CRITICAL, SOFT = (4, 1.0), (2, 0.35)


@F.udf(StringType())
def _pattern_error(pattern):
    """Why a pattern is no regular expression; one call a rule, not a text."""
    try:
        re.compile(pattern or "", re.A)
    except re.error as e:
        return f"no regular expression: {e}"
    return None


def judged_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason) rules. Of several rows of one rule_id the one of the greatest version counts (ties: by pattern); the others
    are neither. Gates come out in lower case, without empty literals."""
    named = {f.name for f in rules.schema}
    wanted = [x.split(" ") for x in SCHEMA.split(", ")]
    r = rules.select(*[(F.col(c) if c in named else F.lit(None)).cast(kind).alias(c) for c, kind in wanted])
    r = r.withColumn("version", F.coalesce("version", F.lit(1))).withColumn("gate", F.filter(F.transform(F.coalesce("gate", F.array().cast("array<string>")), F.lower), lambda g: g.isNotNull() & (g != "")))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    reason = F.coalesce(
        F.when(blank("rule_id"), "no rule_id"), F.when(blank("family"), "no family"), F.when(F.col("severity").isNull() | ~F.col("severity").between(1, 4), "severity is not 1 to 4"),
        F.when(F.col("weight").isNull() | F.isnan("weight") | ~F.col("weight").between(0, 1), "weight is not 0 to 1"), F.when(F.col("tail") <= 0, "tail is not above 0"), F.when(blank("pattern"), "no pattern"), _pattern_error("pattern"),
    )
    r = r.withColumn("reason", reason)
    latest = Window.partitionBy("rule_id").orderBy(F.desc("version"), "pattern")
    valid = r.filter("reason is null").withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n", "reason")
    return valid, r.filter("reason is not null")


def rule_rows(valid: DataFrame, most: int = MOST_RULES) -> list[dict]:
    """Valid rules as the rows that a scan takes, by rule_id; an error where there are more than `most`, as every task gets them."""
    rows = valid.limit(most + 1).collect()  # bounded
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return sorted((r.asDict() for r in rows), key=lambda r: r["rule_id"])


def read_rules(spark: SparkSession, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rules of a Parquet table or of JSON lines. A line that is no JSON has no rule_id and so is rejected."""
    return judged_rules(spark.read.parquet(path) if kind == "parquet" else spark.read.schema(SCHEMA).json(path))


def read_pattern_file(spark: SparkSession, path: str, family: str = "firewall") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rules of a pattern file: named by list and place (critical-0, soft-2), without gates, in any case."""
    file = spark.read.schema("version int, critical array<string>, soft array<string>").option("multiLine", True).json(path)
    lists = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(weight).alias("weight"), F.coalesce(name, F.array().cast("array<string>")).alias("patterns")) for name, (severity, weight) in (("critical", CRITICAL), ("soft", SOFT))])
    rows = file.select("version", F.explode(lists).alias("l")).select("version", "l.name", "l.severity", "l.weight", F.posexplode("l.patterns").alias("at", "p"))
    pattern = F.when(F.trim("p") != "", F.concat(F.lit("(?i)"), "p"))
    return judged_rules(rows.select(F.concat_ws("-", "name", F.col("at").cast("string")).alias("rule_id"), F.lit(family).alias("family"), "severity", "weight", pattern.alias("pattern"), "version"))
