"""A corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the docs of the next.
All but the last return the columns of documents. A document goes if its language can't be told, if a text of
its class of near duplicates stays already, or if it holds a benchmark passage; the mix repeats or leaves out
documents so that sources come near their targets; the last stage places each row in a shard.

Stages decide by row, not by doc_id: ids may be null or given twice. Null and blank texts have no letters, so the first stage
rejects them; the others would keep them (they are near copies of nothing and hold no passage) but for the mix, which takes
none of their words. Null sources are a source of their own. Repeated rows are near duplicates of each other. Columns that
documents does not have are dropped. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewarden.llm.common import fresh, kept, scratch, stored, table
from lakewarden.llm.decontamination import contamination, small
from lakewarden.llm.jaccard_join import similar_classes
from lakewarden.llm.language import label_languages, train_language_model
from lakewarden.llm.mixing import fair_mix
from lakewarden.llm.sharding import stratified_shards

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SHARE = 0.5  # of a text's letters in one language
LENGTH = 10  # words of a benchmark window


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and that column's name: ids may be null or given twice.

    Rows read from files are numbered by file (a small table of their names is written, so that numbers stay) and place in it;
    others are written with their numbers."""
    row, file, place = (fresh(name, docs.columns) for name in ("row", "_file", "_place"))
    try:
        read = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    except AnalysisException:
        return stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row
    files = stored(read.groupBy(file).agg(F.count("*").alias("_n")).withColumn("_at", F.row_number().over(Window.orderBy(file))), "pipeline-files")  # a row a file
    rows = read.join(small(files.select(file, "_at"), files.count()), file)
    return rows.withColumn(row, F.col("_at").cast("long") * (1 << 40) + F.col(place)).drop(file, place, "_at"), row


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts with letters, half of them at least in one language's spans. Null and blank texts go."""
    model = train_language_model(docs)
    return label_languages(docs, model, keep=COLUMNS).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near duplicates (five words, similarity 0.8): the smallest doc_id, nulls last, and
    of rows with one id the first. Null and wordless texts stay, each."""
    rows, row = numbered(docs)
    with scratch():
        found = stored(similar_classes(rows, id_col=row, size=5, num=4, den=5).select(F.col("id").alias(row), "component"), "pipeline-classes")
        several = found.groupBy("component").agg(F.count("*").alias("_k")).filter("_k > 1").select("component")
        members = stored(found.join(several, "component").join(rows.select(row, "doc_id"), row), "pipeline-members")
        stays = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", row)).alias("s")).select(F.col(f"s.{row}").alias(row))
        gone = kept(stored(members.select(row).join(stays, row, "left_anti"), "pipeline-gone"))
    return rows.join(small(gone, gone.count()), row, "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts with a benchmark passage of ten words (or a whole shorter item). Null and wordless texts stay."""
    rows, row = numbered(docs)
    with scratch():
        found = contamination(rows, table(spark, sf_dir, "benchmark"), length=LENGTH, id_col=row).filter("contaminated")
        hit = kept(stored(found.select(F.col("doc_id").alias(row)), "pipeline-hit"))
    return rows.join(small(hit, hit.count()), row, "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Sizes are mixed; the texts are joined at the end. Wordless texts are not taken."""
    rows, row = numbered(docs)
    with scratch():
        taken = kept(stored(fair_mix(rows, keep=[row]).filter("copies > 0").select(row, "copies"), "pipeline-mix"))
    copies = rows.join(small(taken, taken.count()), row).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return copies.select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return stratified_shards(docs, shards=24)


STAGES = [("language_id", identify), ("ngram_jaccard", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
ORACLE_SQL = None  # language identification and its model are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
