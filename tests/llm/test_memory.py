"""What waits beside the executor's heap: rows on their way to tasks and back, and workers of the driver's rows."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import common, language
from lakewarden.llm.decontamination import contamination
from lakewarden.llm.jaccard_join import similar_classes
from lakewarden.llm.sharding import stratified_shards


def test_texts_are_labelled_together_though_they_travel_in_small_batches(spark):
    model = language.LanguageModel(["de", "en"], language.np.zeros((language.SLOTS, 2)), language.np.ones((len(language.NAMES) + 1, 2), bool))
    texts = spark.range(0, 2600, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("text "), F.col("id"))).alias("text"))
    before = spark.conf.get(common.BATCH)
    try:
        out = language.label_languages(texts, model, keep=["id", "text"])
        assert int(spark.conf.get(common.BATCH)) <= 500
        rows = out.orderBy("id").collect()
    finally:
        spark.conf.set(common.BATCH, before)
    assert [(r["id"], r["text"]) for r in rows] == [(i, f"text {i}" if i % 7 else None) for i in range(2600)]
    assert all((r["lang_pred"], r["score"], len(r["spans"])) == (("de", 1.0, 1) if r["id"] % 7 else ("und", 0.0, 0)) for r in rows)
    whole = language.pa.RecordBatch.from_pydict({"text": ["x" * 10] * 30})
    parts = [whole.slice(a, 10) for a in (0, 10, 20)]
    assert [b.num_rows for b in language.together(iter(parts), 20, 1 << 20)] == [20, 10] and [b.num_rows for b in language.together(iter(parts), 99, 1)] == [10, 10, 10]


def test_operators_send_no_rows_of_the_drivers_python(spark, monkeypatch):
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.lit("one two three four five six").alias("text"), F.lit("a").alias("source")).cache()
    docs.count()
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda *a, **b: 1 / 0)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: 1 / 0)
    assert similar_classes(docs).select("component").distinct().count() == 1
    assert contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text"), length=10).filter("contaminated").count() == 6
    assert stratified_shards(docs, shards=3).count() == 6
