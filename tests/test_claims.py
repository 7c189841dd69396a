"""Claims read from texts: names of several words, both orders, aliases, units, codes and key words."""

from pyspark.sql import functions as F

from lakewarden.operators import claims as C

UNITS = {"mg": "mg", "milligrams": "mg", "mcg": "mcg", "units": "units"}


def test_ranges_from_text(spark):
    texts = [
        (1, "Take Warm Tea 1,500 mg daily; later take warm tea 1500 MG. Also 20 milligrams of Sleepy Root now."),
        (2, "warm tea 3 mcg and unheard stuff 5 mg"), (3, None), (4, ""), (5, "nothing 5 apples, 12 monkeys"), (6, "use WT 2 mg, then warm tea 2.0 mg"), (7, "insulin 12.5 units"), (8, "tea " * 20_000 + "warm tea 900mg"),
    ]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("name", F.lit("x")).withColumn("value", F.lit(1))
    reference = spark.createDataFrame([("warm tea", "mg", 100.0, 1000.0), ("sleepy root", "mg", 5.0, 50.0), ("insulin", "units", 20.0, 40.0)], "name string, unit string, low double, high double")
    aliases = spark.createDataFrame([("WT", "warm tea"), ("root", "sleepy root")], "alias string, name string")
    got = sorted((r.id, r.name, r.value, r.unit, r.status, r.violation) for r in C.range_claims(df, "id", "text", reference, aliases, UNITS).collect() if r.name)
    assert got == [
        (1, "sleepy root", 20.0, "mg", "in_range", False), (1, "warm tea", 1500.0, "mg", "above", True), (6, "warm tea", 2.0, "mg", "below", True), (7, "insulin", 12.5, "units", "below", True), (8, "warm tea", 900.0, "mg", "in_range", False),
    ]
    unknown = {(r.id, r.said, r.status, r.violation) for r in C.range_claims(df, "id", "text", reference, aliases, UNITS, strict=True).collect() if not r.name}
    assert (2, "stuff", "unknown", True) in unknown and not [u for u in unknown if u[0] in (3, 4, 5)]
    assert C.range_claims(df.limit(0), "id", "text", reference, aliases, UNITS).count() == 0
    assert {r.status for r in C.range_claims(df, "id", "text", reference.limit(0), aliases.limit(0), UNITS).collect()} == {"unknown"}


def test_codes_against_what_was_asked(spark):
    asked = [(1, "About K12.1 and L20.0"), (2, "My heart hurts"), (3, "no field at all"), (4, None), (5, "K11.1")]
    said = [(1, "It is K99.9, or M10.1, M10.1"), (2, "So I20.1 or M10.1"), (3, "M10.1"), (4, "M10.1"), (5, "nothing"), (6, "M10.1")]
    keywords = spark.createDataFrame([("heart", "I")], "keyword string, domain string")
    q, a = (spark.createDataFrame(x, "id int, text string") for x in (asked, said))
    run = lambda strict: {r.id: (r.codes, r.domains, r.mismatch) for r in C.code_claims(q, a, "id", "text", r"\b[A-Z]\d{2}\.\d\b", F.substring("code", 1, 1), keywords, strict).collect()}
    plain, strict = run(False), run(True)
    assert plain[1] == (2, "M", True) and plain[2] == (2, "M", False) and plain[3] == (1, "M", False) and 5 not in plain
    assert strict[2] == (2, "M", True) and strict[3][2] and strict[4][2] and strict[6][2]


def test_lines_of_no_part_and_parts_of_no_table_count_as_in_the_sql(spark, tmp_path):
    """Two unknown parts at one price, one part in two places of an order, a line of no part, a price whose cents two roundings tell apart."""
    import duckdb

    from lakewarden.plans import catalog

    lines = [
        (1, 17, 10.0, 1.0, 1), (1, 34, 10.0, 1.0, 1), (1, 51, 10.0, 1.0, 3), (1, 51, 10.0, 1.0, 7), (2, 17, 10.0, 1.0, 1), (2, 17, 10.0, 1.0, 2), (2, 17, 10.0, 1.0, 4),
        (3, 999, 10.0, 1.0, 1), (3, 5, 2.01, 2.0, 2), (3, 6, 2.01, 2.0, 1), (3, 6, 2.01, 2.0, 2), (4, None, 5.0, 1.0, 1),
    ]
    parts = [(17, 10.0), (34, 10.0), (51, 10.0), (5, 1.005 / 1.1), (6, 1.0)]
    for name, rows, schema in (("lineitem", lines, "l_orderkey long, l_partkey long, l_extendedprice double, l_quantity double, l_linenumber int"), ("part", parts, "p_partkey long, p_retailprice double")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(catalog.SQL["range_claims"]).fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES["range_claims"](spark, str(tmp_path)).select("status", "violation", "n").collect()) == want


def test_claims_are_dealt_by_name_and_by_id_alone(spark):
    """Aliases of any number of words, the longest that is known counts; names of other lengths and whole claims are not dealt again and again."""
    texts = [(1, "deep red tea 5 mg, red tea 5 mg; 7 mg of red tea cup and tea 5 mg"), (1, "so red tea 5 mg"), (2, "blue red tea 5 mg and 5 mg of tea"), (None, "red tea 9 mg"), (3, "deep red tea 5 units")]
    df = spark.createDataFrame(texts, "id int, text string")
    reference = spark.createDataFrame([("tea", "mg", 1.0, 4.0), ("red tea", "mg", 6.0, 8.0), ("deep red tea", "mg", 5.0, 5.0)], "name string, unit string, low double, high double")
    aliases = spark.createDataFrame([("x", "unheard of"), ("nobody", None)], "alias string, name string")
    tell = lambda: sorted((str(r.id), r.name, r.said, r.value, r.unit, r.status) for r in C.range_claims(df, "id", "text", reference, aliases, UNITS).collect() if r.name)
    want = [
        ("1", "deep red tea", "deep red tea", 5.0, "mg", "in_range"), ("1", "red tea", "red tea", 5.0, "mg", "below"), ("1", "red tea", "red tea", 7.0, "mg", "in_range"), ("1", "tea", "tea", 5.0, "mg", "above"),
        ("2", "red tea", "red tea", 5.0, "mg", "below"), ("2", "tea", "tea", 5.0, "mg", "above"), ("None", "red tea", "red tea", 9.0, "mg", "above"),
    ]
    assert tell() == want
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:  # as where neither table is small
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert tell() == want
        plan = C.range_claims(df, "id", "text", reference, aliases, UNITS).groupBy("status").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning(id#") == 1
