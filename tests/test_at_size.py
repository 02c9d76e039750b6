"""What shows only on large tables: joins that must not be broadcast, rows that must not meet in one task, ties that the order of rows decided."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import dates, text
from fieldloom.operators import governance, mrz, places, results, scoring
from fieldloom.plans import catalogue, tables


def test_many_places_are_not_broadcast(spark):
    run = spark.createDataFrame([(1, "tunas"), (2, "sfax")], "doc_id long, run string")
    known = places.union_places(spark.createDataFrame([("Tunis",), ("Sfax",)], "place string"))
    found = places.matched(run, known, least=4, small=0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.select("doc_id", "place", "edits").collect()) == [(1, "Tunis", 1), (2, "Sfax", 0)]


def test_details_without_a_key_are_dealt(spark):
    detail = spark.range(2000).select("id", F.when(F.col("id") < 5, F.lit("h1")).alias("history_id"), F.when(F.col("id").between(5, 9), F.lit("j1")).alias("job_id"))
    history = spark.createDataFrame([("h1", "j1"), ("h2", "j2")], "id string, job_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        _, kept = governance.delete_history(history, detail, spark.createDataFrame([("h1",)], "id string"))
        assert kept.columns == ["id", "history_id", "job_id"]
        rows = kept.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert sorted(r["id"] for r in rows) == list(range(10, 2000))
    assert len({r["task"] for r in rows}) > 1


def test_rows_are_dealt_by_their_number(spark):
    rows = spark.range(100).coalesce(1)
    assert tables.dealt(rows, "id", 10).rdd.getNumPartitions() == 10
    assert tables.dealt(rows, "id", 100).rdd.getNumPartitions() == 1
    assert sorted(r[0] for r in tables.dealt(rows, "id", 10).collect()) == list(range(100))


@pytest.mark.parametrize("turn", [1, -1])
def test_merged_row_is_not_told_by_the_order_of_rows(spark, turn):
    shape = "doc_id long, name string, value string, confidence double, validated boolean"
    rows = [(1, "tax_id", "", 0.5, False), (1, "tax_id", "", 0.5, True)][::turn]
    merged = scoring.merge_fields(spark.createDataFrame(rows, shape).coalesce(1), spark.createDataFrame([], shape))
    assert [r["validated"] for r in merged.collect()] == [True]


def test_long_numbers_of_zones_are_whole(spark):
    rows = spark.createDataFrame([("id_number", "no 1000019/l2I", "1000019/121"), ("id_number", "no 500019/l2I", "500019/121"), ("id_number", "055412/121", "055412/121"), ("number", "[U 1000000|", "EU1000000"), ("number", "[U 100000|", "EU100000")], "name string, raw string, want string")
    for r in rows.select("want", results.zone_value(F.col("name"), F.col("raw"), F.lit(None).cast("string"))["value"].alias("got")).collect():
        assert r["got"] == r["want"]


@pytest.mark.parametrize("body", ["", "a12b3", "12", "x\u0001 7 \u0001\u00018", "1 2 3"])
def test_pieces_and_spans(spark, body):
    import re

    row = spark.createDataFrame([(body,)], "t string").select(text.pieces(F.col("t"), r"\d+").alias("p"), text.spans(F.col("t"), r"\d+").alias("s")).first()
    assert row["p"] == re.split(r"(\d+)", body)
    assert [tuple(s) for s in row["s"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+", body)]


def test_dates_and_check_digits(spark):
    want = {"le 7/3/1990 ou 1/1/2000": "1990-03-07", "31/02/1990 2001-2-3": "2001-02-03", "1/1/0000": None, "5 Février 1999": "1999-02-05", "5 foo 1999": None, "1990": None, "": None, "\n٧/٣/١٩٩٠\n": "1990-03-07"}
    rows = spark.createDataFrame(list(want.items()), "t string, w string").select("t", "w", dates.parse_date_any(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in rows] == [r["w"] for r in rows]
    words = ["520727", "L898902C3", "<<<<", "", "ZE184226B<<<<<", "a-é9"]
    value = lambda x: int(x) if x.isascii() and x.isdigit() else ord(x) - 55 if "A" <= x <= "Z" else 0
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", mrz.check_digit(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in rows] == [sum(value(x) * (7, 3, 1)[i % 3] for i, x in enumerate(r["t"])) % 10 for r in rows]


def test_confidences_are_summed_in_the_order_of_rows(spark):
    """However rows are spread over tasks, equal scores rank as where one task has them all, and as in SQL."""
    shape = "doc_id long, field string, value string, source string, engine string, avg_conf double"
    rows = [(1, "name", v, "full", "first", c) for v, cs in (("A", (0.3, 0.2, 0.1)), ("B", (0.1, 0.2, 0.3))) for c in cs]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE lineitem AS SELECT * FROM (VALUES (1, 1, 3, 30, 'A'), (1, 1, 3, 20, 'A'), (1, 1, 3, 10, 'A'), (1, 1, 3, 10, 'B'), (1, 1, 3, 20, 'B'), (1, 1, 3, 30, 'B')) AS t(l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag)")
    duck.execute("ALTER TABLE lineitem ADD COLUMN l_linestatus VARCHAR DEFAULT ''")
    duck.execute("SET threads = 1")
    want = [r[0] for r in duck.execute(f"SELECT value FROM ({catalogue.oracle_sql()['rank_candidates']}) ORDER BY rank").fetchall()]
    spread = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), shape)
    for candidate in (spread, spark.createDataFrame(rows, shape).coalesce(1), spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), shape), spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), shape)):
        ranked = scoring.rank_candidates(candidate, catalogue.SOURCE_BONUS)
        assert [r.value for r in ranked.orderBy("rank").collect()] == want == ["B", "A"]
        assert [r.value for r in scoring.resolve_fields(ranked).collect()] == ["B"]
