"""Round trips of files, rules with known answers, and keyed states against a plain walk."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import dates
from fieldloom.operators import boxes, extraction, fusion
from fieldloom.sources import files
from fieldloom.streaming import states


def one(spark, column, given):
    return spark.createDataFrame([(given,)], "t string").select(column.alias("x")).first()["x"]


def test_date_and_value_steps(spark):
    t = F.col("t")
    for step, given, want in [
        (dates.parse_date_any, "le 3/4/2020.", "2020-04-03"),
        (dates.parse_date_any, "2020-04-03", "2020-04-03"),
        (dates.parse_date_any, "12 Février 1999", "1999-02-12"),
        (dates.parse_date_any, "٠٣ جانفي ١٩٨٠", "1980-01-03"),
        (dates.parse_date_any, "31/02/2024", None),
        (dates.parse_date_any, None, None),
        (dates.due_date_iso, "311224", "2024-12-31"),
        (dates.due_date_iso, "31122024", "2024-12-31"),
        (dates.due_date_iso, "soon", None),
        (dates.currency_code, " Dinars ", "TND"),
        (dates.currency_code, "yen", None),
        (dates.clean_value, ": ACME - www.acme.test page 2", "ACME"),
        (dates.is_placeholder, "CIN_NAME", True),
        (dates.clean_words, "«Helloo»  wwworld!", ["helo", "world"]),
        (dates.text_variants, "abc", ["abc"]),
        (dates.text_variants, "نص a", ["نص a", "صن a"]),
    ]:
        assert one(spark, step(t), given) == want, (step.__name__, given)
    assert float(one(spark, dates.normalize_capital(t), "au capital de 1 250 000 dinars, 12 parts")) == 1250000.0
    assert one(spark, dates.normalize_capital(t), "0") is None


def test_rules(spark):
    rules = [
        extraction.Rule("name", anchors=("nom",), required=True, no_digits=True, forbidden=("test",)),
        extraction.Rule("day", anchors=("né le",), kind="date", required=True),
        extraction.Rule("code", patterns=(r"X(\d+)", r"Y(\d+)"), min_length=2, max_length=3),
        extraction.Rule("late", anchors=("nowhere",), patterns=(r"Y(\d+)",)),
    ]
    docs = spark.createDataFrame([(1, "Nom : Test\nné le\n\n3.4.2020\nY12"), (2, None), (3, ""), (4, "الاسم: محمد\nX1\nNom: A2 B")], "doc_id long, raw_text string")
    got = {(r["doc_id"], r["name"]): (r["value"], r["confidence"], r["validated"], r["error"]) for r in extraction.extract_fields(docs, rules).collect()}
    assert got[1, "name"] == ("Test", 0.85, False, "forbidden:test")
    assert got[1, "day"] == ("2020-04-03", 0.75, True, None)
    assert got[1, "code"] == ("12", 0.88, True, None)
    assert got[1, "late"] == ("12", 0.836, True, None)
    assert got[2, "name"] == got[3, "name"] == (None, 0.0, False, "missing")
    assert got[4, "code"] == ("1", 0.95, False, "too_short")
    assert got[4, "name"] == ("A2 B", 0.85, False, "digits")
    assert extraction.extract_fields(docs.limit(0), rules).count() == 0
    field = spark.createDataFrame([("a", "8 12"), ("b", "x")], "name string, value string")
    hooked = {r["name"]: r["value"] for r in extraction.apply_hooks(field, {"a": ["strip_spaces", "registration_letter"], "b": ["uppercase"]}).collect()}
    assert hooked == {"a": "B12", "b": "X"}


def test_consensus_edges(spark):
    shape = "doc_id long, name string, value string, confidence double, validated boolean"
    first = spark.createDataFrame([(1, "a", "v", 0.5, True), (1, "b", None, 0.9, True), (1, "c", "v", 0.5, True), (1, "d", "v", 0.96, True)], shape)
    second = spark.createDataFrame([(1, "a", "w", 0.7, True), (1, "b", "w", 0.2, True), (1, "c", "w", 0.6, True), (1, "d", " V", 0.2, True), (2, "a", "n", 0.3, True), (2, "z", "n", 0.3, True)], shape)
    got = {(r["doc_id"], r["name"]): (r["value"], r["confidence"], r["action"]) for r in fusion.merge_consensus(first, second, ["a", "b", "c", "d"]).collect()}
    assert got == {(1, "a"): ("w", 0.7, "replaced"), (1, "b"): ("w", 0.2, "filled"), (1, "c"): ("v", 0.5, "kept"), (1, "d"): ("v", 0.99, "agreed"), (2, "a"): ("n", 0.3, "filled")}


def test_result_and_case_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    result = {"job_id": "j1", "status": "success", "fields": [{"name": "a", "value": "1", "confidence": 0.9, "validated": True}], "normalized_data": {"k": "v"}}
    (tmp_path / "r" / "one.json").write_text(json.dumps(result, indent=1))
    rows = files.read_results(spark, str(tmp_path / "r"))
    flat = files.flatten_results(rows)
    assert {(r["section"], r["key"], r["value"]) for r in flat.collect()} == {("field", "a", "1"), ("normalized", "k", "v")}
    files.write_csv_export(flat, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    files.write_json_export(rows.select("job_id", "status"), str(tmp_path / "pretty"))
    files.write_results(rows.select("job_id", F.lit("o1").alias("organization_id")), str(tmp_path / "by_org"))
    assert (tmp_path / "by_org" / "organization_id=o1").is_dir()
    files.write_manifest(rows.select("job_id"), str(tmp_path / "m"))
    assert [r["job_id"] for r in files.read_manifest(spark, str(tmp_path / "m"), "job_id string").collect()] == ["j1"]
    for _ in range(2):
        files.append_audit(rows.select("job_id"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    (tmp_path / "cases.json").write_text(json.dumps([{"file": "f1", "template_id": "t", "expected": {"a": "1", "b": "2"}}]))
    assert {(r["case_id"], r["name"], r["expected"]) for r in files.read_cases(spark, str(tmp_path / "cases.json")).collect()} == {("f1", "a", "1"), ("f1", "b", "2")}


def test_annotations_and_boxes(spark, tmp_path):
    shape = {"name": "rect", "x": 10, "y": 20, "width": 100, "height": 30}
    regions = [{"shape_attributes": shape, "region_attributes": {"field_name": "name", "value": "A"}}, {"shape_attributes": shape | {"width": 0}, "region_attributes": {"field_name": "gone"}}, {"shape_attributes": shape | {"name": "circle"}, "region_attributes": {"field_name": "gone"}}]
    (tmp_path / "a.json").write_text(json.dumps({"_via_settings": {}, "_via_img_metadata": {"i1": {"filename": "f", "regions": regions}}}))
    got = files.read_annotations(spark, str(tmp_path / "a.json")).collect()
    assert [(r["filename"], r["field_name"], r["value"], r["x"], r["w"]) for r in got] == [("f", "name", "A", 10.0, 100.0)]
    raw = json.dumps([[[[0, 1], [9, 1], [9, 5], [0, 5]], "t", 0.5], [[[0, 1], [4, 1], [4, 3], [0, 3]], ["u", 0.7]]])
    rows = files.read_boxes(spark.createDataFrame([(1, raw), (2, None)], "doc_id long, j string"), "j")
    got = boxes.geometry(boxes.from_corners(rows)).orderBy("idx").collect()
    assert [(r["text"], r["confidence"], r["x2"], r["cy"]) for r in got] == [("t", 0.5, 9.0, 3.0), ("u", 0.7, 4.0, 2.0)]


@pytest.mark.parametrize(("span", "resets"), [("1 hour", False), ("20 seconds", False), ("20 seconds", True), ("3 minutes", True)])
def test_breaker_is_the_plain_walk(spark, span, resets):
    rnd, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows, at = [], {k: start for k in "abc"}
    for i in range(600):
        key = rnd.choice("aaaabc")
        at[key] += dt.timedelta(seconds=rnd.choice([1, 2, 5, 40]))
        rows.append((key, at[key], rnd.random() < 0.4, i))
    want, held = {}, {k: ("closed", 0, 0.0) for k in "abc"}
    for key, ts, ok, i in rows:
        mode, n, since = held[key]
        now = ts.timestamp()
        half = mode == "open" and now - since >= 30
        if ok:
            held[key] = ("closed", 0, now) if half else (mode, 0 if resets and mode == "closed" else n, since)
        else:
            held[key] = ("open", n + 1, now) if half or n + 1 >= 5 else (mode, n + 1, since)
        want[key, ts.timestamp()] = held[key][:2]
    df = spark.createDataFrame(rows, "key string, ts timestamp, ok boolean, event_id long")
    got = {(r["key"], r["ts"].timestamp()): (r["state"], r["failures"]) for r in states.breaker_table(df, span=span, resets=resets).collect()}
    assert got == want and {s for s, _ in want.values()} == {"closed", "open"}


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s), s < 0) for s in (0, 10, 20, 59, 60, 61)] + [("b", start, True)]
    source = _stream(spark, tmp_path, rows, "key string, ts timestamp, ok boolean")
    limit = states.rate_limit_stream(source, 4).writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    limit.awaitTermination(120)
    counts = [r["n"] for r in spark.sql("select n from limits where key = 'a' order by ts").collect()]
    assert counts == [1, 2, 3, 4, 4, 5]
    breaker = states.breaker_stream(source).writeStream.outputMode("update").format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    breaker.awaitTermination(120)
    assert {(r["key"], r["state"], r["failures"]) for r in spark.sql("select * from breaker").collect()} == {("a", "open", 6), ("b", "closed", 0)}


def test_folder_to_done_and_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"doc_id": 1, "raw_text": "ok"}\n{"doc_id": 2, "raw_text": ""}')
    (tmp_path / "in" / "y.txt").write_text("ignored")
    docs = states.watch_folder(spark, str(tmp_path / "in")).withColumn("error", F.when(F.col("raw_text") == "", "empty"))
    run = docs.writeStream.foreachBatch(lambda b, n: states.route_done_error(b, str(tmp_path / "out"), n)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out" / "done")).collect()] == [1]
    assert [(r["doc_id"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out" / "error")).collect()] == [(2, "empty")]
