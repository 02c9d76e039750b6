"""Templates from files, extractors by family over tables and streams, nightly work."""

import datetime as dt

from pyspark.sql import functions as F

from fieldloom.operators import plugins, results, routing
from fieldloom.plans.tables import table
from fieldloom.sources import files
from fieldloom.streaming import states


def test_templates_from_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("id: inv\nname: Invoice\ndocument_type: invoice\nfields:\n  - {name: number, place: 1, pattern: 'N° (\\w+)'}\n  - {name: number, place: 2, pattern: '(X\\d+)'}\n")
    (tmp_path / "b.yml").write_text("id: old\ndocument_type: invoice\nis_active: false\nfields: [{name: gone, place: 1, pattern: '(.)'}]\n")
    (tmp_path / "c.yaml").write_text("not: [closed")
    (tmp_path / "d.txt").write_text("id: no\n")
    catalog = files.load_templates(spark, str(tmp_path))
    assert {(r.id, r.is_active, r.n_fields) for r in catalog.collect()} == {("inv", True, 2), ("old", False, 1)}
    docs = spark.createDataFrame([(1, "invoice", "N° A7 X9"), (2, "invoice", "X9"), (3, "invoice", None), (4, "other", "X9")], "doc_id long, document_type string, raw_text string")
    got = plugins.extract_by_rule_table(docs, files.template_rules(catalog)).collect()
    assert {(r.doc_id, r.name, r.value, r.place) for r in got} == {(1, "number", "A7", 1), (2, "number", "X9", 2)}


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"doc_id": 1, "raw_text": "a"}\n{"doc_id": 2, "raw_text": null}\n')
    rows = files.read_documents(spark, str(tmp_path / "d.jsonl"))
    rows.write.parquet(str(tmp_path / "d.parquet"))
    assert sorted(map(tuple, files.read_documents(spark, str(tmp_path / "d.parquet")).collect())) == [(1, "a"), (2, None)]


def test_fallback_rules(spark):
    docs = spark.createDataFrame([(1, "FACTURE N° A-1\nDate: 02/03/2020\nTotal TTC: 12,500"), (2, None)], "doc_id long, raw_text string")
    got = {(r.doc_id, r.name): r.value for r in plugins.extract_or_fallback(docs, "invoice", None).collect()}
    assert got == {(1, "invoice_number"): "A-1", (1, "invoice_date"): "2020-03-02", (1, "total_amount"): "12.500", (2, "invoice_number"): None, (2, "invoice_date"): None, (2, "total_amount"): None}


def test_stream_of_documents_to_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"doc_id": 1, "raw_text": "FACTURE N° A-1"}\n{"doc_id": 2, "raw_text": ""}\n{"doc_id": 3, "raw_text": "nothing here"}')
    docs = states.watch_folder(spark, str(tmp_path / "in")).withColumns({"family": F.lit("invoice"), "variant": F.lit(None).cast("string")})
    run = plugins.extract_stream(docs, plugins.default_extractors(2025), str(tmp_path / "out"), states.route_done_error).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out" / "done")).collect()] == [1]
    assert {(r.doc_id, r.error) for r in spark.read.parquet(str(tmp_path / "out" / "error")).collect()} == {(2, "empty"), (3, "no_valid_field")}


def test_nightly_work(spark, sf_dir):
    now = F.lit(dt.datetime(1998, 1, 1))
    job, org, audit = (table(spark, sf_dir, t) for t in ("job", "org", "audit"))
    jobs, trail, orgs = plugins.maintain(job, org, audit.withColumn("created_at", F.lit(dt.datetime(1997, 1, 1))), now)
    assert jobs.count() == job.count() and jobs.filter("purged_at is not null and result_path is not null").count() == 0
    assert trail.filter("not is_anonymized").count() == 0 and orgs.agg(F.max("usage_jobs_this_month")).first()[0] == 0


def test_families_by_zone_and_variants_by_script(spark):
    docs = spark.createDataFrame([(1, "P<UTOX<<Y"), (2, "passport total"), (3, "facture بطاقة تعريف وطنية"), (4, "facture tva two three")], "doc_id long, text string")
    families = {"invoice": ["facture", "total", "tva"], "passport": ["passport", "mrz", "surname"]}
    got = {r.doc_id: (r.family, r.confidence) for r in routing.classify_family(docs, families, zone_family="passport").collect()}
    assert got == {1: ("passport", 0.85), 2: ("invoice", 0.3333), 3: ("invoice", 0.3333), 4: ("invoice", 0.6667)}
    variants = {"ar": (["facture"], ["x"], 0.4), "fr": (["facture"], ["tva"], 0.4)}
    got = {r.doc_id: (r.variant, r.confidence) for r in routing.classify_variant(docs, variants, "g", {"ar": "arabic", "fr": "latin"}).collect()}
    assert got == {1: ("g", 0.0), 2: ("g", 0.0), 3: ("ar", 0.6), 4: ("fr", 1.0)}


def test_types_and_zone_values_at_the_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, "ةقاطب فيرعتلا"), (3, "surname nationality"), (4, "<<id<<<abc")], "doc_id long, raw_text string")
    got = {r.doc_id: (r.document_type, r.confidence) for r in results.detect_document_type(docs).collect()}
    assert got[1] == ("unknown", 0.0) and got[2][0] == "cin_tn" and got[3] == ("id_document", 0.25)
    rows = spark.createDataFrame([("birth_date", "31.02.1990"), ("birth_date", None), ("surname", "محمد"), ("number", "EU 39 4022 "), ("other", "")], "name string, raw string")
    got = [tuple(r.v) for r in rows.select(results.zone_value(F.col("name"), F.col("raw"), F.lit(None).cast("string")).alias("v")).collect()]
    assert got == [(None, False, "invalid_date"), (None, False, "invalid_date"), (None, False, "invalid_latin_name"), ("EU394022", True, None), (None, False, "empty")]
