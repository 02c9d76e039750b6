"""Known answers of single operators."""

from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import datasets, invoices, mrz, scoring
from fieldloom.streaming import metrics


def one(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], list(given))
    return row.select(column.alias("x")).first()["x"]


def test_text_steps(spark):
    cases = [
        (text.clean_ocr_noise, "a ....  b\n\n\n\nc ____ d", "a b\n\nc d"),
        (text.ascii_digits, "٠١٢ ۳۴", "012 34"),
        (text.digits_only, "N° 12-٣", "123"),
        (text.normalize_number, "1.234,50", "1234.50"),
        (text.normalize_number, "1,234.50", "1234.50"),
        (text.normalize_number, "1 234,5", "1234.5"),
        (text.normalize_number, "1,234,567", "1234567"),
        (text.slugify, "  Hello, World! ", "hello-world"),
        (text.reverse_word_order, "a b\nc d", "b a\nd c"),
        (text.arabic_tokens, "abc مرحبا 12 عالم", "مرحبا عالم"),
        (text.digits_from_ocr, "o1b", "018"),
        (text.normalize_french, "«a»  ‘b’", "\"a\" 'b'"),
    ]
    for step, given, want in cases:
        assert one(spark, step(F.col("t")), t=given) == want, step.__name__
    assert one(spark, text.is_arabic(F.col("t")), t="مرحبا a") and not one(spark, text.is_arabic(F.col("t")), t="abc م")
    assert one(spark, text.pseudonym(F.col("t")), t="10.0.0.1").startswith("anon_")
    df = spark.createDataFrame([("  hello.world  ",)], "v string")
    assert text.clean_text(df, "v", ["strip", "uppercase"]).first()["v"] == "HELLO.WORLD"


def test_invoice_dates(spark):
    for given, want in [("03/04/24", "2024-04-03"), ("04/13/2023", "2023-04-13"), ("1.2.99", "1999-02-01"), ("soon", "soon")]:
        assert one(spark, invoices.invoice_date_iso(F.col("t")), t=given) == want


def test_second_pattern_is_less_sure(spark):
    value, confidence = invoices.first_match(F.col("t"), invoices.PATTERNS["invoice_number"])
    assert one(spark, F.struct(value, confidence), t="Invoice no: A-1")[:] == ("A-1", 0.88)


def test_scores_of_two_fields(spark):
    rows = [(1, "a", "x", 0.9, True, False, True, True, 1.0), (1, "b", "y", 0.7, True, False, False, True, 1.0), (2, "a", "x", 0.9, True, False, True, True, 1.0), (2, "b", "", 0.0, False, False, False, True, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, name string, value string, confidence double, validated boolean, review_required boolean, critical boolean, required boolean, weight double")
    got = {r.doc_id: r for r in scoring.document_scores(df).collect()}
    assert (got[1].global_confidence, got[2].global_confidence, got[2].coverage_pct) == (0.8, 0.45, 50.0)
    assert (got[1].status, got[2].status) == ("success", "partial")


def test_passport_specimen(spark):
    lines = spark.createDataFrame([(1, "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"), (2, None, None)], "doc_id long, line1 string, line2 string")
    r, empty = mrz.mrz_parse(lines, F.lit(2025)).orderBy("doc_id").collect()
    assert (r.surname, r.given_names, r.document_number, r.birth_date, r.expiry_date, r.sex, r.valid) == ("ERIKSSON", "ANNA MARIA", "L898902C3", "1974-08-12", "2012-04-15", "F", True)
    assert not empty.valid


def test_boxes(spark):
    df = spark.createDataFrame([(10, 20, 100, 30, 1000, 500)], "x int, y int, w int, h int, width int, height int")
    assert datasets.normalised_box(df).first()["bbox_norm"] == [0.01, 0.04, 0.1, 0.06]


def test_metrics_as_a_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = metrics.metric_windows(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("metric_windows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = metrics.metric_windows(batch, "1 hour")
    assert spark.table("metric_windows").exceptAll(want).isEmpty() and spark.table("metric_windows").count() == want.count()
