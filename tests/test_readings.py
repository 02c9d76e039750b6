"""Readings of one card fused: swaps, equal names, ties, odd values."""

from fieldloom.operators import readings

SCHEMA = "doc_id long, field string, value string, source string, engine string, confidence double, score string"
KINDS = {"spatial": "boxes", "zone": "boxes", "text": "text"}


def fused(spark, rows):
    table = spark.createDataFrame([(*r, "x", 0.5, "s") for r in rows], SCHEMA)
    return {(r.doc_id, r.name): (r.value, r.n) for r in readings.fuse(table, {"spatial": 3.0}, KINDS).collect()}


def test_swaps_equal_names_and_near_readings(spark):
    family, first = "family_name", "first_name"
    rows = [(1, family, "Ben Salem", "text"), (1, family, "BEN SALAM", "zone"), (1, family, "Mariam", "spatial"), (1, first, "mariam", "text"), (1, first, "MARIEM", "zone"), (1, first, "Ben Salem", "spatial")]
    rows += [(2, family, "Mansour", "text"), (2, family, "Mansour", "text"), (2, first, "Mansour", "text"), (2, first, "Mansour", "text"), (2, first, "Hedi", "zone")]  # the same name leads both lists
    rows += [(3, family, "Gharbi", "text"), (3, first, "Gharbi", "text"), (3, first, "Gharbi", "text")]  # no pair differs
    rows += [(4, family, "Gharbi", "text"), (4, first, "Gharbi", "text"), (4, "date_of_birth", "31/02/1990", "text"), (4, "cin_number", "12", "text"), (4, "other", "x", "text")]
    rows += [(5, family, None, "text"), (5, family, "A1B", "text"), (5, first, "", "text"), (5, "date_of_birth", "03/04/1990", "zone"), (5, "cin_number", "N 12345678", "zone"), (5, "place_of_birth", "  Tunis ", "zone"), (5, "place_of_birth", "Sfax", "zone")]
    rows += [(None, family, "Zaidi", "text"), (None, first, "Amel", "text")]
    got = fused(spark, rows)
    assert got[1, family] == ("BEN SALAM", 2) or got[1, family] == ("BEN SALEM", 2)
    assert got[1, first][0].startswith("MARI") and got[1, first][1] == 2
    assert (got[2, family], got[2, first]) == (("MANSOUR", 2), ("HEDI", 1))
    assert (3, family) not in got and got[3, first] == ("GHARBI", 2)
    assert got[4, family] == ("GHARBI", 1) and len([k for k in got if k[0] == 4]) == 1
    assert {k[1]: v[0] for k, v in got.items() if k[0] == 5} == {"date_of_birth": "1990-04-03", "cin_number": "12345678", "place_of_birth": "Sfax"}
    assert got[None, family] == ("ZAIDI", 1) and got[None, first] == ("AMEL", 1)
    assert fused(spark, [(1, "other", "x", "text")]) == {}


def test_readings_are_shuffled_by_document_once(spark):
    rows = [(d, f, v, s, "x", c, "s") for d in (1, 2) for f in ("family_name", "first_name", "place_of_birth") for v, s, c in (("Amel", "text", 0.5), ("Amal", "zone", None), ("Karim", "other", 0.25))]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = readings.fuse(spark.createDataFrame(rows, SCHEMA), {"zone": 1.5}, KINDS)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange ") == 2 and "Join" not in plan
    # The two near readings of a name count together; their confidences are added before they are shared out. The pair read by one kind gains.
    assert got >= {(d, "place_of_birth", "Amal", 8.5, 1) for d in (1, 2)}
    assert {r[1:] for r in got if r[1] != "place_of_birth"} == {("family_name", "AMAL", 15.75, 2), ("first_name", "KARIM", 7.25, 1)}
