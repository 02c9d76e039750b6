"""Values near labels: pages of any size, odd boxes, ties."""

import math
import random
import time

from pyspark.sql import functions as F

from fieldloom.functions.dates import parse_date_any
from fieldloom.operators import boxes, spatial
from fieldloom.operators.spatial import Wanted

BOX = "doc_id long, idx long, text string, confidence double, x1 double, y1 double, x2 double, y2 double, kind string"
NAME = Wanted("name", ("Nom",), lambda t: F.when(t.rlike("^[A-Z][a-z]+$"), t))
DAY = Wanted("day", ("Date",), parse_date_any, joined=True)


def test_near_is_all_pairs(spark):
    r = random.Random(3)
    places = [(d, i, r.uniform(-900, 900), r.uniform(-900, 900)) for d in (1, 2) for i in range(150)]
    rows = spark.createDataFrame(places, "doc_id long, i long, cx double, cy double")
    labels, others = (rows.filter(f).select("doc_id", F.struct("i", "cx", "cy").alias(n)) for f, n in (("i < 30", "a"), ("i >= 20", "b")))
    got = {(x.doc_id, x.a.i, x.b.i) for x in boxes.near(labels, others, 200.0).collect()}
    want = {(d, i, j) for d, i, x, y in places for e, j, u, v in places if d == e and i < 30 and j >= 20 and math.hypot(x - u, y - v) <= 200}
    assert got == want


def test_ways_of_finding_a_value(spark):
    rows = [
        (1, 1, "Nom: Amel", 1.0, 0.0, 0.0, 50.0, 10.0),  # inside the label's box
        (2, 1, "Nom", 1.0, 0.0, 0.0, 50.0, 10.0), (2, 2, "Karim", 1.0, 60.0, 0.0, 90.0, 10.0), (2, 3, "Salma", 1.0, 0.0, 20.0, 50.0, 30.0),  # row before below
        (3, 1, "Nom", 1.0, 0.0, 50.0, 50.0, 60.0), (3, 2, "Leila", 1.0, 0.0, 34.0, 50.0, 44.0),  # above
        (4, 1, "Nom", 1.0, 0.0, 0.0, 50.0, 10.0), (4, 2, "Tarek", 1.0, 1000.0, 0.0, 1050.0, 10.0),  # out of reach
        (5, 1, "Date", 1.0, 0.0, 0.0, 40.0, 10.0), (5, 2, "12/03", 1.0, 50.0, 0.0, 90.0, 10.0), (5, 3, "/1999", 1.0, 92.0, 0.0, 120.0, 10.0), (5, 4, "01/01/2001", 1.0, 50.0, 60.0, 90.0, 70.0),
        (6, 1, None, 1.0, 0.0, 0.0, 40.0, 10.0), (6, 2, "Nom", None, 0.0, 0.0, 0.0, 10.0), (6, 3, " ", 1.0, 0.0, 0.0, 9.0, 9.0), (6, 4, "Nom", None, 0.0, 40.0, 30.0, 50.0), (6, 5, "Hedi", None, 40.0, 40.0, 70.0, 50.0), (6, 5, "Hedi", None, 40.0, 40.0, 70.0, 50.0),
        (None, 1, "Nom Zied", 1.0, 0.0, 0.0, 50.0, 10.0),
    ]
    table = spark.createDataFrame([(*x, "k") for x in rows], BOX)
    got = {(r.doc_id, r.name): (r.value, r.how) for r in spatial.label_fields(table, [NAME, DAY], 200.0).collect()}
    assert got == {(1, "name"): ("Amel", "inline"), (2, "name"): ("Karim", "merged"), (3, "name"): ("Leila", "beside"), (5, "day"): ("2001-01-01", "right"), (6, "name"): ("Hedi", "merged"), (None, "name"): ("Zied", "inline")}
    assert spatial.spatial_fields(table.limit(0)).collect() == []


def test_a_page_of_many_boxes_takes_linear_time(spark):
    """A hundred thousand boxes on one page, a thousandth of them labels: each label meets the boxes around it."""
    n = 100_000
    page = spark.range(n).selectExpr("1L as doc_id", "id as idx", "if(id % 1000 = 7, 'Nom', if(id % 1000 = 8, 'Amel', 'x1')) as text", "0.5D as confidence", "double(id % 100 * 100) as x1", "double(id div 100 * 30) as y1", "double(id % 100 * 100 + 60) as x2", "double(id div 100 * 30 + 10) as y2", "'k' as kind")
    begun = time.time()
    found = spatial.candidates(page, [NAME], 200.0)
    assert found.count() == 2 * n // 1000  # each name as it is and merged with its label
    assert [tuple(r)[1:3] for r in spatial.best_values(found).collect()] == [("name", "Amel")]
    assert time.time() - begun < 60


def test_short_and_long_pages_are_read_alike(spark, monkeypatch):
    """Labels meet boxes in their page's row or on the grid: with copies of labels, null numbers and without a doc_id."""
    r = random.Random(5)
    words = ["Nom", "Nom Amel", "Date", "Date 1/2/1990", "Karim", "emis 3/4/1999", "12/03/1999", "x1", " "]
    rows = [(d, r.choice([i, None]), r.choice(words), r.choice([0.5, None]), x := r.uniform(0, 400.0), y := r.uniform(0, 200.0), x + 30, y + 12, "k") for d in (1, 2, 3, None) for i in range(20)]
    table = spark.createDataFrame(rows + rows[::3], BOX)
    found = {}
    for few in (0, 64):
        monkeypatch.setattr(spatial, "FEW", few)
        found[few] = {tuple(x) for x in spatial.candidates(table, [NAME, DAY], 150.0, "^emis").collect()}
    assert found[0] == found[64] and {x[4] for x in found[0]} == set(spatial.HOW)
    assert {x[4] for x in found[0] if x[0] is None} <= {"inline", "line", "around", "right"}
