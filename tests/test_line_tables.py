"""Rows of tables in texts: known layouts, odd texts, numbers."""

import time

import pytest

from fieldloom.operators import line_tables

HEAD = "Facture 7\nCode Désignation Qté TVA PU Total HT\n"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("P1 Vis acier 3 19 10,500 31.500", [("P1", "Vis acier", 3.0, None, 19.0, 10.5, 31.5)]),
        ("P1 Vis acier\nno 5 bleue 3 19 10,500 31.500\nsuite", [("P1", "Vis acier no 5 bleue suite", 3.0, None, 19.0, 10.5, 31.5)]),
        ("P2 Sucre 2 kg 1.5 3,0", [("P2", "Sucre", 2.0, "kg", None, 1.5, 3.0)]),
        ("P2 Sucre 2 kg 7% 1.5 3,0", [("P2", "Sucre", 2.0, "kg", 7.0, 1.5, 3.0)]),
        ("P2 Sucre 1 1 1\nP2 Sucre 1 1 1\nP3 Sel 1 1 1", [("P2", "Sucre", 1.0, None, None, 1.0, 1.0), ("P3", "Sel", 1.0, None, None, 1.0, 1.0)]),
        ("P4 Or fin 2 1.234,50 2,469.00", [("P4", "Or fin", 2.0, None, None, 1234.5, 2469.0)]),
        ("P5 Grand lot 20000 1 20000\nP6 Cher 1 2000000 2000000\nTVA rien 1 2 3", []),
        ("Total 9 9 9\nP3 apres 1 2 3", []),
        ("ABC", []),
    ],
)
def test_rows(body, want):
    assert line_tables.items(HEAD + body) == want


def test_odd_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "P1 without header 1 2 3", "x"), (None, HEAD + "P1 Vis 1 2 2", "x"), (4, HEAD + "P1 Vis 1 2 2", "x"), (4, HEAD + "P1 Vis 1 2 2", "x"), (5, HEAD + "\n".join(f"P{i} Piece {i} 2 {2 * i}" for i in range(1, 3000)), "x")]
    table = spark.createDataFrame(rows, "doc_id long, raw_text string, code string")
    got = line_tables.table_items(table).collect()
    assert sorted((r.doc_id or 0, r.code) for r in got if r.doc_id != 5) == [(0, "P1"), (4, "P1"), (4, "P1")]
    assert [r.line_no for r in got if r.doc_id == 5] == list(range(1, 3000))
    assert line_tables.table_items(table.limit(0)).collect() == []


def test_a_long_row_takes_linear_time():
    """Twenty thousand words that look like codes before a row's numbers, then as many numbers that fit nothing."""
    n = 20_000
    begun = time.time()
    assert line_tables.items(HEAD + "P1 Vis\n" + "MOT\n" * n + "3 2 6") == [("P1", "Vis " + "MOT " * (n - 1) + "MOT", 3.0, None, None, 2.0, 6.0)]
    assert line_tables.items(HEAD + "P1 Vis acier " + "50 1 7 " * n)[0][2:] == (50.0, None, 1.0, 7.0, 50.0)
    assert time.time() - begun < 5
