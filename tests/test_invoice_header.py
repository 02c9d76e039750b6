"""Invoice headers: values that contradict each other, odd rows."""

from fieldloom.operators.invoice_header import invoice_header


def test_values_are_chosen_together(spark):
    rows = [
        (1, "Date : 10/03/2020  Echéance : 01/03/2020\nDate limite de paiement : 09/04/2020", "x"),  # the first due date lies before the invoice
        (2, "Date : 10/03/2020\nPériode : du 01/05/2020 au 31/05/2020", "x"),  # a period that begins after the invoice
        (3, "Total HT : 10,000\nTotal HT : 100,000\nTVA 19% : 19,000\nTotal TTC : 119,000 DT", "x"),
        (4, "Total HT : 10,000\nTVA : 5\nTotal TTC : 119,000 €", "x"),  # nothing fits: the first of each
        (5, "MF : 12\nMF : 1234567 A / B / M / 001\nClient: Client Date\nMF: 7654321Z", "x"),
        (6, None, "x"), (6, "", "x"), (None, "Facture N° : A-1\nDevise : dollars", "x"),
    ]
    got = [(r.doc_id, r) for r in invoice_header(spark.createDataFrame(rows, "doc_id long, raw_text string, parts string")).collect()]
    by = dict(got)
    assert len(got) == 8 and sum(d == 6 for d, _ in got) == 2
    assert (by[1].invoice_date, by[1].due_date) == ("2020-03-10", "2020-04-09")
    assert (by[2].invoice_date, by[2].period_start, by[2].period_end) == ("2020-03-10", None, None)
    assert (by[3].total_ht, by[3].vat, by[3].total_ttc, by[3].consistent, by[3].currency) == (100.0, 19.0, 119.0, True, "TND")
    assert (by[4].total_ht, by[4].consistent, by[4].currency) == (10.0, False, "EUR")
    assert (by[5].supplier_tax_id, by[5].customer, by[5].customer_tax_id) == ("1234567A/B/M/001", "Client Date", "7654321Z")
    assert (by[None].invoice_number, by[None].currency) == ("A-1", "USD")
    assert {c: v for c, v in by[6].asDict().items() if v is not None} == {"doc_id": 6, "consistent": False}


def test_labels_however_they_are_spelt(spark):
    """Behind a tab too, in capitals, and with the letters that count as others in another case."""
    rows = [(1, "\tDate : 10/03/2020\n\t DATE D’ÉCHÉANCE : 9/4/2020"), (2, "fournıſſeur : Maison\nDate facture : 0000-01-02"), (3, "Total\tHT : 10,000\nDate: 10/03/0000\nEchéance : 31/02/2020 1 mars 2020")]
    by = {r.doc_id: r for r in invoice_header(spark.createDataFrame(rows, "doc_id long, raw_text string")).collect()}
    assert (by[1].invoice_date, by[1].due_date) == ("2020-03-10", "2020-04-09")
    assert (by[2].supplier, by[2].invoice_date) == ("Maison", None)
    assert (by[3].total_ht, by[3].invoice_date, by[3].due_date) == (10.0, None, "2020-03-01")


def test_values_are_searched_where_the_first_do_not_fit(spark):
    rows = [(1, "Date : 10/03/2020\nEchéance : 01/03/2020\nEchéance : 11/03/2020\nEchéance : 12/03/2020"), (2, "Total HT : 1\nTotal HT : 2\nTVA : 3\nTVA : 4\nTotal TTC : 6"), (3, "Total HT : 1\nTotal HT : 2\nTVA : 3"), (4, "Date : 10/03/2020\nPériode : 01/02/2020 01/01/2020\nPériode : 01/01/2020 01/02/2020")]
    by = {r.doc_id: r for r in invoice_header(spark.createDataFrame(rows, "doc_id long, raw_text string")).collect()}
    assert by[1].due_date == "2020-03-11"
    assert [(by[i].total_ht, by[i].vat, by[i].total_ttc, by[i].consistent) for i in (2, 3)] == [(2.0, 4.0, 6.0, True), (1.0, 3.0, None, False)]
    assert (by[4].period_start, by[4].period_end) == ("2020-01-01", "2020-02-01")
