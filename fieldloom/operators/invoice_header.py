"""An invoice's header as one consistent whole: parties, tax numbers, dates, period, currency and totals.

All labels of a text are found once, by their places; each gives a candidate from what stands between it and the next label. Values are then
chosen together: of all combinations of dates the one with most values in which no due date lies before the invoice and no period ends before it
begins or begins after the invoice; of all combinations of totals the one where net and tax make the gross. A tax number belongs to the party
whose label stood before it, and counts only if it is well formed.

Defined results: one row per row of the input; null texts are empty and give nulls; equal combinations go to the values that stand first;
repeated and null doc_ids keep their own rows. A text's labels of dates and totals are few, as are the combinations; each is tried.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.dates import CURRENCIES, DATE_SPAN, parse_date_any
from fieldloom.functions.text import decimal_point, number_characters, once, pieces, spelt_tree, with_computed

# Words of the labels by field; shape of a tax number; the rounding that totals may differ by.
LABELS = {
    "invoice_number": ["facture n°", "facture no", "facture numero", "invoice no", "n° facture"],
    "due_date": ["date d'echeance", "echeance", "date limite de paiement", "due date"],
    "invoice_date": ["date de facture", "date facture", "date d'emission", "invoice date", "date"],
    "period": ["periode", "period"],
    "supplier": ["fournisseur", "supplier", "emetteur"],
    "customer": ["client", "customer", "facture a"],
    "tax_id": ["matricule fiscal", "mf", "identifiant fiscal", "tax id"],
    "currency": ["devise", "currency"],
    "total_ht": ["total ht", "montant ht"],
    "vat": ["total tva", "montant tva", "tva"],
    "total_ttc": ["total ttc", "montant ttc", "net a payer"],
}
TAX_ID, ROUNDING = r"(?<![\w])(\d{7}\s*/?\s*[A-Z](?:\s*/\s*[A-Z]){0,2}(?:\s*/\s*\d{3})?)(?![\w])", 0.01

_WORDS = spelt_tree([w for words in LABELS.values() for w in words])
#: At the begin of a line, or before a mark; so a label's word inside a value is none.
_LABEL = rf"(?imU)^[ \t]*{_WORDS}(?!\p{{L}})|(?<!\p{{L}})(?=\p{{L}}){_WORDS}(?=\s*[:°])"
#: Letters as labels are compared, with what else a pattern takes for them in any case; blanks go.
_ODD = {"é": "e", "è": "e", "ê": "e", "à": "a", "â": "a", "É": "e", "È": "e", "Ê": "e", "À": "a", "Â": "a", "’": "'", "°": "o", "İ": "i", "ı": "i", "ſ": "s"}
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_FROM, _TO = "".join(_ODD) + string.ascii_uppercase + _BLANKS, "".join(_ODD.values()) + string.ascii_lowercase
_PLAIN = str.maketrans(_FROM[: len(_TO)], _TO, _BLANKS)
_FIELD_OF = {w.translate(_PLAIN): name for name, words in reversed(LABELS.items()) for w in words}
_SOME = lambda c: F.nullif(F.trim(c), F.lit(""))
_DATES = "struct<a:string,b:string>"


def _field(label: Column) -> Column:
    """The field that a label names, however it is spelt."""
    return F.create_map(*[F.lit(x) for pair in _FIELD_OF.items() for x in pair])[F.translate(label, _FROM, _TO)]


def _of(name: str, value: Callable[[Column], Column]) -> Column:
    """Values of a field's parts, in order."""
    return F.filter(F.transform(F.filter("parts", lambda x: x["name"] == name), value), lambda v: v.isNotNull())


def _line(rest: Column) -> Column:
    return _SOME(F.regexp_extract(rest, r"^[\s:.\-]*([^\n]*?)[\s:;,.\-]*(?:\n|$)", 1))


def _amount(rest: Column) -> Column:
    """The last amount of the line: rates stand before it."""
    found = F.regexp_extract_all(F.regexp_extract(rest, r"^[^\n]*", 0), F.lit(r"\d[\d .,]*\d(?!\s*%)|\d(?![\d\s]*%)"), F.lit(0))
    return once(number_characters(F.try_element_at(found, F.lit(-1))), lambda n: decimal_point(n).try_cast("double"))


def _dates(rest: Column) -> Column:
    found = F.regexp_extract_all(rest, F.lit(rf"(?=\d){DATE_SPAN}"), F.lit(0))
    return F.filter(F.transform(found, _day), lambda d: d.isNotNull())


def _day(d: Column) -> Column:
    """As ``parse_date_any``, which dates as they mostly stand don't need."""
    whole = F.concat(F.substring(d, 7, 4), F.lit("-"), F.substring(d, 4, 2), F.lit("-"), F.substring(d, 1, 2))
    return F.when(d.rlike(r"^\d\d/\d\d/(?!0000)\d{4}$"), whole.try_cast("date").cast("string")).otherwise(parse_date_any(d))


def _indexed(values: Column, kind: str) -> Column:
    """The values with their places, and none at all."""
    some = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.concat(some, F.array(F.struct(F.lit(None).cast(kind).alias("v"), F.lit(1000).alias("i"))))


def _combined(a: str, b: str, c: str, make: Callable[[Column, Column, Column], Column]) -> Column:
    return F.flatten(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.transform(c, lambda z: make(x, y, z))))))


def header_parts(doc: DataFrame, text: str = "raw_text") -> DataFrame:
    """doc_id, body, parts: each label's field, and the text up to the next label."""
    rows = with_computed(doc.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("body")), cut=pieces(F.col("body"), _LABEL))
    # Every second piece is a label, and the piece behind it stands up to the next one.
    part = lambda x, i: F.when(i % 2 == 1, F.struct(_field(x).alias("name"), F.get("cut", i + 1).alias("rest")))
    return with_computed(rows, parts=F.filter(F.transform("cut", part), lambda x: x.isNotNull())).drop("cut")


def _read(x: Column) -> Column:
    """A part's field and what its text is read as: dates, an amount, a line, a number's characters, a tax number."""
    read = lambda names, value: F.when(x["name"].isin(*names), value(x["rest"]))
    return F.struct(
        x["name"].alias("name"),
        read(["invoice_date", "due_date", "period"], _dates).alias("dates"),
        read(["total_ht", "vat", "total_ttc"], _amount).alias("amount"),
        read(["supplier", "customer", "currency"], _line).alias("line"),
        read(["invoice_number"], lambda r: _SOME(F.regexp_extract(r, r"^[\s:.\-]*([A-Z0-9][A-Z0-9/\-]*)", 1))).alias("number"),
        read(["tax_id"], lambda r: _SOME(F.regexp_replace(F.regexp_extract(r, TAX_ID, 1), r"\s", ""))).alias("tax_id"),
    )


def invoice_header(doc: DataFrame, text: str = "raw_text") -> DataFrame:
    """doc_id, supplier, supplier_tax_id, customer, customer_tax_id, invoice_number, invoice_date, due_date, period_start, period_end, currency,
    total_ht, vat, total_ttc, consistent."""
    rows = header_parts(doc, text)
    rows = with_computed(rows, read=F.transform("parts", _read)).drop("parts").withColumnRenamed("read", "parts")
    day = lambda x: F.get(x["dates"], 0)
    pair = lambda x: F.when(F.size(x["dates"]) >= 2, F.struct(F.get(x["dates"], 0).alias("a"), F.get(x["dates"], 1).alias("b")))
    amount, line = (lambda x: x["amount"]), (lambda x: x["line"])
    # Of each tax number the party named last before it.
    party = lambda i: F.element_at(F.concat(F.array(F.lit("supplier")), F.filter(F.transform(F.slice("parts", 1, i), lambda x: x["name"]), lambda n: n.isin("supplier", "customer"))), -1)
    numbers = F.filter(F.transform("parts", lambda x, i: F.when(x["name"] == "tax_id", F.struct(party(i).alias("party"), x["tax_id"].alias("id")))), lambda x: x["id"].isNotNull())
    first = lambda name, read: F.get(_of(name, read), 0)
    word = F.regexp_replace(F.coalesce(first("currency", line), F.regexp_extract("body", rf"(?i)\d\s*({'|'.join(w for words in CURRENCIES.values() for w in words if w.isalpha())}|€|£|\$)(?!\p{{L}})", 1)), r"[^\p{L}$€£]", "")
    rows = with_computed(
        rows,
        dates=_indexed(_of("invoice_date", day), "string"),
        dues=_indexed(_of("due_date", day), "string"),
        periods=_indexed(_of("period", pair), _DATES),
        nets=_indexed(_of("total_ht", amount), "double"),
        taxes=_indexed(_of("vat", amount), "double"),
        grosses=_indexed(_of("total_ttc", amount), "double"),
        numbers=numbers,
        supplier=first("supplier", line),
        customer=first("customer", line),
        number=first("invoice_number", lambda x: x["number"]),
        word=F.lower(word),
    ).drop("body", "parts")

    def times(d: Column, e: Column, p: Column) -> Column:
        day, due, begin, end = d["v"], e["v"], p["v"]["a"], p["v"]["b"]
        wrong = F.coalesce(due < day, F.lit(False)) | F.coalesce(end < begin, F.lit(False)) | F.coalesce(begin > day, F.lit(False))
        here = lambda c: F.when(c.isNotNull(), -1).otherwise(0)
        return F.struct(F.when(wrong, 1).otherwise(0).alias("wrong"), (2 * here(day) + here(due) + here(begin)).alias("few"), (d["i"] + e["i"] + p["i"]).alias("i"), day.alias("day"), due.alias("due"), begin.alias("begin"), end.alias("end"))

    def totals(n: Column, t: Column, g: Column) -> Column:
        right = F.abs(n["v"] + t["v"] - g["v"]) <= ROUNDING
        here = lambda c: F.when(c.isNotNull(), -1).otherwise(0)
        return F.struct(F.when(right, 0).otherwise(1).alias("wrong"), (here(n["v"]) + here(t["v"]) + here(g["v"])).alias("few"), (n["i"] + t["i"] + g["i"]).alias("i"), n["v"].alias("net"), t["v"].alias("tax"), g["v"].alias("gross"))

    # The first values have the least places and none is missing that is there: where they are consistent, no combination comes before them.
    first_of = lambda make, *lists: make(*[F.get(c, 0) for c in lists])
    rows = rows.withColumns({"t": first_of(times, "dates", "dues", "periods"), "s": first_of(totals, "nets", "taxes", "grosses")})
    searched = lambda first, make, *lists: F.when(first["wrong"] == 0, first).otherwise(F.array_min(_combined(*lists, make)))
    rows = rows.withColumns({"t": searched(F.col("t"), times, "dates", "dues", "periods"), "s": searched(F.col("s"), totals, "nets", "taxes", "grosses")})
    tax = lambda who: F.get(F.filter("numbers", lambda x: x["party"] == who), 0)["id"]
    return rows.select(
        "doc_id", "supplier", tax("supplier").alias("supplier_tax_id"), "customer", tax("customer").alias("customer_tax_id"), F.col("number").alias("invoice_number"),
        F.col("t.day").alias("invoice_date"), F.col("t.due").alias("due_date"), F.col("t.begin").alias("period_start"), F.col("t.end").alias("period_end"), _currency(F.col("word")).alias("currency"),
        F.col("s.net").alias("total_ht"), F.col("s.tax").alias("vat"), F.col("s.gross").alias("total_ttc"), (F.col("s.wrong") == 0).alias("consistent"),
    )


def _currency(low: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, words in reversed(CURRENCIES.items()):
        out = F.when(low.isin(*words), code).otherwise(out)
    return out
