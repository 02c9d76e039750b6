"""Invoice fields from whole texts: patterns unrolled as literals into one projection, amounts as decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import decimal_point, number_characters, with_computed

AMOUNT = "decimal(18,3)"
TOLERANCE = 0.010
# Field, patterns in order of preference.
PATTERNS = {
    "invoice_number": [r"(?i)facture\s*n[°o]?\s*:?\s*([A-Z0-9][A-Z0-9/-]+)", r"(?i)invoice\s*(?:no|number)\.?\s*:?\s*([A-Z0-9][A-Z0-9/-]+)"],
    "invoice_date": [r"(?i)(?<!due )date\s*:?\s*(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})"],
    "customer": [r"(?i)client\s*:\s*([^\n]+)", r"(?i)customer\s*:\s*([^\n]+)"],
    "total_ht": [r"(?i)total\s*h\.?t\.?\s*:?\s*([0-9][0-9 .,]*)"],
    "vat": [r"(?i)tva[^:\n]*:\s*([0-9][0-9 .,]*)"],
    "total_ttc": [r"(?i)total\s*t\.?t\.?c\.?\s*:?\s*([0-9][0-9 .,]*)"],
}


def first_match(text: Column, patterns: list[str], group: int = 1) -> tuple[Column, Column]:
    """The first pattern's match, and its confidence: 0.95 less 0.07 for each pattern before it, 0.5 at least."""
    found = [F.nullif(F.trim(F.regexp_extract(text, p, group)), F.lit("")) for p in patterns]
    confidence = F.coalesce(*[F.when(m.isNotNull(), round(max(0.95 - 0.07 * i, 0.5), 2)) for i, m in enumerate(found)])
    return F.coalesce(*found), confidence


def invoice_date_iso(c: Column) -> Column:
    """Day first, but month first where the second part is above 12; years of two digits turn at 50; else as it stands."""
    part = lambda k: F.regexp_extract(c, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$", k).try_cast("int")
    a, b, y = part(1), part(2), part(3)
    year = F.when(y >= 100, y).when(y > 50, 1900 + y).otherwise(2000 + y)
    day, month = F.when(b > 12, b).otherwise(a), F.when(b > 12, a).otherwise(b)
    return F.coalesce(F.when(c.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$"), F.format_string("%04d-%02d-%02d", year, month, day)), c)


def invoice_fields(doc: DataFrame) -> DataFrame:
    """Long table: doc_id, name, value, confidence. Each pattern runs once a row."""
    found = {n: first_match(F.col("raw_text"), patterns) for n, patterns in PATTERNS.items()}
    amounts = ("total_ht", "vat", "total_ttc")
    rows = with_computed(doc.select("doc_id", "raw_text"), **{f"m_{n}": number_characters(v) if n in amounts else v for n, (v, _) in found.items()}, **{f"c_{n}": c for n, (_, c) in found.items()}).drop("raw_text")
    rows = with_computed(rows, **{f"a_{n}": decimal_point(F.col(f"m_{n}")).try_cast(AMOUNT).cast("string") for n in amounts})
    value = lambda n: F.col(f"a_{n}") if n in amounts else invoice_date_iso(F.col(f"m_{n}")) if n == "invoice_date" else F.col(f"m_{n}")
    return rows.select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), value(n).alias("value"), F.col(f"c_{n}").alias("confidence")) for n in PATTERNS])))


def invoice_results(doc: DataFrame) -> DataFrame:
    """One row per invoice: header, amounts, and whether net and tax add up to the gross, but for a stamp of at most 5.

    Each pattern runs once a row: matches, their number characters and the amounts are computed in steps of their own."""
    value = lambda name: first_match(F.col("raw_text"), PATTERNS[name])[0]
    amounts = ("total_ht", "vat", "total_ttc")
    rows = with_computed(doc.select("doc_id", "raw_text"), number=value("invoice_number"), date=value("invoice_date"), customer=value("customer"), **{n: number_characters(value(n)) for n in amounts})
    rows = with_computed(rows.drop("raw_text"), **{f"{n}_amount": decimal_point(F.col(n)).try_cast(AMOUNT) for n in amounts})
    rows = rows.select("doc_id", "number", "date", "customer", *[F.col(f"{n}_amount").alias(n) for n in amounts])
    gross_less_net = F.col("total_ttc") - F.col("total_ht") - F.col("vat")
    stamp = F.when(gross_less_net.between(0, 5), gross_less_net)
    gap = F.abs(F.coalesce(stamp, F.lit(0)) - gross_less_net)
    return rows.select(
        "doc_id", F.col("number").alias("invoice_number"), invoice_date_iso(F.col("date")).alias("invoice_date"), "customer",
        *[F.col(n).cast("double").alias(n) for n in amounts], stamp.cast("double").alias("stamp"), F.coalesce(gap <= TOLERANCE, F.lit(False)).alias("consistent"),
    )
