"""Dates, amounts, currencies and value clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.text import ascii_digits, once

# Month names as they are written in French, English and Arabic.
MONTHS = {
    1: ["janvier", "january", "جانفي", "يناير"],
    2: ["fevrier", "février", "february", "فيفري", "فبراير"],
    3: ["mars", "march", "مارس"],
    4: ["avril", "april", "أفريل", "افريل", "أبريل"],
    5: ["mai", "may", "ماي", "مايو"],
    6: ["juin", "june", "جوان", "يونيو"],
    7: ["juillet", "july", "جويلية", "يوليو"],
    8: ["aout", "août", "august", "أوت", "اوت", "أغسطس"],
    9: ["septembre", "september", "سبتمبر"],
    10: ["octobre", "october", "أكتوبر", "اكتوبر"],
    11: ["novembre", "november", "نوفمبر"],
    12: ["decembre", "décembre", "december", "ديسمبر"],
}
CURRENCIES = {"TND": ["tnd", "dt", "dinar", "dinars"], "EUR": ["eur", "€", "euro", "euros"], "USD": ["usd", "$", "dollar", "dollars"], "GBP": ["gbp", "£"]}


#: A date in a text, perhaps broken over lines.
DATE_SPAN = r"(?<!\d)(?:\d{1,2}\s*[/.\-]\s*\d{1,2}\s*[/.\-]\s*\d{4}|\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}|\d{1,2}\s+\p{L}{3,12}\s+\d{4})(?!\d)"


def _iso(year: Column, month: Column, day: Column) -> Column:
    """The date as text, null where there is no such day."""
    whole = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.date_format(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))


_DAY_FIRST = r"(?<!\d)(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})(?!\d)"
_YEAR_FIRST = r"(?<!\d)(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})(?!\d)"
_NAMED = r"(?<!\d)(\d{1,2})\s+(\p{L}+)\s+(\d{4})(?!\d)"


def parse_date_any(c: Column) -> Column:
    """Day, month, year in digits, or year first, or with the month's name; null where it is no date. Arabic digits count."""
    return once(F.lower(ascii_digits(c)), _parsed)


def _parsed(c: Column) -> Column:
    # Each pattern runs where it fits only, and once for all three parts of its first match. There is no year 0.
    first = lambda pattern, parts: F.regexp_replace(c, rf"(?s)^.*?{pattern}.*$", parts)
    day = lambda whole: F.when(~whole.startswith("0000"), whole).try_cast("date").cast("string")
    pairs = [x for number, names in MONTHS.items() for name in names for x in (F.lit(name), F.lit(str(number)))]
    month = F.create_map(*pairs)[F.regexp_extract(c, _NAMED, 2)]
    return F.coalesce(
        F.when(c.rlike(_DAY_FIRST), once(first(_DAY_FIRST, "$3-$2-$1"), day)),
        F.when(c.rlike(_YEAR_FIRST), once(first(_YEAR_FIRST, "$1-$2-$3"), day)),
        F.when(c.rlike(_NAMED), once(F.concat(F.regexp_extract(c, _NAMED, 3), F.lit("-"), month, F.lit("-"), F.regexp_extract(c, _NAMED, 1)), day)),
    )


def due_date_iso(c: Column) -> Column:
    """Compact ddMMyy or ddMMyyyy; else null."""
    part = lambda a, n: F.substring(c, a, n).try_cast("int")
    long, short = c.rlike(r"^\d{8}$"), c.rlike(r"^\d{6}$")
    return F.when(long, _iso(part(5, 4), part(3, 2), part(1, 2))).when(short, _iso(part(5, 2) + 2000, part(3, 2), part(1, 2)))


def currency_code(c: Column) -> Column:
    low, found = F.lower(F.trim(c)), F.lit(None).cast("string")
    for code, names in reversed(CURRENCIES.items()):
        found = F.when(low.isin(*names), code).otherwise(found)
    return found


def normalize_capital(c: Column) -> Column:
    """The longest number of a text with three decimals; null where it is not above zero."""
    numbers = F.regexp_extract_all(F.regexp_replace(ascii_digits(c), r"(?<=\d)[ .](?=\d{3}(?!\d))", ""), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    best = F.get(F.transform(F.reverse(F.array_sort(F.transform(numbers, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))), lambda s: s["x"]), 0)
    value = F.replace(best, F.lit(","), F.lit(".")).try_cast("decimal(18,3)")
    return F.when(value > 0, value)


def clean_value(c: Column) -> Column:
    """Cut at addresses and page marks, then trim punctuation."""
    cut = F.split(c, r"(?i)https?://|www\.|\bpage\s+\d+", 2)[0]
    return F.regexp_replace(cut, r"^[\s:;,.|_/\-]+|[\s:;,.|_/\-]+$", "")


def is_noisy_value(c: Column, longest: int = 120) -> Column:
    return (F.length(c) > longest) | c.rlike(r"(?i)https?://|www\.|\bpage\s+\d+") | c.rlike(r"^[\d\s]+$")


def is_placeholder(c: Column) -> Column:
    """Field names echoed as values: ``CIN_NAME`` and the like, or capitals joined by underscores."""
    return F.trim(c).rlike(r"^[A-Z]+(_[A-Z]+)+$")


def text_variants(c: Column) -> Column:
    """The text, and the text with each Arabic word reversed; once where both are equal."""
    turned = F.array_join(F.transform(F.split(c, " "), lambda w: F.when(w.rlike(r"[؀-ۿ]"), F.reverse(w)).otherwise(w)), " ")
    return F.array_distinct(F.array(c, turned))


def clean_words(c: Column) -> Column:
    """Words without edge punctuation, repeated letters folded to one, empty ones gone."""
    folded = F.regexp_replace(F.lower(c), r"(\p{L})\1+", "$1")
    return F.filter(F.transform(F.split(folded, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\d]+|[^\p{L}\d]+$", "")), lambda w: w != "")
