"""Machine-readable zones of passports (two lines of 44 characters) by position, with check digits in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import once

# Fixed values of the standard: weights of the check digits, and places (from 1) and lengths in the second line.
WEIGHTS = [7, 3, 1]
_DIGITS, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLACES = {"document_number": (1, 9), "birth_date": (14, 6), "expiry_date": (22, 6), "personal_number": (29, 14)}


def check_digit(c: Column) -> Column:
    """Sum of character values by weights 7, 3, 1, modulo 10. Digits count themselves, letters 10 to 35, the filler 0."""
    # All modulo 10, so a value is one digit, and so is its product with a weight. Each weight's signs are every third one.
    values = F.regexp_replace(F.translate(c, _LETTERS, "".join(str(k % 10) for k in range(len(_LETTERS)))), "[^0-9]", "0")
    third = lambda v, i: F.regexp_replace(F.substring(v, F.lit(i + 1), F.length(v)), "(.).{0,2}", "$1")
    weighted = lambda v: F.concat(*(F.translate(third(v, i), _DIGITS, "".join(str(k * w % 10) for k in range(10))) for i, w in enumerate(WEIGHTS)))
    # The sum of digits by their bits: how many have the bit, times its worth.
    having = lambda d, bit: F.length(F.translate(d, "".join(k for k in _DIGITS if not int(k) >> bit & 1), ""))
    return once(once(values, weighted), lambda d: having(d, 0) + 2 * having(d, 1) + 4 * having(d, 2) + 8 * having(d, 3)) % 10


def mrz_date(c: Column, as_of_year: Column, birth: bool) -> Column:
    """Births after the present year are of the last century; expiries below 80 are of this one."""
    yy = F.substring(c, 1, 2).try_cast("int")
    past = yy > as_of_year % 100 if birth else yy >= 80
    year = F.when(past, 1900 + yy).otherwise(2000 + yy)
    return F.to_date(F.try_to_timestamp(F.concat(year.cast("string"), F.substring(c, 3, 4)), F.lit("yyyyMMdd")))


def mrz_parse(lines: DataFrame, as_of_year: Column) -> DataFrame:
    """From doc_id, line1, line2: names, fields, the checks and whether all hold."""
    take = lambda name: F.substring("line2", *PLACES[name])
    holds = lambda name: check_digit(take(name)) == F.substring("line2", sum(PLACES[name]), 1).try_cast("int")
    whole = F.concat(F.substring("line2", 1, 10), F.substring("line2", 14, 7), F.substring("line2", 22, 22))
    names = F.split(F.regexp_replace(F.substring("line1", 6, 39), "<+$", ""), "<<")
    text = lambda c: F.trim(F.translate(c, "<", " "))
    checks = {n: F.coalesce(holds(n), F.lit(False)) for n in ("document_number", "birth_date", "expiry_date")}
    final = F.coalesce(check_digit(whole) == F.substring("line2", 44, 1).try_cast("int"), F.lit(False))
    return lines.select(
        "doc_id",
        text(F.get(names, 0)).alias("surname"),
        text(F.coalesce(F.get(names, 1), F.lit(""))).alias("given_names"),
        text(take("document_number")).alias("document_number"),
        text(F.substring("line2", 11, 3)).alias("nationality"),
        mrz_date(take("birth_date"), as_of_year, True).cast("string").alias("birth_date"),
        mrz_date(take("expiry_date"), as_of_year, False).cast("string").alias("expiry_date"),
        F.nullif(F.substring("line2", 21, 1), F.lit("<")).alias("sex"),
        *[c.alias(f"{n}_ok") for n, c in checks.items()],
        (checks["document_number"] & checks["birth_date"] & checks["expiry_date"] & final).alias("valid"),
    )
