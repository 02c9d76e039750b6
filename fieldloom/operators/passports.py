"""Passport zones in raw texts: found, repaired, chosen, and turned into fields. Two lines of 44 characters.

Everything is per document, so nothing is shuffled: a text's lines and words are arrays, its possible zones one more array; only the
choice between zones groups rows, by doc_id. Texts are null or whole; a text without a zone has null lines and no valid field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import spelt, with_computed
from fieldloom.operators.mrz import check_digit, mrz_date

WIDTH = 44
# Signs that recognition gives for the filler, digits read for letters and letters for digits, places (from 1, with lengths) of
# the second line, those of its digits, countries' first letters of numbers that are misread, scores of a parsed zone, weights of fields.
FILLERS = "«»‹›≤≥>＜_"
LETTER_OF, DIGIT_OF = ("012458", "OIZASB"), ("OQDIL|ZSB", "000111258")
NUMBER, COUNTRY, BIRTH, SEX, EXPIRY, PERSONAL = (1, 9), (11, 3), (14, 6), (21, 1), (22, 6), (29, 14)
DIGIT_RUNS = [(10, 1), (14, 7), (22, 7), (43, 2)]
MISREAD = {"TUN": ("408WYR", "WRY")}
POINTS = {"document_number": 6, "surname": 6, "given_names": 4, "issuing_country": 3, "nationality": 3, "birth_date": 5, "expiry_date": 5, "gender": 2}
WEIGHTS = {"mrz": 12.0, "document_number": 10.0, "surname": 8.0, "given_names": 6.0, "nationality": 6.0, "birth_date": 7.0, "expiry_date": 7.0, "gender": 4.0, "issuing_country": 4.0, "personal_number": 2.0}
REQUIRED = ["document_number", "surname", "birth_date", "expiry_date", "nationality"]
NUMBER_WORDS = ["passport no", "passport n°", "pasaport numarası", "pasaport numarasi", "document no"]
NUMBER_LABEL = rf"(?i)(?:{spelt(NUMBER_WORDS)})\s*[:#]?\s*([A-Z0-9]{{6,12}})"
PASSPORT_NAMES = {"document_number": "passport_number", "surname": "surname", "given_names": "given_names", "birth_date": "date_of_birth", "expiry_date": "date_of_expiry", "gender": "sex"}


def zone_characters(c: Column) -> Column:
    """In capitals, with fillers told apart from nothing else, and all other signs gone."""
    return F.regexp_replace(F.translate(F.upper(c), FILLERS, "<" * len(FILLERS)), r"[^A-Z0-9<]", "")


def padded(c: Column) -> Column:
    return F.rpad(c, WIDTH, "<")


def _with_lines(doc: DataFrame, text: str) -> DataFrame:
    """doc_id, body, lines: the text's lines in zone characters, without empty ones."""
    rows = doc.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("body"))
    return with_computed(rows, lines=F.filter(F.transform(F.split("body", r"\r\n|\r|\n"), zone_characters), lambda x: x != ""))


def _first_zone(lines: Column) -> Column:
    """struct(line1, line2): the first long line that begins with P and the next long one; else 88 characters of all lines from P on."""
    long = F.filter(lines, lambda x: F.length(x) >= 30)
    pairs = F.zip_with(long, F.slice(long, F.lit(2), F.greatest(F.size(long), F.lit(1))), lambda a, b: F.struct(padded(a).alias("line1"), padded(b).alias("line2")))
    seen = F.get(F.filter(pairs, lambda p: p["line1"].startswith("P") & p["line2"].isNotNull()), 0)
    joined = F.array_join(lines, "")
    at = F.coalesce(F.nullif(F.instr(joined, "P<"), F.lit(0)), F.nullif(F.instr(joined, "P"), F.lit(0)))
    part = lambda begin: padded(F.substring(joined, at + begin, F.lit(WIDTH)))
    cut = F.when(F.length(joined) - at + 1 >= 70, F.struct(part(0).alias("line1"), part(WIDTH).alias("line2")))
    return F.coalesce(seen, cut)


def zone_lines(doc: DataFrame, text: str = "raw_text") -> DataFrame:
    """doc_id, line1, line2: a text's zone; null lines where it has none."""
    return with_computed(_with_lines(doc, text), zone=_first_zone(F.col("lines"))).select("doc_id", "zone.line1", "zone.line2")


def begins_with(letters: str):
    return lambda v: F.substring(v, 1, 1).isin(*letters)


def second_lines(seed: Column, country: Column) -> Column:
    """An array of what a second line may have been: itself, with digits where digits stand, with a country's first letters, with a sex."""
    base, parts, at = padded(seed), [], 1
    for begin, length in DIGIT_RUNS:
        parts += [F.substring(base, at, begin - at), F.translate(F.substring(base, begin, length), *DIGIT_OF)]
        at = begin + length
    some = F.array_distinct(F.array(base, F.concat(*parts)))
    more = lambda known, wrong, new: F.concat(known, F.flatten(F.transform(F.filter(known, wrong), lambda v: F.array(*[n(v) for n in new]))))
    for name, (read, letters) in MISREAD.items():
        prefixed = more(some, begins_with(read), [lambda v, x=x: F.concat(F.lit(x), F.substring(v, 2, WIDTH)) for x in letters])
        some = F.when(country == name, prefixed).otherwise(some)
    sexed = [lambda v, x=x: F.concat(F.substring(v, 1, SEX[0] - 1), F.lit(x), F.substring(v, SEX[0] + 1, WIDTH)) for x in "MF<"]
    return F.array_distinct(more(some, lambda v: ~F.substring(v, *SEX).isin("M", "F", "<"), sexed))


def zone_variants(doc: DataFrame, text: str = "raw_text") -> DataFrame:
    """doc_id, place, method, line1, line2: each zone that a text may hold, the one as read first, then from lines that stand together,
    then from its words strung together behind ``P<``. A text without any has one row of null lines."""
    rows = _with_lines(doc, text)
    from_sign = lambda x: F.substring(x, F.instr(x, "P<"), F.length(x))
    some = F.filter("lines", lambda x: F.length(x) >= 8)
    beside = F.filter(F.zip_with(some, F.slice(some, F.lit(2), F.greatest(F.size(some), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNotNull() & p["a"].contains("P<"))
    beside = F.transform(beside, lambda p: F.struct(from_sign(p["a"]).alias("a"), p["b"].alias("b"), F.lit("lines").alias("method")))
    words = F.filter(F.split(F.translate(F.upper("body"), FILLERS, "<" * len(FILLERS)), r"[^A-Z0-9<]+"), lambda w: F.length(w) >= 5)
    rows = with_computed(rows, words=words, beside=beside, zone=_first_zone(F.col("lines")))

    def strung(w: Column, i: Column) -> Column:
        # Nine words of five characters or more fill a line.
        after, rest = from_sign(w), F.array_join(F.slice("words", i + 2, F.lit(9)), "")
        return F.struct(F.substring(after, 1, WIDTH).alias("a"), F.concat(F.substring(after, WIDTH + 1, WIDTH), rest).alias("b"), F.lit("words").alias("method"))

    marked = F.filter(F.transform("words", lambda w, i: F.when(w.contains("P<"), strung(w, i))), lambda s: s.isNotNull() & (F.length(s["a"]) >= 12) & (F.length(s["b"]) >= 12))
    repaired = lambda s: F.transform(second_lines(s["b"], F.substring(s["a"], 3, 3)), lambda v: F.struct(s["method"].alias("method"), padded(s["a"]).alias("line1"), v.alias("line2")))
    read = F.array(F.struct(F.lit("read").alias("method"), F.col("zone.line1").alias("line1"), F.col("zone.line2").alias("line2")))
    every = F.concat(read, F.flatten(F.transform(F.concat("beside", marked), repaired)))
    return rows.select("doc_id", F.posexplode(every).alias("place", "v")).select("doc_id", "place", "v.*")


def zone_parse(lines: DataFrame, as_of_year: Column) -> DataFrame:
    """Adds to line1, line2 their fields, checks, ``valid``, the errors and a score.

    Valid needs number, surname, a country of three letters and both dates, and either the digits of number and dates or the composite one."""
    take = lambda place: F.substring("line2", *place)
    text = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.translate(c, "<", " "), r"[^A-Z' -]", ""), r"\s+", " ")), F.lit(""))
    country = lambda c: F.nullif(F.regexp_replace(F.translate(c, *LETTER_OF), r"[^A-Z]", ""), F.lit(""))
    plain = lambda c: F.nullif(F.translate(c, "<", ""), F.lit(""))
    digits = lambda c: F.regexp_replace(F.translate(c, *DIGIT_OF), r"[^0-9]", "")
    date = lambda place, birth: F.when(F.length(digits(take(place))) == 6, mrz_date(digits(take(place)), as_of_year, birth).cast("string"))
    holds = lambda c, at: F.coalesce(check_digit(c) == F.substring("line2", at, 1).try_cast("int"), F.lit(False))
    names = F.split(F.substring("line1", 6, 39), "<<", 2)
    whole = F.concat(take((1, 10)), take((14, 7)), take((22, 7)), take((29, 15)))
    rows = with_computed(
        lines,
        document_number=plain(take(NUMBER)),
        surname=text(F.get(names, 0)),
        given_names=text(F.get(names, 1)),
        issuing_country=country(F.substring("line1", 3, 3)),
        nationality=country(take(COUNTRY)),
        birth_date=date(BIRTH, True),
        expiry_date=date(EXPIRY, False),
        gender=F.when(take(SEX).isin("M", "F"), take(SEX)),
        personal_number=plain(take(PERSONAL)),
        number_ok=holds(take(NUMBER), 10),
        birth_ok=holds(take(BIRTH), 20),
        expiry_ok=holds(take(EXPIRY), 28),
        personal_ok=(F.translate(take(PERSONAL), "<", "") == "") | holds(take(PERSONAL), 43),
        composite_ok=holds(whole, 44),
    )
    three = F.coalesce(F.length("nationality") == 3, F.lit(False))
    core = F.col("document_number").isNotNull() & F.col("surname").isNotNull() & three & F.col("birth_date").isNotNull() & F.col("expiry_date").isNotNull()
    rows = rows.withColumn("valid", core & ((F.col("number_ok") & F.col("birth_ok") & F.col("expiry_ok")) | F.col("composite_ok")))
    there = F.col("line1").isNotNull()
    errors = [F.when(~there, "zone_not_found")]
    errors += [F.when(there & bad, code) for code, bad in (("missing_document_number", F.col("document_number").isNull()), ("missing_surname", F.col("surname").isNull()), ("invalid_nationality", ~three), ("invalid_birth_date", F.col("birth_date").isNull()), ("invalid_expiry_date", F.col("expiry_date").isNull()))]
    errors.append(F.when(there & (F.col("issuing_country") == "AZE") & (F.col("nationality") != "AZE") & three, "nationality_mismatch"))
    errors.append(F.when(there & ~F.col("valid"), "checks_failed"))
    rows = rows.withColumn("errors", F.filter(F.array(*errors), lambda e: e.isNotNull()))
    points = sum((F.when(F.col(n).isNotNull(), p).otherwise(0) for n, p in POINTS.items()), F.lit(0.0))
    checked = sum((F.when(F.col(c), 2.0).otherwise(-1.0) for c in ("number_ok", "birth_ok", "expiry_ok", "personal_ok", "composite_ok")), F.lit(0.0))
    score = F.when(there, points + 4 + checked).otherwise(0.0) + F.when(F.col("valid"), 40.0).otherwise(-10.0) - 1.2 * F.size("errors")
    return rows.withColumn("score", F.round(score, 4))


def best_zone(doc: DataFrame, as_of_year: Column, text: str = "raw_text") -> DataFrame:
    """One parsed zone per document: the first valid one, else the one of the highest score, the first of equals."""
    parsed = zone_parse(zone_variants(doc, text), as_of_year)
    order = F.struct("valid", F.when(F.col("valid"), 0.0).otherwise(F.col("score")), -F.col("place"))
    best = parsed.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in parsed.columns if c != "doc_id"]), order).alias("b"))
    return best.select("doc_id", "b.*")


def zone_fields(zone: DataFrame) -> DataFrame:
    """Ten rows per document: doc_id, name, value, confidence, validated, error, review_required. A value stands only if the zone is valid."""
    rows = []
    for name in WEIGHTS:
        own = F.concat_ws("\n", "line1", "line2") if name == "mrz" else F.col(name)
        good = F.col("valid") & own.isNotNull()
        value = own if name == "mrz" else F.when(good, own)
        confidence = F.when(good, 0.97 if name == "mrz" else 0.94).otherwise(0.0)
        rows.append(F.struct(F.lit(name).alias("name"), value.alias("value"), confidence.alias("confidence"), good.alias("validated"), F.when(~good, f"invalid_{name}").alias("error"), (~good & F.lit(name in REQUIRED)).alias("review_required")))
    return zone.select("doc_id", F.inline(F.array(*rows)))


def passport_fields(doc: DataFrame, as_of_year: Column, text: str = "raw_text") -> DataFrame:
    """Fields of a valid zone as read (0.9), else the number alone, by its label (0.92; 0 where there are zone lines that do not hold)."""
    lines = with_computed(_with_lines(doc, text), zone=_first_zone(F.col("lines"))).select("doc_id", "body", "zone.line1", "zone.line2")
    zone = zone_parse(lines, as_of_year)
    zone = with_computed(zone, labelled=F.nullif(F.upper(F.regexp_extract("body", NUMBER_LABEL, 1)), F.lit("")))
    sure = F.when(F.col("valid"), 0.9).otherwise(0.0)
    out = []
    for own, name in PASSPORT_NAMES.items():
        value, confidence = F.when(F.col("valid"), F.col(own)), sure
        if own == "document_number":
            confidence = F.when(F.col("line1").isNotNull() & F.coalesce(value, F.col("labelled")).isNotNull(), sure).when(F.col("labelled").isNotNull(), 0.92).otherwise(0.0)
            value = F.coalesce(value, F.col("labelled"))
        out.append(F.struct(F.lit(name).alias("name"), value.alias("value"), confidence.alias("confidence"), value.isNotNull().alias("validated")))
    for line in ("1", "2"):
        out.append(F.when(F.col("valid"), F.struct(F.lit(f"mrz_line_{line}").alias("name"), F.col(f"line{line}").alias("value"), sure.alias("confidence"), F.lit(True).alias("validated"))))
    return zone.select("doc_id", F.inline(F.filter(F.array(*out), lambda s: s.isNotNull())))


def best_zone_run(field: DataFrame) -> DataFrame:
    """doc_id, run, score, valid: of several runs of ``zone_fields`` the first valid one, else the one of the highest score, the first of equals."""
    weight = F.lit(1.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("name") == name, w).otherwise(weight)
    there = F.coalesce(F.col("value") != "", F.lit(False))
    part = F.when(~there, 0.0).when(F.col("validated"), weight * (1 + F.col("confidence"))).otherwise(F.least(weight, F.lit(1.0)) * 0.1)
    runs = field.groupBy("doc_id", "run").agg(F.round(F.sum(part) - 3.0 * F.count_if("review_required"), 4).alias("score"), F.bool_or((F.col("name") == "mrz") & F.col("validated")).alias("valid"))
    runs = runs.withColumn("score", F.when(F.col("valid"), F.col("score")).otherwise(F.least("score", F.lit(-15.0))))
    best = runs.groupBy("doc_id").agg(F.min_by(F.struct("run", "score", "valid"), F.struct(~F.col("valid"), F.when(F.col("valid"), 0.0).otherwise(-F.col("score")), "run")).alias("b"))
    return best.select("doc_id", "b.*")
