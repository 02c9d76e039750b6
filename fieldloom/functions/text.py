"""Text steps as Catalyst expressions: each takes and returns a string column, so a chain of them stays in generated code."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARABIC_DIGITS, PERSIAN_DIGITS, DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"

#: Letters, marks and blanks that scans give in different ways.
_SPELT = {"e": "[eéèê]", "a": "[aàâ]", "'": "['’]", "°": "[°o]", " ": r"\s*", "ا": "[اأإآ]", "أ": "[اأإآ]", "إ": "[اأإآ]"}


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often later columns name them: they come out of a generator, into which Catalyst
    moves no expression that stands above it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def spelt(words: list[str]) -> str:
    """Any of the words as scans spell them: with or without accents, hooks over letters and blanks; the longest first."""
    return "|".join("".join(_SPELT.get(c, re.escape(c)) for c in w) for w in sorted(words, key=lambda w: (-len(w), w)))


def spelt_tree(words: list[str]) -> str:
    """As ``spelt``, where what words have in common at their begin is tried once."""
    return _branches([[_SPELT.get(c, re.escape(c)) for c in w] for w in sorted(words, key=lambda w: (-len(w), w))])


def _branches(words: list[list[str]]) -> str:
    """The words by their first parts; the word that ends here comes last, as the shortest."""
    by_first: dict[str, list[list[str]]] = {}
    for w in words:
        if w:
            by_first.setdefault(w[0], []).append(w[1:])
    branches = [first + (_branches(rest) if any(rest) else "") for first, rest in by_first.items()]
    if any(not w for w in words):
        branches.append("")
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


#: Stands around matches where a text is cut at them.
_MARK = "\u0001"


def pieces(text: Column, pattern: str) -> Column:
    """A text cut at all matches of a pattern: what stands before the first, the first, what stands between it and the second, and so on. The
    pattern runs once over the text and is compiled once; only a text that has the mark in it is matched and split by the pattern itself."""
    cut = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, gap: F.array(gap, m))
    plainly = F.concat(F.flatten(pairs), F.array(F.element_at(gaps, -1)))
    return F.when(F.contains(text, F.lit(_MARK)), plainly).otherwise(cut)


def spans(text: Column, pattern: str) -> Column:
    """Where a pattern stands in a text, from the left: start, end (from 0, end excluded) and text of each match."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        end = s["at"] + F.length(x)
        found = F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), end.alias("end"), x.alias("text"))))
        return F.struct(end.alias("at"), (~s["match"]).alias("match"), F.when(s["match"], found).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces(text, pattern), start, add, lambda s: s["out"])


def is_present(c: Column) -> Column:
    return c.isNotNull() & (c != "") & (c != "[]")


def clean_ocr_noise(c: Column) -> Column:
    """Rule lines and runs of dots go, runs of blanks become one, and of blank lines at most one stays."""
    c = F.regexp_replace(c, r"[_=~-]{3,}", " ")
    c = F.regexp_replace(c, r"\.{3,}", " ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(c, r" ?\n ?(\n ?)+", "\n\n"))


def normalize_french(c: Column) -> Column:
    c = F.translate(c, "‘’“”«»–—", "''\"\"\"\"--")
    return F.trim(F.regexp_replace(c, r"[ \t\x{00A0}]+", " "))


def cleanup_arabic(c: Column) -> Column:
    """Without signs that steer the direction of writing; Arabic letters, digits and a few marks stay, all else is a space."""
    c = ascii_digits(F.regexp_replace(c, r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{061C}]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\x{0600}-\x{06FF}0-9\s:/\\.\-]", " "), r"\s+", " "))


# Misread labels and names of identity cards, and what they mean.
LABEL_FIXES = [("اللقب:", "اللقب"), ("الالقب", "اللقب"), ("نساما", "الاسم"), ("نسإما", "الاسم"), ("النسم", "الاسم"), ("الاسم:", "الاسم"), ("الممادة", "الولادة"), ("الم ادة", "الولادة"), ("تاريخالممادة", "تاريخ الولادة"), ("بثت", "بنت")]
NAME_FIXES = [("محمم", "محمد"), ("دمحم", "محمد"), ("عزمم", "عزيز"), ("بممز", "زينب"), ("اضر", "رضا"), ("ناضمر", "رمضان"), ("نمسحما", "الحسين"), ("نبرعما", "العربي")]


def fix_labels(c: Column) -> Column:
    """Misread labels wherever they stand, in order, then misread names where they are whole words."""
    for bad, good in LABEL_FIXES:
        c = F.replace(c, F.lit(bad), F.lit(good))
    for bad, good in NAME_FIXES:
        c = F.regexp_replace(c, rf"(?<![\x{{0600}}-\x{{06FF}}]){bad}(?![\x{{0600}}-\x{{06FF}}])", good)
    return c


# Frequent small words by which Latin texts are told apart.
STOP_WORDS = {"fr": "le la les de des du et est dans pour une".split(), "en": "the of and to in is that for with on".split(), "de": "der die das und ist nicht ein zu den mit".split(), "es": "el los las y en que por una con del".split()}


def detect_language(c: Column, hint: Column | None = None) -> Column:
    """The hint, else English, for fewer than ten characters; Arabic where its letters are more than the Latin ones; else the language with
    most small words, the first of equals, and the hint or English without any. A vote stands in for a trained model."""
    text, hint = F.coalesce(c, F.lit("")), F.lit(None).cast("string") if hint is None else hint
    words = F.split(F.lower(text), r"[^\p{L}]+")
    votes = F.array(*[F.struct(F.size(F.filter(words, _is_one_of(some))).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, some) in enumerate(STOP_WORDS.items())])
    best = F.array_max(votes)
    arabic = F.regexp_count(text, F.lit(r"[\x{0600}-\x{06FF}]")) > F.regexp_count(text, F.lit(r"[A-Za-zÀ-ÿ]"))
    return F.when(F.length(F.trim(text)) < 10, F.coalesce(hint, F.lit("en"))).when(arabic, F.when(hint.startswith("fr"), "ar+fr").otherwise("ar")).when(best["n"] > 0, best["lang"]).otherwise(F.coalesce(hint, F.lit("en")))


def _is_one_of(some: list[str]):
    return lambda w: w.isin(*some)


def normalize_arabic(c: Column) -> Column:
    c = F.regexp_replace(c, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", "")
    return F.translate(c, "أإآىة", "اااايه"[:3] + "يه")


def ascii_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS + PERSIAN_DIGITS, DIGITS + DIGITS)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(ascii_digits(c), r"[^0-9]", "")


def arabic_tokens(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"([\x{0600}-\x{06FF}]+)"), 1), " ")


def is_arabic(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(r"[\x{0600}-\x{06FF}]")) / F.length(c) > 0.3).otherwise(False)


def dominant_script(c: Column) -> Column:
    arabic, latin = F.regexp_count(c, F.lit(r"[\x{0600}-\x{06FF}]+")), F.regexp_count(c, F.lit(r"[A-Za-z]+"))
    return F.when(arabic > latin, "arabic").otherwise("latin")


def normalize_number(c: Column) -> Column:
    """French and English thousands and decimals: the last of comma and point that is followed by one to three digits is the decimal mark;
    two of one kind are thousands."""
    return decimal_point(number_characters(c))


def number_characters(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.,-]", "")


def decimal_point(c: Column) -> Column:
    """The second half of ``normalize_number``; it names its argument often, so give it a column that is computed already."""
    comma, point = F.instr(F.reverse(c), ","), F.instr(F.reverse(c), ".")
    both = (comma > 0) & (point > 0)
    french = F.translate(c, ",.", ".")
    english = F.translate(c, ",", "")
    many = F.length(c) - F.length(english) > 1
    return F.when(both & (comma < point), french).when(both, english).when(many, english).when(comma > 0, F.translate(c, ",", ".")).otherwise(c)


def reverse_word_order(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), lambda line: F.array_join(F.reverse(F.split(line, " ")), " ")), "\n")


def letters_from_ocr(c: Column) -> Column:
    return F.translate(c, "0145862", "OIASBGZ")


def digits_from_ocr(c: Column) -> Column:
    return F.translate(F.upper(c), "OQDILZSBG", "000112586")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def pseudonym(c: Column) -> Column:
    digest = F.translate(F.base64(F.unhex(F.substring(F.sha2(c, 256), 1, 24))), "+/", "-_")
    return F.concat(F.lit("anon_"), digest)


def key_hash(c: Column) -> Column:
    return F.sha2(c, 256)


STEPS = {f.__name__: f for f in (clean_ocr_noise, normalize_french, normalize_arabic, ascii_digits, digits_only, arabic_tokens, normalize_number, reverse_word_order, letters_from_ocr, digits_from_ocr, slugify)}
STEPS |= {"strip": F.trim, "uppercase": F.upper, "lowercase": F.lower}


def clean_text(df: DataFrame, column: str, steps: Iterable[str], out: str | None = None) -> DataFrame:
    """Runs named steps in order over a column."""
    c = F.col(column)
    for step in steps:
        c = STEPS[step](c)
    return df.withColumn(out or column, c)
