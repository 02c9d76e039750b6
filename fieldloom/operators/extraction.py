"""Rule-driven fields from whole texts. Rules are literals unrolled into one projection over arrays of lines: no join, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import dates
from fieldloom.functions.text import is_present, normalize_number, spelt

SEPARATOR = r"\s*[:/–-]\s*|\s{2,}"
VALUE = r"[A-Za-zÀ-ÿ؀-ۿ0-9]"
SHAPE = "struct<value:string,confidence:double>"
# Confidences of values right of the anchor, left of it, beside an Arabic one, on the next lines; the loss when a fallback pattern is used.
RIGHT, LEFT, BESIDE, BELOW, FALLBACK = 0.85, 0.83, 0.80, 0.75, 0.88


@dataclass(frozen=True)
class Rule:
    """One field: how to find it, what type it has and what it must satisfy. ``kind``: text, number, date or enum."""

    name: str
    patterns: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()
    kind: str = "text"
    required: bool = False
    options: tuple[str, ...] = ()
    check: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    no_digits: bool = False
    forbidden: tuple[str, ...] = ()


def _found(value: Column, confidence: Column | float) -> Column:
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.when(value.isNotNull(), F.struct(value.alias("value"), confidence.cast("double").alias("confidence")))


def _is_value(c: Column) -> Column:
    return (F.length(F.trim(c)) >= 2) & c.rlike(VALUE)


def by_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """The first pattern that matches: its first group, or the whole where it has none; 0.95 less 0.07 for each pattern before it, 0.5 at least."""
    if not patterns:
        return F.lit(None).cast(SHAPE)
    group = [1 if "(" in p.replace("(?", "").replace(r"\(", "") else 0 for p in patterns]
    hits = [F.nullif(F.trim(F.regexp_extract(text, p, g)), F.lit("")) for p, g in zip(patterns, group)]
    return F.coalesce(*[_found(h, round(max(0.95 - 0.07 * i, 0.5), 2)) for i, h in enumerate(hits)])


def by_anchor(lines: Column, anchors: Sequence[str]) -> Column:
    """The value beside the first anchor that has one: right of the separator, left of it, or on one of the next two lines."""
    def beside(anchor: str) -> Column:
        low, arabic = anchor.lower(), any("؀" <= ch <= "ۿ" for ch in anchor)
        places = F.filter(F.transform(lines, lambda x, i: F.struct(F.trim(x).alias("line"), i.alias("i"))), lambda s: F.lower(s["line"]).contains(low))

        def answer(s: Column) -> Column:
            parts = F.split(s["line"], SEPARATOR, 2)
            left, right = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
            tries = [
                F.when(F.lower(left).contains(low) & _is_value(right), _found(right, RIGHT)),
                F.when(F.lower(right).contains(low) & _is_value(left), _found(left, LEFT)),
            ]
            if arabic:
                rest = F.trim(F.regexp_replace(F.replace(s["line"], F.lit(anchor), F.lit("")), r"^[ :/–-]+|[ :/–-]+$", ""))
                tries.append(F.when(_is_value(rest), _found(rest, BESIDE)))
            for step in (1, 2):
                below = F.trim(F.get(lines, s["i"] + step))
                tries.append(F.when(_is_value(below), _found(below, BELOW)))
            return F.coalesce(*tries)

        return F.get(F.filter(F.transform(places, answer), lambda a: a.isNotNull()), 0)

    return F.coalesce(*map(beside, anchors)) if anchors else F.lit(None).cast(SHAPE)


def typed(value: Column, kind: str) -> Column:
    if kind == "number":
        return normalize_number(value)
    if kind == "date":
        return F.coalesce(dates.parse_date_any(value), value)
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def problems(value: Column, rule: Rule) -> Column:
    """The errors of a value in fixed order; none where all hold. An absent value is an error only where it is required."""
    there, low = F.coalesce(is_present(value), F.lit(False)), F.lower(value)
    tests: list[tuple[str, Column]] = []
    if rule.check:
        tests.append(("pattern", ~value.rlike(rule.check)))
    if rule.kind == "number":
        tests.append(("not_a_number", value.try_cast("double").isNull()))
    if rule.kind == "date":
        tests.append(("not_a_date", F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNull()))
    if rule.kind == "enum":
        tests.append(("not_an_option", ~low.isin(*[o.lower() for o in rule.options])))
    if rule.min_length is not None:
        tests.append(("too_short", F.length(value) < rule.min_length))
    if rule.max_length is not None:
        tests.append(("too_long", F.length(value) > rule.max_length))
    if rule.no_digits:
        tests.append(("digits", value.rlike("[0-9]")))
    tests += [(f"forbidden:{w}", low.contains(w.lower())) for w in rule.forbidden]
    errors = [F.when(there & bad, code) for code, bad in tests]
    errors.append(F.when(~there & F.lit(rule.required), "missing"))
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def extract_fields(doc: DataFrame, rules: Sequence[Rule], text: str = "raw_text") -> DataFrame:
    """Long table: doc_id, name, value, confidence, validated, error (the first). Anchors come first, then patterns at a discount.

    A null text is an empty one; a field that is not found has a null value and confidence 0; every rule gives one row per document.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = doc.select("doc_id", body.alias("_text"), F.split(body, r"\r?\n").alias("_lines"))
    for n, rule in enumerate(rules):
        pattern = by_pattern(F.col("_text"), rule.patterns)
        if rule.anchors:
            pattern = _found(pattern["value"], pattern["confidence"] * FALLBACK)
        rows = rows.withColumn(f"_raw{n}", F.coalesce(by_anchor(F.col("_lines"), rule.anchors), pattern))
    return _long(rows, rules, lambda raw, ok: F.round(F.coalesce(raw["confidence"], F.lit(0.0)), 4))


def generic_extract(doc: DataFrame, rules: Sequence[Rule], text: str = "raw_text") -> DataFrame:
    """As ``extract_fields``, but patterns first, then anchors as aliases; 0.86 by pattern, 0.76 by alias, 0.45 where invalid."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = doc.select("doc_id", body.alias("_text"), F.split(body, r"\r?\n").alias("_lines"))
    for n, rule in enumerate(rules):
        first, second = by_pattern(F.col("_text"), rule.patterns)["value"], by_anchor(F.col("_lines"), rule.anchors)["value"]
        rows = rows.withColumn(f"_raw{n}", F.coalesce(_found(first, 0.86), _found(second, 0.76)))
    return _long(rows, rules, lambda raw, ok: F.when(raw.isNull(), 0.0).when(ok, raw["confidence"]).otherwise(0.45))


def _long(rows: DataFrame, rules: Sequence[Rule], confidence) -> DataFrame:
    out = []
    for n, rule in enumerate(rules):
        raw = F.col(f"_raw{n}")
        value = typed(raw["value"], rule.kind)
        errors = problems(value, rule)
        ok = raw.isNotNull() & (F.size(errors) == 0)
        out.append(F.struct(F.lit(rule.name).alias("name"), value.alias("value"), confidence(raw, ok).alias("confidence"), ok.alias("validated"), F.get(errors, 0).alias("error")))
    return rows.select("doc_id", F.inline(F.array(*out)))


def marker_extract(doc: DataFrame, prefix: str, text: str = "raw_text") -> DataFrame:
    """Every ``PREFIX_NAME: value`` line of a text, the first of each name."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: x.rlike(rf"^\s*{prefix}_[A-Z_]+\s*:\s*\S"))
    part = lambda x, k: F.regexp_extract(x, rf"^\s*{prefix}_([A-Z_]+)\s*:\s*(.*\S)\s*$", k)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(part(x, 1)).alias("name"), part(x, 2).alias("value")))
    rows = doc.select("doc_id", F.posexplode(pairs).alias("pos", "pair"))
    return rows.groupBy("doc_id", F.col("pair.name").alias("name")).agg(F.min_by("pair.value", "pos").alias("value"))


def line_items(doc: DataFrame, text: str = "raw_text", most: int | None = None) -> DataFrame:
    """Table lines ``code designation quantity price total``: one row each with its place, repeated lines once.

    ``most`` keeps the first lines only where a page format sets such a limit; by default all are given.
    """
    shape = r"^\s*([A-Z0-9-]*[0-9][A-Z0-9-]*)\s+(.*?\S)\s+([0-9]+(?:[.,][0-9]+)?)\s+([0-9]+[.,][0-9]+)\s+([0-9]+[.,][0-9]+)\s*$"
    lines = F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: x.rlike(shape)))
    lines = F.slice(lines, 1, most) if most is not None else lines
    part = lambda k: F.regexp_extract("line", shape, k)
    amount = lambda k: F.replace(part(k), F.lit(","), F.lit(".")).try_cast("decimal(18,3)").cast("double")
    return doc.select("doc_id", F.posexplode(lines).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).alias("line_no"), part(1).alias("code"), part(2).alias("designation"), amount(3).alias("quantity"), amount(4).alias("price"), amount(5).alias("total")
    )


@dataclass(frozen=True)
class Shape:
    """A value of runs of characters (set, least, most), behind one of the labels, if there are any; ``whole``: no part of a longer word; ``apart``:
    something stands between label and value."""

    runs: tuple[tuple[str, int, int], ...]
    labels: tuple[str, ...] = ()
    whole: bool = False
    apart: bool = False

    @property
    def pattern(self) -> str:
        value, edge = "".join(f"[{c}]{{{a},{b}}}" for c, a, b in self.runs), r"\b" if self.whole else ""
        label = f"(?:{spelt(list(self.labels))})[:\\s\\-]{'+' if self.apart else '*'}" if self.labels else ""
        return f"(?i){edge}{label}({value}){edge}"


_DIGIT, _MARK, _CODE = "0-9", "/\\-._", "A-Z0-9\\-/"
# Labels and lengths of the older extractors' fields, by family; the first shape that is found gives the value.
LEGACY = {
    "CIN": {
        "cin_number": [Shape((("A-Z", 1, 2), (_DIGIT, 4, 8)), whole=True), Shape((("A-Z0-9", 5, 12),), ("cin",), whole=True)],
        "full_name": [Shape((("A-Z", 1, 1), ("A-Z\\s\\-", 3, 60)), ("nom", "name"), apart=True)],
        "birth_date": [Shape(((_DIGIT, 2, 2), (_MARK, 1, 1), (_DIGIT, 2, 2), (_MARK, 1, 1), (_DIGIT, 4, 4)), whole=True)],
        "address": [Shape((("^\\n", 5, 100),), ("adresse", "address"), apart=True)],
    },
    "FACTURE": {
        "invoice_number": [Shape(((_CODE, 3, 30),), tuple(f"{w}{mark}" for w in ("facture", "invoice") for mark in ("", " n°", " no", " #")))],
        "invoice_date": [Shape((("0-3", 0, 1), (_DIGIT, 1, 1), (_MARK, 1, 1), ("01", 0, 1), (_DIGIT, 1, 1), (_MARK, 1, 1), (_DIGIT, 2, 4)), ("date",))],
        "total_ttc": [Shape(((_DIGIT, 1, 1), ("0-9.,\\s", 1, 20)), ("total ttc", "montant total"))],
        "ice": [Shape(((_DIGIT, 8, 20),), ("ice",), whole=True)],
    },
    "REGISTRE_COMMERCE": {
        "rc_number": [Shape(((_CODE, 3, 30),), ("rc", "registre de commerce"))],
        "company_name": [Shape((("^\\n", 3, 80),), ("raison sociale", "denomination"), apart=True)],
        "if_number": [Shape(((_DIGIT, 4, 20),), ("if",), whole=True)],
        "ice": [Shape(((_DIGIT, 8, 20),), ("ice",), whole=True)],
    },
}


def legacy_extract(doc: DataFrame, text: str = "raw_text") -> DataFrame:
    """doc_id, name, value by the older shapes of the document's ``family``, the first that matches; documents of other families give no row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = None
    for family, fields in LEGACY.items():
        found = [F.struct(F.lit(n).alias("name"), F.regexp_replace(by_pattern(body, [shape.pattern for shape in shapes])["value"], r"^\s+|\s+$", "").alias("value")) for n, shapes in fields.items()]
        part = doc.filter(F.col("family") == family).select("doc_id", F.inline(F.array(*found)))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def apply_hooks(field: DataFrame, hooks: dict[str, list[str]]) -> DataFrame:
    """Named column functions over the values of named fields, in order."""
    value = F.col("value")
    for name, steps in hooks.items():
        changed = F.col("value")
        for step in steps:
            changed = HOOKS[step](changed)
        value = F.when(F.col("name") == name, changed).otherwise(value)
    return field.withColumn("value", value)


HOOKS = {
    "strip_spaces": lambda c: F.regexp_replace(c, r"\s+", ""),
    "uppercase": F.upper,
    "iso_date": lambda c: F.coalesce(dates.parse_date_any(c), c),
    "registration_letter": lambda c: F.regexp_replace(c, "^8", "B"),
}
