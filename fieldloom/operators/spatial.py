"""Fields read from where texts stand: values inside, beside, below and above their labels, and the fields of a whole card.

A page of up to ``FEW`` boxes is one row, in which its labels meet its boxes. On longer pages they meet on a grid (``boxes.near``), so the work
grows with the boxes within reach of labels; bands of rows and columns are tested after the join.

Defined results: boxes without an extent and null or blank texts give nothing; documents without any candidate give no row; candidates equal
in score to nine places go by how they were found (``HOW``'s order), then by the label's and the box's number, then by the value; repeated
boxes change nothing but their row's joined text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.dates import parse_date_any
from fieldloom.functions.text import ascii_digits, once, with_computed
from fieldloom.operators import identity
from fieldloom.operators.boxes import geometry, near

# Scores of candidates by how they were found, shares of confidence, loss by distance, and the bands in heights of the larger box.
HOW = {"inline": 15.0, "merged": 12.5, "row": 12.0, "beside": 8.5, "line": 14.0, "around": 12.5, "right": 9.5}
PLACE_LESS = {"around": 1.0, "right": 0.5}
SURE = {"inline": 0.20, "line": 0.20, "merged": 0.18, "row": 0.18, "beside": 0.15}
LOSS, IN_ROW, BELOW, ABOVE, RIGHT = 0.02, 0.90, 2.4, 2.0, 0.42
NUMBER_SCORE, NUMBER_SURE = 20.0, 0.2
#: Boxes of a page whose labels are compared with each of them.
FEW = 64

_SEPARATORS = r"^[\s:;,_/|.\-؛،]+|[\s:;,_/|.\-؛،]+$"


@dataclass(frozen=True)
class Wanted:
    """A field: its labels' words, what makes a text its value (null: nothing), and whether it is read from what stands around a label, joined,
    or from each neighbour for itself. ``less`` lowers the scores of some ways."""

    name: str
    labels: tuple[str, ...]
    read: Callable[[Column], Column]
    joined: bool = False
    less: tuple[tuple[str, float], ...] = ()

    @property
    def pattern(self) -> str:
        """A label as a whole word, read either way; one of four letters or more also inside a word."""
        words = sorted({w for x in self.labels for w in (x, x[::-1])}, key=lambda w: (-len(w), w))
        whole, inside = "|".join(map(re.escape, words)), "|".join(re.escape(w) for w in words if len(w) >= 4)
        return rf"(?i)(?<!\p{{L}})(?:{whole})(?!\p{{L}})" + (f"|{inside}" if inside else "")

    def bare(self, text: Column) -> Column:
        """The text without the labels and the separators around what is left."""
        rest = F.regexp_replace(F.regexp_replace(text, self.pattern, " "), r"\s+", " ")
        return F.regexp_replace(rest, _SEPARATORS, "")


def _by_kind(wanted: list[Wanted], of: Callable[[Wanted], Column]) -> Column:
    out = F.lit(None).cast("string")
    for i, field in reversed(list(enumerate(wanted))):
        out = F.when(F.col("kind") == i, of(field)).otherwise(out)
    return out


def _boxes(box: DataFrame) -> DataFrame:
    """doc_id and ``b``, of boxes that have an extent and a text."""
    kept = with_computed(box, shown=F.trim("text")).filter("shown <> ''").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return geometry(kept).select("doc_id", F.struct("idx", F.col("shown").alias("text"), "confidence", "x1", "x2", "cx", "cy", "h").alias("b"))


def _met(page: DataFrame, wanted: list[Wanted], reach: float, by_row: Column) -> DataFrame:
    """doc_id, kind, a, met: labels and the boxes within their reach, with their distance; of pages of few boxes in their own row, without a
    shuffle. A row without a label stands for the whole page. Boxes without a doc_id meet none but themselves."""
    few, none = (F.size("w") <= FEW) & F.col("doc_id").isNotNull(), F.array().cast("array<int>")
    kinds = lambda b: F.concat(none, *(F.when(b["text"].rlike(w.pattern), F.array(F.lit(i))).otherwise(none) for i, w in enumerate(wanted)))
    named = lambda b: F.transform(kinds(b), lambda k: F.struct(k.alias("kind"), b.alias("a")))
    whole = F.transform(F.concat(none, F.array(*(F.lit(i) for i, w in enumerate(wanted) if w.joined)).cast("array<int>")), lambda k: F.struct(k.alias("kind"), F.get("w", F.lit(-1)).alias("a")))
    told = page.select("doc_id", "w", F.inline(F.concat(F.when(few, F.flatten(F.transform("w", named))).otherwise(F.slice(F.transform("w", lambda b: F.struct(F.lit(0).alias("kind"), b.alias("a"))), 1, 0)), whole)))
    apart = lambda b: F.sqrt(F.pow(b["cx"] - F.col("a.cx"), 2) + F.pow(b["cy"] - F.col("a.cy"), 2))
    each = lambda boxes, distance: F.transform(boxes, lambda b: F.struct(b.alias("b"), distance(b).alias("distance")))
    copies = F.size(F.filter("w", lambda b: _same(F.col("a"), b)))
    banded = F.filter("w", lambda b: F.abs(b["cy"] - F.col("a.cy")) <= max(IN_ROW, BELOW, ABOVE) * F.greatest(b["h"], F.col("a.h")))
    near_by = F.filter(each(banded, apart), lambda p: p["distance"] <= reach)
    met = F.when(F.col("a").isNull(), each("w", lambda _: F.lit(0.0))).when(copies == 1, near_by).otherwise(F.flatten(F.array_repeat(near_by, copies)))

    # The doc_id comes out of the generator, so that no filter of the join goes below the grouping, which both ways share.
    boxes = page.filter(~few).select(F.inline(F.transform("w", lambda b: F.struct(F.col("doc_id").alias("doc_id"), b.alias("b")))))
    labels = boxes.select("doc_id", F.col("b").alias("a"), F.explode(kinds(F.col("b"))).alias("kind"))
    alone = labels.filter("doc_id is null").select("doc_id", "kind", "a", F.array(F.struct(F.col("a").alias("b"), F.lit(0.0).alias("distance"))).alias("met"))
    pairs, pair = near(labels, boxes, reach), F.struct("b", "distance")
    joined = pairs.filter(by_row & _around(F.col("a"), F.col("b"))).groupBy("doc_id", "kind", "a").agg(F.collect_list(pair).alias("met"))
    single = pairs.filter(~by_row).select("doc_id", "kind", "a", F.array(pair).alias("met"))
    return told.select("doc_id", "kind", "a", met.alias("met")).unionByName(alone).unionByName(joined).unionByName(single)


def _same(a: Column, b: Column) -> Column:
    return a["idx"].eqNullSafe(b["idx"]) & (a == b)


def _in_row(a: Column, b: Column) -> Column:
    return F.abs(b["cy"] - a["cy"]) <= IN_ROW * F.greatest(a["h"], b["h"])


def _below(a: Column, b: Column) -> Column:
    step = b["cy"] - a["cy"]
    return (step > 0) & (step <= BELOW * F.greatest(a["h"], b["h"]))


def _above(a: Column, b: Column) -> Column:
    step = b["cy"] - a["cy"]
    return (step < 0) & (-step <= ABOVE * F.greatest(a["h"], b["h"]))


def _around(a: Column, b: Column) -> Column:
    return _same(a, b) | _in_row(a, b) | _below(a, b)


def candidates(box: DataFrame, wanted: list[Wanted], reach: float = 400.0, skip: str | None = None) -> DataFrame:
    """doc_id, name, value, score, how, label_idx, box_idx: every value found for every field; ``skip`` is a pattern of boxes that are no values.

    Boxes are shuffled once, by page. What is told of a label is an array of its row until the values are read: expressions inside arrays are
    run one by one, where the generated code of all of them is too long to be compiled.
    """
    by_row = F.col("kind").isin(*[i for i, w in enumerate(wanted) if w.joined])
    page = _boxes(box).groupBy("doc_id").agg(F.collect_list("b").alias("w"))
    labels = _met(page, wanted, reach, by_row)
    base = lambda how: HOW[how] - _less(wanted, how)
    a = F.col("a")
    found = lambda how, text, score, label, box: F.struct(F.lit(how).alias("how"), text.alias("text"), score.alias("score"), label.alias("label_idx"), box.alias("box_idx"))
    own = lambda how: found(how, a["text"], base(how) + SURE[how] * a["confidence"], a["idx"], a["idx"])

    def single(p: Column) -> Column:
        b = p["b"]
        both = F.when(b["x1"] < a["x1"], F.concat_ws(" ", b["text"], a["text"])).otherwise(F.concat_ws(" ", a["text"], b["text"]))
        one = lambda how, text: found(how, text, base(how) + SURE[how] * b["confidence"] - LOSS * p["distance"], a["idx"], b["idx"])
        value = ~b["text"].rlike(skip) if skip else F.lit(True)
        return F.when(_same(a, b), F.array(own("inline"))).when(_in_row(a, b) & value, F.array(one("row", b["text"]), one("merged", both))).when((_below(a, b) | _above(a, b)) & value, F.array(one("beside", b["text"])))

    def line(pairs: Column) -> Column:
        placed = F.array_sort(F.transform(pairs, lambda p: F.struct(*(p["b"][c].alias(c) for c in ("cy", "x1", "idx", "text")))))
        return F.array_join(F.transform(placed, lambda x: x["text"]), " ")

    none, width = F.lit(None).cast("bigint"), F.array_max(F.transform("met", lambda p: p["b"]["x2"]))
    far = once(width, lambda most: line(F.filter("met", lambda p: (p["b"]["x1"] >= RIGHT * most) | (p["b"]["cx"] >= RIGHT * most))))
    right = F.array(found("right", far, base("right"), none, none))
    around = found("around", line(F.filter("met", lambda p: _around(a, p["b"]))), base("around"), a["idx"], a["idx"])
    singles = F.flatten(F.array_compact(F.transform("met", single)))
    told = F.when(a.isNull(), right).when(by_row, F.array(own("line"), around)).otherwise(singles)

    bare = lambda text: _by_kind(wanted, lambda w: w.bare(text))
    text = lambda c: F.when(c["how"].isin("row", "beside", "right"), c["text"]).otherwise(bare(c["text"]))
    value = lambda c: once(text(c), lambda t: _by_kind(wanted, lambda w: w.read(t)))
    read = F.filter(F.transform(told, lambda c: F.struct(value(c).alias("value"), F.round(c["score"], 9).alias("score"), *(c[x].alias(x) for x in ("how", "label_idx", "box_idx")))), lambda c: c["value"] != "")
    return labels.select("doc_id", _by_kind(wanted, lambda w: F.lit(w.name)).alias("name"), F.inline(read))


def _less(wanted: list[Wanted], how: str) -> Column:
    out = F.lit(0.0)
    for i, field in enumerate(wanted):
        if dict(field.less).get(how):
            out = F.when(F.col("kind") == i, dict(field.less)[how]).otherwise(out)
    return out


def best_values(found: DataFrame) -> DataFrame:
    """doc_id, name, value, score, how: of each field's candidates the best."""
    rank = F.array_position(F.array(*map(F.lit, HOW)), F.col("how"))
    first = lambda c: -F.coalesce(F.col(c), F.lit(-1))
    best = F.max_by(F.struct("value", "score", "how"), F.struct("score", -rank, first("label_idx"), first("box_idx"), "value"))
    return found.groupBy("doc_id", "name").agg(best.alias("b")).select("doc_id", "name", "b.value", F.round("b.score", 4).alias("score"), "b.how")


def label_fields(box: DataFrame, wanted: list[Wanted], reach: float = 400.0, skip: str | None = None) -> DataFrame:
    return best_values(candidates(box, wanted, reach, skip))


def numbers(box: DataFrame, digits: int = 8) -> DataFrame:
    """Candidates for a card's number: runs of that many digits, marks and spaces between them left out."""
    number = F.regexp_extract(F.regexp_replace(ascii_digits(F.col("b.text")), "[^0-9]", ""), rf"(\d{{{digits}}})", 1)
    rows = _boxes(box).select("doc_id", F.lit("cin_number").alias("name"), number.alias("value"), F.round(NUMBER_SCORE + NUMBER_SURE * F.col("b.confidence"), 9).alias("score"), F.lit("row").alias("how"), F.col("b.idx").alias("label_idx"), F.col("b.idx").alias("box_idx"))
    return rows.filter("value <> ''")


def _name(most: int) -> Callable[[Column], Column]:
    def read(text: Column) -> Column:
        return F.get(F.transform(F.array(identity.words_of(text)), lambda w: F.when(identity.name_ok(w, most), F.array_join(w, " "))), 0)

    return read


def _place(text: Column) -> Column:
    """The known place that the text names, the longest first."""
    known = sorted({identity.plain_letters(p) for p in identity.PLACES}, key=lambda p: (-len(p), p))
    return F.nullif(F.regexp_extract(F.array_join(identity.words_of(text), " "), rf"(?<!\p{{L}})({'|'.join(known)})(?!\p{{L}})", 1), F.lit(""))


#: The fields of an Arabic identity card.
CARD = [
    Wanted("family_name", tuple(identity.FAMILY_LABELS), _name(3)),
    Wanted("first_name", tuple(identity.FIRST_LABELS), _name(2)),
    Wanted("date_of_birth", ("تاريخ الولادة", "تاريخ", "الولادة", "تاخ", "تارخ"), parse_date_any, joined=True),
    Wanted("place_of_birth", tuple(identity.PLACE_LABELS), _place, joined=True, less=tuple(PLACE_LESS.items())),
]


def spatial_fields(box: DataFrame, reach: float = 400.0) -> DataFrame:
    """doc_id, name, value, score, how: a card's number, names, date and place of birth; a first name equal to the family name goes."""
    head = rf"(?<!\p{{L}})(?:{'|'.join(identity.HEAD)})(?!\p{{L}})"
    best = best_values(candidates(box, CARD, reach, head).unionByName(numbers(box)))
    rows = best.groupBy("doc_id").agg(F.collect_list(F.struct("name", "value", "score", "how")).alias("f"))
    family = F.get(F.filter("f", lambda x: x["name"] == "family_name"), 0)["value"]
    kept = F.filter("f", lambda x: ~((x["name"] == "first_name") & x["value"].eqNullSafe(family)))
    return rows.select("doc_id", F.inline(kept))
