"""Fields by ordered strategies that are rows of a table, so that each template may try the same ways in an order of its own.

A strategy row: template_id, field, rank, kind, and what its kind reads. Of each field the strategies are tried by rank up to the first
that gives text; none after it is evaluated.

| kind | gives |
| --- | --- |
| ``known`` | the document's known value of ``source``, or of the field where that is null |
| ``pattern`` | group ``part`` (0: all) of the first match of ``pattern`` in the first text that has one |
| ``anchor`` | of ``width`` characters from the anchor on: the match of ``pattern``; without a pattern, what stands there beside the anchor |
| ``first_line`` | the first line that is not blank |
| ``constant`` | ``source`` itself: a default, if it stands last |

Texts are read in their order, behind the text of the strategy's ``region`` where the document has it.
Defined results: null texts, regions and known values are absent; values are trimmed; a field without any hit has a null value and rank;
repeated documents give repeated rows; documents of a template without strategies, or of none, give no rows; a strategy of an unknown kind
never hits; of strategies of equal rank the one that sorts first by kind and then by its other columns comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = ["rank", "kind", "pattern", "part", "anchor", "width", "source", "region"]
STRATEGY = "template_id string, field string, rank int, kind string, pattern string, part int, anchor string, width int, source string, region string"


def stripped(value: Column) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))


def first_of(texts: Column, given) -> Column:
    """The first text's value that is not null."""
    return F.get(F.filter(F.transform(texts, given), lambda v: v.isNotNull()), F.lit(0))


def _match(text: Column, step: Column) -> Column:
    return stripped(F.call_function("regexp_extract", text, step["pattern"], F.coalesce(step["part"], F.lit(1))))


def _window(text: Column, step: Column) -> Column:
    """From the anchor on; null where the text doesn't have it."""
    at = F.call_function("instr", text, step["anchor"])
    return F.when((F.length(step["anchor"]) > 0) & (at > 0), F.substring(text, at, F.coalesce(step["width"], F.lit(80))))


def attempt(step: Column, field: Column) -> Column:
    """What one strategy gives for the row's texts, regions and known values."""
    region = stripped(F.col("regions")[step["region"]])
    texts = F.when(region.isNotNull(), F.concat(F.array(region), F.col("texts"))).otherwise(F.col("texts"))
    beside = F.get(F.filter(F.transform(texts, lambda t: _window(t, step)), lambda w: w.isNotNull()), F.lit(0))
    lines = F.flatten(F.transform(texts, lambda t: F.split(t, r"\r\n|\r|\n")))
    kind = step["kind"]
    return (
        F.when(kind == "known", stripped(F.col("known")[F.coalesce(step["source"], field)]))
        .when(kind == "pattern", first_of(texts, lambda t: _match(t, step)))
        .when((kind == "anchor") & step["pattern"].isNotNull(), first_of(texts, lambda t: _match(_window(t, step), step)))
        .when(kind == "anchor", stripped(F.replace(beside, step["anchor"], F.lit(""))))
        .when(kind == "first_line", first_of(lines, stripped))
        .when(kind == "constant", stripped(step["source"]))
    )


def strategy_fields(doc: DataFrame, strategy: DataFrame) -> DataFrame:
    """doc_id, field, value, rank from doc_id, template_id, texts, regions and known (maps of text) and the strategies.

    A template's strategies meet its documents as one array, in a join that Spark broadcasts or shuffles by their true size; each document is
    read once, whatever the number of its fields."""
    by_field = strategy.groupBy("template_id", "field").agg(F.array_sort(F.collect_list(F.struct(*STEP))).alias("steps"))
    by_template = by_field.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("field", "steps"))).alias("fields"))
    texts = F.filter(F.coalesce("texts", F.array().cast("array<string>")), lambda t: t.isNotNull())
    rows = doc.select("doc_id", "template_id", texts.alias("texts"), "regions", "known").join(by_template, "template_id")
    nothing = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("rank"))

    def chosen(f: Column) -> Column:
        def step(held: Column, s: Column) -> Column:
            there = held["value"].isNotNull()
            return F.struct(F.when(there, held["value"]).otherwise(attempt(s, f["field"])).alias("value"), F.when(there, held["rank"]).otherwise(s["rank"]).alias("rank"))

        return F.aggregate(f["steps"], nothing, step, lambda held: F.struct(f["field"].alias("field"), held["value"].alias("value"), F.when(held["value"].isNotNull(), held["rank"]).alias("rank")))

    return rows.select("doc_id", F.inline(F.transform("fields", chosen)))
