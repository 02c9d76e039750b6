"""Many readings of one card fused into its fields: near-equal readings count together, and names are chosen as a pair.

Readings (doc_id, field, value, source, engine, confidence) are brought into one form and counted by value; values with the same skeleton
(consonants) that are few edits from the best of them are one cluster. Family and first name are then chosen together: of all pairs that
differ the one with the highest sum, with a gain where one kind of source read both. So a reading in which the two were swapped costs both
names, and a name that leads both lists takes only one place.

A pair can only be won by one of the two best skeletons of a kind of source in each list, since a name excludes one skeleton at most. So a
document keeps a few rows before its pairs are formed. Readings are counted first and then shuffled by document once; all further groups,
orders and pairs stay where their document is.

Defined results: readings that are null or have no valid form go; repeated readings count each; equal scores go to the higher family score,
then to the lesser values; where all pairs clash, the better name of the two stays, the family name if they are equal in score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.dates import parse_date_any
from fieldloom.functions.text import digits_only, with_computed

EACH, TOGETHER = 7.0, 3.0
FAMILY, FIRST = "family_name", "first_name"
_SILENT = "[^\\p{L}]|[AEIOUYÀÂÉÈÊËÎÏÔÙÛ]|[اأإآويىةهء]"


def name_form(value: Column) -> Column:
    """In capitals, single spaces, without digits; null with fewer than three letters."""
    plain = F.trim(F.regexp_replace(F.upper(value), r"\s+", " "))
    return F.when(~plain.rlike(r"\d") & (F.length(F.regexp_replace(plain, r"[^\p{L}]", "")) >= 3), plain)


def number_form(digits: int) -> Callable[[Column], Column]:
    return lambda value: F.when(F.length(digits_only(value)) == digits, digits_only(value))


#: The form of each field's values; null where it is none.
FORMS: dict[str, Callable[[Column], Column]] = {
    FAMILY: name_form,
    FIRST: name_form,
    "date_of_birth": parse_date_any,
    "cin_number": number_form(8),
    "place_of_birth": lambda value: F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit("")),
}


def skeleton(value: Column) -> Column:
    """What stays of a name where vowels are misread; all of it where there is nothing else."""
    rest = F.regexp_replace(F.upper(value), _SILENT, "")
    return F.when(rest == "", value).otherwise(rest)


def edits(value: Column) -> Column:
    """How many edits a reading may be from the one that leads it."""
    return F.greatest(F.lit(1), F.floor(F.length(value) / 4)).cast("int")


def clusters(reading: DataFrame, bonus: dict[str, float], kinds: dict[str, str], forms: dict[str, Callable[[Column], Column]] = FORMS) -> DataFrame:
    """doc_id, field, value, n, score, skeleton, kinds: each field's readings by the value that leads them. ``bonus`` is what a source adds, ``kinds``
    its kind (sources of no kind are their own)."""
    form, gain, kind = F.lit(None).cast("string"), F.lit(0.0), F.col("source")
    for name, make in forms.items():
        form = F.when(F.col("field") == name, make(F.col("value"))).otherwise(form)
    for source, points in bonus.items():
        gain = F.when(F.col("source") == source, points).otherwise(gain)
    for source, of in kinds.items():
        kind = F.when(F.col("source") == source, of).otherwise(kind)
    rows = with_computed(reading.select("doc_id", "field", "value", "source", "confidence"), form=form).filter("form is not null")
    sure = F.coalesce("confidence", F.lit(0.0))
    parts = rows.groupBy("doc_id", "field", F.col("form").alias("value"), kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(sure).alias("sure"), F.max(gain).alias("gain"))
    points = lambda n, total, best: F.round(EACH * n + total / n + best, 6)
    alike = Window.partitionBy("doc_id", "field", "skeleton")
    each = alike.partitionBy("doc_id", "field", "skeleton", "value")
    parts = with_computed(parts.repartition("doc_id"), skeleton=skeleton(F.col("value")))
    counted = parts.withColumn("points", points(F.sum("n").over(each), F.sum("sure").over(each), F.max("gain").over(each)))
    joined = counted.withColumn("leader", F.first("value").over(alike.orderBy(F.col("points").desc(), "value")))
    same = F.levenshtein("value", "leader") <= edits(F.col("leader"))
    led = joined.withColumn("led", F.when((F.col("value") != F.col("leader")) & same & F.col("field").isin(FAMILY, FIRST), F.col("leader")).otherwise(F.col("value")))
    out = led.groupBy("doc_id", "field", "skeleton", F.col("led").alias("value")).agg(F.sum("n").alias("n"), F.sum("sure").alias("sure"), F.max("gain").alias("gain"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return out.select("doc_id", "field", "value", "n", points(F.col("n"), F.col("sure"), F.col("gain")).alias("score"), "skeleton", "kinds")


def best_clusters(found: DataFrame) -> DataFrame:
    """doc_id, family_name, first_name, others: of each list of names the clusters by which a pair can be won, and of other fields the best cluster."""
    name = F.col("field").isin(FAMILY, FIRST)
    kinds = F.concat(F.filter("kinds", lambda _: name), F.array(F.lit("")))
    each = found.select("doc_id", "field", "skeleton", F.explode(kinds).alias("kind"), F.struct("score", "value", "n", "skeleton", "kinds").alias("c"))
    # Of one skeleton the best cluster, of one kind the two best skeletons.
    best = each.groupBy("doc_id", "field", "kind", "skeleton").agg(F.min_by("c", F.struct(-F.col("c.score"), "c.value")).alias("c"))
    order = Window.partitionBy("doc_id", "field", "kind").orderBy(F.col("c.score").desc(), "c.value")
    few = best.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    other = F.when(~name & (F.col("rank") == 1), F.struct("field", F.struct("c.value", "c.score", "c.n").alias("c")))
    return few.groupBy("doc_id").agg(*(F.collect_set(F.when(F.col("field") == f, F.col("c"))).alias(f) for f in (FAMILY, FIRST)), F.collect_list(other).alias("others"))


def best_pairs(few: DataFrame) -> DataFrame:
    """``few`` with pair (family, first): of all pairs of clusters with different skeletons the best, or the better of the two names."""
    together = lambda a, b: F.when(F.arrays_overlap(a["kinds"], b["kinds"]), TOGETHER).otherwise(0.0)
    pair = lambda a, b: F.struct((-F.round(a["score"] + b["score"] + together(a, b), 6)).alias("s"), (-a["score"]).alias("t"), a["value"].alias("fv"), b["value"].alias("gv"), a.alias("family"), b.alias("first"))
    pairs = F.flatten(F.transform(FAMILY, lambda a: F.transform(F.filter(FIRST, lambda b: b["skeleton"] != a["skeleton"]), lambda b: pair(a, b))))
    top = lambda c: F.get(F.array_sort(F.transform(c, lambda x: F.struct((-x["score"]).alias("s"), x["value"].alias("v"), x.alias("c")))), 0)
    rows = with_computed(few, p=F.array_min(pairs), a=top(FAMILY), b=top(FIRST))
    alone = F.col("b").isNull() | (F.col("a.s") <= F.col("b.s"))
    family = F.when(F.col("p").isNotNull(), F.col("p.family")).when(alone, F.col("a.c"))
    first = F.when(F.col("p").isNotNull(), F.col("p.first")).when(~F.coalesce(alone, F.lit(False)), F.col("b.c"))
    return rows.select("doc_id", "others", F.struct(family.alias(FAMILY), first.alias(FIRST)).alias("pair"))


def fuse(reading: DataFrame, bonus: dict[str, float], kinds: dict[str, str], forms: dict[str, Callable[[Column], Column]] = FORMS) -> DataFrame:
    """doc_id, name, value, score, n: one row for each field that has a valid reading."""
    pairs = best_pairs(best_clusters(clusters(reading, bonus, kinds, forms)))
    named = F.array(*(F.struct(F.lit(f).alias("field"), F.struct(*(F.col(f"pair.{f}.{x}").alias(x) for x in ("value", "score", "n"))).alias("c")) for f in (FAMILY, FIRST)))
    rows = pairs.select("doc_id", F.inline(F.concat("others", named)))
    return rows.filter("c.value is not null").select("doc_id", F.col("field").alias("name"), "c.value", "c.score", "c.n")
