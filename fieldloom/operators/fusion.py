"""Fields of several runs or engines into one: unions and one grouped aggregate each, never a join of the runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.text import is_present

AGREE_BONUS, AGREE_CAP, CLEARLY = 0.05, 0.99, 0.15
SHAPE = ["value", "confidence", "validated"]


def _there(s: Column) -> Column:
    return F.coalesce(s["validated"] & is_present(s["value"]), F.lit(False))


def _same(a: Column, b: Column) -> Column:
    fold = lambda c: F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.coalesce(fold(a) == fold(b), F.lit(False))


def _two(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per document and name the row of each run, null where it has none. Of repeated rows the surest, then the least value."""
    rows = first.select("doc_id", "name", *SHAPE, F.lit(1).alias("run")).unionByName(second.select("doc_id", "name", *SHAPE, F.lit(2).alias("run")))
    pick = lambda run: F.max(F.when(F.col("run") == run, F.struct("confidence", "value", "validated")))
    return rows.groupBy("doc_id", "name").agg(pick(1).alias("a"), pick(2).alias("b"))


def merge_consensus(primary: DataFrame, secondary: DataFrame, critical: list[str]) -> DataFrame:
    """The second run may fill, confirm (+0.05, at most 0.99) or, where surer by more than 0.15, replace critical fields; ``action`` tells which."""
    rows = _two(primary, secondary)
    a, b = F.col("a"), F.col("b")
    usable = _there(b) & F.col("name").isin(*critical)
    action = (
        F.when(~usable, "kept").when(a.isNull() | ~_there(a), "filled").when(_same(a["value"], b["value"]), "agreed").when(b["confidence"] > a["confidence"] + CLEARLY, "replaced").otherwise("kept")
    )
    rows = rows.withColumn("action", action).filter(a.isNotNull() | (F.col("action") == "filled"))
    won = F.when(F.col("action").isin("filled", "replaced"), b).otherwise(a)
    sure = F.when(F.col("action") == "agreed", F.least(F.greatest(a["confidence"], b["confidence"]) + AGREE_BONUS, F.lit(AGREE_CAP))).otherwise(won["confidence"])
    return rows.select("doc_id", "name", won["value"].alias("value"), F.round(sure, 4).alias("confidence"), won["validated"].alias("validated"), "action")


def fill_header(base: DataFrame, targeted: DataFrame, names: list[str]) -> DataFrame:
    """Named fields that the base has not as valid are filled from targeted valid values; nothing valid is overwritten."""
    rows = _two(base, targeted)
    fill = F.col("name").isin(*names) & _there(F.col("b")) & ~F.coalesce(_there(F.col("a")), F.lit(False))
    rows = rows.withColumn("filled", F.coalesce(fill, F.lit(False))).filter(F.col("a").isNotNull() | F.col("filled"))
    won = F.when(F.col("filled"), F.col("b")).otherwise(F.col("a"))
    return rows.select("doc_id", "name", *[won[c].alias(c) for c in SHAPE], "filled")


def best_run(field: DataFrame, critical: list[str], run: str = "run") -> DataFrame:
    """Per document the run of the best 0.5 mean confidence + 0.3 valid share + 0.2 valid critical share; the first run name wins ties."""
    valid = F.coalesce(F.col("validated") & is_present(F.col("value")), F.lit(False))
    is_critical = F.col("name").isin(*critical)
    share = F.when(F.count_if(is_critical) > 0, F.count_if(is_critical & valid) / F.count_if(is_critical)).otherwise(0.0)
    scored = field.groupBy("doc_id", run).agg(F.round(F.round(0.5 * F.avg("confidence") + 0.3 * F.count_if(valid) / F.count("*") + 0.2 * share, 9), 4).alias("score"))
    best = scored.groupBy("doc_id").agg(F.max("score").alias("score"), F.min_by(run, F.struct(-F.col("score"), F.col(run))).alias(run))
    return best.select("doc_id", run, "score")


def suppress_weak(field: DataFrame, weak: list[str], anchor: list[str]) -> DataFrame:
    """Weak fields are invalid in documents without a valid anchor field."""
    held = F.bool_or(F.col("name").isin(*anchor) & F.col("validated")).over(Window.partitionBy("doc_id"))
    rows = field.withColumn("_held", F.coalesce(held, F.lit(False)))
    drop = F.col("name").isin(*weak) & ~F.col("_held")
    return rows.withColumns({"validated": F.col("validated") & ~drop, "error": F.when(drop, "no_anchor").otherwise(F.col("error"))}).drop("_held")


def suppress_derived(field: DataFrame, source: str, derived: list[str]) -> DataFrame:
    """Values derived from an invalid source field are null."""
    good = F.coalesce(F.bool_or((F.col("name") == source) & F.col("validated")).over(Window.partitionBy("doc_id")), F.lit(False))
    rows = field.withColumn("_good", good)
    return rows.withColumn("value", F.when(F.col("_good") | ~F.col("name").isin(*derived), F.col("value"))).drop("_good")


def engine_label(candidate: DataFrame) -> DataFrame:
    """The engine of a document's rows, or ``mixed(a+b)`` in order of names."""
    rows = candidate.groupBy("doc_id").agg(F.array_sort(F.collect_set("engine")).alias("e"))
    return rows.select("doc_id", F.when(F.size("e") > 1, F.concat(F.lit("mixed("), F.array_join("e", "+"), F.lit(")"))).otherwise(F.get("e", 0)).alias("engine_label"))


def first_from_sources(ranked: DataFrame, order: list[str], least: float = 0.0, but: list[str] | None = None) -> DataFrame:
    """Per document and field the best value of the first source in ``order`` that has one of at least that score."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    rows = ranked.filter(F.col("source").isin(*order) & (F.col("avg_conf") >= least))
    rows = rows.filter(~F.col("value").isin(*but)) if but else rows
    best = rows.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "source"), F.struct(rank, -F.col("avg_conf"), F.col("value"))).alias("b"))
    return best.select("doc_id", "field", "b.value", "b.source")


def combined_text(part: DataFrame, text: str, order: str) -> DataFrame:
    """A document's different texts, one a line, in order of their first place."""
    firsts = part.groupBy("doc_id", text).agg(F.min(order).alias("_at"))
    rows = firsts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_at", text))).alias("t"))
    return rows.select("doc_id", F.array_join(F.transform("t", lambda s: s[text]), "\n").alias("text"))
