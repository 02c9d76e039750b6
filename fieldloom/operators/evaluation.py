"""Benchmarks of extraction runs: one conditional aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rate(a: Column, b: Column, places: int = 4) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), places)


def micro_f1(prf: DataFrame) -> DataFrame:
    """All fields' counts in one F1."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return prf.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), _rate(2 * tp, 2 * tp + fp + fn, 3).alias("f1"))


def critical_pass(field: DataFrame, critical: list[str]) -> DataFrame:
    """Per document: valid critical fields, whether all are, and ``name:error`` of the others in order."""
    good = F.coalesce(F.col("validated") & (F.coalesce("value", F.lit("")) != ""), F.lit(False))
    state = F.when(F.coalesce("value", F.lit("")) == "", "missing").otherwise(F.coalesce("error", F.lit("invalid")))
    failed = F.array_sort(F.collect_set(F.when(~good, F.concat("name", F.lit(":"), state))))
    rows = field.filter(F.col("name").isin(*critical)).groupBy("doc_id").agg(F.count_if(good).alias("n_valid"), failed.alias("f"))
    return rows.select("doc_id", "n_valid", (F.col("n_valid") == len(critical)).alias("critical_pass"), F.array_join("f", ",").alias("errors"))


def exact_matches(expected: DataFrame, field: DataFrame) -> DataFrame:
    """Per document: fields that are valid and equal, and the names of missing and wrong ones."""
    rows = expected.join(field.select("doc_id", "name", "value", "validated"), ["doc_id", "name"], "left")
    absent = F.coalesce("value", F.lit("")) == ""
    hit = ~absent & F.coalesce("validated", F.lit(False)) & (F.col("value") == F.col("expected"))
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("name")))), ",")
    return rows.groupBy("doc_id").agg(F.count_if(hit).alias("n_exact"), names(absent).alias("missing"), names(~absent & ~hit).alias("wrong"))


def behaviour(case_result: DataFrame) -> DataFrame:
    """Whether each case did what it should: cases in scope pass automatically, others end in review and never pass."""
    passed = F.col("critical_valid_count") >= F.col("critical_total")
    auto = F.col("api_status") == "success"
    return case_result.select("case_id", F.when(F.col("in_scope"), passed & auto).otherwise(~auto & ~passed).alias("behaviour_ok"), F.when(F.col("in_scope"), "auto_success").otherwise("controlled_review").alias("expected_behaviour"))


def time_budget(case_result: DataFrame, good_ms: int, low_ms: int) -> DataFrame:
    """Per family: cases within the time that their quality grants, and mean milliseconds of the answered ones."""
    within = F.col("processing_time_ms") <= F.when(F.col("in_scope"), good_ms).otherwise(low_ms)
    return case_result.groupBy("family").agg(F.count("*").alias("cases"), F.count_if(within).alias("within"), _rate(F.count_if(within), F.count("*")).alias("share"), F.round(F.avg(F.when(F.col("http_ok"), F.col("processing_time_ms"))), 2).alias("avg_ms"))


def false_accepts(case_result: DataFrame) -> DataFrame:
    """All critical fields were validated although the case was sent to review."""
    return case_result.filter((F.col("critical_valid_count") >= F.col("critical_total")) & (F.col("api_status") == "review_required"))


def strict_and_review(case_result: DataFrame) -> DataFrame:
    strict = F.col("in_scope")
    passed = F.col("critical_valid_count") >= F.col("critical_total")
    return case_result.agg(F.count_if(strict).alias("strict"), F.count_if(strict & passed).alias("strict_passed"), F.count_if(~strict).alias("review"), F.count_if(~strict & (F.col("api_status") == "review_required")).alias("review_right"))


def model_accuracy(prediction: DataFrame, item: str, model: str, right: Column) -> DataFrame:
    """Mean over items of each item's share of right fields, per model."""
    each = prediction.groupBy(model, item).agg(F.avg(right.cast("double")).alias("a"))
    return each.groupBy(model).agg(F.count("*").alias("items"), F.round(F.round(F.avg("a"), 9), 4).alias("accuracy"))


def accept_prediction(prediction: DataFrame, scores: dict[str, Column], least: float) -> DataFrame:
    """Classes in order of score, the best one, and whether it is accepted; the first class wins ties."""
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())])))
    rows = prediction.withColumn("_r", ranked)
    return rows.select("item_id", F.col("_r")[0]["n"].alias("best"), F.col("_r")[0]["s"].alias("score"), (F.col("_r")[0]["s"] >= least).alias("accepted"), F.array_join(F.transform("_r", lambda x: x["n"]), ">").alias("ranking"))
