"""Erasure, export, retention, cascades and paging over tenant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def erase(job: DataFrame, which: Column, now: Column) -> DataFrame:
    """Chosen jobs purged: flagged, stamped, without their path. Jobs purged before stay as they are, so a second run changes nothing."""
    fresh = F.coalesce(which, F.lit(False)) & ~F.col("is_purged")
    stamped = F.col("purged_at") if "purged_at" in job.columns else F.lit(None).cast("timestamp")
    rows = job.withColumn("_fresh", fresh)
    return rows.withColumns({"purged_at": F.when(F.col("_fresh"), now).otherwise(stamped), "result_path": F.when(~F.col("_fresh"), F.col("result_path")), "is_purged": F.col("is_purged") | F.col("_fresh")}).drop("_fresh")


def export_org(job: DataFrame) -> DataFrame:
    """One JSON line per job with its organisation and its place, newest first: written by organisation, no organisation's jobs meet in one value."""
    order = Window.partitionBy("organization_id").orderBy(F.col("created_at").desc(), "id")
    rows = job.withColumn("place", F.row_number().over(order))
    return rows.select("organization_id", "place", F.to_json(F.struct("id", "status", "page_count")).alias("json"))


def retention_info(org: DataFrame) -> DataFrame:
    return org.select("id", "data_retention_days", F.when(F.col("data_retention_days") < 90, "short").otherwise("standard").alias("policy"))


def delete_history(history: DataFrame, detail: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History rows by ``id`` go, and details that name their id or job."""
    gone = history.join(doomed.select("id").distinct(), "id", "left_semi")
    kept = history.join(doomed.select("id").distinct(), "id", "left_anti")
    # Rows without a key meet none; the second key deals them over all tasks, where the first alone would send them to one.
    dealt = lambda c: F.when(F.col(c).isNull(), F.xxhash64(*detail.columns)).otherwise(F.xxhash64(c))
    by = lambda own, c: gone.select(F.col(own).alias(c), F.xxhash64(own).alias("_dealt"))
    by_id = detail.withColumn("_dealt", dealt("history_id")).join(by("id", "history_id"), ["history_id", "_dealt"], "left_anti")
    by_job = by_id.withColumn("_dealt", dealt("job_id")).join(by("job_id", "job_id"), ["job_id", "_dealt"], "left_anti")
    return kept, by_job.select(*detail.columns)


def history_with_detail(history: DataFrame, detail: DataFrame) -> DataFrame:
    """Each history row with its newest detail, by id or by job. Two equal joins and one aggregate stand in for the OR."""
    columns = F.struct("detail_at", "detail_id", "note")
    by_id = detail.filter("history_id is not null").select(F.col("history_id").alias("id"), columns.alias("d"))
    by_job = detail.filter("job_id is not null").select("job_id", columns.alias("d")).join(history.select("id", "job_id"), "job_id").select("id", "d")
    newest = by_id.unionByName(by_job).groupBy("id").agg(F.max("d").alias("d"))
    return history.join(newest, "id", "left").select(*[history[c] for c in history.columns], F.col("d.detail_id").alias("detail_id"), F.col("d.note").alias("note"))


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def org_jobs(org: DataFrame, job: DataFrame, first: int) -> DataFrame:
    """The newest jobs of each organisation, ``first`` of them."""
    rank = F.row_number().over(Window.partitionBy("organization_id").orderBy(F.col("created_at").desc(), "id"))
    newest = job.withColumn("rank", rank).filter(F.col("rank") <= first)
    return newest.join(org.select(F.col("id").alias("organization_id"), "slug"), "organization_id")


def quota_metric(org: DataFrame) -> DataFrame:
    """One row per organisation and kind: its use in percent."""
    pct = lambda k: F.round(100 * F.col(f"usage_{k}_this_month") / F.col(f"quota_{k}_per_month"), 1)
    return org.select(F.col("id").alias("organization_id"), F.stack(F.lit(2), F.lit("pages"), pct("pages"), F.lit("jobs"), pct("jobs")).alias("kind", "pct"))


def user_counts(user: DataFrame) -> DataFrame:
    return user.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(F.col("role") == "admin").alias("admins"), F.count_if((F.col("role") == "operator") & ~F.col("is_active")).alias("pending_operators"))


def search(catalog: DataFrame, words: str | None, kind: str | None = None, active: bool | None = None) -> DataFrame:
    """Templates whose id, name or type contains the words, whatever the case."""
    if words:
        low = words.lower()
        catalog = catalog.filter(F.lower("id").contains(low) | F.lower("name").contains(low) | F.lower("document_type").contains(low))
    catalog = catalog.filter(F.col("document_type") == kind) if kind else catalog
    return catalog.filter(F.col("is_active") == active) if active is not None else catalog


def upsert(catalog: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` stand in for those of equal key; the others stay."""
    return catalog.join(new.select(key), key, "left_anti").unionByName(new)


def flat_record(field: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Valid present values of each document as one JSON object under their output keys, in order of keys; names bound its size."""
    pairs = [x for a, b in keys.items() for x in (F.lit(a), F.lit(b))]
    named = F.coalesce(F.create_map(*pairs)[F.col("name")], F.col("name"))
    good = field.filter(F.col("validated") & (F.coalesce("value", F.lit("")) != "")).select("doc_id", named.alias("key"), "value")
    one = good.groupBy("doc_id", "key").agg(F.max("value").alias("value"))
    rows = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("kv"))
    return rows.select("doc_id", F.array_join(F.transform("kv", lambda s: F.concat_ws("=", s["key"], s["value"])), ";").alias("record"), F.to_json(F.map_from_entries("kv")).alias("json"))


def recommendation(score: DataFrame) -> DataFrame:
    """One advice code per document, by the first rule that fits."""
    advice = F.when(F.col("status") == "failed", "rescan").when(F.col("n_missing") > 0, "complete_fields").when(F.col("global_confidence") < 0.70, "check_values").when(F.col("status") == "review_required", "review").otherwise("accept")
    return score.select("doc_id", advice.alias("advice"))


def assess(score: DataFrame, critical: DataFrame) -> DataFrame:
    """0.60 of the mean, 0.25 of the critical share, 0.10 of coverage, 0.05 of the valid share, and a status by thresholds."""
    rows = score.join(critical, "doc_id")
    total = 0.60 * F.coalesce("quality", F.lit(0.0)) + 0.25 * F.col("critical_share") + 0.10 * F.col("coverage_pct") / 100 + 0.05 * F.col("n_valid") / F.col("n_fields")
    rows = rows.withColumn("business_score", F.round(F.round(total, 9), 4))
    return rows.select("doc_id", "business_score", F.when(F.col("n_present") == 0, "failed").when(F.col("critical_share") < 1, "review_required").when(F.col("business_score") < 0.5, "partial").otherwise("success").alias("assessed"))
