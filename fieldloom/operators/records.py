"""Filters and analytics over history, jobs, organisations, keys and audit rows: one pass each, aggregates before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.text import pseudonym


def visible_history(history: DataFrame, role: str, user_id: str | None = None, email: str | None = None) -> DataFrame:
    """Admins see all, operators and simple users their own by id or email, others nothing."""
    if role == "admin":
        return history
    if role in ("operator", "simple_user"):
        return history.filter((F.col("user_id") == user_id) | (F.col("user_email") == email))
    return history.filter(F.lit(False))


def list_jobs(job: DataFrame, organization_id: str | None = None, status: str | None = None) -> DataFrame:
    job = job.filter(~F.col("is_purged"))
    job = job.filter(F.col("organization_id") == organization_id) if organization_id is not None else job
    return job.filter(F.col("status") == status) if status is not None else job


def active_keys(key: DataFrame, scope: str, now: Column) -> DataFrame:
    scopes = F.transform(F.split("scopes", ","), lambda s: F.trim(s))
    return key.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & F.array_contains(scopes, scope))


def audit_log(audit: DataFrame, organization_id: str | None = None, event_type: str | None = None, n: int = 100) -> DataFrame:
    audit = audit.filter(F.col("organization_id") == organization_id) if organization_id else audit
    audit = audit.filter(F.col("event_type") == event_type) if event_type else audit
    return audit.orderBy(F.col("created_at").desc(), "id").limit(n)


def dashboard_totals(history: DataFrame) -> DataFrame:
    """Counts by status, and averages: confidence to four places, milliseconds cut to whole ones."""
    by = lambda s: F.count_if(F.col("status") == s)
    return history.agg(
        F.count("*").alias("total"),
        by("success").alias("success"),
        by("review_required").alias("review"),
        by("failed").alias("failed"),
        F.round(F.avg("global_confidence"), 4).alias("avg_confidence"),
        F.floor(F.avg("processing_time_ms")).cast("bigint").alias("avg_ms"),
    )


def by_document_type(history: DataFrame) -> DataFrame:
    return history.groupBy(F.coalesce("document_type", F.lit("unknown")).alias("document_type")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "document_type")


def latest(history: DataFrame, n: int = 8) -> DataFrame:
    """The n latest rows, as many as are asked for; of equal times the least id first."""
    return history.orderBy(F.col("created_at").desc(), "id").limit(n)


def history_stats(history: DataFrame) -> DataFrame:
    """Status by what it contains; confidences above one are read as percent."""
    c = F.col("global_confidence")
    has = lambda p: F.count_if(F.col("status").rlike(p))
    share = F.when(c > 1, c / 100).otherwise(c)
    return history.agg(has("success|done").alias("ok"), has("review|partial").alias("review"), has("fail|error").alias("bad"), F.round(F.avg(share), 4).alias("avg_confidence"))


def problem_documents(history: DataFrame) -> DataFrame:
    return history.filter(F.col("status").rlike("fail|error|review") | (F.col("global_confidence") < 0.70))


def quota_usage(org: DataFrame) -> DataFrame:
    def left(kind: str) -> list[Column]:
        quota, used = F.col(f"quota_{kind}_per_month"), F.col(f"usage_{kind}_this_month")
        return [F.greatest(quota - used, F.lit(0)).alias(f"{kind}_remaining"), F.round(100 * used / quota, 1).alias(f"{kind}_pct")]

    return org.select("id", *left("pages"), *left("jobs"))


def quota_exceeded(org: DataFrame, pages: int) -> DataFrame:
    return quota_usage(org).filter(F.col("pages_remaining") < pages)


def monthly_usage(job: DataFrame) -> DataFrame:
    return job.groupBy("organization_id", F.date_trunc("month", "created_at").alias("month")).agg(F.sum("page_count").alias("pages"), F.count("*").alias("jobs"))


def extraction_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("template_id", "engine_used", "status").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Cumulative counts at or below each edge, and of all rows, in one pass."""
    counts = df.agg(*[F.count_if(F.col(value) <= e).alias(str(i)) for i, e in enumerate(edges)], F.count(value).alias("all"))
    rows = F.array(*[F.struct(F.lit(float(e)).alias("le"), F.col(str(i)).alias("n")) for i, e in enumerate(edges)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return counts.select(F.inline(rows))


def duration_quantiles(history: DataFrame, exact: bool = True) -> DataFrame:
    pick = F.percentile if exact else F.percentile_approx
    at = lambda p: pick("processing_time_ms", F.lit(p)).cast("double")
    return history.groupBy("template_id").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def field_outcomes(field: DataFrame) -> DataFrame:
    outcome = F.when(F.coalesce("value", F.lit("")) == "", "missing").when(~F.col("validated"), "invalid").otherwise("found")
    return field.groupBy("name", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def avg_confidence_pct(history: DataFrame) -> DataFrame:
    """The mean of each series' mean, in percent."""
    series = history.groupBy("template_id", "engine_used").agg(F.avg("global_confidence").alias("m"))
    return series.agg(F.round(100 * F.avg("m"), 4).alias("pct"))


#: Milliseconds of a slice of a key's events, and of the window before each event.
SLICE, REACH = 600_000, 60_000


def rate_limit_windows(events: DataFrame, rpm: int, burst: int) -> DataFrame:
    """Requests of the key in the last 60 seconds (now - 60 s, now], what remains of the limit, and whether it is allowed.

    A key's events are cut into slices of time, each with a copy of the minute before it, so one busy key is many tasks' work."""
    rows = events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("own", F.floor(F.col("ms") / SLICE))
    late = F.pmod("ms", F.lit(SLICE)) > SLICE - REACH
    rows = rows.withColumn("slice", F.explode(F.when(late, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    n = F.count("*").over(Window.partitionBy("user_id", "slice").orderBy("ms").rangeBetween(1 - REACH, 0))
    rows = rows.withColumn("n", n).filter(F.col("slice").eqNullSafe(F.col("own")))
    return rows.select("event_id", "user_id", "n", F.greatest(F.lit(rpm + burst) - F.col("n"), F.lit(0)).alias("remaining"), (F.col("n") <= rpm + burst).alias("allowed"))


def expired_jobs(job: DataFrame, org: DataFrame, now: Column) -> DataFrame:
    days = org.select(F.col("id").alias("organization_id"), "data_retention_days")
    cut = now - F.make_dt_interval(F.col("data_retention_days"))
    return job.filter(~F.col("is_purged")).join(days, "organization_id").filter(F.col("created_at") < cut)


def purge_expired(job: DataFrame, org: DataFrame, now: Column) -> DataFrame:
    """The job table with expired rows flagged, stamped and without their path."""
    days = org.select(F.col("id").alias("organization_id"), "data_retention_days")
    gone = ~F.col("is_purged") & F.coalesce(F.col("created_at") < now - F.make_dt_interval(F.col("data_retention_days")), F.lit(False))
    rows = job.join(days, "organization_id", "left").withColumn("gone", gone)
    kept = [c for c in job.columns if c not in ("is_purged", "result_path")]
    return rows.select(*kept, (F.col("is_purged") | F.col("gone")).alias("is_purged"), F.when(~F.col("gone"), F.col("result_path")).alias("result_path"), F.when(F.col("gone"), now).alias("purged_at"))


def anonymize_audit(audit: DataFrame, now: Column, days: int = 30) -> DataFrame:
    old = ~F.col("is_anonymized") & (F.col("created_at") < now - F.make_dt_interval(F.lit(days)))
    return audit.withColumn("_old", old).select(
        "id",
        F.when(F.col("_old"), pseudonym(F.col("ip_address"))).otherwise(F.col("ip_address")).alias("ip_address"),
        F.when(F.col("_old"), "***").otherwise(F.col("api_key_prefix")).alias("api_key_prefix"),
        F.when(~F.col("_old"), F.col("details")).alias("details"),
        (F.col("is_anonymized") | F.col("_old")).alias("is_anonymized"),
    )
