"""Registered queries of the record, scoring and extraction operators, each with SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import datasets, invoices, mrz, records, routing, scoring
from fieldloom.plans import document_queries, field_queries, layout_queries
from fieldloom.plans.tables import plain, table
from fieldloom.streaming import metrics

NOW = "TIMESTAMP '1998-01-01 00:00:00'"
SOURCE_BONUS = {"spatial": 3.0, "zone": 1.5}
CRITICAL = ["invoice_number", "invoice_date", "total_amount"]
PRESENT = "(value IS NOT NULL AND value <> '' AND value <> '[]')"


def now():
    return F.expr(NOW)


def _all() -> dict[str, tuple[str, Callable[[DataFrame], DataFrame], str]]:
    """Name: working table, operator, SQL over that table's name."""
    h, j, f = "history", "job", "field"
    return {
        "visible_history": (h, lambda d: records.visible_history(d, "operator", "7", "u9@mail.test").select("id", "user_id", "status"), "SELECT id, user_id, status FROM history WHERE user_id = '7' OR user_email = 'u9@mail.test'"),
        "list_jobs": (j, lambda d: records.list_jobs(d, status="done").select("id", "organization_id", "page_count"), "SELECT id, organization_id, page_count FROM job WHERE NOT is_purged AND status = 'done'"),
        "active_keys": ("api_key", lambda d: records.active_keys(d, "extract", now()).select("key_prefix", "organization_id"), f"SELECT key_prefix, organization_id FROM api_key WHERE is_active AND (expires_at IS NULL OR expires_at > {NOW}) AND list_contains(list_transform(string_split(scopes, ','), lambda s: trim(s)), 'extract')"),
        "audit_log": ("audit", lambda d: records.audit_log(d, "3", None, 50).select("id", "event_type", "created_at"), "SELECT id, event_type, created_at FROM audit WHERE organization_id = '3' ORDER BY created_at DESC, id LIMIT 50"),
        "dashboard_totals": (h, records.dashboard_totals, "SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'review_required') AS review, count(*) FILTER (status = 'failed') AS failed, round(avg(global_confidence), 4) AS avg_confidence, CAST(floor(avg(processing_time_ms)) AS BIGINT) AS avg_ms FROM history"),
        "by_document_type": (h, records.by_document_type, "SELECT coalesce(document_type, 'unknown') AS document_type, count(*) AS n FROM history GROUP BY 1"),
        "latest_history": (h, lambda d: records.latest(d, 8).select("id", "status", "created_at"), "SELECT id, status, created_at FROM history ORDER BY created_at DESC, id LIMIT 8"),
        "history_stats": (h, records.history_stats, "SELECT count(*) FILTER (regexp_matches(status, 'success|done')) AS ok, count(*) FILTER (regexp_matches(status, 'review|partial')) AS review, count(*) FILTER (regexp_matches(status, 'fail|error')) AS bad, round(avg(global_confidence), 4) AS avg_confidence FROM history"),
        "problem_documents": (h, lambda d: records.problem_documents(d).select("id", "status", "global_confidence"), "SELECT id, status, global_confidence FROM history WHERE regexp_matches(status, 'fail|error|review') OR global_confidence < 0.70"),
        "quota_usage": ("org", records.quota_usage, "SELECT id, greatest(quota_pages_per_month - usage_pages_this_month, 0) AS pages_remaining, round(100 * usage_pages_this_month / quota_pages_per_month, 1) AS pages_pct, greatest(quota_jobs_per_month - usage_jobs_this_month, 0) AS jobs_remaining, round(100 * usage_jobs_this_month / quota_jobs_per_month, 1) AS jobs_pct FROM org"),
        "quota_exceeded": ("org", lambda d: records.quota_exceeded(d, 50).select("id", "pages_remaining"), "SELECT id, greatest(quota_pages_per_month - usage_pages_this_month, 0) AS pages_remaining FROM org WHERE greatest(quota_pages_per_month - usage_pages_this_month, 0) < 50"),
        "monthly_usage": (j, lambda d: records.monthly_usage(d).withColumn("month", F.date_format("month", "yyyy-MM")), "SELECT organization_id, strftime(created_at, '%Y-%m') AS month, CAST(sum(page_count) AS BIGINT) AS pages, count(*) AS jobs FROM job GROUP BY 1, 2"),
        "extraction_counts": (h, records.extraction_counts, "SELECT template_id, engine_used, status, count(*) AS n FROM history GROUP BY 1, 2, 3"),
        "duration_histogram": (h, lambda d: records.histogram(d, "processing_time_ms", [500, 1000, 2000, 5000, 10000, 30000, 60000]), " UNION ALL ".join(f"SELECT CAST({e} AS DOUBLE) AS le, count(*) FILTER (processing_time_ms <= {e}) AS n FROM history" for e in (500, 1000, 2000, 5000, 10000, 30000, 60000)) + " UNION ALL SELECT CAST('inf' AS DOUBLE), count(processing_time_ms) FROM history"),
        "duration_quantiles": (h, records.duration_quantiles, "SELECT template_id, quantile_cont(CAST(processing_time_ms AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(processing_time_ms AS DOUBLE), 0.95) AS p95, quantile_cont(CAST(processing_time_ms AS DOUBLE), 0.99) AS p99 FROM history GROUP BY 1"),
        "field_outcomes": (f, records.field_outcomes, "SELECT name, CASE WHEN coalesce(value, '') = '' THEN 'missing' WHEN NOT validated THEN 'invalid' ELSE 'found' END AS outcome, count(*) AS n FROM field GROUP BY 1, 2"),
        "avg_confidence_pct": (h, records.avg_confidence_pct, "SELECT round(100 * avg(m), 4) AS pct FROM (SELECT avg(global_confidence) AS m FROM history GROUP BY template_id, engine_used)"),
        "anonymize_audit": ("audit", lambda d: records.anonymize_audit(d, F.expr("TIMESTAMP '2024-06-01 00:00:00'")), "SELECT id, CASE WHEN old THEN 'anon_' || translate(base64(unhex(substr(sha256(ip_address), 1, 24))), '+/', '-_') ELSE ip_address END AS ip_address, CASE WHEN old THEN '***' ELSE api_key_prefix END AS api_key_prefix, CASE WHEN NOT old THEN details END AS details, is_anonymized OR old AS is_anonymized FROM (SELECT *, NOT is_anonymized AND created_at < TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 30 DAY AS old FROM audit)"),
        "document_scores": (f, scoring.document_scores, f"""
            SELECT *, CASE WHEN n_present = 0 THEN 'failed' WHEN review_required THEN 'review_required' WHEN n_missing > 0 THEN 'partial' ELSE 'success' END AS status FROM (
            SELECT doc_id, CAST(round(CAST(sum(weight * CASE WHEN {PRESENT} THEN confidence ELSE 0.0 END) / sum(weight) AS DECIMAL(18,9)), 4) AS DOUBLE) AS global_confidence, CAST(round(CAST(avg(CASE WHEN {PRESENT} THEN confidence END) AS DECIMAL(18,9)), 4) AS DOUBLE) AS quality,
                   count(*) AS n_fields, count(*) FILTER {PRESENT} AS n_present, round(100.0 * count(*) FILTER {PRESENT} / count(*), 1) AS coverage_pct, count(*) FILTER ({PRESENT} AND validated) AS n_valid,
                   bool_or(review_required OR (critical AND confidence < 0.78)) AS review_required, count(*) FILTER (required AND NOT {PRESENT}) AS n_missing
            FROM field GROUP BY doc_id)"""),
        "weak_fields": (f, lambda d: scoring.weak_fields(d).select("doc_id", "name", "value", "confidence"), f"SELECT doc_id, name, value, confidence FROM field WHERE {PRESENT} AND (confidence < 0.70 OR NOT validated)"),
        "missing_critical": (f, lambda d: scoring.missing_critical(d, CRITICAL), f"SELECT doc_id, name FROM (SELECT DISTINCT doc_id FROM field), (SELECT unnest({CRITICAL}) AS name) EXCEPT SELECT doc_id, name FROM field WHERE {PRESENT}"),
        "rank_candidates": ("candidate", lambda d: scoring.rank_candidates(d, SOURCE_BONUS), """
            SELECT doc_id, field, value, n, round(score, 4) AS score, engines, rank, round(score - lead(score) OVER w, 4) AS gap FROM (
              SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, n DESC, mean DESC, value) AS INT) AS rank FROM (
                SELECT doc_id, field, value, count(*) AS n, avg(avg_conf) AS mean, string_agg(DISTINCT engine, '+' ORDER BY engine) AS engines,
                       7 * count(*) + avg(avg_conf) + max(CASE source WHEN 'spatial' THEN 3.0 WHEN 'zone' THEN 1.5 ELSE 0.0 END) AS score
                FROM candidate GROUP BY 1, 2, 3)) WINDOW w AS (PARTITION BY doc_id, field ORDER BY rank)"""),
        "resolve_fields": ("candidate", lambda d: scoring.resolve_fields(scoring.rank_candidates(d, SOURCE_BONUS)), """
            SELECT doc_id, field, value, round(score, 4) AS score, coalesce(round(score - next, 4) < 0.02, false) AS ambiguous FROM (
              SELECT *, row_number() OVER w AS r, lead(score) OVER w AS next FROM (
                SELECT doc_id, field, value, count(*) AS n, avg(avg_conf) AS mean, 7 * count(*) + avg(avg_conf) + max(CASE source WHEN 'spatial' THEN 3.0 WHEN 'zone' THEN 1.5 ELSE 0.0 END) AS score
                FROM candidate GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY doc_id, field ORDER BY score DESC, n DESC, mean DESC, value)) WHERE r = 1"""),
        "merge_fields": (f, lambda d: scoring.merge_fields(d.filter("doc_id % 3 <> 0").select("doc_id", "name", "value", "confidence", "validated"), d.filter("doc_id % 2 = 0").select("doc_id", "name", F.concat("value", F.lit("*")).alias("value"), (F.col("confidence") * 0.5 + 0.3).alias("confidence"), (~F.col("validated")).alias("validated"))).withColumn("confidence", F.round("confidence", 4)), f"""
            SELECT doc_id, name, value, round(confidence, 4) AS confidence, validated, run FROM (
              SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY coalesce(validated AND {PRESENT}, false) DESC, coalesce({PRESENT}, false) DESC, confidence DESC, run, value DESC) AS r FROM (
                SELECT doc_id, name, value, confidence, validated, 1 AS run FROM field WHERE doc_id % 3 <> 0
                UNION ALL SELECT doc_id, name, value || '*', confidence * 0.5 + 0.3, NOT validated, 2 FROM field WHERE doc_id % 2 = 0)) WHERE r = 1"""),
        "class_metrics": ("prediction", scoring.class_metrics, """
            SELECT c AS class, CAST(count(*) FILTER (actual = c) AS BIGINT) AS support, round(count(*) FILTER (actual = c AND predicted = c) / greatest(count(*) FILTER (predicted = c), 1), 4) AS precision,
                   round(count(*) FILTER (actual = c AND predicted = c) / greatest(count(*) FILTER (actual = c), 1), 4) AS recall, round(2 * count(*) FILTER (actual = c AND predicted = c) / greatest(count(*) FILTER (actual = c) + count(*) FILTER (predicted = c), 1), 4) AS f1
            FROM prediction, (SELECT DISTINCT actual AS c FROM prediction) GROUP BY c"""),
        "confusion_matrix": ("prediction", lambda d: scoring.confusion_matrix(d, ["A", "N", "R"]), "SELECT actual, count(*) FILTER (predicted = 'A') AS A, count(*) FILTER (predicted = 'N') AS N, count(*) FILTER (predicted = 'R') AS R FROM prediction GROUP BY 1"),
        "misclassified": ("prediction", lambda d: d.filter("actual <> predicted").select("item_id", "actual", "predicted", "confidence"), "SELECT item_id, actual, predicted, confidence FROM prediction WHERE actual <> predicted"),
        "family_summary": ("case_result", scoring.family_summary, """
            SELECT coalesce(family, 'all') AS family, count(*) AS cases, count(*) FILTER (http_ok) AS http_ok, count(*) FILTER (in_scope) AS in_scope, count(*) FILTER (template_ok) AS template_ok,
                   count(*) FILTER (critical_valid_count >= critical_total AND in_scope) AS critical_pass, count(*) FILTER (in_scope = (critical_valid_count >= critical_total)) AS scope_correct,
                   count(*) FILTER (api_status = 'success') AS auto_success, round(avg(processing_time_ms), 2) AS avg_ms,
                   round(count(*) FILTER (critical_valid_count >= critical_total AND in_scope) / greatest(count(*) FILTER (in_scope), 1), 4) AS pass_rate
            FROM case_result GROUP BY ROLLUP (family)"""),
        "field_prf": (f, lambda d: scoring.field_prf(d.select(F.col("doc_id").alias("case_id"), "name", F.concat(F.lit("N"), F.regexp_replace("value", "^[A-Z]", "")).alias("expected")), d.filter("confidence > 0.2").select(F.col("doc_id").alias("case_id"), "name", "value")), f"""
            SELECT name, tp, fp, fn, round(tp / greatest(tp + fp, 1), 3) AS precision, round(tp / greatest(tp + fn, 1), 3) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 3) AS f1 FROM (
              SELECT name, count(*) FILTER (there AND expected = lower(value)) AS tp, count(*) FILTER (there AND expected <> lower(value)) AS fp, count(*) FILTER (NOT there) AS fn FROM (
                SELECT e.name, lower('N' || regexp_replace(e.value, '^[A-Z]', '')) AS expected, a.value, coalesce(a.value <> '' AND a.value <> '[]', false) AS there
                FROM field e LEFT JOIN (SELECT * FROM field WHERE confidence > 0.2) a ON e.doc_id = a.doc_id AND e.name = a.name) GROUP BY name)"""),
        "invoice_results": ("invoice_text", invoices.invoice_results, _INVOICE),
        "invoice_fields": ("invoice_text", invoices.invoice_fields, f"""
            SELECT doc_id, 'invoice_number' AS name, regexp_extract(raw_text, 'N° ([A-Z0-9-]+)', 1) AS value, CAST(0.95 AS DOUBLE) AS confidence FROM invoice_text
            UNION ALL SELECT doc_id, 'customer', regexp_extract(raw_text, 'Client: ([^\\n]+)', 1), 0.95 FROM invoice_text
            UNION ALL SELECT doc_id, 'invoice_date', strftime({_DATE}, '%Y-%m-%d'), 0.95 FROM invoice_text
            UNION ALL SELECT doc_id, 'total_ht', CAST({_AMOUNT.format('Total HT')} AS VARCHAR), 0.95 FROM invoice_text
            UNION ALL SELECT doc_id, 'vat', CAST({_AMOUNT.format('TVA 19%')} AS VARCHAR), 0.95 FROM invoice_text
            UNION ALL SELECT doc_id, 'total_ttc', CAST({_AMOUNT.format('Total TTC')} AS VARCHAR), 0.95 FROM invoice_text"""),
    }


_DATE = "make_date(CAST(regexp_extract(raw_text, 'Date: (\\d+)/(\\d+)/(\\d+)', 3) AS INT), CAST(regexp_extract(raw_text, 'Date: (\\d+)/(\\d+)/(\\d+)', 2) AS INT), CAST(regexp_extract(raw_text, 'Date: (\\d+)/(\\d+)/(\\d+)', 1) AS INT))"
_AMOUNT = "CAST(replace(regexp_extract(raw_text, '{}: ([0-9,]+)', 1), ',', '.') AS DECIMAL(18,3))"
_INVOICE = f"""
    SELECT doc_id, invoice_number, invoice_date, customer, CAST(ht AS DOUBLE) AS total_ht, CAST(v AS DOUBLE) AS vat, CAST(ttc AS DOUBLE) AS total_ttc,
           CASE WHEN ttc - ht - v BETWEEN 0 AND 5 THEN CAST(ttc - ht - v AS DOUBLE) END AS stamp, abs(ht + v + CASE WHEN ttc - ht - v BETWEEN 0 AND 5 THEN ttc - ht - v ELSE 0 END - ttc) <= 0.010 AS consistent
    FROM (SELECT doc_id, regexp_extract(raw_text, 'N° ([A-Z0-9-]+)', 1) AS invoice_number, strftime({_DATE}, '%Y-%m-%d') AS invoice_date, regexp_extract(raw_text, 'Client: ([^\\n]+)', 1) AS customer,
                 {_AMOUNT.format('Total HT')} AS ht, {_AMOUNT.format('TVA 19%')} AS v, {_AMOUNT.format('Total TTC')} AS ttc FROM invoice_text)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text.clean_text(_documents(spark, sf_dir), "text", ["clean_ocr_noise", "normalize_french"], "clean")
    return docs.select("doc_id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("bigint").alias("n_clean"), text.dominant_script(F.col("clean")).alias("script"))


def text_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.slugify(F.col("source")).alias("slug"), text.digits_only(F.col("source")).alias("digits"), text.key_hash(F.col("text")).alias("hash"))


def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.rate_limit_windows(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts"), 1, 1)


def expired_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.expired_jobs(table(spark, sf_dir, "job"), table(spark, sf_dir, "org"), now()).select("id", "organization_id")


def purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.purge_expired(table(spark, sf_dir, "job"), table(spark, sf_dir, "org"), now())
    return rows.select("id", "is_purged", "result_path", F.col("purged_at").isNotNull().alias("stamped"))


def mrz_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mrz.mrz_parse(table(spark, sf_dir, "mrz_text"), F.lit(2025))


#: Check digits of ``mrz_text`` are rendered from the key, so some hold and most do not.
_DIGIT = "(SELECT sum(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE 0 END * CASE i % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END) FROM (SELECT substr({0}, i + 1, 1) AS c, i FROM (SELECT unnest(range({1})) AS i))) % 10"
_MRZ = f"""
    SELECT doc_id, trim(translate(regexp_extract(substr(line1, 6), '^(.*?)<<', 1), '<', ' ')) AS surname, trim(translate(regexp_extract(substr(line1, 6), '<<(.*?)<*$', 1), '<', ' ')) AS given_names,
           trim(translate(substr(line2, 1, 9), '<', ' ')) AS document_number, trim(translate(substr(line2, 11, 3), '<', ' ')) AS nationality,
           CAST(CASE WHEN CAST(substr(line2, 14, 2) AS INT) > 25 THEN '19' ELSE '20' END || substr(line2, 14, 2) || '-' || substr(line2, 16, 2) || '-' || substr(line2, 18, 2) AS VARCHAR) AS birth_date,
           '20' || substr(line2, 22, 2) || '-' || substr(line2, 24, 2) || '-' || substr(line2, 26, 2) AS expiry_date, nullif(substr(line2, 21, 1), '<') AS sex,
           a = CAST(substr(line2, 10, 1) AS INT) AS document_number_ok, b = CAST(substr(line2, 20, 1) AS INT) AS birth_date_ok, c = CAST(substr(line2, 28, 1) AS INT) AS expiry_date_ok,
           a = CAST(substr(line2, 10, 1) AS INT) AND b = CAST(substr(line2, 20, 1) AS INT) AND c = CAST(substr(line2, 28, 1) AS INT) AND d = CAST(substr(line2, 44, 1) AS INT) AS valid
    FROM (SELECT *, {_DIGIT.format("substr(line2, 1, 9)", 9)} AS a, {_DIGIT.format("substr(line2, 14, 6)", 6)} AS b, {_DIGIT.format("substr(line2, 22, 6)", 6)} AS c,
                 {_DIGIT.format("(substr(line2, 1, 10) || substr(line2, 14, 7) || substr(line2, 22, 22))", 39)} AS d FROM mrz_text)"""

KEYWORDS = {"license": {"licensed": 2.0, "license": 1.0}, "contact": {"@": 2.0, "+1 (": 1.5}, "english": {" the ": 1.0, " and ": 1.0}, "french": {" le ": 1.0, " de ": 1.0}}


def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.detect_type(_documents(spark, sf_dir), KEYWORDS)


def _keyword_sql() -> str:
    sums = {k: " + ".join(f"CASE WHEN contains(t, '{w}') THEN {x} ELSE 0 END" for w, x in words.items()) for k, words in KEYWORDS.items()}
    columns = ", ".join(f"CAST({v} AS DOUBLE) AS s{i}" for i, v in enumerate(sums.values()))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(sums))) + ")"
    kind = "CASE WHEN b = 0 THEN NULL " + " ".join(f"WHEN s{i} = b THEN '{k}'" for i, k in enumerate(sums)) + " END"
    return f"SELECT doc_id, {kind} AS document_type, b AS score, least(b / 4, 1.0) AS confidence FROM (SELECT *, {best} AS b FROM (SELECT doc_id, {columns} FROM (SELECT doc_id, lower(text) AS t FROM documents)))"


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.label_index(_documents(spark, sf_dir), "lang")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups on both sides of a split: none; with the sources' number."""
    sides = datasets.group_split(_documents(spark, sf_dir), "source", 0.8).groupBy("source").agg(F.countDistinct("split").alias("sides"))
    return sides.agg(F.count("*").alias("n_groups"), F.count_if(F.col("sides") > 1).alias("leaked"))


def metric_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.metric_windows(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour")
    return rows.select(F.date_format("begin", "yyyy-MM-dd HH:mm").alias("begin"), "event_type", "n", "per_second")


_WITH_TABLES = {
    "mrz_fields": (mrz_fields, ["mrz_text"], _MRZ),
    "detect_type": (detect_type, [], _keyword_sql()),
    "label_index": (label_index, [], "SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INT) AS index FROM (SELECT DISTINCT lang FROM documents)"),
    "split_leakage": (split_leakage, [], "SELECT count(DISTINCT source) AS n_groups, CAST(0 AS BIGINT) AS leaked FROM documents"),
    "metric_windows": (metric_windows, [], "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS begin, event_type, count(*) AS n, count(*) / 3600 AS per_second FROM events GROUP BY 1, 2"),
    "clean_text": (clean_text, [], r"""
        SELECT doc_id, md5(clean) AS clean_md5, CAST(length(clean) AS BIGINT) AS n_clean,
               CASE WHEN len(regexp_extract_all(clean, '[\x{0600}-\x{06FF}]+')) > len(regexp_extract_all(clean, '[A-Za-z]+')) THEN 'arabic' ELSE 'latin' END AS script
        FROM (SELECT doc_id, trim(regexp_replace(translate(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[_=~-]{3,}', ' ', 'g'), '\.{3,}', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?(\n ?)+', chr(10) || chr(10), 'g'), ' '), '‘’“”«»–—', repeat(chr(39), 2) || repeat(chr(34), 4) || '--'), '[ \t\x{00A0}]+', ' ', 'g'), ' ') AS clean FROM documents)"""),
    "text_slugs": (text_slugs, [], "SELECT doc_id, regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(source, '[^0-9]', '', 'g') AS digits, sha256(text) AS hash FROM documents"),
    "rate_limit_windows": (rate_limit_windows, [], "SELECT event_id, user_id, n, greatest(2 - n, 0) AS remaining, n <= 2 AS allowed FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS n FROM events)"),
    "expired_jobs": (expired_jobs, ["job", "org"], f"SELECT job.id, organization_id FROM job JOIN org ON organization_id = org.id WHERE NOT is_purged AND created_at < {NOW} - to_days(data_retention_days)"),
    "purge_expired": (purge_expired, ["job", "org"], f"SELECT id, is_purged OR gone AS is_purged, CASE WHEN NOT gone THEN result_path END AS result_path, gone AS stamped FROM (SELECT job.*, NOT is_purged AND coalesce(created_at < {NOW} - to_days(data_retention_days), false) AS gone FROM job LEFT JOIN org ON organization_id = org.id)"),
}


QUERIES = field_queries.QUERIES | document_queries.QUERIES | layout_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda spark, sf_dir, t=t, op=op: op(table(spark, sf_dir, t))) for name, (t, op, _) in _all().items()}
    return found | {name: f for name, (f, _, _) in (_WITH_TABLES | QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    found = {name: f"WITH {t} AS ({plain(t)}) {sql}" for name, (t, _, sql) in _all().items()}
    for name, (_, used, sql) in _WITH_TABLES.items():
        found[name] = ("WITH " + ", ".join(f"{t} AS ({plain(t)})" for t in used) + " " if used else "") + sql
    for name, (_, used, sql) in QUERIES.items():
        if sql is not None:
            ctes = [f"{t} AS ({plain(t)})" for t in used]
            starts = sql.lstrip().upper().startswith("SELECT")
            found[name] = ("WITH " + ", ".join(ctes) + (" " if starts else ", ") if ctes else "") + sql
    scores, critical = found["document_scores"], found["critical_pass"]
    found["recommendations"] = f"""WITH s AS ({scores}) SELECT doc_id, CASE WHEN status = 'failed' THEN 'rescan' WHEN n_missing > 0 THEN 'complete_fields' WHEN global_confidence < 0.70 THEN 'check_values'
        WHEN status = 'review_required' THEN 'review' ELSE 'accept' END AS advice FROM s"""
    found["assess_documents"] = f"""WITH s AS ({scores}), c AS ({critical}), b AS (SELECT s.doc_id, n_present, c.n_valid / 3 AS share,
        round(CAST(0.60 * coalesce(quality, 0) + 0.25 * (c.n_valid / 3) + 0.10 * coverage_pct / 100 + 0.05 * s.n_valid / n_fields AS DECIMAL(18,9)), 4) AS score FROM s JOIN c ON s.doc_id = c.doc_id)
        SELECT doc_id, CAST(score AS DOUBLE) AS business_score, CASE WHEN n_present = 0 THEN 'failed' WHEN share < 1 THEN 'review_required' WHEN score < 0.5 THEN 'partial' ELSE 'success' END AS assessed FROM b"""
    return found
