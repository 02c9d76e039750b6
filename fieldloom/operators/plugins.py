"""Extractors by document family, rules as tables, and the jobs that run them over tables, folders and nights.

An extractor is a function from (doc_id, raw_text) to (doc_id, name, value, confidence, validated); ``extract`` gives each document to the
first one that takes its family and variant. Rules as a table are joined by type, so a new rule is a new row, not a new plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import extraction, identity, invoices, passports, records, registry
from fieldloom.operators.extraction import Rule

COLUMNS = ["doc_id", "name", "value", "confidence", "validated"]


@dataclass(frozen=True)
class Extractor:
    name: str
    families: tuple[str, ...]
    fields: Callable[[DataFrame], DataFrame]
    variant: str | None = None

    def takes(self, family: Column, variant: Column) -> Column:
        """Whether a document of this family and variant (null: any) is its own."""
        fits = F.coalesce(family.isin(*self.families), F.lit(False))
        return fits & F.coalesce(variant.contains(self.variant), F.lit(False)) if self.variant else fits


def default_extractors(this_year: int) -> list[Extractor]:
    year = F.lit(this_year)
    return [
        Extractor("passport", ("id_document",), lambda d: passports.passport_fields(d, year), "passport"),
        Extractor("identity_card", ("id_document",), lambda d: identity.identity_card(d, year)),
        Extractor("registry", ("business_registry", "registre_commerce"), registry.registry_fields),
        Extractor("invoice", ("invoice",), lambda d: invoices.invoice_fields(d).withColumn("validated", F.col("value").isNotNull())),
    ]


def extract(doc: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """doc_id, extractor, name, value, confidence, validated from doc_id, raw_text, family, variant; documents that none takes give no row."""
    out, taken = None, F.lit(False)
    for e in extractors:
        own = e.takes(F.col("family"), F.col("variant"))
        rows = e.fields(doc.filter(own & ~taken).select("doc_id", "raw_text")).select(F.lit(e.name).alias("extractor"), *COLUMNS)
        taken = taken | own
        out = rows if out is None else out.unionByName(rows)
    return out.select("doc_id", "extractor", *COLUMNS[1:])


#: Rules for documents whose template has none, by type.
FALLBACK_RULES = {
    "invoice": [Rule("invoice_number", patterns=(r"(?i)facture\s*n[°o]?\s*:?\s*([A-Z0-9][A-Z0-9/-]+)",), required=True), Rule("invoice_date", patterns=(r"(?i)date\s*:?\s*(\d{1,2}[/.-]\d{1,2}[/.-]\d{4})",), kind="date", required=True), Rule("total_amount", patterns=(r"(?i)total\s*t\.?t\.?c\.?\s*:?\s*([0-9][0-9.,]*)",), kind="number")],
    "identity": [Rule("id_number", patterns=(r"(?<!\d)(\d{8})(?!\d)",), check=r"^\d{8}$", required=True), Rule("last_name", anchors=("nom",), no_digits=True), Rule("birth_date", anchors=("naissance",), kind="date")],
}


def extract_or_fallback(doc: DataFrame, document_type: str, rules: list[Rule] | None) -> DataFrame:
    """By the template's rules, or by the type's own where it has none."""
    return extraction.extract_fields(doc, rules or FALLBACK_RULES[document_type])


def extract_by_rule_table(doc: DataFrame, rule: DataFrame) -> DataFrame:
    """doc_id, name, value, place from doc_id, document_type, raw_text and rules (document_type, name, place, pattern): of each name the rule of
    the least place that matches; its first group. A type's rules meet its documents as one array, so a document is read once."""
    by_type = rule.groupBy("document_type").agg(F.array_sort(F.collect_list(F.struct("name", "place", "pattern"))).alias("rules"))
    rows = doc.select("doc_id", "document_type", F.coalesce("raw_text", F.lit("")).alias("_text")).join(by_type, "document_type")
    found = F.transform("rules", lambda r: F.struct(r["name"].alias("name"), r["place"].alias("place"), F.nullif(F.trim(F.call_function("regexp_extract", F.col("_text"), r["pattern"], F.lit(1))), F.lit("")).alias("value")))
    hits = rows.select("doc_id", F.inline(F.filter(found, lambda x: x["value"].isNotNull())))
    return hits.groupBy("doc_id", "name").agg(F.min_by(F.struct("value", "place"), F.struct("place", "value")).alias("b")).select("doc_id", "name", "b.value", "b.place")


def maintain(job: DataFrame, org: DataFrame, audit: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nightly work: jobs with the expired purged, the audit trail with old entries anonymised, organisations with their day's counts set back."""
    return records.purge_expired(job, org, now), records.anonymize_audit(audit, now), org.withColumn("usage_jobs_this_month", F.when(F.dayofmonth(now) == 1, 0).otherwise(F.col("usage_jobs_this_month")))


def with_outcome(doc: DataFrame, field: DataFrame) -> DataFrame:
    """doc_id, n_valid, error: null where some field is valid, else why the document goes to the error folder."""
    counts = field.groupBy("doc_id").agg(F.count_if("validated").alias("n_valid"))
    rows = doc.select("doc_id", F.trim(F.coalesce("raw_text", F.lit(""))).alias("_text")).join(counts, "doc_id", "left").fillna(0, ["n_valid"])
    return rows.select("doc_id", "n_valid", F.when(F.col("_text") == "", "empty").when(F.col("n_valid") == 0, "no_valid_field").alias("error"))


def extract_stream(source: DataFrame, extractors: list[Extractor], folder: str, write: Callable[[DataFrame, str, int], None]):
    """A stream writer (start it with a checkpoint) that extracts each batch of documents and routes their outcomes by ``write``."""
    def one(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        write(with_outcome(kept, extract(kept, extractors)), folder, number)
        kept.unpersist()

    return source.writeStream.foreachBatch(one)
