"""The training-data pipeline: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and keeps the columns of documents, but for the last, whose rows are packed pieces. Columns beside
doc_id and text come through as they are, whatever their names; null texts read as empty ones; texts of any length are read whole; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import jaccard_join, packing, quality_rules, toxicity
from fieldloom.llm.common import read_table, staged, text_of
from fieldloom.llm.queries import held_out, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; empty ones go. Repeated rows stay or go together."""
    return quality_rules.judge(docs).filter("kept").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. Labels of held-out rows teach nothing; without labels of both kinds all stay."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.score(docs, model).filter("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class one row stays: of its least doc_id, null last, and then of the least text key. Where rows are equal in
    both, they differ in other columns only, and any one stays."""
    _, known = jaccard_join.text_classes(docs)
    kept = known.filter("key = class_key").select("key", "text_id")
    rows = docs.select(F.struct("*").alias("row"))
    keyed = rows.withColumn("own", jaccard_join.key_of(text_of("row.text")))
    named = keyed.join(kept, (F.col("own") == F.col("key")) & F.col("row.doc_id").eqNullSafe(F.col("text_id")), "left_semi")
    return named.dropDuplicates(["own"]).select("row.*")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; repeated rows and null doc_ids are packed each for itself."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [("quality rules", keep_quality), ("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_duplicates), ("packing", pack_tokens)]

#: No SQL expresses the tokenizer of the last stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


