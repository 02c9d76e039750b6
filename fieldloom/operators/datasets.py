"""Data-set preparation: leak-free splits, labels, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_split(item: DataFrame, group: str, ratio: float, seed: int = 42) -> DataFrame:
    """``split`` is train or val; all rows of a group are on one side, by the group's hash, so no shuffle is needed."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(group).cast("string")), F.lit(1_000_000)) / 1_000_000
    return item.withColumn("split", F.when(share < ratio, "train").otherwise("val"))


def label_index(item: DataFrame, label: str) -> DataFrame:
    """Distinct labels in order with numbers from 0; there are few of them."""
    return item.select(label).distinct().withColumn("index", F.row_number().over(Window.orderBy(label)) - 1)


def normalised_box(region: DataFrame) -> DataFrame:
    """x, y, w, h in pixels to shares of the image, six places."""
    part = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return region.filter((F.col("w") > 0) & (F.col("h") > 0)).withColumn("bbox_norm", F.array(part("x", "width"), part("y", "height"), part("w", "width"), part("h", "height")))


def field_type(region: DataFrame) -> DataFrame:
    """The type of a field by its name."""
    low = F.lower("field_name")
    kind = F.when(low.rlike("photo|face|signature"), "image").when(low.rlike("date|birth|expir"), "date").when(low.contains("mrz"), "mrz").when(low.rlike("gender|sex"), "enum").when(low.rlike("number|id$|amount"), "number").otherwise("text")
    return region.withColumn("field_type", kind)


def mean_box(region: DataFrame) -> DataFrame:
    """Mean of normalised boxes per class and field, six places."""
    mean = lambda i: F.round(F.round(F.avg(F.col("bbox_norm")[i]), 12), 6)
    return region.groupBy("class_name", "field_name").agg(F.count("*").alias("n"), *[mean(i).alias(c) for i, c in enumerate(("x", "y", "w", "h"))])


def synth_templates(region: DataFrame) -> DataFrame:
    """One template per class: its fields with type and mean zone, in order of names. The names of fields bound a template's size."""
    kinds = field_type(mean_box(region))
    rows = kinds.groupBy("class_name").agg(F.array_sort(F.collect_list(F.struct("field_name", "field_type", "x", "y", "w", "h"))).alias("fields"))
    return rows.select("class_name", F.size("fields").cast("bigint").alias("n_fields"), "fields")


def split_summary(item: DataFrame, group: str) -> DataFrame:
    """Rows and groups of each split, and groups that are on both sides."""
    sides = item.groupBy(group).agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "val").alias("v"))
    return sides.agg(F.sum("t").alias("n_train"), F.sum("v").alias("n_val"), F.count_if(F.col("t") > 0).alias("train_groups"), F.count_if(F.col("v") > 0).alias("val_groups"), F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("leaked"))


def group_leakage(train: DataFrame, val: DataFrame, group: str) -> DataFrame:
    return train.select(group).intersect(val.select(group))


def detection_manifest(item: DataFrame, boxes: DataFrame) -> DataFrame:
    """Items with a box: of the labelled source, else of the found one; ``label_source`` tells which. Items without any go."""
    best = boxes.groupBy("doc_id").agg(F.max_by("line", F.col("source") == "labelled").alias("line"), F.max_by("source", F.col("source") == "labelled").alias("label_source"))
    return item.join(best, "doc_id")


def first_n(item: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return item.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("rank") <= n)
