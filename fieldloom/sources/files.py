"""Files in and out: results, cases, annotations, manifests, exports. Schemas are given, so no file is read twice."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELD = "struct<name:string,value:string,confidence:double,validated:boolean>"
RESULT = f"job_id string, status string, template_id string, document_type string, global_confidence double, processing_time_ms int, fields array<{FIELD}>, normalized_data map<string,string>, raw_text string"
CASE = "file string, template_id string, expected map<string,string>"
SHAPES = "struct<name:string,x:double,y:double,width:double,height:double>"
ANNOTATION = f"_via_img_metadata map<string,struct<filename:string,regions:array<struct<shape_attributes:{SHAPES},region_attributes:map<string,string>>>>>"
#: Extensions and size that uploads may have.
EXTENSIONS, MOST_BYTES = ["pdf", "png", "jpg", "jpeg", "tif", "tiff"], 20 * 1024 * 1024


DOCUMENT = "doc_id bigint, raw_text string"
RULES = "array<struct<name:string,place:int,pattern:string>>"
TEMPLATE = f"id string, name string, document_type string, doc_family string, language string, is_active boolean, fields {RULES}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, raw_text of recognised texts: Parquet tables or folders of JSON lines, by the path's ending."""
    return spark.read.schema(DOCUMENT).json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path).select("doc_id", "raw_text")


def load_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue of a folder of YAML files, one template each; parsed where the files are read. A file that is no template gives no row."""
    def parse(batches):
        import pyarrow as pa
        import yaml

        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                try:
                    found = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                if isinstance(found, dict) and found.get("id"):
                    out.append(json.dumps(found, default=str))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["template"])

    parsed = spark.read.option("pathGlobFilter", "*.y*ml").text(folder, wholetext=True).mapInArrow(parse, "template string")
    rows = parsed.select(F.from_json("template", TEMPLATE).alias("t")).select("t.*")
    return rows.withColumn("is_active", F.coalesce("is_active", F.lit(True))).withColumn("n_fields", F.coalesce(F.size("fields"), F.lit(0)))


def template_rules(catalog: DataFrame) -> DataFrame:
    """document_type, name, place, pattern: one row for each rule of an active template."""
    return catalog.filter("is_active").select("document_type", F.inline("fields"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One stored result per file; a file that is no JSON gives a row of nulls."""
    return spark.read.schema(RESULT).option("multiLine", True).json(path)


def flatten_results(result: DataFrame) -> DataFrame:
    """section, key, value, confidence, validated: the fields, then the normalised map."""
    fields = result.select("job_id", F.inline("fields")).select("job_id", F.lit("field").alias("section"), F.col("name").alias("key"), "value", "confidence", "validated")
    mapped = result.select("job_id", F.explode("normalized_data").alias("key", "value"))
    return fields.unionByName(mapped.withColumn("section", F.lit("normalized")), allowMissingColumns=True)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Long table of expectations: case_id (the file), template_id, name, expected."""
    rows = spark.read.schema(CASE).option("multiLine", True).json(path)
    return rows.select(F.col("file").alias("case_id"), "template_id", F.explode("expected").alias("name", "expected"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rectangles with a field name and an extent: filename, field_name, value, x, y, w, h."""
    rows = spark.read.schema(ANNOTATION).option("multiLine", True).json(path).select(F.explode("_via_img_metadata").alias("key", "image"))
    rows = rows.select("image.filename", F.explode("image.regions").alias("r"))
    shape, named = F.col("r.shape_attributes"), F.col("r.region_attributes")
    boxes = rows.select("filename", named["field_name"].alias("field_name"), named["value"].alias("value"), shape["name"].alias("shape"), *[shape[c].alias(a) for c, a in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))])
    return boxes.filter("shape = 'rect' and field_name <> '' and w > 0 and h > 0").drop("shape")


def read_boxes(df: DataFrame, column: str) -> DataFrame:
    """Recognised boxes from JSON text, ``[box, text, confidence]`` or ``[box, [text, confidence]]``: doc_id, idx, bbox, text, confidence."""
    rows = df.select("doc_id", F.posexplode(F.from_json(column, "array<array<string>>")).alias("idx", "item"))
    pair = F.from_json(F.get("item", F.lit(1)), "array<string>")
    nested = F.get("item", F.lit(1)).startswith("[")
    text = F.when(nested, F.get(pair, 0)).otherwise(F.get("item", F.lit(1)))
    sure = F.when(nested, F.get(pair, 1)).otherwise(F.get("item", F.lit(2))).try_cast("double")
    return rows.select("doc_id", "idx", F.from_json(F.get("item", F.lit(0)), "array<array<double>>").alias("bbox"), text.alias("text"), sure.alias("confidence"))


def screen_uploads(files: DataFrame) -> DataFrame:
    """``reason`` of each listed file (path, length) that may not enter: its extension, no content, too large; null for the others."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("reason", F.when(~extension.isin(*EXTENSIONS), "extension").when(F.col("length") <= 0, "empty").when(F.col("length") > MOST_BYTES, "too_large"))


def discover_cases(files: DataFrame, most: int | None = None) -> DataFrame:
    """Class and variant by the last two folders of each path; ``most`` keeps the first paths of each class."""
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", k)
    rows = files.select("path", part(1).alias("class_name"), part(2).alias("variant")).filter("class_name <> ''")
    if most is None:
        return rows
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("class_name").orderBy("path"))).filter(F.col("rank") <= most).drop("rank")


def write_results(result: DataFrame, path: str) -> None:
    result.write.partitionBy("organization_id").mode("overwrite").json(path)


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, for writers that replace; of equally new ones the largest, column by column."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(order, whole)).alias("_r")).select("_r.*")


def write_csv_export(flat: DataFrame, path: str) -> None:
    flat.write.option("header", True).mode("overwrite").csv(path)


def write_json_export(result: DataFrame, path: str) -> None:
    result.select(F.to_json(F.struct(*result.columns), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
