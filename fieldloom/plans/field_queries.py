"""Registered queries of rule-driven fields, boxes, fusion, evaluation, data sets, governance and states, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import boxes, datasets, evaluation, extraction, fusion, governance, routing, scoring, strategies
from fieldloom.operators.extraction import Rule
from fieldloom.plans.tables import table
from fieldloom.sources import files
from fieldloom.streaming import states

NOW = "TIMESTAMP '1998-01-01 00:00:00'"
CRITICAL = ["invoice_number", "invoice_date", "total_amount"]
PRESENT = "(value IS NOT NULL AND value <> '' AND value <> '[]')"
SAFE = f"coalesce(validated AND {PRESENT}, false)"
IDENTITY = [
    Rule("last_name", anchors=("nom",), required=True, no_digits=True),
    Rule("birth_date", anchors=("naissance",), kind="date", required=True),
    Rule("id_number", anchors=("numero",), patterns=(r"\b(\d{8})\b",), check=r"^\d{8}$", required=True),
    Rule("sex", patterns=(r"Sexe = (\w)",), kind="enum", options=("F", "M")),
]
_BIRTH = "concat(CAST(1950 + c_custkey % 50 AS VARCHAR), '-', lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0'))"
_NAME = "upper(split_part(c_name, '#', 1))"
_ID = "lpad(CAST(c_custkey AS VARCHAR), 8, '0')"


#: Two templates that try the same ways in orders of their own: template_id, field, rank, kind, pattern, part, anchor, width, source, region.
STRATEGIES = [
    ("front", "place", 1, "anchor", r":\s*(\w+)", 1, "CIN_PLACE:", 60, None, None),
    ("front", "place", 2, "first_line", None, None, None, None, None, None),
    ("back", "place", 1, "first_line", None, None, None, None, None, None),
    ("back", "place", 2, "anchor", r":\s*(\w+)", 1, "CIN_PLACE:", 60, None, None),
    ("front", "sex", 1, "pattern", r"Sexe = (\w)", 1, None, None, None, None),
    ("front", "sex", 2, "known", None, None, None, None, None, None),
    ("front", "sex", 3, "constant", None, None, None, None, "?", None),
    ("back", "sex", 1, "known", None, None, None, None, None, None),
    ("back", "sex", 2, "pattern", r"Sexe = (\w)", 1, None, None, None, None),
    ("front", "id_number", 1, "pattern", r"\d{8}", 0, None, None, None, None),
    ("back", "id_number", 1, "pattern", r"\d{8}", 0, None, None, None, "number"),
    ("front", "last_name", 1, "anchor", None, None, "Nom:", 13, None, None),
    ("back", "last_name", 1, "pattern", r"Nom: *(.+)", 1, None, None, None, None),
]


def _strategies(doc: DataFrame) -> DataFrame:
    """Every fifth document has a known sex, every seventh a region read for its number."""
    given = doc.select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, "front").otherwise("back").alias("template_id"),
        F.array("raw_text").alias("texts"),
        F.when(F.col("doc_id") % 7 == 0, F.create_map(F.lit("number"), F.concat(F.lit("no 9"), F.lpad(F.col("doc_id").cast("string"), 7, "0")))).alias("regions"),
        F.when(F.col("doc_id") % 5 == 0, F.create_map(F.lit("sex"), F.lit("M"))).alias("known"),
    )
    return strategies.strategy_fields(given, doc.sparkSession.createDataFrame(STRATEGIES, strategies.STRATEGY))


def _item_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice tables rendered from order lines, one text per order."""
    line = F.format_string("P%d  Part no %d  %d  %s  %s", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"), F.col("l_discount").cast("decimal(18,2)").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("l"))
    return rows.select("doc_id", F.concat(F.lit("Code Designation Qty Price Total\n"), F.array_join(F.transform("l", lambda s: s["line"]), "\n")).alias("raw_text"))


def _second(field: DataFrame) -> DataFrame:
    return field.filter("doc_id % 2 = 0").select("doc_id", "name", F.when(F.col("confidence") > 0.5, F.col("value")).otherwise(F.concat("value", F.lit("x"))).alias("value"), (1 - F.col("confidence")).alias("confidence"), F.lit(True).alias("validated"))


def _first(field: DataFrame) -> DataFrame:
    return field.filter("doc_id % 3 <> 0 and name <> 'total_amount'").select("doc_id", "name", "value", "confidence", "validated")


_RUNS = """a0 AS (SELECT doc_id, name, value, confidence, validated FROM field WHERE doc_id % 3 <> 0 AND name <> 'total_amount'),
    b0 AS (SELECT doc_id, name, CASE WHEN confidence > 0.5 THEN value ELSE concat(value, CASE WHEN value IS NULL THEN NULL ELSE 'x' END) END AS value, 1 - confidence AS confidence, true AS validated FROM field WHERE doc_id % 2 = 0),
    a AS (SELECT * FROM a0 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, value DESC NULLS LAST, validated DESC) = 1),
    b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, value DESC NULLS LAST) = 1),
    ab AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.name, b.name) AS name, a.doc_id IS NOT NULL AS has_a, a.value AS av, a.confidence AS ac, a.validated AS avd, b.value AS bv, b.confidence AS bc,
                  coalesce(a.validated AND a.value <> '', false) AS ag, coalesce(b.validated AND b.value <> '', false) AS bg
           FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.name = b.name)"""


def _run_field(field: DataFrame) -> DataFrame:
    return field.withColumn("run", F.concat(F.lit("run-"), (F.col("doc_id") % 3).cast("string"))).withColumn("doc_id", F.expr("doc_id div 3"))


def _once(field: DataFrame) -> DataFrame:
    """One row per document and name."""
    return field.groupBy("doc_id", "name").agg(F.max("value").alias("value"), F.bool_and("validated").alias("validated"))


_ONCE = "o AS (SELECT doc_id, name, max(value) AS value, bool_and(validated) AS validated FROM field GROUP BY 1, 2)"


def _micro(field: DataFrame) -> DataFrame:
    rows = _once(field).withColumnRenamed("doc_id", "case_id")
    return evaluation.micro_f1(scoring.field_prf(rows.select("case_id", "name", F.lit("a1").alias("expected")), rows.select("case_id", "name", "value")))


def _table(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def _tables(names: list[str], op: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(*[table(spark, sf_dir, n) for n in names])


def _documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/documents.parquet"))


FAMILIES = {"licence": ["license", "copyright", "warranty", "permission"], "personal": ["@", "phone", "address", "born"], "web": ["http", "www", "click", "cookie", "login", "menu"]}
VARIANTS = {"mail_full": (["@", "http"], ["www", "phone"], 0.5), "mail": (["@"], ["phone", "address"], 0.5), "plain": (["the"], ["and", "of"], 0.8)}
TEMPLATES = {"legal": (["license"], ["copyright", "warranty"]), "contact": (["@"], ["phone", "http"])}


def _best(pairs: list[tuple[str, str]], least: str) -> str:
    """SQL of the first best of (name, score) pairs at or above ``least``."""
    top = "greatest(" + ", ".join(s for _, s in pairs) + ")"
    return "CASE " + " ".join(f"WHEN {s} = {top} AND {s} >= {least} THEN '{n}'" for n, s in pairs) + " END"


def _has(word: str) -> str:
    return f"CAST(contains(lower(coalesce(text, '')), '{word}') AS INT)"


def _family_sql() -> str:
    pairs = [(n, f"least(({' + '.join(map(_has, ws))}) / {float(min(len(ws), 5))}, 1.0)") for n, ws in FAMILIES.items()]
    top = "greatest(" + ", ".join(s for _, s in pairs) + ")"
    return f"SELECT doc_id, coalesce({_best(pairs, '0.20')}, 'unknown') AS family, CAST(CASE WHEN {top} >= 0.20 THEN round({top}, 4) ELSE 0 END AS DOUBLE) AS confidence FROM documents"


def _variant_sql() -> str:
    pairs = []
    for n, (need, bonus, least) in VARIANTS.items():
        score = f"round(0.5 + 0.4 * ({' + '.join(map(_has, bonus))}) / {float(len(bonus))}, 3)"
        pairs.append((n, f"(CASE WHEN {' AND '.join(_has(w) + ' = 1' for w in need)} AND {score} >= {least} THEN {score} ELSE 0 END)"))
    top = "greatest(" + ", ".join(s for _, s in pairs) + ")"
    return f"SELECT doc_id, coalesce({_best(pairs, '0.0001')}, 'text_generic') AS variant, CAST({top} AS DOUBLE) AS confidence FROM documents"


def _template_sql() -> str:
    pairs = [(n, "(" + " + ".join([f"3 * {_has(w)}" for w in strong] + [_has(w) for w in weak]) + ")") for n, (strong, weak) in TEMPLATES.items()]
    top = "greatest(" + ", ".join(s for _, s in pairs) + ")"
    return f"SELECT doc_id, {_best(pairs, '3')} AS template_id, CAST({top} AS BIGINT) AS score FROM documents"


_LINES = """g AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM box WHERE x2 > x1 AND y2 > y1),
    t AS (SELECT *, greatest(12.0, 0.75 * median(h) OVER (PARTITION BY doc_id)) AS tolerance, cy - lag(cy) OVER (PARTITION BY doc_id ORDER BY cy, x1, idx) AS step FROM g),
    lines AS (SELECT *, CAST(sum(CASE WHEN step > tolerance THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY cy, x1, idx) AS BIGINT) AS line_no FROM t)"""


def _route(history: DataFrame) -> DataFrame:
    given = F.when(F.col("user_id") == "3", F.col("template_id"))
    rows = history.select(F.col("id").alias("doc_id"), "document_type", given.alias("given_template"), F.when(F.col("status") == "success", F.col("template_id")).alias("guessed_template"))
    return routing.route(rows, {"invoice": "invoice-std", "passport": "mrz-std"})


def _detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = table(spark, sf_dir, "box")
    lines = boxes.yolo_lines(boxes.document_box(box, 0.55, 400, 150), 400, 150)
    found = lines.withColumn("source", F.lit("found")).unionByName(lines.filter("doc_id % 3 = 0").withColumn("source", F.lit("labelled")))
    return datasets.detection_manifest(box.select("doc_id").distinct(), found)


def _delete(history: DataFrame, detail: DataFrame) -> DataFrame:
    kept, details = governance.delete_history(history, detail, history.filter("user_id = '7'").select("id"))
    return kept.select(F.lit("history").alias("kept"), "id").unionByName(details.select(F.lit("detail").alias("kept"), F.col("detail_id").cast("string").alias("id")))


def _assess(field: DataFrame) -> DataFrame:
    done = evaluation.critical_pass(field, CRITICAL).select("doc_id", (F.col("n_valid") / len(CRITICAL)).alias("critical_share"))
    return governance.assess(scoring.document_scores(field), done)


def _norm(region: DataFrame) -> DataFrame:
    return datasets.normalised_box(region)


def _expected(field: DataFrame) -> DataFrame:
    field = _once(field)
    wanted = field.select("doc_id", "name", F.when(F.col("doc_id") % 2 == 0, F.coalesce("value", F.lit("none"))).otherwise(F.lit("A1")).alias("expected"))
    return evaluation.exact_matches(wanted, field)


_DOC_BOX = "u AS (SELECT doc_id, min(x1) AS a, min(y1) AS b, max(x2) AS c, max(y2) AS d FROM box GROUP BY doc_id), p AS (SELECT doc_id, greatest(a - (c - a) * 0.55, 0.0) AS x1, greatest(b - (d - b) * 0.55, 0.0) AS y1, least(c + (c - a) * 0.55, 400.0) AS x2, least(d + (d - b) * 0.55, 150.0) AS y2 FROM u)"
_PASSED = "critical_valid_count >= critical_total"

#: Name: query, working tables of its SQL, SQL (from CTEs or SELECT; None where no SQL expresses it).
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], list[str], str | None]] = {
    "identity_fields": (_table("identity_text", lambda d: extraction.extract_fields(d, IDENTITY)), [], f"""
        SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'last_name' AS name, {_NAME} AS value, CAST(0.85 AS DOUBLE) AS confidence, true AS validated, CAST(NULL AS VARCHAR) AS error FROM customer
        UNION ALL SELECT c_custkey, 'birth_date', {_BIRTH}, 0.75, true, NULL FROM customer
        UNION ALL SELECT c_custkey, 'id_number', {_ID}, 0.83, true, NULL FROM customer
        UNION ALL SELECT c_custkey, 'sex', CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'X' END, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 0.95 END, c_custkey % 3 <> 0 AND c_custkey % 2 = 0, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 1 THEN 'not_an_option' END FROM customer"""),
    "generic_extract": (_table("identity_text", lambda d: extraction.generic_extract(d, IDENTITY)), [], f"""
        SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'last_name' AS name, {_NAME} AS value, CAST(0.76 AS DOUBLE) AS confidence, true AS validated, CAST(NULL AS VARCHAR) AS error FROM customer
        UNION ALL SELECT c_custkey, 'birth_date', {_BIRTH}, 0.76, true, NULL FROM customer
        UNION ALL SELECT c_custkey, 'id_number', {_ID}, 0.86, true, NULL FROM customer
        UNION ALL SELECT c_custkey, 'sex', CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'X' END, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 0.86 ELSE 0.45 END, c_custkey % 3 <> 0 AND c_custkey % 2 = 0, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 1 THEN 'not_an_option' END FROM customer"""),
    "strategy_fields": (_table("identity_text", _strategies), [], f"""
        SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'place' AS field, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'REPUBLIQUE' END AS value, 1 AS rank FROM customer
        UNION ALL SELECT c_custkey, 'sex', CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 <> 0 THEN 'F' WHEN c_custkey % 5 = 0 THEN 'M' ELSE '?' END WHEN c_custkey % 5 = 0 THEN 'M' WHEN c_custkey % 3 <> 0 THEN 'X' END,
               CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 <> 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 2 ELSE 3 END WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 3 <> 0 THEN 2 END FROM customer
        UNION ALL SELECT c_custkey, 'id_number', CASE WHEN c_custkey % 14 = 7 THEN concat('9', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) ELSE {_ID} END, 1 FROM customer
        UNION ALL SELECT c_custkey, 'last_name', CASE WHEN c_custkey % 2 = 0 THEN trim(substr({_NAME}, 1, 8)) ELSE {_NAME} END, 1 FROM customer"""),
    "marker_fields": (_table("identity_text", lambda d: extraction.marker_extract(d, "CIN")), [], "SELECT c_custkey AS doc_id, 'place' AS name, c_mktsegment AS value FROM customer"),
    "line_items": (lambda s, d: extraction.line_items(_item_text(s, d)), [], "SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat('P', l_partkey, '  Part no ', l_suppkey, '  ', CAST(l_quantity AS BIGINT), '  ', CAST(l_discount AS DECIMAL(18,2)), '  ', CAST(l_extendedprice AS DECIMAL(18,2)))) AS INT) AS line_no, concat('P', l_partkey) AS code, concat('Part no ', l_suppkey) AS designation, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS quantity, CAST(CAST(l_discount AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS total FROM lineitem"),
    "classify_family": (_documents(lambda d: routing.classify_family(d, FAMILIES)), [], _family_sql()),
    "classify_variant": (_documents(lambda d: routing.classify_variant(d, VARIANTS, "text_generic")), [], _variant_sql()),
    "auto_template": (_documents(lambda d: routing.auto_template(d, TEMPLATES)), [], _template_sql()),
    "route_documents": (_table("history", _route), ["history"], """
        SELECT id AS doc_id, coalesce(CASE WHEN user_id = '3' THEN template_id END, CASE document_type WHEN 'invoice' THEN 'invoice-std' WHEN 'passport' THEN 'mrz-std' END, CASE WHEN status = 'success' THEN template_id END) AS template_id,
               CASE WHEN user_id = '3' THEN 'explicit' WHEN document_type IN ('invoice', 'passport') THEN 'type' WHEN status = 'success' THEN 'classifier' ELSE 'none' END AS method FROM history"""),
    "needs_second_pass": (_table("field", lambda d: routing.needs_second_pass(d, {"total_amount": 0.9, "invoice_date": 0.8}, 0.6).select("doc_id", "name", "confidence")), ["field"], "SELECT doc_id, name, confidence FROM field WHERE confidence < CASE name WHEN 'total_amount' THEN 0.9 WHEN 'invoice_date' THEN 0.8 ELSE 0.6 END"),
    "reading_order": (_table("box", boxes.reading_order), ["box"], f"{_LINES} SELECT doc_id, line_no, string_agg(text, ' ' ORDER BY x1, idx, text) AS text FROM lines GROUP BY 1, 2"),
    "running_lines": (_table("box", lambda d: boxes.reading_order(d, lines=boxes.running_lines)), ["box"], """g AS (SELECT doc_id, idx, text, x1, (y1 + y2) / 2 AS cy, y2 - y1 AS h FROM box WHERE x2 > x1 AND y2 > y1),
        t AS (SELECT *, greatest(12.0, 0.75 * median(h) OVER (PARTITION BY doc_id)) AS tolerance, list(cy) OVER (PARTITION BY doc_id ORDER BY cy, x1, idx, text ROWS UNBOUNDED PRECEDING) AS above FROM g),
        f AS (SELECT *, list_reduce([{'line': CAST(-1 AS BIGINT), 's': CAST(0 AS DOUBLE), 'n': CAST(1 AS BIGINT), 'c': CAST(0 AS DOUBLE), 'tol': tolerance}] || list_transform(above, lambda y: {'line': CAST(0 AS BIGINT), 's': CAST(0 AS DOUBLE), 'n': CAST(1 AS BIGINT), 'c': CAST(y AS DOUBLE), 'tol': tolerance}),
                lambda a, b: CASE WHEN a.line < 0 OR b.c - a.s / a.n > a.tol THEN {'line': a.line + 1, 's': b.c, 'n': CAST(1 AS BIGINT), 'c': b.c, 'tol': a.tol} ELSE {'line': a.line, 's': a.s + b.c, 'n': a.n + 1, 'c': b.c, 'tol': a.tol} END).line AS line_no FROM t)
        SELECT doc_id, line_no, string_agg(text, ' ' ORDER BY x1, idx, text) AS text FROM f GROUP BY 1, 2"""),
    "label_contexts": (_table("box", lambda d: boxes.label_contexts(boxes.reading_order(d), "Nom")), ["box"], f"{_LINES}, r AS (SELECT doc_id, line_no, string_agg(text, ' ' ORDER BY x1, idx, text) AS text FROM lines GROUP BY 1, 2), c AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS before, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM r) SELECT * FROM c WHERE contains(text, 'Nom')"),
    "label_values": (_table("box", lambda d: boxes.label_values(d, "^Nom$")), ["box"], f"""{_LINES}, m AS (SELECT doc_id, idx, x1, x2, cx, cy, h FROM g WHERE text = 'Nom'),
        d AS (SELECT g.doc_id, g.text, g.idx, m.idx AS l_idx, sqrt(pow(g.cx - m.cx, 2) + pow(g.cy - m.cy, 2)) AS far, abs(g.cy - m.cy) <= greatest(m.h, g.h) * 0.6 AND g.x1 >= m.x1 AS beside, g.cy > m.cy AND abs(g.cx - m.cx) <= greatest(m.x2 - m.x1, g.w) AS under FROM g JOIN m ON g.doc_id = m.doc_id WHERE g.text <> 'Nom'),
        s AS (SELECT *, CASE WHEN beside THEN 12.0 WHEN under THEN 8.5 END - 0.02 * far AS raw FROM d WHERE far <= 400),
        k AS (SELECT *, round(raw, 9) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 9) DESC, idx, l_idx, text DESC) AS r FROM s WHERE raw IS NOT NULL)
        SELECT doc_id, text AS value, round(score, 4) AS score FROM k WHERE r = 1"""),
    "id_from_boxes": (_table("box", boxes.id_from_boxes), ["box"], "SELECT doc_id, arg_max(text, (confidence, -idx, text)) AS number FROM box WHERE regexp_full_match(text, '[0-9]{8}') GROUP BY doc_id"),
    "zone_texts": (_table("box", lambda d: boxes.zone_text(boxes.boxes_in_zone(d, {"head": (0, 0, 1, 0.2), "left": (0, 0.2, 0.4, 1)}, 400, 150))), ["box"], f"{_LINES} SELECT doc_id, zone, string_agg(text, ' ' ORDER BY cy, x1, idx, text) AS text FROM (SELECT *, CASE WHEN cx / 400 BETWEEN 0 AND 1 AND cy / 150 BETWEEN 0 AND 0.2 THEN 'head' WHEN cx / 400 BETWEEN 0 AND 0.4 AND cy / 150 BETWEEN 0.2 AND 1 THEN 'left' END AS zone FROM g) WHERE zone IS NOT NULL GROUP BY 1, 2"),
    "document_box": (_table("box", lambda d: boxes.document_box(d, 0.55, 400, 150)), ["box"], f"{_DOC_BOX} SELECT * FROM p"),
    "detection_manifest": (_detection, ["box"], f"{_DOC_BOX} SELECT doc_id, printf('0 %.6f %.6f %.6f %.6f', CAST(round(CAST((x1 + x2) / 2 / 400 AS DECIMAL(18,9)), 6) AS DOUBLE), CAST(round(CAST((y1 + y2) / 2 / 150 AS DECIMAL(18,9)), 6) AS DOUBLE), CAST(round(CAST((x2 - x1) / 400 AS DECIMAL(18,9)), 6) AS DOUBLE), CAST(round(CAST((y2 - y1) / 150 AS DECIMAL(18,9)), 6) AS DOUBLE)) AS line, CASE WHEN doc_id % 3 = 0 THEN 'labelled' ELSE 'found' END AS label_source FROM p"),
    "merge_consensus": (_table("field", lambda d: fusion.merge_consensus(_first(d), _second(d), CRITICAL)), ["field"], f"""{_RUNS}, x AS (SELECT *, CASE WHEN NOT (bg AND name IN ('invoice_number', 'invoice_date', 'total_amount')) THEN 'kept' WHEN NOT ag THEN 'filled' WHEN av = bv THEN 'agreed' WHEN bc > ac + 0.15 THEN 'replaced' ELSE 'kept' END AS action FROM ab)
        SELECT doc_id, name, CASE WHEN action IN ('filled', 'replaced') THEN bv ELSE av END AS value, CAST(round(CASE action WHEN 'agreed' THEN least(greatest(ac, bc) + 0.05, 0.99) WHEN 'kept' THEN ac ELSE bc END, 4) AS DOUBLE) AS confidence,
               CASE WHEN action IN ('filled', 'replaced') THEN true ELSE avd END AS validated, action FROM x WHERE has_a OR action = 'filled'"""),
    "fill_header": (_table("field", lambda d: fusion.fill_header(_first(d), _second(d), ["invoice_number", "invoice_date"])), ["field"], f"""{_RUNS}, x AS (SELECT *, bg AND NOT ag AND name IN ('invoice_number', 'invoice_date') AS filled FROM ab)
        SELECT doc_id, name, CASE WHEN filled THEN bv ELSE av END AS value, CASE WHEN filled THEN bc ELSE ac END AS confidence, CASE WHEN filled THEN true ELSE avd END AS validated, filled FROM x WHERE has_a OR filled"""),
    "best_run": (_table("field", lambda d: fusion.best_run(_run_field(d), CRITICAL)), ["field"], f"""r AS (SELECT CAST(floor(doc_id / 3) AS BIGINT) AS doc_id, concat('run-', doc_id % 3) AS run, confidence, {SAFE} AS good, name IN ('invoice_number', 'invoice_date', 'total_amount') AS crit FROM field),
        s AS (SELECT doc_id, run, CAST(round(CAST(0.5 * avg(confidence) + 0.3 * count(*) FILTER (good) / count(*) + 0.2 * count(*) FILTER (good AND crit) / greatest(count(*) FILTER (crit), 1) AS DECIMAL(18,9)), 4) AS DOUBLE) AS score FROM r GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, run) AS n FROM s) SELECT doc_id, run, score FROM k WHERE n = 1"""),
    "suppress_weak": (_table("field", lambda d: fusion.suppress_weak(d, ["supplier", "customer"], ["invoice_number"]).select("doc_id", "name", "validated", "error")), ["field"], "f AS (SELECT *, bool_or(name = 'invoice_number' AND validated) OVER (PARTITION BY doc_id) AS held FROM field) SELECT doc_id, name, validated AND NOT (name IN ('supplier', 'customer') AND NOT held) AS validated, CASE WHEN name IN ('supplier', 'customer') AND NOT held THEN 'no_anchor' ELSE error END AS error FROM f"),
    "suppress_derived": (_table("field", lambda d: fusion.suppress_derived(d, "invoice_number", ["invoice_date", "currency"]).select("doc_id", "name", "value")), ["field"], "f AS (SELECT *, bool_or(name = 'invoice_number' AND validated) OVER (PARTITION BY doc_id) AS good FROM field) SELECT doc_id, name, CASE WHEN good OR name NOT IN ('invoice_date', 'currency') THEN value END AS value FROM f"),
    "engine_label": (_table("candidate", fusion.engine_label), ["candidate"], "SELECT doc_id, CASE WHEN count(DISTINCT engine) > 1 THEN concat('mixed(', string_agg(DISTINCT engine, '+' ORDER BY engine), ')') ELSE min(engine) END AS engine_label FROM candidate GROUP BY doc_id"),
    "first_from_sources": (_table("candidate", lambda d: fusion.first_from_sources(d, ["spatial", "full"], 0.2)), ["candidate"], "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY CASE source WHEN 'spatial' THEN 1 ELSE 2 END, avg_conf DESC, value) AS r FROM candidate WHERE source IN ('spatial', 'full') AND avg_conf >= 0.2) SELECT doc_id, field, value, source FROM k WHERE r = 1"),
    "combined_text": (_table("candidate", lambda d: fusion.combined_text(d.withColumn("pos", F.concat("field", "engine")), "value", "pos")), ["candidate"], "v AS (SELECT doc_id, value, min(concat(field, engine)) AS pos FROM candidate GROUP BY 1, 2) SELECT doc_id, string_agg(value, chr(10) ORDER BY pos, value) AS text FROM v GROUP BY 1"),
    "micro_f1": (_table("field", _micro), ["field"], f"{_ONCE}, c AS (SELECT count(*) FILTER ({PRESENT} AND lower(value) = 'a1') AS tp, count(*) FILTER ({PRESENT} AND lower(value) <> 'a1') AS fp, count(*) FILTER (NOT coalesce({PRESENT}, false)) AS fn FROM o) SELECT *, round(2 * tp / greatest(2 * tp + fp + fn, 1), 3) AS f1 FROM c"),
    "critical_pass": (_table("field", lambda d: evaluation.critical_pass(d, CRITICAL)), ["field"], "f AS (SELECT *, coalesce(validated AND value <> '', false) AS good, CASE WHEN coalesce(value, '') = '' THEN 'missing' ELSE coalesce(error, 'invalid') END AS state FROM field WHERE name IN ('invoice_number', 'invoice_date', 'total_amount')) SELECT doc_id, count(*) FILTER (good) AS n_valid, count(*) FILTER (good) = 3 AS critical_pass, coalesce(string_agg(DISTINCT concat(name, ':', state), ',' ORDER BY concat(name, ':', state)) FILTER (NOT good), '') AS errors FROM f GROUP BY doc_id"),
    "exact_matches": (_table("field", _expected), ["field"], f"{_ONCE}, f AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN coalesce(value, 'none') ELSE 'A1' END AS expected, coalesce(value, '') = '' AS absent FROM o), x AS (SELECT *, NOT absent AND validated AND value = expected AS hit FROM f) SELECT doc_id, count(*) FILTER (hit) AS n_exact, coalesce(string_agg(name, ',' ORDER BY name) FILTER (absent), '') AS missing, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT absent AND NOT hit), '') AS wrong FROM x GROUP BY doc_id"),
    "case_behaviour": (_table("case_result", evaluation.behaviour), ["case_result"], f"SELECT case_id, CASE WHEN in_scope THEN {_PASSED} AND api_status = 'success' ELSE api_status <> 'success' AND NOT ({_PASSED}) END AS behaviour_ok, CASE WHEN in_scope THEN 'auto_success' ELSE 'controlled_review' END AS expected_behaviour FROM case_result"),
    "time_budget": (_table("case_result", lambda d: evaluation.time_budget(d, 8000, 9000)), ["case_result"], "SELECT family, count(*) AS cases, count(*) FILTER (ok) AS within, round(count(*) FILTER (ok) / count(*), 4) AS share, round(avg(processing_time_ms) FILTER (http_ok), 2) AS avg_ms FROM (SELECT *, processing_time_ms <= CASE WHEN in_scope THEN 8000 ELSE 9000 END AS ok FROM case_result) GROUP BY family"),
    "false_accepts": (_table("case_result", lambda d: evaluation.false_accepts(d).select("case_id", "family")), ["case_result"], f"SELECT case_id, family FROM case_result WHERE {_PASSED} AND api_status = 'review_required'"),
    "strict_and_review": (_table("case_result", evaluation.strict_and_review), ["case_result"], f"SELECT count(*) FILTER (in_scope) AS strict, count(*) FILTER (in_scope AND {_PASSED}) AS strict_passed, count(*) FILTER (NOT in_scope) AS review, count(*) FILTER (NOT in_scope AND api_status = 'review_required') AS review_right FROM case_result"),
    "model_accuracy": (_table("prediction", lambda d: evaluation.model_accuracy(d.withColumn("doc", F.expr("item_id div 8")), "doc", "actual", F.col("actual") == F.col("predicted"))), ["prediction"], "e AS (SELECT actual, floor(item_id / 8) AS doc, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS a FROM prediction GROUP BY 1, 2) SELECT actual, count(*) AS items, CAST(round(CAST(avg(a) AS DECIMAL(18,9)), 4) AS DOUBLE) AS accuracy FROM e GROUP BY 1"),
    "accept_prediction": (_table("prediction", lambda d: evaluation.accept_prediction(d.groupBy("item_id").agg(F.max("confidence").alias("confidence")), {"A": F.col("confidence"), "N": 1 - F.col("confidence"), "R": F.lit(0.3)}, 0.6)), ["prediction"], "p AS (SELECT item_id, max(confidence) AS confidence FROM prediction GROUP BY 1), s AS (SELECT item_id, unnest(['A', 'N', 'R']) AS n, unnest([confidence, 1 - confidence, 0.3]) AS v, unnest([1, 2, 3]) AS o FROM p) SELECT item_id, arg_min(n, o) FILTER (v = top) AS best, any_value(top) AS score, any_value(top) >= 0.6 AS accepted, string_agg(n, '>' ORDER BY v DESC, o) AS ranking FROM (SELECT *, max(v) OVER (PARTITION BY item_id) AS top FROM s) GROUP BY item_id"),
    "mean_boxes": (_table("region", lambda d: datasets.mean_box(_norm(d))), ["region"], "n AS (SELECT class_name, field_name, x / width AS x, y / height AS y, w / width AS w, h / height AS h FROM region WHERE w > 0 AND h > 0) SELECT class_name, field_name, count(*) AS n, round(avg(round(x, 6)), 6) AS x, round(avg(round(y, 6)), 6) AS y, round(avg(round(w, 6)), 6) AS w, round(avg(round(h, 6)), 6) AS h FROM n GROUP BY 1, 2"),
    "synth_templates": (_table("region", lambda d: datasets.synth_templates(_norm(d)).select("class_name", "n_fields", F.array_join(F.transform("fields", lambda s: F.concat_ws("=", s["field_name"], s["field_type"])), ",").alias("fields"))), ["region"], "n AS (SELECT DISTINCT class_name, concat(field_name, '=', CASE field_name WHEN 'photo' THEN 'image' WHEN 'birth_date' THEN 'date' WHEN 'doc_number' THEN 'number' WHEN 'gender' THEN 'enum' ELSE 'text' END) AS f FROM region WHERE w > 0 AND h > 0) SELECT class_name, count(*) AS n_fields, string_agg(f, ',' ORDER BY f) AS fields FROM n GROUP BY 1"),
    "split_summary": (_table("region", lambda d: datasets.split_summary(d.withColumn("split", F.when(F.substring("group_id", -1, 1) == "7", "val").otherwise("train")), "group_id")), ["region"], "s AS (SELECT group_id, right(group_id, 1) = '7' AS v FROM region) SELECT count(*) FILTER (NOT v) AS n_train, count(*) FILTER (v) AS n_val, count(DISTINCT group_id) FILTER (NOT v) AS train_groups, count(DISTINCT group_id) FILTER (v) AS val_groups, CAST(0 AS BIGINT) AS leaked FROM s"),
    "group_leakage": (_table("region", lambda d: datasets.group_leakage(d.filter("field_name = 'photo'"), d.filter("class_name = 'class-1'"), "group_id")), ["region"], "SELECT DISTINCT group_id FROM region WHERE field_name = 'photo' INTERSECT SELECT group_id FROM region WHERE class_name = 'class-1'"),
    "first_per_class": (_table("listed_file", lambda d: files.discover_cases(d, 5)), ["listed_file"], "c AS (SELECT path, split_part(path, '/', 3) AS class_name, split_part(path, '/', 4) AS variant FROM listed_file) SELECT path, class_name, variant FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY path) AS r FROM c) WHERE r <= 5"),
    "screen_uploads": (_table("listed_file", files.screen_uploads), ["listed_file"], "SELECT path, length, CASE WHEN path LIKE '%.exe' THEN 'extension' WHEN length = 0 THEN 'empty' WHEN length > 20971520 THEN 'too_large' END AS reason FROM listed_file"),
    "latest_details": (_table("detail", lambda d: files.latest_per_key(d.filter("job_id is not null"), "job_id", "detail_at")), ["detail"], "SELECT * FROM detail WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY detail_at DESC, detail_id DESC, history_id DESC NULLS LAST, note DESC) = 1"),
    "history_with_detail": (_tables(["history", "detail"], lambda h, d: governance.history_with_detail(h, d).select("id", "detail_id", "note")), ["history", "detail"], "p AS (SELECT history_id AS id, detail_at, detail_id, note FROM detail WHERE history_id IS NOT NULL UNION ALL SELECT h.id, detail_at, detail_id, note FROM detail d JOIN history h ON d.job_id = h.job_id), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY detail_at DESC, detail_id DESC, note DESC) AS r FROM p) SELECT h.id, n.detail_id, n.note FROM history h LEFT JOIN n ON h.id = n.id AND n.r = 1"),
    "delete_history": (_tables(["history", "detail"], _delete), ["history", "detail"], "SELECT 'history' AS kept, id FROM history WHERE user_id <> '7' UNION ALL SELECT 'detail', CAST(detail_id AS VARCHAR) FROM detail WHERE coalesce(history_id, '') NOT IN (SELECT id FROM history WHERE user_id = '7') AND coalesce(job_id, '') NOT IN (SELECT job_id FROM history WHERE user_id = '7')"),
    "erase_org": (_table("job", lambda d: governance.erase(d, F.col("organization_id") == "7", F.expr(NOW)).select("id", "is_purged", "result_path", F.col("purged_at").isNotNull().alias("stamped"))), ["job"], "SELECT id, is_purged OR organization_id = '7' AS is_purged, CASE WHEN is_purged OR organization_id <> '7' THEN result_path END AS result_path, NOT is_purged AND organization_id = '7' AS stamped FROM job"),
    "export_org": (_table("job", governance.export_org), ["job"], "SELECT organization_id, CAST(row_number() OVER (PARTITION BY organization_id ORDER BY created_at DESC, id) AS INT) AS place, concat('{\"id\":\"', id, '\",\"status\":\"', status, '\",\"page_count\":', page_count, '}') AS json FROM job"),
    "retention_info": (_table("org", governance.retention_info), ["org"], "SELECT id, data_retention_days, CASE WHEN data_retention_days < 90 THEN 'short' ELSE 'standard' END AS policy FROM org"),
    "org_jobs": (_tables(["org", "job"], lambda o, j: governance.org_jobs(o, j, 3).select("organization_id", "slug", "id", "rank")), ["org", "job"], "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY organization_id ORDER BY created_at DESC, id) AS INT) AS rank FROM job) SELECT organization_id, slug, r.id, rank FROM r JOIN org ON organization_id = org.id WHERE rank <= 3"),
    "job_page": (_table("job", lambda d: governance.page(d, 3, 20, [F.col("created_at").desc(), F.col("id")]).select("id", "created_at")), ["job"], "SELECT id, created_at FROM job ORDER BY created_at DESC, id LIMIT 20 OFFSET 40"),
    "quota_metric": (_table("org", governance.quota_metric), ["org"], "SELECT id AS organization_id, 'pages' AS kind, round(100 * usage_pages_this_month / quota_pages_per_month, 1) AS pct FROM org UNION ALL SELECT id, 'jobs', round(100 * usage_jobs_this_month / quota_jobs_per_month, 1) FROM org"),
    "user_counts": (_table("account", governance.user_counts), ["account"], "SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (role = 'admin') AS admins, count(*) FILTER (role = 'operator' AND NOT is_active) AS pending_operators FROM account"),
    "search_templates": (_table("template", lambda d: governance.search(d, "TPL-1", None, True)), ["template"], "SELECT * FROM template WHERE is_active AND (contains(lower(id), 'tpl-1') OR contains(lower(name), 'tpl-1') OR contains(lower(document_type), 'tpl-1'))"),
    "upsert_templates": (_table("template", lambda d: governance.upsert(d, d.filter("is_active").withColumn("name", F.upper("name")))), ["template"], "SELECT id, CASE WHEN is_active THEN upper(name) ELSE name END AS name, document_type, is_active FROM template"),
    "flat_record": (_table("field", lambda d: governance.flat_record(d, {"invoice_number": "number", "total_amount": "total"})), ["field"], "v AS (SELECT doc_id, CASE name WHEN 'invoice_number' THEN 'number' WHEN 'total_amount' THEN 'total' ELSE name END AS key, max(value) AS value FROM field WHERE validated AND value <> '' GROUP BY 1, 2) SELECT doc_id, string_agg(concat(key, '=', value), ';' ORDER BY key) AS record, '{' || string_agg('\"' || key || '\":\"' || value || '\"', ',' ORDER BY key) || '}' AS json FROM v GROUP BY 1"),
    "recommendations": (_table("field", lambda d: governance.recommendation(scoring.document_scores(d))), [], None),
    "assess_documents": (_table("field", _assess), [], None),
    "job_states": (_table("job_event", states.job_states), ["job_event"], "SELECT job_id, arg_max(state, (ts, event_id)) AS state, count(*) FILTER (state = 'processing') AS attempts, count(*) FILTER (state = 'failed') AS failures, max(ts) AS changed_at FROM job_event GROUP BY 1"),
}
