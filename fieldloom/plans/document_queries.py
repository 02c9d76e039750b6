"""Registered queries of whole documents: passports, identity cards, registry extracts and invoices rendered from the given tables, with SQL
that tells from the same tables what must be found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import extraction, identity, passports, plugins, registry, results
from fieldloom.plans.tables import table

YEAR = 2025


def _table(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


def _zone(doc: DataFrame) -> DataFrame:
    return passports.best_zone(doc, F.lit(YEAR))


#: What the passport texts hold by kind: kinds 4 and 5 have no zone that holds, kind 7 is of another country, kind 2 has no sex.
_ZONE_OK = "kind NOT IN (4, 5)"
_ZONE_VALUES = {
    "document_number": "number",
    "surname": "surname",
    "given_names": "given",
    "nationality": "country",
    "birth_date": "concat('19', substr(birth, 1, 2), '-07-15')",
    "expiry_date": "concat('20', substr(expiry, 1, 2), '-12-31')",
    "gender": "CASE WHEN kind <> 2 THEN sex END",
    "issuing_country": "country",
    "personal_number": "personal",
}


def _zone_fields_sql() -> str:
    rows = []
    for name, value in _ZONE_VALUES.items():
        good = f"{_ZONE_OK} AND ({value}) IS NOT NULL"
        required = str(name in passports.REQUIRED).lower()
        rows.append(f"SELECT doc_id, '{name}' AS name, CASE WHEN {good} THEN {value} END AS value, CAST(CASE WHEN {good} THEN 0.94 ELSE 0 END AS DOUBLE) AS confidence, {good} AS validated, CASE WHEN NOT ({good}) THEN 'invalid_{name}' END AS error, NOT ({good}) AND {required} AS review_required FROM passport_text")
    shown = "CASE WHEN kind = 4 THEN concat(line1, chr(10), bad_line2) WHEN kind = 2 THEN concat(line1, chr(10), substr(line2, 1, 20), '0', substr(line2, 22)) WHEN kind = 5 THEN '' ELSE concat(line1, chr(10), line2) END"
    rows.append(f"SELECT doc_id, 'mrz', {shown}, CASE WHEN {_ZONE_OK} THEN 0.97 ELSE 0 END, {_ZONE_OK}, CASE WHEN NOT ({_ZONE_OK}) THEN 'invalid_mrz' END, false FROM passport_text")
    return " UNION ALL ".join(rows)


def _passport_sql() -> str:
    good = "kind NOT IN (1, 4, 5, 7)"
    values = {"passport_number": f"CASE WHEN {good} THEN number WHEN kind = 5 THEN label_number END"} | {n: f"CASE WHEN {good} THEN {_ZONE_VALUES[own]} END" for own, n in passports.PASSPORT_NAMES.items() if own != "document_number"}
    rows = []
    for name, value in values.items():
        confidence = "CASE WHEN kind = 5 THEN 0.92 WHEN kind NOT IN (1, 4, 7) THEN 0.9 ELSE 0 END" if name == "passport_number" else f"CASE WHEN {good} THEN 0.9 ELSE 0 END"
        rows.append(f"SELECT doc_id, '{name}' AS name, {value} AS value, CAST({confidence} AS DOUBLE) AS confidence, ({value}) IS NOT NULL AS validated FROM passport_text")
    second = "CASE WHEN kind = 2 THEN concat(substr(line2, 1, 20), '0', substr(line2, 22)) ELSE line2 END"
    rows += [f"SELECT doc_id, 'mrz_line_{k}', {line}, 0.9, true FROM passport_text WHERE {good}" for k, line in ((1, "line1"), (2, second))]
    return " UNION ALL ".join(rows)


#: What the registry texts hold by kind, as (French labels, Arabic labels, old extract, new extract).
_REGISTRY_VALUES = {
    "date_extrait": ("concat('2020-03-', day)", "concat('2021-03-', day)", "concat('1999-07-', day)", "NULL"),
    "identifiant_unique": ("code", "code", "NULL", "NULL"),
    "numero_registre": ("NULL", "NULL", "concat('B', substr(code, 1, 7))", "concat('B', substr(code, 1, 7))"),
    "numero_depot": ("NULL", "NULL", "concat('D', substr(code, 1, 7))", "NULL"),
    "numero_interne": ("NULL", "NULL", "concat('G', substr(code, 1, 7))", "NULL"),
    "raison_sociale": ("concat(company, ' SUARL')", "NULL", "concat('GULF ', seg, ' GAZ CORPORATION')", "CASE WHEN doc_id % 8 = 3 THEN 'ET FILS SARL' ELSE 'FORME SARL' END"),
    "nom_commercial": ("concat('Boutique ', k)", "NULL", "NULL", "NULL"),
    "adresse_sociale": ("concat('rue ', k, ' Tunis')", "NULL", "NULL", "NULL"),
    "capital": ("concat(cap, '500.000')", "concat(cap, '.000')", "NULL", "NULL"),
    "activite_principale": ("concat('commerce ', seg)", "'تجارة'", "NULL", "NULL"),
    "activite_secondaire": ("'conseil'", "NULL", "NULL", "NULL"),
    "forme_juridique": ("'SUARL'", "'محدودة'", "NULL", "'SARL'"),
    "date_publication": ("concat('2020-04-', day)", "concat('2021-04-', day)", "NULL", "NULL"),
    "date_debut_activite": ("concat('2020-05-', day)", "NULL", "NULL", "NULL"),
    "dirigeant_qualite": ("'Gérant'", "'وكيل'", "NULL", "NULL"),
    "dirigeant_adresse": ("NULL", "NULL", "NULL", "NULL"),
    "dirigeant_nationalite": ("'Tunisienne'", "'Tunisienne'", "NULL", "NULL"),
    "dirigeant_date_naissance": ("concat('1970-06-', day)", "NULL", "NULL", "NULL"),
    "dirigeant_nom_prenom": ("concat('Ali Ben ', seg)", "NULL", "NULL", "NULL"),
}


def _registry_sql() -> str:
    rows = []
    for name, (french, arabic, old, new) in _REGISTRY_VALUES.items():
        value = f"CASE kind WHEN 0 THEN {french} WHEN 1 THEN {arabic} WHEN 2 THEN {old} ELSE {new} END"
        missing = f"{name}_not_found" if name in registry.REQUIRED else "field_not_found"
        rows.append(f"SELECT doc_id, '{name}' AS name, CAST({value} AS VARCHAR) AS value FROM registry_text")
    confidence = "CASE name " + " ".join(f"WHEN '{n}' THEN {c}" for n, c in registry.CONFIDENCE.items()) + " END"
    missing = "CASE WHEN name IN ('date_extrait', 'identifiant_unique', 'raison_sociale') THEN concat(name, '_not_found') ELSE 'field_not_found' END"
    return f"SELECT doc_id, name, value, CAST(CASE WHEN value IS NULL THEN 0 ELSE {confidence} END AS DOUBLE) AS confidence, value IS NOT NULL AS validated, CASE WHEN value IS NULL THEN {missing} END AS error FROM ({' UNION ALL '.join(rows)})"


_MODERN_SQL = """
    SELECT doc_id, 'registration_number' AS name, CASE WHEN kind >= 2 THEN concat('B', substr(code, 1, 7)) END AS value, CAST(CASE WHEN kind >= 2 THEN 0.90 ELSE 0 END AS DOUBLE) AS confidence FROM registry_text
    UNION ALL SELECT doc_id, 'company_name', CASE kind WHEN 0 THEN upper(concat(company, ' SUARL')) WHEN 3 THEN upper(concat(company, CASE WHEN doc_id % 8 = 3 THEN ' et fils' ELSE '' END)) END, CASE WHEN kind IN (0, 3) THEN 0.82 ELSE 0 END FROM registry_text
    UNION ALL SELECT doc_id, 'legal_form', CASE kind WHEN 0 THEN 'SUARL' WHEN 3 THEN 'SARL' END, CASE WHEN kind IN (0, 3) THEN 0.88 ELSE 0 END FROM registry_text
    UNION ALL SELECT doc_id, 'capital', CASE WHEN kind = 0 THEN concat(cap, '500.000') WHEN kind = 3 AND doc_id % 3 = 0 THEN '10000' WHEN kind = 3 THEN concat(cap, '500.750') END, CASE WHEN kind = 0 OR kind = 3 AND doc_id % 3 <> 0 THEN 0.85 WHEN kind = 3 THEN 0.70 ELSE 0 END FROM registry_text"""


def _two_runs(field: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry fields as two recognitions of one document may give them, from the order lines."""
    name = F.element_at(F.array(*map(F.lit, _CHOSEN)), (F.col("doc_id") % len(_CHOSEN) + 1).cast("int"))
    rows = field.groupBy("doc_id").agg(F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.min("value").alias("a"), F.max("value").alias("b"), F.bool_or("validated").alias("ok")).withColumn("name", name)
    first = rows.filter("doc_id % 5 <> 0").select("doc_id", "name", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("https "), "a")).otherwise(F.col("a")).alias("value"), F.col("low").alias("confidence"), "ok")
    second = rows.filter("doc_id % 6 <> 0").select("doc_id", "name", F.when(F.col("doc_id") % 4 == 0, F.col("a")).otherwise(F.col("b")).alias("value"), F.col("high").alias("confidence"), F.lit(True).alias("ok"))
    return first.withColumnRenamed("ok", "validated"), second.withColumnRenamed("ok", "validated")


_CHOSEN = ["raison_sociale", "adresse_sociale", "capital", "identifiant_unique"]
_SCORE = """(CASE WHEN length({v}) >= 3 THEN 1 ELSE 0 END + CASE WHEN regexp_matches({v}, '[A-Za-z]') THEN 1 ELSE 0 END - CASE WHEN contains({v}, 'https') OR (regexp_matches({v}, '[0-9]') AND NOT regexp_matches({v}, '[A-Za-z]')) THEN 5 ELSE 0 END
    + CASE WHEN name = 'capital' AND regexp_matches({v}, '[1-9]') THEN 4 ELSE 0 END)"""
_CHOSEN_SQL = f"""g AS (SELECT doc_id, min(confidence) AS low, max(confidence) AS high, min(value) AS a, max(value) AS b, bool_or(validated) AS ok, [{', '.join(repr(n) for n in _CHOSEN)}][CAST(doc_id % 4 + 1 AS INT)] AS name FROM field GROUP BY doc_id),
    x AS (SELECT doc_id, name, CASE WHEN doc_id % 7 = 0 THEN 'https ' || a ELSE a END AS av, low AS ac, ok AS ad, CASE WHEN doc_id % 4 = 0 THEN a ELSE b END AS bv, high AS bc, doc_id % 5 <> 0 AS ah, doc_id % 6 <> 0 AS bh FROM g),
    y AS (SELECT *, ah AND coalesce(ad AND trim(av) <> '', false) AS ag, bh AND coalesce(bv <> '', false) AS bg, trim(av) = trim(bv) AS eq, {_SCORE.format(v="trim(bv)")} - {_SCORE.format(v="trim(av)")} AS gain FROM x),
    z AS (SELECT *, NOT ah OR (bh AND bg AND (NOT ag OR (NOT coalesce(eq, false) AND CASE WHEN name = 'adresse_sociale' THEN gain >= 0 ELSE gain > 0.5 END))) AS second FROM y WHERE ah OR bh)
    SELECT doc_id, name, CASE WHEN second THEN bv ELSE av END AS value, CAST(CASE WHEN ag AND bg AND eq THEN greatest(ac, bc, 0.90) WHEN second THEN bc ELSE ac END AS DOUBLE) AS confidence, CASE WHEN second THEN true ELSE ad END AS validated, CASE WHEN second THEN 'second' ELSE 'first' END AS run FROM z"""


def _confidence(candidate: DataFrame) -> DataFrame:
    """Readings of last and first names by value, from the working table's candidates."""
    sources = F.collect_set(F.when(F.col("source") == "spatial", "spatial_boxes").when(F.col("source") == "zone", "roi_ocr").otherwise("full_text"))
    rows = candidate.groupBy("doc_id", "field", "value").agg(F.avg("avg_conf").alias("mean"), F.count("*").alias("n"), sources.alias("sources"))
    confidence = identity.candidate_confidence(F.col("field"), F.col("mean"), F.col("n"), 7 * F.col("n") + F.col("mean"), F.col("sources"))
    return rows.select("doc_id", "field", "value", confidence.alias("confidence"))


def _runs(doc: DataFrame) -> DataFrame:
    rows = passports.zone_fields(_zone(doc))
    return rows.withColumn("run", F.concat(F.lit("run-"), (F.col("doc_id") % 3).cast("string"))).withColumn("doc_id", F.expr("doc_id div 3"))


def _tables(names: list[str], op: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(*[table(spark, sf_dir, n) for n in names])


def _documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _types(passport: DataFrame, extract: DataFrame) -> DataFrame:
    texts = passport.select(F.col("doc_id") * 2, "raw_text").toDF("doc_id", "raw_text").unionByName(extract.select((F.col("doc_id") * 2 + 1).alias("doc_id"), "raw_text"))
    return results.detect_document_type(texts)


def _compatible(history: DataFrame) -> DataFrame:
    seen = F.when(F.col("template_id") == "tpl-1", "Facture").when(F.col("template_id") == "tpl-2", "cin").when(F.col("template_id") == "tpl-3", "passeport")
    return history.select("id", results.type_compatible(F.when(F.col("document_type") == "identity", "id_card").otherwise(F.col("document_type")), seen, F.col("global_confidence")).alias("compatible"))


_COMPATIBLE_SQL = """
    c AS (SELECT id, global_confidence AS g, CASE document_type WHEN 'identity' THEN 'id_document' ELSE coalesce(document_type, 'auto') END AS a, CASE template_id WHEN 'tpl-1' THEN 'invoice' WHEN 'tpl-2' THEN 'cin_tn' WHEN 'tpl-3' THEN 'passport' ELSE 'auto' END AS b FROM history)
    SELECT id, a = 'auto' OR b = 'auto' OR a = b OR (a = 'id_document' AND b = 'cin_tn') OR g < 0.25 AS compatible FROM c"""


def _extractor(history: DataFrame) -> DataFrame:
    rows = history.select(F.col("id").alias("doc_id"), F.col("document_type").alias("family"), F.when(F.col("user_id") != "5", F.col("template_id")).alias("template_id"), F.col("global_confidence").alias("confidence"))
    return results.choose_extractor(rows, {"invoice": "invoice_fields", "passport": "passport_fields"})


def _profiles(doc: DataFrame) -> DataFrame:
    body = F.when(F.col("doc_id") % 4 == 0, F.concat("raw_text", F.lit(" TTN"))).when(F.col("doc_id") % 4 == 1, F.regexp_replace("raw_text", "TVA|TTC", "X")).when(F.col("doc_id") % 4 == 2, F.lit("page")).otherwise(F.col("raw_text"))
    return doc.select("doc_id", results.invoice_profile(body).alias("profile"))


def _gross(doc: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    body = F.concat(F.lit("total Montant T.T.C, "), (k % 90 + 10).cast("string"), F.lit(".500 et "), (k % 70 + 5).cast("string"), F.lit(",250"))
    amount = results.gross_fallback(body, (k % 70).cast("decimal(18,3)"), F.lit(5).cast("decimal(18,3)"), F.when(k % 2 == 0, F.lit(0.25)).cast("decimal(18,3)"))
    return doc.select("doc_id", amount.cast("double").alias("amount"))


def _outputs(field: DataFrame) -> DataFrame:
    entries = F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return results.output_values(field, {"invoice_number": "number", "total_amount": "total"}).select("doc_id", entries.alias("data"))


def _formatted(field: DataFrame) -> DataFrame:
    out = results.formatted(results.build_result(field), results.output_values(field), field)
    return out.select("doc_id", "status", F.coalesce(F.size("data"), F.lit(0)).cast("bigint").alias("n_data"), F.size("confidences").cast("bigint").alias("n_confidences"))


_LAYOUT = ["numero_registre", "dirigeant_qualite", "raison_sociale", "adresse_sociale", "photo"]


def _layout(field: DataFrame) -> DataFrame:
    rows = field.groupBy("doc_id").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.max("confidence").alias("c"), F.bool_and("validated").alias("ok")).withColumn("name", F.element_at(F.array(*map(F.lit, _LAYOUT)), (F.col("doc_id") % len(_LAYOUT) + 1).cast("int")))
    base = rows.filter("doc_id % 3 <> 0").select("doc_id", "name", F.col("a").alias("value"), (1 - F.col("c")).alias("confidence"), F.col("ok").alias("validated"))
    return results.merge_layout(base, rows.filter("doc_id % 4 <> 0").select("doc_id", "name", F.col("b").alias("value"), F.col("c").alias("confidence"), F.lit(True).alias("validated")), ["raison_sociale"])


_LAYOUT_SQL = f"""
    g AS (SELECT doc_id, min(value) AS a, max(value) AS b, max(confidence) AS c, bool_and(validated) AS ok, [{", ".join(repr(n) for n in _LAYOUT)}][CAST(doc_id % 5 + 1 AS INT)] AS name FROM field GROUP BY doc_id),
    x AS (SELECT *, doc_id % 3 <> 0 AS ah, doc_id % 4 <> 0 AND name NOT IN ('raison_sociale', 'photo') AND coalesce(b, '') <> '' AS bh, coalesce(doc_id % 3 <> 0 AND ok AND a <> '', false) AS held FROM g),
    y AS (SELECT *, CASE WHEN NOT bh THEN 'kept' WHEN NOT held THEN 'added' WHEN name = 'dirigeant_qualite' AND a <> b THEN 'replaced' ELSE 'kept' END AS action FROM x WHERE ah OR bh)
    SELECT doc_id, name, CASE WHEN action = 'kept' THEN a ELSE b END AS value, CAST(CASE WHEN action = 'kept' THEN 1 - c ELSE round(c, 3) END AS DOUBLE) AS confidence, CASE WHEN action = 'kept' THEN ok ELSE true END AS validated, action FROM y"""

_LABELLED = ["family_name", "first_name", "date_of_birth", "place_of_birth"]


def _override(field: DataFrame) -> DataFrame:
    rows = field.groupBy(F.expr("doc_id div 4").alias("doc_id"), F.element_at(F.array(*map(F.lit, _LABELLED)), (F.col("doc_id") % 4 + 1).cast("int")).alias("name")).agg(F.min("value").alias("a"), F.max("value").alias("b"), F.bool_or("validated").alias("ok"), F.max("confidence").alias("c"))
    spatial = rows.select("doc_id", "name", F.col("a").alias("value"), F.col("ok").alias("valid"), (F.col("c") / 2).alias("score"))
    labelled = rows.select("doc_id", "name", F.col("b").alias("value"), F.lit(True).alias("valid"), F.when(F.col("c") > 0.5, F.col("c")).alias("score"))
    return results.override_by_labels(spatial, labelled, ["A1"]).select("doc_id", "name", "value", F.round("score", 4).alias("score"), "taken")


_OVERRIDE_SQL = f"""
    g AS (SELECT CAST(floor(doc_id / 4) AS BIGINT) AS doc_id, [{", ".join(repr(n) for n in _LABELLED)}][CAST(doc_id % 4 + 1 AS INT)] AS name, min(value) AS a, max(value) AS b, bool_or(validated) AS ok, max(confidence) AS c FROM field GROUP BY 1, 2),
    o AS (SELECT doc_id, CASE name WHEN 'family_name' THEN 'first_name' ELSE 'family_name' END AS name, b AS other FROM g WHERE name IN ('family_name', 'first_name')),
    x AS (SELECT g.*, other, coalesce(a, '') IN ('', '[]') AS empty, coalesce(b, '') NOT IN ('', '[]') AS bh FROM g LEFT JOIN o ON g.doc_id = o.doc_id AND g.name = o.name),
    y AS (SELECT *, bh AND coalesce(CASE WHEN name IN ('family_name', 'first_name') THEN empty OR NOT ok OR coalesce(a = other, false) WHEN name = 'place_of_birth' THEN empty OR a = 'A1' OR (a <> b AND length(b) > length(a)) ELSE empty END, false) AS taken FROM x)
    SELECT doc_id, name, CASE WHEN taken THEN b ELSE a END AS value, CAST(round(CASE WHEN taken THEN greatest(c / 2, CASE WHEN c > 0.5 THEN c ELSE 0.90 END) ELSE c / 2 END, 4) AS DOUBLE) AS score, taken FROM y"""

RULE_TABLE = [
    ("invoice", "number", 1, r"N° (INV-\d*5)\b"), ("invoice", "number", 2, r"(INV-\d+)"), ("invoice", "client", 1, r"Client: ([^\n]+)"), ("invoice", "stamp", 1, r"Timbre: (\d+)"),
    ("identity", "place", 1, r"CIN_PLACE: (\w+)"), ("identity", "number", 1, r"(\d{8}) : Numero"),
]


def _rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "invoice_text").select("doc_id", "raw_text", F.lit("invoice").alias("document_type")).unionByName(table(spark, sf_dir, "identity_text").select((-F.col("doc_id") - 1).alias("doc_id"), "raw_text", F.lit("identity").alias("document_type")))
    return plugins.extract_by_rule_table(docs, spark.createDataFrame(RULE_TABLE, "document_type string, name string, place int, pattern string"))


_RULE_TABLE_SQL = """
    SELECT CAST(o_orderkey AS BIGINT) AS doc_id, 'number' AS name, concat('INV-', o_orderkey) AS value, CASE WHEN o_orderkey % 10 = 5 THEN 1 ELSE 2 END AS place FROM orders
    UNION ALL SELECT o_orderkey, 'client', concat('Customer ', o_custkey), 1 FROM orders
    UNION ALL SELECT -c_custkey - 1, 'place', c_mktsegment, 1 FROM customer UNION ALL SELECT -c_custkey - 1, 'number', lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 1 FROM customer"""


def _families(passport: DataFrame, extract: DataFrame, invoice: DataFrame) -> DataFrame:
    """Three tables of texts as one, each with its family; extracts of kind 2 are of a family that no extractor takes."""
    part = lambda df, k, family, variant=None: df.select((F.col("doc_id") * 3 + k).alias("doc_id"), "raw_text", family.alias("family"), F.lit(variant).cast("string").alias("variant"))
    family = F.when(F.col("kind") == 2, "unknown").otherwise("business_registry")
    docs = part(passport, 0, F.lit("id_document"), "passport_generic").unionByName(part(extract, 1, family)).unionByName(part(invoice, 2, F.lit("invoice")))
    return plugins.extract(docs, plugins.default_extractors(YEAR)).select("doc_id", "extractor", "name", "value", "validated")


def _legacy(invoice: DataFrame, extract: DataFrame) -> DataFrame:
    docs = invoice.select((F.col("doc_id") * 2).alias("doc_id"), "raw_text", F.when(F.col("doc_id") % 3 != 0, "FACTURE").alias("family"))
    return extraction.legacy_extract(docs.unionByName(extract.select((F.col("doc_id") * 2 + 1).alias("doc_id"), "raw_text", F.lit("REGISTRE_COMMERCE").alias("family"))))


_LEGACY_SQL = """
    SELECT doc_id * 2 AS doc_id, unnest(['invoice_number', 'invoice_date', 'total_ttc', 'ice']) AS name,
           unnest([regexp_extract(raw_text, 'N° ([A-Z0-9-]+)', 1), regexp_extract(raw_text, 'Date: ([0-9/]+)', 1), regexp_extract(raw_text, 'Total TTC: ([0-9,]+)', 1), NULL]) AS value FROM invoice_text WHERE doc_id % 3 <> 0
    UNION ALL SELECT doc_id * 2 + 1, unnest(['rc_number', 'company_name', 'if_number', 'ice']), unnest([CASE kind WHEN 0 THEN 'ial' END, CASE kind WHEN 0 THEN concat(company, ' SUARL') WHEN 3 THEN company END, NULL, NULL]) FROM registry_text"""


def _registry_zones(extract: DataFrame) -> DataFrame:
    zone = lambda name, *parts: F.struct(F.lit(name).alias("zone"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))
    day, k = F.col("day"), F.col("k")
    every = F.array(zone("company_block", "Nom Commercial : Boutique ", k), zone("adresse_zone", "Adresse Sociale - rue ", k, " Capital : 5 "), zone("activity_block", "Activité Principale : vente Forme Juridique : "), zone("forme_juridique_zone", "sarl"), zone("direction_table_zone", "2019-01-02 Gérant tunisien ", day, "/06/1970 Ali ", F.col("seg")))
    return registry.registry_zone_fields(extract.select("doc_id", F.inline(F.when(F.col("kind") < 2, every).otherwise(F.slice(every, 1, 2)))))


_REGISTRY_ZONES_SQL = """
    SELECT doc_id, 'nom_commercial' AS name, concat('Boutique ', k) AS value, CAST(0.58 AS DOUBLE) AS confidence, 'company_block' AS source_zone FROM registry_text
    UNION ALL SELECT doc_id, 'adresse_sociale', concat('rue ', k), 0.60, 'adresse_zone' FROM registry_text UNION ALL SELECT doc_id, 'activite_principale', 'vente', 0.58, 'activite_zone' FROM registry_text WHERE kind < 2
    UNION ALL SELECT doc_id, 'forme_juridique', 'sarl', 0.58, 'forme_juridique_zone' FROM registry_text WHERE kind < 2 UNION ALL SELECT doc_id, 'dirigeant_date_naissance', concat('1970-06-', day), 0.72, 'direction_table_zone' FROM registry_text WHERE kind < 2
    UNION ALL SELECT doc_id, 'dirigeant_nationalite', 'Tunisienne', 0.68, 'direction_table_zone' FROM registry_text WHERE kind < 2 UNION ALL SELECT doc_id, 'dirigeant_qualite', 'Gérant', 0.58, 'direction_table_zone' FROM registry_text WHERE kind < 2
    UNION ALL SELECT doc_id, 'dirigeant_nom_prenom', concat('Ali ', seg), 0.48, 'direction_table_zone' FROM registry_text WHERE kind < 2"""


def _best_place(card: DataFrame) -> DataFrame:
    one = lambda value, score, source, rank: F.struct(value.alias("value"), F.lit(score).alias("score"), F.array(source).alias("sources"), F.lit(rank).alias("rank"))
    every = F.array(one(F.lit("XYZ"), 99.0, F.lit("spatial_boxes"), 1), one(F.col("place"), 10.0, F.when(F.col("doc_id") % 3 != 0, "text_place_global").otherwise("zone"), 2), one(F.lit("تونس"), 12.0, F.lit("spatial_boxes"), 3))
    return identity.best_place(card.select("doc_id", F.inline(every)))


def _scored(card: DataFrame) -> DataFrame:
    """Candidates of cards: numbers (every fifth with a digit too many), names (every seventh a label), dates and places."""
    one = lambda name, raw, source: F.struct(F.lit(name).alias("field"), raw.alias("raw_text"), F.lit(source).alias("source"))
    k = F.col("doc_id")
    every = F.array(
        one("id_number", F.concat(F.lit("رقم "), "number", F.when(k % 5 == 0, "7").otherwise("")), "zone:id_number"), one("last_name", F.when(k % 7 == 0, F.lit("اللقب")).otherwise(F.col("family")), "zone:names"),
        one("birth_date", F.concat("day", F.lit("/03/"), "year"), "full"), one("birth_place", F.col("place"), "zone:right_text"),
    )
    rows = card.select("doc_id", "kind", F.inline(every)).withColumns({"confidence": F.col("doc_id") % 10 / 10, "anchor_hit": F.col("kind") == 0, "same_line": F.col("kind") != 2, "wanted_zone": F.when(F.col("field") == "id_number", "id_number").otherwise("none")})
    return identity.score_candidates(rows).select("doc_id", "field", "value", "valid", "business_score")


_SCORED_SQL = """
    c AS (SELECT *, doc_id % 10 / 10 AS g FROM card_text),
    x AS (SELECT doc_id, 'id_number' AS field, number AS value, true AS valid, CASE WHEN doc_id % 5 = 0 THEN 0.74 ELSE least(0.99, 0.76 + g * 0.20 + 0.14) END AS s FROM c
    UNION ALL SELECT doc_id, 'last_name', CASE WHEN doc_id % 7 <> 0 THEN family END, doc_id % 7 <> 0, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE least(0.97, 0.28 + g * 0.38 + 0.9 * 0.22 + 0.04 + CASE WHEN kind = 0 THEN 0.12 ELSE 0 END + CASE WHEN kind <> 2 THEN 0.05 ELSE 0 END) END FROM c
    UNION ALL SELECT doc_id, 'birth_date', concat(year, '-03-', day), true, least(0.98, 0.54 + g * 0.34) FROM c
    UNION ALL SELECT doc_id, 'birth_place', place, true, greatest(0, least(0.90, 0.18 + g * 0.35 + 0.9 * 0.20 - 0.04 + CASE WHEN kind = 0 THEN 0.08 ELSE 0 END)) FROM c)
    SELECT doc_id, field, value, valid, CAST(round(CAST(s AS DECIMAL(18,9)), 3) AS DOUBLE) AS business_score FROM x"""


#: Texts of zones by the key modulo 8.
_ZONE_TEXTS = {
    "birth_date": ("concat(lpad(CAST(1 + doc_id % 28 AS {s}), 2, '0'), ' . O3.1', '98', CAST(doc_id % 10 AS {s}))", "concat('198', CAST(doc_id % 10 AS {s}), '-03-', lpad(CAST(1 + doc_id % 28 AS {s}), 2, '0'))", "true"),
    "gender": ("CASE WHEN doc_id % 3 = 0 THEN 'sex: f' ELSE 'x' END", "CASE WHEN doc_id % 3 = 0 THEN 'F' END", "doc_id % 3 = 0"),
    "number": ("concat('[U ', CAST(100000 + doc_id AS {s}), '|')", "concat('EU', CAST(100000 + doc_id AS {s}))", "true"),
    "id_number": ("concat('no ', CASE WHEN doc_id % 3 = 0 THEN concat(CAST(500000 + doc_id AS {s}), '/') ELSE substr(CAST(500000 + doc_id AS {s}), 1, 6) END, 'l2I')", "CASE WHEN doc_id % 3 = 0 THEN concat(CAST(500000 + doc_id AS {s}), '/121') ELSE concat('0', substr(CAST(500000 + doc_id AS {s}), 1, 5), '/', substr(CAST(500000 + doc_id AS {s}), 6, 1), '121') END", "true"),
    "nationality": ("CASE WHEN doc_id % 3 = 0 THEN 'svk ' ELSE 'gtt' END", "CASE WHEN doc_id % 3 = 0 THEN 'SVK' ELSE 'GTT' END", "doc_id % 3 = 0"),
    "surname": ("CASE WHEN doc_id % 3 = 0 THEN 'Novák  Jana' WHEN doc_id % 3 = 1 THEN 'C S E trjeo' ELSE 'SURNAME' END", "CASE WHEN doc_id % 3 = 0 THEN 'Novák Jana' WHEN doc_id % 3 = 1 THEN 'C S E trjeo' END", "doc_id % 3 = 0"),
    "issue_place": ("CASE WHEN doc_id % 3 = 0 THEN 'Bratislava, (II)' ELSE 'Md' END", "CASE WHEN doc_id % 3 = 0 THEN 'Bratislava, (II)' ELSE 'Md' END", "doc_id % 3 = 0"),
    "note": ("CASE WHEN doc_id % 3 = 0 THEN ' a  b ' ELSE '' END", "CASE WHEN doc_id % 3 = 0 THEN 'a b' END", "doc_id % 3 = 0"),
}


def _zones(doc: DataFrame) -> DataFrame:
    raw = F.expr("CASE name " + " ".join(f"WHEN '{n}' THEN {t.format(s='STRING')}" for n, (t, _, _) in _ZONE_TEXTS.items()) + " END")
    names = doc.select("doc_id", F.element_at(F.array(*map(F.lit, _ZONE_TEXTS)), (F.col("doc_id") % len(_ZONE_TEXTS) + 1).cast("int")).alias("name"))
    rows = names.select("doc_id", "name", raw.alias("text"), (F.col("doc_id") % 5 / 5).alias("mean"), (F.col("doc_id") % 2 == 0).alias("required"))
    return results.zone_fields(rows)


def _zones_sql() -> str:
    case = lambda k: "CASE name " + " ".join(f"WHEN '{n}' THEN {x[k].format(s='VARCHAR')}" for n, x in _ZONE_TEXTS.items()) + " END"
    errors = "CASE name " + " ".join(f"WHEN '{n}' THEN '{e}'" for n, e in results.ZONE_ERRORS.items()) + " ELSE 'empty' END"
    names = ", ".join(f"'{n}'" for n in _ZONE_TEXTS)
    return f"""n AS (SELECT doc_id, [{names}][CAST(doc_id % {len(_ZONE_TEXTS)} + 1 AS INT)] AS name FROM card_text), x AS (SELECT *, {case(1)} AS value, {case(2)} AS ok FROM n)
        SELECT doc_id, name, value, CAST(round(CASE WHEN ok THEN least(0.95, 0.70 + 0.25 * (doc_id % 5 / 5)) WHEN value IS NOT NULL THEN 0.45 ELSE 0 END, 4) AS DOUBLE) AS confidence, ok AS validated, CASE WHEN NOT ok THEN {errors} END AS error, doc_id % 2 = 0 AND NOT ok AS review_required FROM x"""


_LANGUAGE_SQL = "SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 10 THEN 'en' WHEN " + "len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}]')) > len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]')) THEN 'ar' " + " ".join(
    f"WHEN n{i} > 0 AND n{i} = greatest(n0, n1, n2, n3) THEN '{lang}'" for i, lang in enumerate(text.STOP_WORDS)
) + " ELSE 'en' END AS language FROM (SELECT doc_id, text, " + ", ".join(
    f"len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda w: w IN ({', '.join(repr(w) for w in words)}))) AS n{i}" for i, words in enumerate(text.STOP_WORDS.values())
) + " FROM documents)"


#: Name: query, working tables of its SQL, SQL.
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], list[str], str | None]] = {
    "passport_zones": (_table("passport_text", lambda d: _zone(d).select("doc_id", "line1", "line2", "valid")), ["passport_text"], """
        SELECT doc_id, CASE WHEN kind <> 5 THEN line1 END AS line1, CASE kind WHEN 4 THEN bad_line2 WHEN 2 THEN concat(substr(line2, 1, 20), '0', substr(line2, 22)) WHEN 5 THEN NULL ELSE line2 END AS line2, kind NOT IN (4, 5) AS valid FROM passport_text"""),
    "zone_fields": (_table("passport_text", lambda d: passports.zone_fields(_zone(d))), ["passport_text"], _zone_fields_sql()),
    "passport_fields": (_table("passport_text", lambda d: passports.passport_fields(d, F.lit(YEAR))), ["passport_text"], _passport_sql()),
    "registry_fields": (_table("registry_text", registry.registry_fields), ["registry_text"], _registry_sql()),
    "registry_modern": (_table("registry_text", registry.registry_modern), ["registry_text"], _MODERN_SQL),
    "choose_registry_values": (_table("field", lambda d: registry.choose_registry_values(*_two_runs(d))), ["field"], _CHOSEN_SQL),
    "registry_warnings": (_table("registry_text", lambda d: registry.registry_warnings(registry.registry_fields(d))), ["registry_text"], """
        SELECT doc_id, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'raison_sociale' WHEN 2 THEN 'identifiant_unique' ELSE 'date_extrait,identifiant_unique' END AS warnings FROM registry_text"""),
    "rule_table_fields": (_rule_table, [], _RULE_TABLE_SQL),
    "routed_fields": (_tables(["passport_text", "registry_text", "invoice_text"], _families), ["passport_text", "registry_text", "invoice_text"], f"""
        p AS ({_passport_sql()}), r AS ({_registry_sql()})
        SELECT doc_id * 3 AS doc_id, 'passport' AS extractor, name, value, validated FROM p
        UNION ALL SELECT r.doc_id * 3 + 1, 'registry', name, value, validated FROM r JOIN registry_text t ON r.doc_id = t.doc_id WHERE kind <> 2
        UNION ALL SELECT doc_id * 3 + 2, 'invoice', n, v, true FROM (SELECT doc_id, unnest(['invoice_number', 'customer', 'invoice_date', 'total_ht', 'vat', 'total_ttc']) AS n, unnest([regexp_extract(raw_text, 'N° ([A-Z0-9-]+)', 1), regexp_extract(raw_text, 'Client: ([^\\n]+)', 1),
            strftime(make_date(CAST(regexp_extract(raw_text, 'Date: (\\d+)/(\\d+)/(\\d+)', 3) AS INT), CAST(regexp_extract(raw_text, 'Date: (\\d+)/(\\d+)/(\\d+)', 2) AS INT), CAST(regexp_extract(raw_text, 'Date: (\\d+)/(\\d+)/(\\d+)', 1) AS INT)), '%Y-%m-%d'),
            CAST(CAST(replace(regexp_extract(raw_text, 'Total HT: ([0-9,]+)', 1), ',', '.') AS DECIMAL(18,3)) AS VARCHAR), CAST(CAST(replace(regexp_extract(raw_text, 'TVA 19%: ([0-9,]+)', 1), ',', '.') AS DECIMAL(18,3)) AS VARCHAR), CAST(CAST(replace(regexp_extract(raw_text, 'Total TTC: ([0-9,]+)', 1), ',', '.') AS DECIMAL(18,3)) AS VARCHAR)]) AS v FROM invoice_text)"""),
    "legacy_fields": (_tables(["invoice_text", "registry_text"], _legacy), ["invoice_text", "registry_text"], _LEGACY_SQL),
    "registry_zone_fields": (_table("registry_text", _registry_zones), ["registry_text"], _REGISTRY_ZONES_SQL),
    "best_places": (_table("card_text", _best_place), ["card_text"], "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 OR contains(place, ' ') THEN place ELSE 'تونس' END AS place FROM card_text"),
    "score_candidates": (_table("card_text", _scored), ["card_text"], _SCORED_SQL),
    "document_types": (_tables(["passport_text", "registry_text"], _types), ["passport_text", "registry_text"], """
        SELECT doc_id * 2 AS doc_id, CASE kind WHEN 6 THEN 'unknown' ELSE 'passport' END AS document_type, CAST(CASE kind WHEN 6 THEN 0 ELSE 1 END AS DOUBLE) AS confidence FROM passport_text
        UNION ALL SELECT doc_id * 2 + 1, CASE kind WHEN 1 THEN 'cin_tn' WHEN 2 THEN 'unknown' ELSE 'registre_commerce' END, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 0.875 WHEN 2 THEN 0 ELSE 0.5 END FROM registry_text"""),
    "type_compatible": (_table("history", _compatible), ["history"], _COMPATIBLE_SQL),
    "keyword_family": (_documents(lambda d: d.select("doc_id", results.first_keyword_family(F.col("text")).alias("family"))), [], "SELECT doc_id, CASE WHEN regexp_matches(t, 'facture|invoice|ttc|montant total') THEN 'FACTURE' WHEN regexp_matches(t, 'registre de commerce|raison sociale|rc|denomination') THEN 'REGISTRE_COMMERCE' ELSE 'CIN' END AS family FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)"),
    "choose_extractor": (_table("history", _extractor), ["history"], "SELECT id AS doc_id, coalesce(CASE WHEN global_confidence >= 0.5 AND user_id <> '5' THEN concat('template:', template_id) END, CASE document_type WHEN 'invoice' THEN 'invoice_fields' WHEN 'passport' THEN 'passport_fields' END, CASE WHEN user_id <> '5' THEN concat('template:', template_id) END, 'none') AS extractor FROM history"),
    "invoice_profiles": (_table("invoice_text", _profiles), ["invoice_text"], "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ttn_electronic' WHEN 1 THEN 'simple' WHEN 2 THEN 'unknown' ELSE 'standard' END AS profile FROM invoice_text"),
    "gross_fallback": (_table("invoice_text", _gross), ["invoice_text"], "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 70 + 5.25 ELSE greatest(doc_id % 90 + 10.5, doc_id % 70 + 5.25) END AS DOUBLE) AS amount FROM invoice_text"),
    "build_results": (_table("field", results.build_result), ["field"], """
        c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (validated) AS n_valid, count(*) FILTER (coalesce(value, '') NOT IN ('', '[]')) AS n_present, bool_or(review_required) AS review, avg(confidence) AS mean, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (review_required), '') AS review_reasons FROM field GROUP BY 1)
        SELECT doc_id, CASE WHEN review THEN 'review_required' WHEN n_valid / n >= 0.70 THEN 'success' ELSE 'partial' END AS status, CAST(round(CAST(0.65 * mean + 0.35 * n_valid / n AS DECIMAL(18,9)), 4) AS DOUBLE) AS global_confidence, round(n_valid / n, 4) AS coverage, n_valid, n_present, review_reasons FROM c"""),
    "output_values": (_table("field", _outputs), ["field"], "v AS (SELECT doc_id, CASE name WHEN 'invoice_number' THEN 'number' WHEN 'total_amount' THEN 'total' ELSE name END AS key, max(value) AS value FROM field WHERE validated AND coalesce(value, '') NOT IN ('', '[]') GROUP BY 1, 2) SELECT doc_id, string_agg(concat(key, '=', value), ';' ORDER BY key) AS data FROM v GROUP BY 1"),
    "formatted_results": (_table("field", _formatted), ["field"], """
        c AS (SELECT doc_id, bool_or(review_required) AS review, count(*) FILTER (validated) / count(*) AS share, count(DISTINCT CASE WHEN validated AND coalesce(value, '') NOT IN ('', '[]') THEN name END) AS n_data, count(DISTINCT name) AS n_confidences FROM field GROUP BY 1)
        SELECT doc_id, CASE WHEN review THEN 'review_required' WHEN share >= 0.70 THEN 'success' ELSE 'partial' END AS status, n_data, n_confidences FROM c"""),
    "drop_visual": (_table("region", lambda d: results.drop_visual(d.withColumnRenamed("field_name", "name")).select("filename", "name", "x", "y")), ["region"], "SELECT filename, field_name AS name, x, y FROM region WHERE field_name <> 'photo'"),
    "template_summary": (_tables(["template", "region", "history"], lambda t, r, h: results.template_summary(t, r.select(F.concat(F.lit("tpl-"), F.substring_index("class_name", "-", -1)).alias("template_id")), h)), ["template", "region", "history"], """
        f AS (SELECT concat('tpl-', split_part(class_name, '-', 2)) AS id, count(*) AS n FROM region GROUP BY 1), u AS (SELECT template_id AS id, count(*) AS n FROM history GROUP BY 1)
        SELECT t.id, t.name, coalesce(f.n, 0) AS field_count, coalesce(u.n, 0) AS usage_count FROM template t LEFT JOIN f ON t.id = f.id LEFT JOIN u ON t.id = u.id"""),
    "merge_layout": (_table("field", _layout), ["field"], _LAYOUT_SQL),
    "override_by_labels": (_table("field", _override), ["field"], _OVERRIDE_SQL),
    "document_summary": (_table("case_result", results.document_summary), ["case_result"], "SELECT case_id, family, critical_total - critical_valid_count AS critical_missing, critical_valid_count >= critical_total AS critical_pass, http_ok AND template_ok AND api_status IN ('success', 'review_required', 'partial') AND critical_valid_count >= critical_total AS benchmark_pass FROM case_result"),
    "service_counts": (lambda s, d: results.service_counts(table(s, d, "job"), s.read.parquet(f"{d}/events.parquet"), F.col("event_id") % 9 == 0), ["job"], """
        SELECT 'pages_processed' AS name, organization_id AS label, CAST(sum(page_count) AS BIGINT) AS n FROM job WHERE status = 'done' GROUP BY 2 UNION ALL SELECT 'queue_depth', 'all', count(*) FROM job WHERE status = 'queued' HAVING count(*) > 0
        UNION ALL SELECT 'rate_limit_hits', CAST(user_id AS VARCHAR), count(*) FROM events WHERE event_id % 9 = 0 GROUP BY 2"""),
    "union_variants": (_table("region", lambda d: results.union_variants(d.filter("x < 100").select("filename", "field_name", "x"), d.filter("y < 50").select("filename", "field_name", "y"))), ["region"], "SELECT filename, field_name, x, CAST(NULL AS DOUBLE) AS y FROM region WHERE x < 100 UNION ALL SELECT filename, field_name, NULL, y FROM region WHERE y < 50"),
    "zone_text_fields": (_table("card_text", _zones), ["card_text"], _zones_sql()),
    "card_cleanup": (_table("card_text", lambda d: d.select("doc_id", text.cleanup_arabic(F.concat("place", F.lit(" x\u200f٣-"), "number")).alias("clean"), text.fix_labels(F.concat(F.lit("نساما دمحم "), "family", F.lit(" دمحمم"))).alias("fixed"))), ["card_text"], "SELECT doc_id, concat(place, ' 3-', number) AS clean, concat('الاسم محمد ', family, ' دمحمم') AS fixed FROM card_text"),
    "text_languages": (_documents(lambda d: d.select("doc_id", text.detect_language(F.col("text")).alias("language"))), [], _LANGUAGE_SQL),
    "capital_words": (_table("registry_text", lambda d: d.select("doc_id", registry.capital_in_words(F.concat(F.lit("Capital de "), F.when(F.col("doc_id") % 3 == 0, "CINQ MILLE").when(F.col("doc_id") % 3 == 1, "cent mille"))).alias("amount"))), ["registry_text"], "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '5000' WHEN 1 THEN '100000' END AS amount FROM registry_text"),
    "card_names": (_table("card_text", identity.names_from_text), ["card_text"], "SELECT doc_id, family AS family_name, first AS first_name FROM card_text"),
    "card_places": (_table("card_text", identity.known_place), ["card_text"], "SELECT doc_id, place FROM card_text"),
    "card_birth_dates": (_table("card_text", identity.birth_date), ["card_text"], "SELECT doc_id, CASE kind WHEN 0 THEN concat(year, CASE month WHEN 'مارس' THEN '-03-' ELSE '-10-' END, day) WHEN 1 THEN concat(year, '-03-', day) END AS birth_date FROM card_text"),
    "card_numbers": (_table("card_text", identity.card_number), ["card_text"], "SELECT doc_id, number FROM card_text"),
    "birth_dates": (_table("dated_text", identity.birth_date), ["dated_text"], "SELECT doc_id, concat(year, CASE WHEN kind = 6 THEN '-10-' ELSE '-03-' END, day) AS birth_date FROM dated_text"),
    "identity_card": (_table("card_text", lambda d: identity.identity_card(d, F.lit(YEAR))), ["card_text"], """
        SELECT doc_id, name, value, CASE WHEN value IS NULL THEN 0 ELSE CAST(sure AS DOUBLE) END AS confidence, value IS NOT NULL AS validated, CASE WHEN value IS NULL THEN concat('missing_', name) END AS error, value IS NULL AND name <> 'place_of_birth' AS review_required
        FROM (SELECT doc_id, 'cin_number' AS name, number AS value, 0.95 AS sure FROM card_text UNION ALL SELECT doc_id, 'family_name', family, 0.85 FROM card_text UNION ALL SELECT doc_id, 'first_name', first, 0.85 FROM card_text
              UNION ALL SELECT doc_id, 'date_of_birth', CASE kind WHEN 0 THEN concat(year, CASE month WHEN 'مارس' THEN '-03-' ELSE '-10-' END, day) WHEN 1 THEN concat(year, '-03-', day) END, 0.88 FROM card_text UNION ALL SELECT doc_id, 'place_of_birth', place, 0.82 FROM card_text)"""),
    "identity_warnings": (_table("field", identity.identity_warnings), ["field"], "SELECT doc_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (review_required AND NOT validated), '') AS warnings FROM field GROUP BY doc_id"),
    "name_quality": (_table("card_text", lambda d: d.select("doc_id", identity.phrase_quality(F.concat_ws(" ", "family", "first", F.when(F.col("kind") == 1, F.lit("الاسم")), F.when(F.col("kind") == 2, F.col("family")), F.when(F.col("doc_id") % 2 == 0, F.col("day")))).alias("quality"))), ["card_text"],
                     "SELECT doc_id, CAST(round(0.9 - CASE WHEN kind = 1 THEN 0.35 ELSE 0 END - CASE WHEN kind = 2 THEN 0.10 ELSE 0 END - CASE WHEN doc_id % 2 = 0 THEN 0.25 ELSE 0 END, 4) AS DOUBLE) AS quality FROM card_text"),
    "candidate_confidence": (_table("candidate", _confidence), ["candidate"], """
        g AS (SELECT doc_id, field, value, avg(avg_conf) AS mean, count(*) AS n, max(CASE WHEN source = 'spatial' THEN 1 ELSE 0 END) AS spatial, max(CASE WHEN source = 'zone' THEN 1 ELSE 0 END) AS zone FROM candidate GROUP BY 1, 2, 3)
        SELECT doc_id, field, value, CAST(round(CAST(least(0.95, 0.58 + least(mean, 1) * 0.15 + least(n, 3) * 0.05 + 0.10 * spatial + 0.03 * zone + CASE WHEN 7 * n + mean >= 20 THEN 0.10 WHEN 7 * n + mean >= 12 THEN 0.05 ELSE 0 END) AS DECIMAL(18,9)), 3) AS DOUBLE) AS confidence FROM g"""),
    "best_zone_run": (_table("passport_text", lambda d: passports.best_zone_run(_runs(d))), ["passport_text"], """
        r AS (SELECT CAST(floor(doc_id / 3) AS BIGINT) AS doc_id, concat('run-', doc_id % 3) AS run, kind, kind NOT IN (4, 5) AS valid,
                     CASE WHEN kind IN (4, 5) THEN -15.0 ELSE 12.0 * 1.97 + 50.0 * 1.94 + CASE WHEN kind = 2 THEN 0 ELSE 4 * 1.94 END END AS score FROM passport_text),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY valid DESC, CASE WHEN kind = 4 THEN 0 ELSE 1 END, run) AS n FROM r)
        SELECT doc_id, run, CAST(round(CASE WHEN valid THEN score ELSE -15.0 END, 4) AS DOUBLE) AS score, valid FROM k WHERE n = 1"""),
}
