"""Registered queries of fields told by where texts stand, of places, fused readings, tables of lines and keyed states, with SQL that walks
through all pairs or rows plainly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.dates import parse_date_any
from fieldloom.operators import invoice_header as headers
from fieldloom.operators import line_tables, places, readings, spatial
from fieldloom.operators.spatial import Wanted
from fieldloom.plans.tables import table
from fieldloom.streaming import states

_TOWNS = "Tunis|Sfax|Gabes|Sousse"
_LABELS = r"\b(Nom|Naissance|Lieu)\b"


def _form_name(text):
    return F.when(text.rlike(r"^[A-Za-z]+( [A-Za-z]+){0,2}$") & ~text.rlike(_LABELS), text)


FORM = [
    Wanted("name", ("Nom",), _form_name),
    Wanted("birth_date", ("Naissance",), parse_date_any, joined=True),
    Wanted("birth_place", ("Lieu",), lambda t: F.regexp_extract(t, rf"\b({_TOWNS})\b", 1), joined=True, less=tuple(spatial.PLACE_LESS.items())),
]
REACH = 150.0


def near_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.label_fields(table(spark, sf_dir, "form_box"), FORM, REACH, skip="^emis")


def spatial_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spatial_fields(table(spark, sf_dir, "card_box")).select("doc_id", "name", "value", "how")


def _bare(kind: str, text: str) -> str:
    pattern = {"name": r"(?i)\b(Nom|moN)\b", "birth_date": "(?i)Naissance|ecnassiaN", "birth_place": "(?i)Lieu|ueiL"}[kind]
    return rf"regexp_replace(regexp_replace(regexp_replace({text}, '{pattern}', ' ', 'g'), '\s+', ' ', 'g'), '^[\s:;,_/|.-]+|[\s:;,_/|.-]+$', '', 'g')"


def _each(of) -> str:
    return "CASE k " + " ".join(f"WHEN '{k}' THEN {of(k)}" for k in ("name", "birth_date", "birth_place")) + " END"


_NEAR = rf"""
    g AS (SELECT doc_id, idx, trim(text) AS text, coalesce(confidence, 0) AS conf, x1, x2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y2 - y1 AS h FROM form_box WHERE trim(text) <> '' AND x2 > x1 AND y2 > y1),
    a AS (SELECT k, doc_id, idx AS ai, text AS att, conf AS ac, x1 AS ax, cx AS acx, cy AS acy, h AS ah, x2 AS ax2 FROM g, (VALUES ('name', '\b(Nom|moN)\b'), ('birth_date', 'Naissance|ecnassiaN'), ('birth_place', 'Lieu|ueiL')) v(k, lab) WHERE regexp_matches(text, lab)),
    p AS (SELECT *, sqrt(pow(cx - acx, 2) + pow(cy - acy, 2)) AS d, idx = ai AND text = att AND x1 = ax AND cy = acy AND h = ah AND x2 = ax2 AND conf = ac AS self, abs(cy - acy) <= 0.9 * greatest(h, ah) AS in_row,
                 cy > acy AND cy - acy <= 2.4 * greatest(h, ah) AS below, cy < acy AND acy - cy <= 2.0 * greatest(h, ah) AS above FROM a JOIN g USING (doc_id)),
    q AS (SELECT * FROM p WHERE d <= {REACH}),
    c AS (
        SELECT doc_id, k, {_each(lambda k: _bare(k, "att"))} AS text, CASE WHEN k = 'name' THEN 'inline' ELSE 'line' END AS how, CASE WHEN k = 'name' THEN 15.0 ELSE 14.0 END + 0.2 * ac AS score, ai AS li, ai AS bi FROM a
        UNION ALL SELECT doc_id, k, text, 'row', 12.0 + 0.18 * conf - 0.02 * d, ai, idx FROM q WHERE k = 'name' AND NOT self AND in_row AND NOT starts_with(text, 'emis')
        UNION ALL SELECT doc_id, k, {_bare("name", "CASE WHEN x1 < ax THEN concat(text, ' ', att) ELSE concat(att, ' ', text) END")}, 'merged', 12.5 + 0.18 * conf - 0.02 * d, ai, idx FROM q WHERE k = 'name' AND NOT self AND in_row AND NOT starts_with(text, 'emis')
        UNION ALL SELECT doc_id, k, text, 'beside', 8.5 + 0.15 * conf - 0.02 * d, ai, idx FROM q WHERE k = 'name' AND NOT self AND NOT in_row AND (below OR above) AND NOT starts_with(text, 'emis')
        UNION ALL SELECT doc_id, k, {_each(lambda k: _bare(k, "t"))}, 'around', CASE WHEN k = 'birth_place' THEN 11.5 ELSE 12.5 END, ai, ai FROM (SELECT doc_id, k, ai, att, ax, acy, ah, ax2, ac, string_agg(text, ' ' ORDER BY cy, x1, idx, text) AS t FROM q WHERE k <> 'name' AND (self OR in_row OR below) GROUP BY ALL)
        UNION ALL SELECT doc_id, k, t, 'right', CASE WHEN k = 'birth_place' THEN 9.0 ELSE 9.5 END, NULL, NULL FROM (SELECT doc_id, string_agg(text, ' ' ORDER BY cy, x1, idx, text) AS t FROM (SELECT *, max(x2) OVER (PARTITION BY doc_id) AS width FROM g) WHERE x1 >= 0.42 * width OR cx >= 0.42 * width GROUP BY doc_id), (VALUES ('birth_date'), ('birth_place')) v(k)),
    v AS (SELECT *, CASE k WHEN 'name' THEN CASE WHEN regexp_full_match(text, '[A-Za-z]+( [A-Za-z]+){{0,2}}') AND NOT regexp_matches(text, '{_LABELS}') THEN text END
                          WHEN 'birth_date' THEN nullif(regexp_replace(regexp_extract(text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'), '(..)/(..)/(....)', '\3-\2-\1'), '')
                          ELSE nullif(regexp_extract(text, '\b({_TOWNS})\b', 1), '') END AS value, round(score, 9) AS s,
                 list_position(['inline', 'merged', 'row', 'beside', 'line', 'around', 'right'], how) AS r FROM c)
    SELECT doc_id, k AS name, value, round(s, 4) AS score, how FROM v WHERE value IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY s DESC, r, coalesce(li, -1), coalesce(bi, -1), value DESC) = 1"""

_CARD = """
    SELECT doc_id, unnest([{'name': 'cin_number', 'value': number, 'how': 'row'}, {'name': 'family_name', 'value': family, 'how': how}, {'name': 'first_name', 'value': CASE WHEN first <> family THEN first END, 'how': how},
                           {'name': 'date_of_birth', 'value': day, 'how': joined}, {'name': 'place_of_birth', 'value': place, 'how': CASE WHEN kind = 3 THEN 'right' ELSE joined END}], recursive := true)
    FROM (SELECT doc_id, CAST(doc_id % 4 AS INT) AS kind, CASE doc_id % 4 WHEN 0 THEN 'merged' WHEN 1 THEN 'inline' ELSE 'beside' END AS how, CASE doc_id % 4 WHEN 1 THEN 'line' WHEN 3 THEN 'right' ELSE 'around' END AS joined,
                 max(text) FILTER (idx = 2) AS number, max(regexp_replace(text, '^اللقب : ', '')) FILTER (idx = CASE WHEN doc_id % 4 = 1 THEN 3 ELSE 4 END) AS family, max(regexp_replace(text, '^الاسم ', '')) FILTER (idx = CASE WHEN doc_id % 4 = 1 THEN 5 ELSE 6 END) AS first,
                 max(regexp_replace(regexp_replace(text, '^تاريخ الولادة ', ''), '(..)/(..)/(....)', '\\3-\\2-\\1')) FILTER (idx = CASE WHEN doc_id % 4 = 1 THEN 7 ELSE 8 END) AS day, max(regexp_replace(text, '^مكانها ', '')) FILTER (idx = CASE WHEN doc_id % 4 = 1 THEN 9 ELSE 10 END) AS place
          FROM card_box GROUP BY doc_id)"""

READING_BONUS = {"spatial": 3.0, "zone": 1.5}
READING_KINDS = {"spatial": "boxes", "zone": "boxes", "text_global": "text", "text_line": "text"}


def fused_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.fuse(table(spark, sf_dir, "reading"), READING_BONUS, READING_KINDS)


#: All pairs of all clusters.
_FUSED = r"""
    r AS (SELECT doc_id, field, coalesce(confidence, 0) AS conf, CASE source WHEN 'spatial' THEN 3.0 WHEN 'zone' THEN 1.5 ELSE 0 END AS gain, CASE source WHEN 'spatial' THEN 'boxes' WHEN 'zone' THEN 'boxes' WHEN 'text_global' THEN 'text' WHEN 'text_line' THEN 'text' ELSE source END AS kind,
                 CASE WHEN field IN ('family_name', 'first_name') THEN CASE WHEN NOT regexp_matches(value, '[0-9]') AND length(value) >= 3 THEN upper(value) END
                      WHEN field = 'date_of_birth' THEN regexp_replace(value, '(..)/(..)/(....)', '\3-\2-\1') WHEN field = 'cin_number' THEN CASE WHEN length(value) = 11 THEN substr(value, 4) END ELSE trim(value) END AS v FROM reading),
    w AS (SELECT doc_id, field, v, count(*) AS n, sum(conf) AS sure, max(gain) AS gain, list(DISTINCT kind) AS kinds, CASE WHEN regexp_replace(upper(v), '[^A-Z]|[AEIOUY]', '', 'g') = '' THEN v ELSE regexp_replace(upper(v), '[^A-Z]|[AEIOUY]', '', 'g') END AS sk FROM r WHERE v IS NOT NULL GROUP BY 1, 2, 3),
    l AS (SELECT *, first_value(v) OVER (PARTITION BY doc_id, field, sk ORDER BY round(7 * n + sure / n + gain, 6) DESC, v) AS lead FROM w),
    c AS (SELECT doc_id, field, sk, v, n, round(7 * n + sure / n + gain, 6) AS s, kinds
          FROM (SELECT doc_id, field, sk, CASE WHEN field IN ('family_name', 'first_name') AND levenshtein(v, lead) <= greatest(1, length(lead) // 4) THEN lead ELSE v END AS v, sum(n) AS n, sum(sure) AS sure, max(gain) AS gain, flatten(list(kinds)) AS kinds FROM l GROUP BY 1, 2, 3, 4)),
    f AS (SELECT * FROM c WHERE field = 'family_name'), g AS (SELECT * FROM c WHERE field = 'first_name'),
    p AS (SELECT f.doc_id, f.v AS fv, f.s AS fs, f.n AS fn, g.v AS gv, g.s AS gs, g.n AS gn FROM f JOIN g ON f.doc_id = g.doc_id AND f.sk <> g.sk
          QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY round(f.s + g.s + CASE WHEN list_has_any(f.kinds, g.kinds) THEN 3 ELSE 0 END, 6) DESC, f.s DESC, f.v, g.v) = 1),
    b AS (SELECT * FROM c WHERE field NOT IN ('family_name', 'first_name') QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY s DESC, v) = 1),
    o AS (SELECT * FROM c WHERE field IN ('family_name', 'first_name') AND doc_id NOT IN (SELECT doc_id FROM p) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, field, v) = 1)
    SELECT doc_id, 'family_name' AS name, fv AS value, fs AS score, fn AS n FROM p UNION ALL SELECT doc_id, 'first_name', gv, gs, gn FROM p
    UNION ALL SELECT doc_id, field, v, s, n FROM b UNION ALL SELECT doc_id, field, v, s, n FROM o"""

def place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.place_lookup(table(spark, sf_dir, "place_text"), table(spark, sf_dir, "place"), ["lieu"])


def union_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' places and those that invoices name behind a label."""
    named = table(spark, sf_dir, "place_text").select(F.regexp_extract("raw_text", "Lieu: (.*) le 3", 1).alias("place"))
    return places.union_places(table(spark, sf_dir, "place"), named).select("place")


#: Every run of words beside every place.
_PLACES = r"""
    f AS (SELECT min(place) AS place, lower(place) AS form FROM place GROUP BY lower(place)),
    w AS (SELECT doc_id, list_filter(string_split_regex(lower(raw_text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM place_text),
    i AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM w),
    r AS (SELECT doc_id, pos, k AS size, array_to_string(w[pos + 1 : pos + k], ' ') AS run, list_contains(w[greatest(pos - 3, 0) + 1 : pos], 'lieu') OR list_contains(w[pos + k + 1 : pos + k + 1], 'lieu') AS labelled FROM i, (VALUES (1), (2)) v(k) WHERE pos + k <= len(w)),
    d AS (SELECT DISTINCT run FROM r),
    m AS (SELECT run, place, levenshtein(run, form) AS edits FROM d JOIN f ON abs(length(run) - length(form)) <= 1 AND levenshtein(run, form) <= CASE WHEN length(form) >= 5 AND length(run) >= 4 THEN 1 ELSE 0 END)
    SELECT doc_id, place, CAST(edits AS INT) AS edits, labelled FROM r JOIN m USING (run) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY labelled DESC, size DESC, edits, pos, place) = 1"""

#: A line of an order as a row of a table, in each of three layouts: one line with a rate; wrapped, with a rate and a rest of the name behind the
#: numbers; with a unit and a number in the name.
_CODE, _QTY, _PRICE = "concat('P', CAST(l_partkey AS STRING))", "CAST(l_quantity AS BIGINT)", "CAST(100 + l_suppkey % 900 AS BIGINT)"
_ROW = f"""CASE l_orderkey % 3 WHEN 0 THEN concat({_CODE}, ' Piece bleue ', CAST({_QTY} AS STRING), ' 19 ', CAST({_PRICE} AS STRING), ',500 ', CAST({_QTY} * {_PRICE} AS STRING), '.000')
    WHEN 1 THEN concat({_CODE}, ' Piece GRANDE', chr(10), 'modele ', l_returnflag, 'x', chr(10), CAST({_QTY} AS STRING), ' 7% ', CAST({_PRICE} AS STRING), ',0 ', CAST({_QTY} * {_PRICE} AS STRING), chr(10), 'avec housse')
    ELSE concat({_CODE}, ' Cable 5 metres ', CAST({_QTY} AS STRING), ' pcs ', CAST({_PRICE} AS STRING), '.00 ', CAST({_QTY} * {_PRICE} AS STRING), ',00') END"""


def table_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.expr(_ROW).alias("row")).alias("l"))
    docs = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    text = F.concat(F.lit("FACTURE 12\nABC 1 2 3\nCode Designation Qte TVA PU Total\n"), F.array_join(F.transform("l", lambda x: x["row"]), "\n"), F.lit("\nTotal HT 12 13 14\nP1 apres 1 2 3"))
    return line_tables.table_items(docs.select("doc_id", text.alias("raw_text")))


_ITEMS = """
    r AS (SELECT DISTINCT ON (doc_id, code, designation, quantity, price) * FROM (
        SELECT l_orderkey AS doc_id, 'P' || l_partkey AS code, CASE l_orderkey % 3 WHEN 0 THEN 'Piece bleue' WHEN 1 THEN 'Piece GRANDE modele ' || l_returnflag || 'x avec housse' ELSE 'Cable 5 metres' END AS designation, l_quantity AS quantity,
               CASE l_orderkey % 3 WHEN 2 THEN 'pcs' END AS unit, CASE l_orderkey % 3 WHEN 0 THEN 19.0 WHEN 1 THEN 7.0 END AS tax_rate, 100 + l_suppkey % 900 + CASE WHEN l_orderkey % 3 = 0 THEN 0.5 ELSE 0 END AS price, l_quantity * (100 + l_suppkey % 900) AS total, l_linenumber, l_partkey,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos FROM lineitem) ORDER BY doc_id, code, designation, quantity, price, pos)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS line_no, code, designation, quantity, unit, CAST(tax_rate AS DOUBLE) AS tax_rate, CAST(price AS DOUBLE) AS price, CAST(total AS DOUBLE) AS total FROM r"""

def invoice_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.invoice_header(table(spark, sf_dir, "header_text"))


_ISO = "regexp_replace({0}, '(..)/(..)/(....)', '\\3-\\2-\\1')"
_HEADER = f"""
    SELECT doc_id, 'Maison ' || number AS supplier, '1' || number || CASE WHEN kind = 5 THEN '/A/M/000' ELSE 'A/M/000' END AS supplier_tax_id, 'Customer ' || cust AS customer, '7' || number || 'C' AS customer_tax_id, 'INV-' || number AS invoice_number, {_ISO.format("day")} AS invoice_date,
           CASE WHEN kind <> 4 THEN {_ISO.format("due")} END AS due_date, CASE WHEN kind NOT IN (3, 4) THEN {_ISO.format("begin")} END AS period_start, CASE WHEN kind NOT IN (3, 4) THEN {_ISO.format("finish")} END AS period_end,
           CASE WHEN kind = 5 THEN 'EUR' ELSE 'TND' END AS currency, CAST(net AS DOUBLE) + 0.5 AS total_ht, CAST(tax AS DOUBLE) AS vat, CAST(net AS DOUBLE) + CAST(tax AS DOUBLE) + 0.5 AS total_ttc, true AS consistent FROM header_text"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "job_event").select(F.col("job_id").alias("key"), "ts", (F.col("state") != "failed").alias("ok"), "event_id")


def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.breaker_table(_outcomes(spark, sf_dir), threshold=3, wait=7200.0, span="6 hours")


def breaker_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a success also forgets the failures before it."""
    return states.breaker_table(_outcomes(spark, sf_dir), threshold=2, wait=7200.0, span="6 hours", resets=True)


def _breaker(threshold: int, resets: bool) -> str:
    """Each key's events one after the other."""
    return f"""
    WITH RECURSIVE e AS (SELECT CAST(job_id AS VARCHAR) AS key, ts, state <> 'failed' AS ok, epoch_ms(ts) / 1000 AS tm, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM (SELECT event_id, user_id AS job_id, ts, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS state FROM events)),
    s AS (SELECT DISTINCT key, CAST(NULL AS TIMESTAMP) AS ts, CAST(0 AS BIGINT) AS n, 'closed' AS state, CAST(0 AS BIGINT) AS failures, CAST(0 AS DOUBLE) AS changed FROM e
          UNION ALL SELECT e.key, e.ts, e.n, CASE WHEN ok THEN CASE WHEN s.state = 'open' AND tm - changed >= 7200 THEN 'closed' ELSE s.state END WHEN s.state = 'open' OR failures + 1 >= {threshold} THEN 'open' ELSE s.state END,
                 CASE WHEN NOT ok THEN failures + 1 WHEN s.state = 'open' AND tm - changed >= 7200 THEN 0 WHEN {str(resets).lower()} AND s.state = 'closed' THEN 0 ELSE failures END,
                 CASE WHEN ok AND NOT (s.state = 'open' AND tm - changed >= 7200) THEN changed WHEN NOT ok AND s.state = 'closed' AND failures + 1 < {threshold} THEN changed ELSE tm END
          FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
    SELECT key, ts, state, failures FROM s WHERE n > 0"""


#: Name: query, working tables of its SQL, SQL.
QUERIES = {
    "near_labels": (near_labels, ["form_box"], _NEAR),
    "fused_fields": (fused_fields, ["reading"], _FUSED),
    "breaker_states": (breaker_states, [], _breaker(3, False)),
    "breaker_resets": (breaker_resets, [], _breaker(2, True)),
    "invoice_header": (invoice_header, ["header_text"], _HEADER),
    "table_items": (table_items, [], "WITH " + _ITEMS.lstrip()),
    "place_lookup": (place_lookup, ["place", "place_text"], _PLACES),
    "union_places": (union_places, ["place", "place_text"], r"SELECT min(place) AS place FROM (SELECT place FROM place UNION ALL SELECT regexp_extract(raw_text, 'Lieu: (.*) le 3', 1) FROM place_text) WHERE place <> '' GROUP BY lower(place)"),
    "spatial_fields": (spatial_fields, ["card_box"], f"SELECT * FROM ({_CARD}) WHERE value IS NOT NULL"),
}
