"""Working tables, derived from the given ones. One SQL text serves Spark (tables as ``{name}``) and other engines (plain names)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession



def _weighed(expr: str, length: int, place: int = 0) -> str:
    """The sum of values of the characters of ``expr`` by weights 7, 3, 1, of which the first is at ``place``; 32 is the value of W."""
    return " + ".join(f"{(7, 3, 1)[(place + i) % 3]} * coalesce(TRY_CAST(substr({expr}, {i + 1}, 1) AS INT), 32)" for i in range(length))


def _checked(expr: str, length: int) -> str:
    return f"CAST(({_weighed(expr, length)}) % 10 AS STRING)"


def _lettered(expr: str) -> str:
    """A number with each digit as a letter twice."""
    out = f"CAST({expr} AS STRING)"
    for digit, letter in enumerate("bcdfghjkmn"):
        out = f"replace({out}, '{digit}', '{letter * 2}')"
    return out


_COMPOSITE = " + ".join(f"{_weighed(e, n, p)}" for e, n, p in (("number", 9, 0), ("number_check", 1, 9), ("birth", 6, 10), ("birth_check", 1, 16), ("expiry", 6, 17), ("expiry_check", 1, 23), ("personal", 14, 24), ("personal_check", 1, 38)))
_WRONG = "CAST((CAST(birth_check AS INT) + 1) % 10 AS STRING)"
_SECOND = "number, number_check, country, {birth}, {check}, sex, expiry, expiry_check, personal, personal_check, composite"


def _day(expr: str) -> str:
    """A date as day/month/year."""
    return f"concat(lpad(CAST(EXTRACT(DAY FROM {expr}) AS STRING), 2, '0'), '/', lpad(CAST(EXTRACT(MONTH FROM {expr}) AS STRING), 2, '0'), '/', CAST(EXTRACT(YEAR FROM {expr}) AS STRING))"


TABLES = {
    "history": """
        SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey % 40 AS STRING) AS user_id,
               concat('u', CAST(o_custkey % 40 AS STRING), '@mail.test') AS user_email,
               CASE o_custkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'operator' WHEN 2 THEN 'simple_user' ELSE 'viewer' END AS user_role,
               concat('job-', CAST(o_orderkey AS STRING)) AS job_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'invoice' WHEN '2-HIGH' THEN 'identity' WHEN '3-MEDIUM' THEN 'passport' WHEN '5-LOW' THEN 'registry' END AS document_type,
               concat('tpl-', CAST(o_custkey % 5 AS STRING)) AS template_id,
               concat('engine-', CAST(o_custkey % 3 AS STRING)) AS engine_used,
               CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'review_required' ELSE 'failed' END AS status,
               CAST(o_orderkey % 101 AS DOUBLE) / 100 AS global_confidence,
               CAST(100 + o_orderkey % 60000 AS INT) AS processing_time_ms, o_orderdate AS created_at
        FROM {orders}""",
    "job": """
        SELECT concat('job-', CAST(o_orderkey AS STRING)) AS id, CAST(o_custkey AS STRING) AS organization_id,
               CASE o_orderstatus WHEN 'O' THEN 'done' WHEN 'F' THEN 'failed' ELSE 'queued' END AS status,
               CAST(1 + o_orderkey % 7 AS INT) AS page_count, concat('/out/', CAST(o_orderkey AS STRING)) AS result_path,
               CAST(o_orderkey % 4 AS INT) AS retry_count, o_orderkey % 11 = 0 AS is_purged, o_orderdate AS created_at
        FROM {orders}""",
    "org": """
        SELECT CAST(c_custkey AS STRING) AS id, c_name AS slug, CAST(1000 AS INT) AS quota_pages_per_month, CAST(100 AS INT) AS quota_jobs_per_month,
               CAST(c_custkey * 7 % 1300 AS INT) AS usage_pages_this_month, CAST(c_custkey * 3 % 130 AS INT) AS usage_jobs_this_month,
               CAST(30 + c_custkey % 300 AS INT) AS data_retention_days
        FROM {customer}""",
    "api_key": """
        SELECT CAST(s_suppkey AS STRING) AS key_prefix, CAST(s_nationkey AS STRING) AS organization_id,
               CASE s_suppkey % 3 WHEN 0 THEN 'extract,read' WHEN 1 THEN 'read' ELSE 'admin, extract' END AS scopes,
               s_suppkey % 5 <> 0 AS is_active,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN TIMESTAMP '1996-01-01 00:00:00' ELSE TIMESTAMP '2000-01-01 00:00:00' END AS expires_at
        FROM {supplier}""",
    "field": """
        SELECT l_orderkey AS doc_id,
               CASE l_linenumber % 7 WHEN 1 THEN 'invoice_number' WHEN 2 THEN 'invoice_date' WHEN 3 THEN 'total_amount' WHEN 4 THEN 'supplier' WHEN 5 THEN 'customer' WHEN 6 THEN 'currency' ELSE 'tax_id' END AS name,
               CASE WHEN l_partkey % 9 = 0 THEN '' WHEN l_partkey % 13 = 0 THEN NULL ELSE concat(l_returnflag, CAST(l_partkey % 50 AS STRING)) END AS value,
               CAST(l_partkey % 101 AS DOUBLE) / 100 AS confidence, l_suppkey % 3 <> 0 AS validated,
               CASE WHEN l_suppkey % 3 = 0 THEN 'invalid' END AS error, l_partkey % 17 = 0 AS review_required,
               l_linenumber <= 3 AS critical, l_linenumber <= 4 AS required, CAST(1 + l_linenumber % 3 AS DOUBLE) AS weight
        FROM {lineitem}""",
    "candidate": """
        SELECT l_orderkey AS doc_id, CASE l_linenumber % 2 WHEN 0 THEN 'last_name' ELSE 'first_name' END AS field,
               concat(l_returnflag, l_linestatus) AS value, CASE l_suppkey % 3 WHEN 0 THEN 'spatial' WHEN 1 THEN 'zone' ELSE 'full' END AS source,
               CASE l_partkey % 2 WHEN 0 THEN 'first' ELSE 'second' END AS engine, CAST(l_partkey % 101 AS DOUBLE) / 100 AS avg_conf
        FROM {lineitem}""",
    "prediction": """
        SELECT l_orderkey * 8 + l_linenumber AS item_id, l_returnflag AS actual,
               CASE WHEN l_partkey % 4 = 0 THEN 'N' WHEN l_partkey % 7 = 0 THEN 'R' ELSE l_returnflag END AS predicted,
               CAST(l_partkey % 101 AS DOUBLE) / 100 AS confidence
        FROM {lineitem}""",
    "case_result": """
        SELECT CAST(o_orderkey AS STRING) AS case_id, CASE o_custkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'identity' ELSE 'passport' END AS family,
               o_custkey % 19 <> 0 AS http_ok, CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'review_required' ELSE 'failed' END AS api_status,
               o_orderkey % 5 <> 0 AS template_ok, 3 AS critical_total, CAST(o_orderkey % 4 AS INT) AS critical_valid_count, o_custkey % 10 <> 0 AS in_scope,
               CAST(1000 + o_orderkey % 9000 AS INT) AS processing_time_ms
        FROM {orders}""",
    "audit": """
        SELECT event_id AS id, concat('10.0.0.', CAST(user_id % 250 AS STRING)) AS ip_address, concat('key_', CAST(user_id AS STRING)) AS api_key_prefix,
               event_type, CAST(user_id % 20 AS STRING) AS organization_id, props AS details, event_id % 23 = 0 AS is_anonymized, ts AS created_at
        FROM {events}""",
    "mrz_text": """
        SELECT c_custkey AS doc_id, rpad(concat('P<UTO', upper(split_part(c_name, '#', 1)), '<<GIVEN<', CASE WHEN c_custkey % 2 = 0 THEN 'ANNA' ELSE 'LEE' END), 44, '<') AS line1,
               concat(lpad(CAST(c_custkey AS STRING), 8, '0'), 'A', CAST(c_custkey % 10 AS STRING), 'UTO', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '0715', CAST(c_custkey % 7 AS STRING),
                      CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '<' END, lpad(CAST(26 + c_custkey % 50 AS STRING), 2, '0'), '1231', CAST(c_custkey % 9 AS STRING), 'ZE184226B<<<<<', '1', CAST(c_custkey % 10 AS STRING)) AS line2
        FROM {customer}""",
    # By the key modulo 8: as it should be; letters for digits; no sex; both lines in one; a wrong digit; no zone; other fillers; a misread letter.
    "passport_text": f"""
        SELECT doc_id, kind, number, country, birth, expiry, personal, sex, 'CUSTOMER' AS surname, given, label_number, line1, line2, bad_line2,
               CASE kind WHEN 1 THEN concat(head, line1, chr(10), substr(line2, 1, 13), replace(birth, '0', 'O'), substr(line2, 20), chr(10), 'end')
                         WHEN 2 THEN concat(head, line1, chr(10), substr(line2, 1, 20), '0', substr(line2, 22))
                         WHEN 3 THEN concat(head, line1, line2, chr(10), 'end')
                         WHEN 4 THEN concat(head, line1, chr(10), bad_line2, chr(10), 'end')
                         WHEN 5 THEN concat('Republic', chr(10), 'Passport No: ', label_number, chr(10), 'end')
                         WHEN 6 THEN concat(head, replace(line1, '<', '«'), chr(10), line2)
                         WHEN 7 THEN concat(head, line1, chr(10), '4', substr(line2, 2))
                         ELSE concat(head, line1, chr(10), line2, chr(10), 'end') END AS raw_text
        FROM (SELECT *, concat('REPUBLIC ', country, chr(10), 'travel paper', chr(10)) AS head, rpad(concat('P<', country, 'CUSTOMER<<', replace(given, ' ', '<')), 44, '<') AS line1,
                     concat({_SECOND.format(birth="birth", check="birth_check")}) AS line2, concat({_SECOND.format(birth="birth", check=_WRONG)}) AS bad_line2
              FROM (SELECT *, CAST(({_COMPOSITE}) % 10 AS STRING) AS composite
                    FROM (SELECT *, {_checked("number", 9)} AS number_check, {_checked("birth", 6)} AS birth_check, {_checked("expiry", 6)} AS expiry_check, {_checked("personal", 14)} AS personal_check
                          FROM (SELECT c_custkey AS doc_id, CAST(c_custkey % 8 AS INT) AS kind, CASE c_custkey % 8 WHEN 7 THEN concat('W', lpad(CAST(c_custkey AS STRING), 8, '0')) ELSE lpad(CAST(c_custkey AS STRING), 9, '0') END AS number,
                                       CASE c_custkey % 8 WHEN 7 THEN 'TUN' ELSE 'UTO' END AS country, concat(CAST(50 + c_custkey % 50 AS STRING), '0715') AS birth, concat(CAST(26 + c_custkey % 50 AS STRING), '1231') AS expiry,
                                       lpad(CAST(c_custkey * 7 AS STRING), 14, '0') AS personal, CASE WHEN c_custkey % 3 = 0 THEN 'F' ELSE 'M' END AS sex,
                                       CASE WHEN c_custkey % 2 = 0 THEN 'GIVEN ANNA' ELSE 'GIVEN LEE' END AS given, concat('AB', lpad(CAST(c_custkey AS STRING), 7, '0')) AS label_number
                                FROM {{customer}}))))""",
    # By the key modulo 3: values behind their labels, values before them, words with their letters turned round.
    "card_text": """
        SELECT doc_id, kind, number, family, first, place, day, month, year,
               CASE kind WHEN 0 THEN concat('الجمهورية التونسية', chr(10), 'بطاقة التعريف الوطنية', chr(10), number, chr(10), 'اللقب ', family, chr(10), 'الاسم ', first, chr(10), 'تاريخ الولادة ', day, ' ', month, ' ', year, chr(10), 'مكانها ', place)
                         WHEN 1 THEN concat(number, chr(10), family, ' اللقب', chr(10), first, ' الاسم', chr(10), 'بنت ', family, chr(10), day, '/03/', year, ' تاريخ الولادة', chr(10), '01/02/2011', chr(10), place, ' مكانها')
                         ELSE concat('رقم ', number, chr(10), 'اللقب ', reverse(family), chr(10), 'الاسم ', first, ' بن ', family, chr(10), 'مكانها ', replace(place, ' ', '')) END AS raw_text
        FROM (SELECT c_custkey AS doc_id, CAST(c_custkey % 3 AS INT) AS kind, lpad(CAST(c_custkey AS STRING), 8, '0') AS number,
                     CASE c_custkey % 5 WHEN 0 THEN 'الزبيدي' WHEN 1 THEN 'العربي' WHEN 2 THEN 'بوزيد' WHEN 3 THEN 'المنصوري' ELSE 'الطرابلسي' END AS family,
                     CASE c_custkey % 7 WHEN 0 THEN 'محمد' WHEN 1 THEN 'عزيز' WHEN 2 THEN 'زينب' WHEN 3 THEN 'رمضان' WHEN 4 THEN 'خالد' WHEN 5 THEN 'مريم' ELSE 'سعيد' END AS first,
                     CASE c_custkey % 4 WHEN 0 THEN 'صفاقس' WHEN 1 THEN 'القيروان' WHEN 2 THEN 'سيدي بوزيد' ELSE 'منزل تميم' END AS place,
                     CAST(10 + c_custkey % 18 AS STRING) AS day, CASE c_custkey % 2 WHEN 0 THEN 'مارس' ELSE 'أكتوبر' END AS month, CAST(1950 + c_custkey % 50 AS STRING) AS year FROM {customer})""",
    # By the key modulo 4: French labels, Arabic labels, an extract of before there were labels, the lines of a new one.
    "registry_text": """
        SELECT doc_id, kind, code, company, cap, day, k, seg,
               CASE kind WHEN 0 THEN concat('Date de l''extrait : 2020/03/', day, chr(10), 'Identifiant Unique : ', code, chr(10), 'Raison sociale : ', company, ' SUARL', chr(10), 'Nom Commercial : Boutique ', k, chr(10), 'Adresse Sociale : rue ', k, ' Tunis', chr(10),
                                'Capital : ', cap, ' 500,000', chr(10), 'Activité Principale : commerce ', seg, chr(10), 'Activité Secondaire : conseil', chr(10), 'Forme Juridique : SUARL', chr(10), 'Date de Publication : ', day, '/04/2020', chr(10),
                                'Date de début d''activité : 2020-05-', day, chr(10), 'Informations relatives à la Direction gérant Tunisien ', day, '/06/1970 Ali Ben ', seg, chr(10), 'https://page 1/2')
                         WHEN 1 THEN concat('تاريخ استخراج المضمون 2021-03-', day, chr(10), 'المعرف الوحيد : ', code, chr(10), 'الاسم الاجتماعي : ', company, chr(10), 'الاسم التجاري : دكان', chr(10), 'رأس المال : ', cap, chr(10), 'النشاط الأصلي : تجارة', chr(10), 'النظام القانوني : محدودة', chr(10), 'تاريخ النشر : 2021-04-', day, chr(10), 'معلومات تخص الإدارة وكيل تونسية')
                         WHEN 2 THEN concat('1999', chr(10), 'GULF ', seg, ' CAZCORPORATION', chr(10), 'B', code7, ' D', code7, ' g', code7, chr(10), 'le ', day, '/07/1999')
                         ELSE concat('B', code7, chr(10), 'Dénomination', chr(10), company, chr(10), CASE WHEN doc_id % 8 = 3 THEN 'et fils' ELSE 'Forme' END, chr(10), 'sarl', chr(10), CASE WHEN doc_id % 3 = 0 THEN 'au capital de dix mille dinars' ELSE concat('Capital social : ', cap, ' 500,750 DT') END) END AS raw_text
        FROM (SELECT c_custkey AS doc_id, CAST(c_custkey % 4 AS INT) AS kind, concat(lpad(CAST(c_custkey AS STRING), 7, '0'), 'B') AS code, lpad(CAST(c_custkey AS STRING), 7, '0') AS code7, concat('Maison ', CAST(c_custkey AS STRING)) AS company, CAST(10 + c_custkey % 80 AS STRING) AS cap,
                     CAST(10 + c_custkey % 18 AS STRING) AS day, CAST(c_custkey AS STRING) AS k, c_mktsegment AS seg FROM {customer})""",
    "invoice_text": """
        SELECT o_orderkey AS doc_id,
               concat('FACTURE N° INV-', CAST(o_orderkey AS STRING), chr(10), 'Date: ', CAST(EXTRACT(DAY FROM o_orderdate) AS STRING), '/', CAST(EXTRACT(MONTH FROM o_orderdate) AS STRING), '/', CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING),
                      chr(10), 'Client: Customer ', CAST(o_custkey AS STRING), chr(10), 'Total HT: ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ',500', chr(10), 'TVA 19%: ', CAST(CAST(floor(o_totalprice * 0.19) AS BIGINT) AS STRING), ',000',
                      chr(10), 'Total TTC: ', CAST(CAST(floor(o_totalprice) + floor(o_totalprice * 0.19) + o_orderkey % 3 AS BIGINT) AS STRING), ',500 DT') AS raw_text
        FROM {orders}""",
    "identity_text": """
        SELECT c_custkey AS doc_id,
               concat('REPUBLIQUE', chr(10), 'Nom: ', upper(split_part(c_name, '#', 1)), chr(10), 'Naissance', chr(10), chr(10), lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0'), '.', lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0'), '.', CAST(1950 + c_custkey % 50 AS STRING),
                      chr(10), lpad(CAST(c_custkey AS STRING), 8, '0'), ' : Numero', chr(10), 'CIN_PLACE: ', c_mktsegment, chr(10), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('Sexe = ', CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'X' END) END) AS raw_text
        FROM {customer}""",
    "box": """
        SELECT l_orderkey AS doc_id, l_linenumber AS idx, CASE WHEN l_linenumber = 1 THEN 'Nom' WHEN l_partkey % 4 = 0 THEN lpad(CAST(l_partkey AS STRING), 8, '0') ELSE concat('w', CAST(l_partkey AS STRING)) END AS text,
               CAST(l_linenumber % 3 * 100 + l_partkey % 40 AS DOUBLE) AS x1, CAST(floor(l_linenumber / 3) * 30 + l_suppkey % 7 AS DOUBLE) AS y1,
               CAST(l_linenumber % 3 * 100 + l_partkey % 40 + 20 + l_partkey % 30 AS DOUBLE) AS x2, CAST(floor(l_linenumber / 3) * 30 + l_suppkey % 7 + 12 + l_partkey % 5 AS DOUBLE) AS y2,
               CAST(l_partkey % 101 AS DOUBLE) / 100 AS confidence
        FROM {lineitem}""",
    # Labels, values, and labels with values, anywhere on a page.
    "form_box": """
        SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS idx,
               CASE l_linenumber
                    WHEN 1 THEN CASE l_partkey % 4 WHEN 0 THEN concat('Nom: ', word) WHEN 1 THEN 'Nom Ben' ELSE 'Nom' END
                    WHEN 2 THEN CASE l_partkey % 3 WHEN 0 THEN concat('Naissance ', day) ELSE 'Naissance' END
                    WHEN 3 THEN CASE l_partkey % 3 WHEN 0 THEN concat('Lieu - ', town) ELSE 'Lieu' END
                    WHEN 4 THEN CASE l_partkey % 4 WHEN 0 THEN concat('emis le ', day) ELSE day END
                    WHEN 5 THEN CASE l_partkey % 5 WHEN 0 THEN concat(word, ' 12') ELSE word END
                    WHEN 6 THEN CASE l_partkey % 4 WHEN 0 THEN 'Nom' WHEN 1 THEN word ELSE town END
                    ELSE CASE l_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN lpad(CAST(l_partkey AS STRING), 8, '0') ELSE concat('a ', town) END END AS text,
               CAST(l_partkey * 37 % 500 AS DOUBLE) AS x1, CAST(l_suppkey * 13 % 120 AS DOUBLE) AS y1,
               CAST(l_partkey * 37 % 500 + 20 + l_partkey % 60 AS DOUBLE) AS x2, CAST(l_suppkey * 13 % 120 + 8 + l_suppkey % 12 AS DOUBLE) AS y2,
               CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_partkey % 101 AS DOUBLE) / 100 END AS confidence
        FROM (SELECT *, CASE l_suppkey % 5 WHEN 0 THEN 'Amel' WHEN 1 THEN 'Karim' WHEN 2 THEN 'Leila Hedi' WHEN 3 THEN 'Salma' ELSE 'Tarek' END AS word,
                     CASE l_suppkey % 4 WHEN 0 THEN 'Tunis' WHEN 1 THEN 'Sfax' WHEN 2 THEN 'Gabes' ELSE 'Sousse' END AS town,
                     concat(CAST(10 + l_partkey % 18 AS STRING), '/0', CAST(1 + l_partkey % 9 AS STRING), '/', CAST(1950 + l_suppkey % 50 AS STRING)) AS day FROM {lineitem})""",
    # Cards as boxes, by the key modulo 4: values left of their labels, inside, below, above; what is no value stands around them.
    "card_box": """
        SELECT doc_id, CAST(i AS BIGINT) AS idx, text, 0.9 - i / 100.0 AS confidence, x AS x1, y AS y1, x + w AS x2, y + 20.0 AS y2
        FROM (SELECT doc_id, i, text, w,
                     CASE WHEN i < 3 THEN 100.0 WHEN i % 2 = 1 OR kind > 1 THEN 300.0 ELSE 150.0 END AS x,
                     CASE WHEN i < 3 THEN 10.0 + 40.0 * i ELSE 150.0 + 140.0 * floor((i - 3) / 2) + CASE WHEN i % 2 = 1 OR kind < 2 THEN 0.0 WHEN kind = 2 THEN 35.0 ELSE -35.0 END END AS y
              FROM (SELECT doc_id, kind, i, 100.0 AS w,
                           CASE i WHEN 0 THEN 'الجمهورية التونسية' WHEN 1 THEN 'بطاقة التعريف الوطنية' WHEN 2 THEN number
                                  WHEN 3 THEN CASE WHEN kind = 1 THEN concat('اللقب : ', family) ELSE 'اللقب' END WHEN 4 THEN CASE WHEN kind = 1 THEN '' ELSE family END
                                  WHEN 5 THEN CASE WHEN kind = 1 THEN concat('الاسم ', first) ELSE 'الاسم' END WHEN 6 THEN CASE WHEN kind = 1 THEN '-' ELSE first END
                                  WHEN 7 THEN CASE WHEN kind = 1 THEN concat('تاريخ الولادة ', day) ELSE 'تاريخ الولادة' END WHEN 8 THEN CASE WHEN kind = 1 THEN '' ELSE day END
                                  WHEN 9 THEN CASE WHEN kind = 1 THEN concat('مكانها ', place) ELSE 'مكانها' END ELSE CASE WHEN kind = 1 THEN NULL ELSE place END END AS text
                    FROM (SELECT c_custkey AS doc_id, CAST(c_custkey % 4 AS INT) AS kind, lpad(CAST(c_custkey AS STRING), 8, '0') AS number,
                                 CASE c_custkey % 5 WHEN 0 THEN 'الزبيدي' WHEN 1 THEN 'العربي' WHEN 2 THEN 'بوزيد' WHEN 3 THEN 'شريف' ELSE 'الطرابلسي' END AS family,
                                 CASE c_custkey % 7 WHEN 0 THEN 'محمد' WHEN 1 THEN 'عزيز' WHEN 2 THEN 'زينب' WHEN 3 THEN 'رمضان' WHEN 4 THEN 'خالد' WHEN 5 THEN 'شريف' ELSE 'سعيد' END AS first,
                                 CASE c_custkey % 3 WHEN 0 THEN 'صفاقس' WHEN 1 THEN 'القيروان' ELSE 'سيدي بوزيد' END AS place,
                                 concat(CAST(10 + c_custkey % 18 AS STRING), '/03/', CAST(1950 + c_custkey % 50 AS STRING)) AS day, c_mktsegment FROM {customer}) AS c
                    CROSS JOIN (SELECT CAST(n_nationkey AS INT) AS i FROM {nation} WHERE n_nationkey < 11) AS n) AS t) AS u""",
    # Readings of cards: some in lower case, with a vowel misread, with a letter lost, or with the two names swapped.
    "reading": """
        SELECT doc_id, field, CASE WHEN field IN ('family_name', 'first_name') THEN CASE err WHEN 1 THEN replace(name, 'A', 'E') WHEN 2 THEN concat(substr(name, 1, 1), substr(name, 3)) WHEN 3 THEN lower(name) WHEN 4 THEN concat(name, '7') ELSE name END
                                   WHEN field = 'date_of_birth' THEN concat(CAST(10 + (doc_id + err) % 18 AS STRING), '/03/', CAST(1950 + doc_id % 50 AS STRING))
                                   WHEN field = 'cin_number' THEN concat('no ', lpad(CAST(doc_id * 7 AS STRING), 8, '0'), CASE WHEN err = 1 THEN '5' ELSE '' END) ELSE concat(' ', CASE WHEN err = 1 THEN 'Sfax' ELSE 'Tunis' END) END AS value,
               source, engine, CASE WHEN err = 5 THEN NULL ELSE confidence END AS confidence
        FROM (SELECT *, CASE WHEN (field = 'family_name') <> (swap = 0) THEN family ELSE first END AS name
              FROM (SELECT CAST(floor(l_orderkey / 5) AS BIGINT) AS doc_id, CASE l_linenumber WHEN 4 THEN 'first_name' WHEN 5 THEN 'first_name' WHEN 6 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'date_of_birth' ELSE 'cin_number' END WHEN 7 THEN 'place_of_birth' ELSE 'family_name' END AS field,
                           CAST(l_partkey % 7 AS INT) AS err, CAST(l_suppkey % 4 AS INT) AS swap, CAST(l_partkey % 101 AS DOUBLE) / 100 AS confidence,
                           CASE l_suppkey % 5 WHEN 0 THEN 'spatial' WHEN 1 THEN 'zone' WHEN 2 THEN 'text_global' WHEN 3 THEN 'text_line' ELSE 'other' END AS source, CASE l_partkey % 2 WHEN 0 THEN 'first' ELSE 'second' END AS engine,
                           CASE floor(l_orderkey / 5) % 5 WHEN 0 THEN 'BENSALEM' WHEN 1 THEN 'TRABELSI' WHEN 2 THEN 'MANSOUR' WHEN 3 THEN 'GHARBI' ELSE 'AOUIA' END AS family,
                           CASE floor(l_orderkey / 5) % 7 WHEN 0 THEN 'MARIAM' WHEN 1 THEN 'TRABELSI' WHEN 2 THEN 'KARIM' WHEN 3 THEN 'SALMA' WHEN 4 THEN 'MANSOUR' WHEN 5 THEN 'LEILA' ELSE 'HEDI' END AS first FROM {lineitem}) AS t) AS u""",
    # A place for each customer, its number in doubled letters: any two differ in two letters at least. Some have two words, some repeat.
    "place": f"""
        SELECT concat(CASE WHEN c_custkey % 3 = 0 THEN 'Ain ' ELSE '' END, upper(substr(code, 1, 1)), substr(code, 2)) AS place
        FROM (SELECT c_custkey, {_lettered('c_custkey + 100')} AS code FROM {{customer}})""",
    # Orders that name a customer's place: as it is, with a letter lost, changed or added, with two changed; some name another one behind a label.
    "place_text": f"""
        SELECT o_orderkey AS doc_id, concat('livre a ', CASE o_orderkey % 6 WHEN 1 THEN concat(substr(name, 1, 4), substr(name, 6)) WHEN 2 THEN concat(substr(name, 1, 3), 'z', substr(name, 5)) WHEN 3 THEN concat(name, 'e') WHEN 4 THEN concat('zz', substr(name, 3)) ELSE name END,
                                            CASE WHEN o_orderkey % 7 = 0 THEN concat('. Lieu: ', upper(other), ' le 3') ELSE ' le 3 mars' END) AS raw_text
        FROM (SELECT o_orderkey, {_lettered('o_custkey + 100')} AS name, {_lettered('o_custkey + 1 + 100')} AS other FROM {{orders}})""",
    # Dates of birth beside, behind, before and far from their labels, on either side of line breaks, with rivals.
    "dated_text": """
        SELECT doc_id, kind, day, year,
               CASE kind WHEN 0 THEN concat('تاريخ الولادة', chr(10), day, ' مارس ', year, chr(10), 'تاريخ الاصدار 01/02/2011')
                         WHEN 1 THEN concat('صدر في 01/02/2011', chr(10), day, '/03/', year, ' تاريخ الولادة')
                         WHEN 2 THEN concat('مولود في ', year, '-03-', day, ' ', rpad('', 40, 'ب'), ' 05/06/2012')
                         WHEN 3 THEN concat('01/02/2011 ', rpad('', 160, 'ب '), 'تاريخ الولادة', chr(10), chr(10), day, '/03/', year, chr(10), '07/08/2013')
                         WHEN 4 THEN concat(day, '/03/', year, chr(10), rpad('', 200, 'ب '), 'الولادة ', rpad('', 200, 'ب '), '01/02/2011')
                         WHEN 5 THEN concat('Date de naissance ', day, chr(10), 'mars', chr(10), year, ' 01/02/2011')
                         ELSE concat('delivre 01/02/2011', chr(10), '31/02/1990 الولادة ', day, ' octobre ', year) END AS raw_text
        FROM (SELECT c_custkey AS doc_id, CAST(c_custkey % 7 AS INT) AS kind, CAST(10 + c_custkey % 18 AS STRING) AS day, CAST(1950 + c_custkey % 50 AS STRING) AS year FROM {customer}) AS t""",
    # Invoice headers by the key modulo 6: as they should be; a due date before the invoice first; a subtotal first; a tax number out of shape and a
    # period turned round; neither due date nor period; labels in English, the parties' order turned round.
    "header_text": f"""
        SELECT doc_id, kind, number, net, tax, day, due, begin, finish, cust,
               CASE kind WHEN 5 THEN concat('Customer: Customer ', cust, chr(10), 'Tax ID: 7', number, 'C', chr(10), 'Supplier: Maison ', number, chr(10), 'Tax ID 1', number, ' / A / M / 000', chr(10), 'Invoice No: INV-', number, chr(10), 'Invoice date: ', day, chr(10), 'Due date: ', due, chr(10), 'Period: ', begin, ' to ', finish, chr(10), 'Currency: EUR', chr(10), 'Total HT ', net, '.50', chr(10), 'Total TVA ', tax, '.00', chr(10), 'Total TTC ', gross, '.50')
                    ELSE concat('Fournisseur : Maison ', number, chr(10), CASE WHEN kind = 3 THEN concat('MF : 12', number, '345', chr(10)) ELSE '' END, 'Matricule fiscal : 1', number, 'A/M/000', chr(10), 'Client : Customer ', cust, chr(10), 'MF: 7', number, 'C', chr(10), 'Facture N° : INV-', number, chr(10), 'Date : ', day, chr(10),
                                CASE WHEN kind = 1 THEN concat('Echéance : 01/01/1980', chr(10)) ELSE '' END, CASE WHEN kind = 4 THEN '' ELSE concat('Date d''échéance : ', due, chr(10), 'Période : du ', CASE WHEN kind = 3 THEN concat(finish, ' au ', begin) ELSE concat(begin, ' au ', finish) END, chr(10)) END,
                                CASE WHEN kind = 2 THEN concat('Total HT : 12,000', chr(10)) ELSE '' END, 'Total HT : ', net, ',500', chr(10), 'TVA 19% : ', tax, ',000', chr(10), 'Total TTC : ', gross, ',500 DT') END AS raw_text
        FROM (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 6 AS INT) AS kind, lpad(CAST(o_orderkey AS STRING), 6, '0') AS number, CAST(o_custkey AS STRING) AS cust, {_day("o_orderdate")} AS day, {_day("(o_orderdate + INTERVAL 30 DAY)")} AS due, {_day("(o_orderdate - INTERVAL 40 DAY)")} AS begin, {_day("(o_orderdate - INTERVAL 10 DAY)")} AS finish,
                     CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS net, CAST(CAST(floor(o_totalprice * 0.19) AS BIGINT) AS STRING) AS tax, CAST(CAST(floor(o_totalprice) + floor(o_totalprice * 0.19) AS BIGINT) AS STRING) AS gross FROM {{orders}}) AS t""",
    "region": """
        SELECT concat('img-', CAST(l_orderkey AS STRING)) AS filename, concat('class-', CAST(l_orderkey % 6 AS STRING)) AS class_name, concat('group-', CAST(l_orderkey % 97 AS STRING)) AS group_id,
               CASE l_linenumber % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'birth_date' WHEN 2 THEN 'doc_number' WHEN 3 THEN 'gender' ELSE 'surname' END AS field_name,
               CAST(1000 AS INT) AS width, CAST(500 AS INT) AS height, CAST(l_partkey % 400 AS DOUBLE) AS x, CAST(l_suppkey % 200 AS DOUBLE) AS y,
               CAST(l_partkey % 90 AS DOUBLE) AS w, CAST(10 + l_suppkey % 30 AS DOUBLE) AS h
        FROM {lineitem}""",
    "detail": """
        SELECT l_orderkey * 8 + l_linenumber AS detail_id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_orderkey AS STRING) END AS history_id, CASE WHEN l_linenumber % 3 = 0 THEN concat('job-', CAST(l_orderkey AS STRING)) END AS job_id,
               l_shipdate AS detail_at, l_returnflag AS note
        FROM {lineitem}""",
    "template": """
        SELECT concat('tpl-', CAST(p_partkey AS STRING)) AS id, p_name AS name, p_brand AS document_type, p_partkey % 4 <> 0 AS is_active FROM {part}""",
    "account": """
        SELECT CAST(c_custkey AS STRING) AS id, CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'operator' ELSE 'simple_user' END AS role, c_custkey % 5 <> 0 AS is_active FROM {customer}""",
    "job_event": """
        SELECT event_id, user_id AS job_id, ts, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS state FROM {events}""",
    "listed_file": """
        SELECT concat('/in/', p_brand, '/', 'v', CAST(p_partkey % 3 AS STRING), '/', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.exe' ELSE '.jpg' END) AS path,
               CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey * 99991 % 30000000 END AS BIGINT) AS length
        FROM {part}""",
}


def plain(name: str) -> str:
    """The working table's SQL over plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", TABLES[name])


#: Rows of a source in one task. Documents made from a few bytes of a row cost thousands of times what it takes to read it, so files must not say
#: how many tasks there are.
TASK_ROWS = 16_384
#: Working tables of documents: their source and its key.
DOCUMENTS = {t: ("customer", "c_custkey") for t in ("mrz_text", "passport_text", "card_text", "registry_text", "identity_text", "card_box", "dated_text")}
DOCUMENTS |= {t: ("orders", "o_orderkey") for t in ("invoice_text", "place_text", "header_text")}


def dealt(rows: DataFrame, key: str, most: int = TASK_ROWS) -> DataFrame:
    """The rows dealt by their key over tasks of about ``most`` rows; as they are where one task has them all."""
    tasks = -(-rows.count() // most)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in set(re.findall(r"\{(\w+)\}", TABLES[name]))}
    if name in DOCUMENTS:
        source, key = DOCUMENTS[name]
        sources[source] = dealt(sources[source], key)
    return spark.sql(TABLES[name], **sources)
