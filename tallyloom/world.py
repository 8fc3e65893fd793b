"""Inputs for the reconciliation operators, made of the star tables.

Customers stand for students and their contacts, suppliers for second contact records
of some, orders for deals and enrollments, line items for payments. Every row of those
tables is used. The definitions are SQL that Spark and DuckDB both run, so that a twin
in SQL starts from the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.resolve import Staged, resolve, with_apart
from .operators.rules import Context
from .storage import stored

_HOME = "'home' || CAST(floor(c_custkey / 3) AS BIGINT) || '@x.example'"
_DOB = "make_date(2008 + c_nationkey % 5, 1 + c_nationkey % 12, 1 + c_nationkey % 27)"
_FIRST = "CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'AUTOMOBILE') THEN lower(c_name) ELSE 'f' || CAST(floor(abs(c_acctbal) / 10) AS BIGINT) END"

SELECTS = {
    "students": f"""
SELECT 'appdb:student:S' || c_custkey AS source_ref, 'S' || c_custkey AS student_id,
  {_FIRST} AS first_name, {_FIRST} AS first_norm, lower(c_mktsegment) AS last_name, lower(c_mktsegment) AS last_norm,
  CASE WHEN c_acctbal < -800 THEN 'bad' WHEN c_acctbal < -700 THEN NULL ELSE CAST({_DOB} AS STRING) END AS dob, CASE WHEN c_acctbal >= -700 THEN {_DOB} END AS dob_norm,
  CASE WHEN c_nationkey = 24 THEN 'Yr 4' WHEN c_nationkey = 23 THEN 'PK' WHEN c_nationkey = 22 THEN 'K' ELSE CAST(1 + c_nationkey % 12 AS STRING) END AS grade,
  CASE WHEN c_nationkey = 24 THEN NULL WHEN c_nationkey = 23 THEN 'PK' WHEN c_nationkey = 22 THEN 'K' ELSE CAST(1 + c_nationkey % 12 AS STRING) END AS grade_norm,
  CASE WHEN c_nationkey = 24 THEN NULL WHEN c_nationkey = 23 THEN -1 WHEN c_nationkey = 22 THEN 0 ELSE 1 + c_nationkey % 12 END AS grade_ord,
  CASE WHEN c_acctbal <= 9900 THEN {_HOME} END AS email_norm,
  CASE WHEN c_acctbal > 5000 THEN 'home' || (CAST(floor(c_custkey / 3) AS BIGINT) + 1) || '@x.example' END AS guardian2_email_norm, 'HH-' || c_nationkey AS household_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'enrolled' WHEN 'AUTOMOBILE' THEN 'active' WHEN 'MACHINERY' THEN 'applied' WHEN 'FURNITURE' THEN 'enrolled' ELSE 'withdrawn' END AS status,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'enrolled' WHEN 'AUTOMOBILE' THEN 'active' WHEN 'MACHINERY' THEN 'applied' WHEN 'FURNITURE' THEN 'enrolled' ELSE 'withdrawn' END AS status_norm,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'applied' WHEN 'HOUSEHOLD' THEN 'withdrawn' ELSE 'enrolled' END AS status_funnel
FROM {{customer}}""",
    "contacts": f"""
SELECT 'crm:contact:' || crm_id AS source_ref, crm_id, external_id, email_norm, email_norm AS email, first_norm AS first_name, first_norm, last_norm AS last_name, last_norm,
  dob, CASE WHEN dob <> 'bad' THEN dob_norm END AS dob_norm, grade, grade AS grade_norm, lifecycle AS lifecycle_stage, lifecycle AS lifecycle_norm,
  CASE lifecycle WHEN 'customer' THEN 'enrolled' WHEN 'opportunity' THEN 'applied' END AS lifecycle_funnel
FROM (
  SELECT 'C' || c_custkey AS crm_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'S' || c_custkey WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 8000 THEN 'S' || (c_custkey + 1) WHEN c_mktsegment = 'MACHINERY' THEN 'S' || c_custkey END AS external_id,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'own' || c_custkey || '@x.example' WHEN c_mktsegment = 'FURNITURE' THEN 'lead' || c_custkey || '@x.example' ELSE {_HOME} END AS email_norm,
    CASE WHEN c_acctbal BETWEEN 6000 AND 7000 AND c_mktsegment = 'BUILDING' THEN 'x' ELSE {_FIRST} END AS first_norm, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'other' ELSE lower(c_mktsegment) END AS last_norm,
    CASE WHEN c_acctbal BETWEEN 1000 AND 1200 THEN 'bad' WHEN c_acctbal BETWEEN 1200 AND 1400 THEN NULL ELSE CAST({_DOB} AS STRING) END AS dob, {_DOB} AS dob_norm,
    CASE WHEN c_acctbal BETWEEN 3000 AND 5000 THEN 'PK' ELSE CAST(1 + c_nationkey % 12 AS STRING) END AS grade, CASE WHEN c_nationkey < 12 THEN 'customer' WHEN c_nationkey < 18 THEN 'opportunity' ELSE 'subscriber' END AS lifecycle
  FROM {{customer}}
  UNION ALL
  SELECT 'D' || s_suppkey, NULL, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'own' || c_custkey || '@x.example' ELSE {_HOME} END, {_FIRST}, lower(c_mktsegment),
    CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST({_DOB} AS STRING) END, CASE WHEN s_acctbal >= 9000 THEN make_date(2001, 1, 1) WHEN s_acctbal >= 0 THEN {_DOB} END, CAST(NULL AS STRING), 'customer'
  FROM {{supplier}} JOIN {{customer}} ON c_custkey = s_suppkey) AS x""",
    "deals": """
SELECT 'crm:deal:DL' || o_orderkey AS source_ref, 'DL' || o_orderkey AS deal_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' THEN 'C' || o_custkey ELSE 'CX' || o_orderkey END AS contact_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Closed Won' WHEN '2-HIGH' THEN 'Deposit Received' WHEN '3-MEDIUM' THEN 'Odd' WHEN '4-NOT SPECIFIED' THEN 'New Lead' END AS stage,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Closed Won' WHEN '2-HIGH' THEN 'Deposit Received' WHEN '4-NOT SPECIFIED' THEN 'New Lead' END AS stage_norm,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'enrolled' WHEN '2-HIGH' THEN 'deposit_paid' WHEN '4-NOT SPECIFIED' THEN 'prospect' END AS stage_funnel
FROM {orders}""",
    "enrollments": """
SELECT 'appdb:enrollment:E' || o_orderkey AS source_ref, CASE WHEN o_orderpriority = '1-URGENT' THEN 'S' || o_custkey ELSE 'Z' || o_orderkey END AS student_id,
  CASE WHEN o_orderstatus = 'O' THEN 'DL' || o_orderkey WHEN o_orderstatus = 'F' THEN 'DL' || (o_orderkey + 1) WHEN o_totalprice > 250000 THEN 'gone' END AS crm_deal_id,
  CASE o_orderstatus WHEN 'F' THEN 'enrolled' WHEN 'O' THEN 'deposit_paid' ELSE 'applied' END AS stage, CASE o_orderstatus WHEN 'F' THEN 'enrolled' WHEN 'O' THEN 'deposit_paid' ELSE 'applied' END AS stage_funnel,
  CASE WHEN o_totalprice < 150000 THEN 'Lower School' WHEN o_totalprice < 300000 THEN 'Upper School' END AS program_norm,
  CAST(o_orderdate AS TIMESTAMP) AS updated_at, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) END AS deposit_paid_at
FROM {orders}""",
    "payments": f"""
SELECT 'payments:payment:P' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS source_ref,
  CASE WHEN l_quantity BETWEEN 46 AND 47 THEN 'S' || o_custkey WHEN l_quantity < 5 THEN 'unknown' END AS external_ref,
  CASE WHEN l_quantity BETWEEN 48 AND 50 THEN {_HOME} WHEN l_quantity = 45 THEN 'home' || (CAST(floor(c_custkey / 3) AS BIGINT) + 1) || '@x.example' WHEN l_quantity > 10 THEN 'payer' || o_custkey || '@y.example' END AS email_norm,
  CASE WHEN l_quantity IN (45, 48) THEN {_FIRST} END AS first_norm, CASE WHEN l_quantity IN (45, 48) THEN lower(c_mktsegment) END AS last_norm, l_quantity IN (45, 48) AS name_pair,
  CASE WHEN l_discount < 0.04 THEN 'Lower School' WHEN l_discount < 0.07 THEN 'Upper School' END AS program_norm,
  CASE WHEN l_linenumber <= 4 THEN 'tuition' WHEN l_linenumber = 5 THEN 'deposit' WHEN l_linenumber = 6 THEN 'Odd' END AS payment_type, CASE WHEN l_linenumber <= 4 THEN 'tuition' WHEN l_linenumber = 5 THEN 'deposit' END AS type_norm,
  CASE WHEN l_returnflag = 'R' THEN 'refunded' ELSE 'paid' END AS payment_status, CASE WHEN l_returnflag = 'R' THEN 'refunded' ELSE 'paid' END AS status_norm,
  CAST(CASE WHEN l_tax < 0.05 THEN 1200000 WHEN l_tax < 0.06 THEN 1600000 ELSE floor(l_extendedprice * 100 + 0.5) END AS BIGINT) AS amount_cents,
  CAST(date_trunc('year', l_shipdate) AS TIMESTAMP) AS occurred_at, CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS TIMESTAMP) END AS refunded_at
FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{customer}} ON c_custkey = o_custkey""",
}

TABLES = ("customer", "supplier", "orders", "lineitem")

#: The records as common table expressions for a SQL twin.
RECORDS_SQL = "WITH RECURSIVE " + ", ".join(f"w_{k} AS ({v.format(**{t: t for t in TABLES})})" for k, v in SELECTS.items())

#: Links and persons as the survey's rules state them, as further expressions. A person is known by its anchor.
LINKS_SQL = """
, l1 AS (SELECT c.source_ref AS contact_ref, s.source_ref AS student_ref, 'L1' AS method FROM w_contacts c JOIN w_students s ON s.student_id = c.external_id)
, free AS (SELECT * FROM w_students WHERE source_ref NOT IN (SELECT student_ref FROM l1))
, mails AS (SELECT source_ref, first_norm, last_norm, email_norm AS mail FROM free WHERE email_norm IS NOT NULL UNION SELECT source_ref, first_norm, last_norm, guardian2_email_norm FROM free WHERE guardian2_email_norm IS NOT NULL)
, l2 AS (SELECT c.source_ref AS contact_ref, min(m.source_ref) AS student_ref, 'L2' AS method FROM w_contacts c JOIN mails m ON m.mail = c.email_norm AND m.first_norm = c.first_norm AND m.last_norm = c.last_norm
    WHERE c.source_ref NOT IN (SELECT contact_ref FROM l1) GROUP BY 1)
, l3 AS (SELECT c.source_ref AS contact_ref, min(f.source_ref) AS student_ref, 'L3' AS method FROM w_contacts c JOIN free f ON f.first_norm = c.first_norm AND f.last_norm = c.last_norm AND f.dob_norm = c.dob_norm
    WHERE c.source_ref NOT IN (SELECT contact_ref FROM l1 UNION ALL SELECT contact_ref FROM l2) GROUP BY 1)
, contact_links AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
, p1 AS (SELECT p.source_ref AS payment_ref, s.source_ref AS student_ref, 'P1' AS method FROM w_payments p JOIN w_students s ON s.student_id = p.external_ref)
, p2 AS (SELECT p.source_ref AS payment_ref, min(s.source_ref) AS student_ref, 'P2' AS method FROM w_payments p JOIN w_students s ON s.email_norm = p.email_norm AND s.first_norm = p.first_norm AND s.last_norm = p.last_norm
    WHERE p.source_ref NOT IN (SELECT payment_ref FROM p1) GROUP BY 1 HAVING count(*) = 1)
, one_child AS (SELECT email_norm, min(source_ref) AS student_ref FROM w_students WHERE email_norm IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
, p3 AS (SELECT p.source_ref AS payment_ref, o.student_ref, 'P3' AS method FROM w_payments p JOIN one_child o USING (email_norm) WHERE p.source_ref NOT IN (SELECT payment_ref FROM p1 UNION ALL SELECT payment_ref FROM p2))
, payment_links AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)
, own_enrollments AS (SELECT s.source_ref AS student_ref, e.source_ref AS enrollment_ref, e.program_norm FROM w_enrollments e JOIN w_students s USING (student_id))
, e1 AS (SELECT l.payment_ref, min(o.enrollment_ref) AS enrollment_ref, 'E1' AS method FROM payment_links l JOIN w_payments p ON p.source_ref = l.payment_ref JOIN own_enrollments o ON o.student_ref = l.student_ref AND o.program_norm = p.program_norm GROUP BY 1 HAVING count(*) = 1)
, e2 AS (SELECT l.payment_ref, min(o.enrollment_ref) AS enrollment_ref, 'E2' AS method FROM payment_links l JOIN own_enrollments o USING (student_ref) WHERE l.payment_ref NOT IN (SELECT payment_ref FROM e1) GROUP BY 1 HAVING count(*) = 1)
, payment_enrollments AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2)
, owner AS (SELECT c.source_ref AS contact_ref, coalesce(l.student_ref, c.source_ref) AS anchor FROM w_contacts c LEFT JOIN contact_links l ON l.contact_ref = c.source_ref)
, deal_persons AS (SELECT DISTINCT d.source_ref AS deal_ref, d.deal_id, o.anchor FROM w_deals d JOIN w_contacts c ON c.crm_id = d.contact_id JOIN owner o ON o.contact_ref = c.source_ref)
, person_refs AS (SELECT source_ref AS anchor, source_ref AS ref FROM w_students UNION SELECT anchor, contact_ref FROM owner UNION SELECT student_ref, payment_ref FROM payment_links UNION SELECT student_ref, enrollment_ref FROM own_enrollments UNION SELECT anchor, deal_ref FROM deal_persons)
, persons AS (SELECT anchor, list(ref ORDER BY ref) FILTER (WHERE ref LIKE 'crm:contact:%' OR ref LIKE 'appdb:student:%') AS identity_refs, list(ref ORDER BY ref) AS entity_refs, min(ref) FILTER (WHERE ref LIKE 'appdb:student:%') AS student_ref,
    count(*) FILTER (WHERE ref LIKE 'crm:contact:%') AS contact_count, count(*) FILTER (WHERE ref LIKE 'payments:payment:%') AS payment_count, count(*) FILTER (WHERE ref LIKE 'appdb:enrollment:%') AS enrollment_count, count(*) FILTER (WHERE ref LIKE 'crm:deal:%') AS deal_count,
    min(ref) FILTER (WHERE ref LIKE 'crm:contact:%') AS contact_ref, min(ref) FILTER (WHERE ref LIKE 'appdb:enrollment:%') AS enrollment_ref, min(ref) FILTER (WHERE ref LIKE 'crm:deal:%') AS deal_ref FROM person_refs GROUP BY 1)
, candidates AS (SELECT DISTINCT c.source_ref, 'ext' AS key_class, s.source_ref AS resolved_ref FROM w_contacts c JOIN w_students s ON s.student_id = c.external_id
    UNION SELECT c.source_ref, 'email', s.source_ref FROM w_contacts c JOIN w_students s ON c.email_norm = s.email_norm OR c.email_norm = s.guardian2_email_norm
    UNION SELECT c.source_ref, 'namedob', s.source_ref FROM w_contacts c JOIN w_students s ON s.first_norm = c.first_norm AND s.last_norm = c.last_norm AND s.dob_norm = c.dob_norm)
"""

_CONTEXTS: dict[tuple, Context] = {}


_BOUGHT = "\nFROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey"
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")


def records(spark: SparkSession, sf_dir: str) -> Staged:
    """The staged frames over the tables of one folder.

    Spark joins in the order written, so the tables behind payments are joined here: orders meet their customers
    first, and line items are dealt out once. repeated: whether a payment's ref may occur again.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    texts = SELECTS | {"payments": SELECTS["payments"].replace(_BOUGHT, ", repeated\nFROM {bought}")}
    orders = tables["orders"].select("o_orderkey", "o_custkey").join(tables["customer"].select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    several = lambda *key: F.count("*").over(W.partitionBy(*key)) > 1
    lines = tables["lineitem"].select(*_LINE).repartition("l_orderkey").withColumn("again", several("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    tables["bought"] = lines.join(orders.repartition("o_orderkey").withColumn("twice", several("o_orderkey")), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("repeated", F.col("again") | F.col("twice"))
    made: dict[str, DataFrame] = {k: spark.sql(v, **{t: x for t, x in tables.items() if f"{{{t}}}" in v}).withColumn("generation", F.lit(1)) for k, v in texts.items()}
    made["deals"] = made["deals"].withColumn("contact_ids", F.array("contact_id"))
    return Staged(**made)


def context(spark: SparkSession, sf_dir: str) -> Context:
    """Records and their resolution, written once a session and folder, as a run of the engine does."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CONTEXTS:
        made = records(spark, sf_dir)
        done = {n: stored(getattr(made, n), n) for n in SELECTS if n != "payments"}
        st = Staged(**done, payments=stored(with_apart(made.payments, done["students"]), "payments", "apart"))
        _CONTEXTS[key] = Context(st, resolve(st, stored))
    return _CONTEXTS[key]
