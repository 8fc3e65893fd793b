"""The operators applied to the star-schema test tables, each with a DuckDB twin.

The tables stand in for records of several sources: customers for people, orders and
line items for what they did in two systems, events for a third. Each entry of
CATALOG is (query, SQL or None).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars as s
from .operators import documents, privacy
from .operators import relational as r
from .plans import dims
from .sources import snapshots

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """Lazy readers of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def entry(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        CATALOG[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
        return f

    return add


cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long")

# --- rules ------------------------------------------------------------------------


@entry("""
WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
  string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS keys FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN done >= 1 AND open = 0 THEN 'conflict' ELSE 'ok' END AS verdict, CASE WHEN done >= 1 AND open = 0 THEN keys END AS payment_refs
FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def paid_but_no_deal(t):
    """Someone who finished orders and has none open; every customer is stamped."""
    done = F.col("o_orderstatus") == "F"
    o = t.orders.groupBy("o_custkey").agg(F.count_if(done).alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), r.sorted_text(F.when(done, F.col("o_orderkey"))).alias("keys"))
    fires = F.coalesce((F.col("done") >= 1) & (F.col("open") == 0), F.lit(False))
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.when(fires, "conflict").otherwise("ok").alias("verdict"), F.when(fires, F.col("keys")).alias("payment_refs"))


@entry("SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'conflict' ELSE 'ok' END AS verdict FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey")
def unattributed(t):
    """Orders that no line item belongs to: a left join that flags instead of filtering."""
    lines = t.lineitem.select("l_orderkey").distinct()
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.when(F.col("l_orderkey").isNull(), "conflict").otherwise("ok").alias("verdict"))


@entry("SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM documents a JOIN documents b ON a.text = b.text AND a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id")
def duplicate_pairs(t):
    """Documents with equal text, language and source; texts are compared by a 128-bit digest."""
    d = t.documents.select("doc_id", "lang", "source", F.md5("text").alias("digest"))
    return r.unordered_pairs(d, ["digest", "lang", "source"], "doc_id").select("left_id", "right_id")


@entry("""
SELECT least(a.event_id, b.event_id) AS left_id, greatest(a.event_id, b.event_id) AS right_id, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap_micros
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 600000000
""")
def interval_pairs(t):
    """Events of one user and type strictly less than ten minutes apart."""
    return r.interval_pairs(t.events, ["user_id", "event_type"], "ts", "event_id", dims.DUPLICATE_SECONDS)


@entry("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) THEN 'conflict' ELSE 'ok' END AS verdict FROM customer")
def single_source(t):
    """Customers of one segment that the event source has never seen."""
    seen = t.events.select("user_id").distinct()
    fires = (F.col("c_mktsegment") == "BUILDING") & F.col("user_id").isNull()
    return t.customer.join(seen, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.when(fires, "conflict").otherwise("ok").alias("verdict"))


def _compared(t) -> DataFrame:
    """Order header against what its line items say: (o_orderkey, logical, left, right) for three fields."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    o = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("open") == F.col("lines"), "O").when(F.col("open") == 0, "F").when(F.col("open") > 0, "P")
    urgent = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").otherwise("low")
    band = F.when(F.col("quantity") > 100, "high").when(F.col("quantity").isNotNull(), "low")
    pair = lambda n, a, b: F.struct(F.lit(n).alias("logical"), a.alias("left"), b.alias("right"))
    each = F.array(pair("year", F.year("o_orderdate").cast("string"), F.year("shipped").cast("string")), pair("status", F.col("o_orderstatus"), status), pair("band", urgent, band))
    return o.select("o_orderkey", F.inline(each))


def _verdicts(t) -> DataFrame:
    differs = F.col("left").isNotNull() & F.col("right").isNotNull() & (F.col("left") != F.col("right"))
    return _compared(t).groupBy("o_orderkey").agg(
        F.count_if(F.col("left").isNotNull() & F.col("right").isNotNull()).alias("compared"),
        F.array_join(F.array_sort(F.collect_set(F.when(differs, F.col("logical")))), ",").alias("fields"),
        F.coalesce(F.bool_and(F.when(differs, F.col("logical").isin("status", "year"))), F.lit(False)).alias("wholly_sensitive"),
    )


_COMPARED_SQL = """
WITH l AS (SELECT l_orderkey, min(l_shipdate) AS shipped, count(*) FILTER (WHERE l_linestatus = 'O') AS open, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
o AS (SELECT * FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
p AS (
  SELECT o_orderkey, 'year' AS logical, CAST(year(o_orderdate) AS VARCHAR) AS a, CAST(year(shipped) AS VARCHAR) AS b FROM o
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus, CASE WHEN open = lines THEN 'O' WHEN open = 0 THEN 'F' WHEN open > 0 THEN 'P' END FROM o
  UNION ALL SELECT o_orderkey, 'band', CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'low' END, CASE WHEN quantity > 100 THEN 'high' WHEN quantity IS NOT NULL THEN 'low' END FROM o),
v AS (
  SELECT o_orderkey, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS compared, coalesce(string_agg(logical, ',' ORDER BY logical) FILTER (WHERE a <> b), '') AS fields,
    coalesce(bool_and(logical IN ('status', 'year')) FILTER (WHERE a <> b), false) AS wholly FROM p GROUP BY 1)
"""


@entry(_COMPARED_SQL + "SELECT o_orderkey, CASE WHEN fields <> '' AND NOT wholly THEN 'conflict' WHEN compared < 2 THEN 'unchecked' ELSE 'ok' END AS verdict, fields FROM v")
def field_disagreement(t):
    fires = (F.col("fields") != "") & ~F.col("wholly_sensitive")
    return _verdicts(t).select("o_orderkey", F.when(fires, "conflict").when(F.col("compared") < 2, "unchecked").otherwise("ok").alias("verdict"), "fields")


@entry(_COMPARED_SQL + "SELECT o_orderkey, CASE WHEN fields <> '' AND wholly THEN 'conflict' WHEN compared < 2 THEN 'unchecked' ELSE 'ok' END AS verdict, fields FROM v")
def sensitive_only(t):
    fires = (F.col("fields") != "") & F.col("wholly_sensitive")
    return _verdicts(t).select("o_orderkey", F.when(fires, "conflict").when(F.col("compared") < 2, "unchecked").otherwise("ok").alias("verdict"), "fields")


@entry("""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('N', 'A')) THEN 'conflict' ELSE 'ok' END AS verdict FROM orders
""")
def enrolled_unpaid(t):
    """Urgent orders without a line that was kept: an existence flag, not a filter."""
    kept = t.lineitem.where(F.col("l_returnflag").isin("N", "A")).select("l_orderkey").distinct()
    fires = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("l_orderkey").isNull()
    return t.orders.join(kept, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.when(fires, "conflict").otherwise("ok").alias("verdict"))


@entry("""
WITH m AS (SELECT c_custkey, c_nationkey * 1000 + (c_custkey % 40) AS household, c_acctbal >= 0 AS eligible,
  c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) AS no_event, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS no_order FROM customer),
h AS (SELECT household, count(*) AS n, count(*) FILTER (WHERE no_event) AS e, count(*) FILTER (WHERE no_order) AS o FROM m WHERE eligible GROUP BY 1),
d AS (SELECT household, CASE WHEN e = 1 AND o = 1 THEN NULL WHEN e = 1 THEN 'events' WHEN o = 1 THEN 'orders' END AS dropped FROM h WHERE n >= 2)
SELECT m.c_custkey, CASE WHEN eligible AND (dropped = 'events' AND no_event OR dropped = 'orders' AND no_order) THEN 'conflict' ELSE 'ok' END AS verdict FROM m LEFT JOIN d USING (household)
""")
def dropped_sibling(t):
    """Households in which exactly one eligible member is missing from exactly one source; a window, no join-back."""
    seen = t.events.select(F.col("user_id").alias("c_custkey")).where("c_custkey is not null").distinct().withColumn("event", F.lit(True))
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("order", F.lit(True))
    m = t.customer.select("c_custkey", (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 40).alias("household"), (F.col("c_acctbal") >= 0).alias("eligible"))
    m = m.join(seen, "c_custkey", "left").join(done, "c_custkey", "left")
    no_event, no_order = F.col("event").isNull(), F.col("order").isNull()
    w = W.partitionBy("household")
    m = m.withColumns({"n": F.count_if("eligible").over(w), "e": F.count_if(F.col("eligible") & no_event).over(w), "o": F.count_if(F.col("eligible") & no_order).over(w)})
    dropped = F.when((F.col("e") == 1) & (F.col("o") == 1), None).when(F.col("e") == 1, "events").when(F.col("o") == 1, "orders")
    fires = F.col("eligible") & (F.col("n") >= 2) & F.coalesce(((dropped == "events") & no_event) | ((dropped == "orders") & no_order), F.lit(False))
    return m.select("c_custkey", F.when(fires, "conflict").otherwise("ok").alias("verdict"))


@entry("""
WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k IS NOT NULL AND n_nationkey IS NULL THEN 'absent' WHEN k IS NOT NULL AND c_nationkey IS NULL THEN 'unresolved' WHEN k <> c_nationkey THEN 'elsewhere' ELSE 'ok' END AS verdict
FROM e LEFT JOIN nation ON n_nationkey = k LEFT JOIN customer ON c_custkey = user_id
""")
def stale_pointer(t):
    """Pointers of events that name nothing, or something that is not this user's."""
    e = t.events.select("event_id", "user_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    j = e.join(t.nation, F.col("n_nationkey") == F.col("k"), "left").join(t.customer, F.col("c_custkey") == F.col("user_id"), "left")
    verdict = F.when(F.col("k").isNotNull() & F.col("n_nationkey").isNull(), "absent").when(F.col("k").isNotNull() & F.col("c_nationkey").isNull(), "unresolved").when(F.col("k") != F.col("c_nationkey"), "elsewhere").otherwise("ok")
    return j.select("event_id", verdict.alias("verdict"))


@entry("""
WITH c AS (
  SELECT DISTINCT o_orderkey AS ref, 'ext' AS key_class, c_nationkey AS target FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT DISTINCT l_orderkey, 'namedob', s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
g AS (SELECT ref, count(*) FILTER (WHERE key_class = 'ext') AS e, count(*) FILTER (WHERE key_class = 'namedob') AS n, min(target) FILTER (WHERE key_class = 'ext') AS et, min(target) FILTER (WHERE key_class = 'namedob') AS nt FROM c GROUP BY 1)
SELECT o_orderkey, CASE WHEN e = 1 AND n = 1 AND et <> nt THEN 'conflict' ELSE 'ok' END AS verdict FROM orders LEFT JOIN g ON ref = o_orderkey
""")
def merge_collapsed(t):
    """Orders that two key classes resolve to one target each, and not the same one."""
    ext = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("ref"), F.lit("ext").alias("key_class"), F.col("c_nationkey").alias("target")).distinct()
    named = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_orderkey").alias("ref"), F.lit("namedob").alias("key_class"), F.col("s_nationkey").alias("target")).distinct()
    of = lambda k: F.when(F.col("key_class") == k, F.col("target"))
    g = ext.unionByName(named).groupBy("ref").agg(F.count(of("ext")).alias("e"), F.count(of("namedob")).alias("n"), F.min(of("ext")).alias("et"), F.min(of("namedob")).alias("nt"))
    fires = F.coalesce((F.col("e") == 1) & (F.col("n") == 1) & (F.col("et") != F.col("nt")), F.lit(False))
    return t.orders.join(g, F.col("ref") == F.col("o_orderkey"), "left").select("o_orderkey", F.when(fires, "conflict").otherwise("ok").alias("verdict"))


@entry("""
SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS amount_cents, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) * CAST(l_quantity AS BIGINT) AS expected_cents,
  CASE WHEN p_partkey IS NULL THEN 'unchecked' WHEN abs(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) - CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) * CAST(l_quantity AS BIGINT)) * 2 > CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) * CAST(l_quantity AS BIGINT) THEN 'conflict' ELSE 'ok' END AS verdict
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
""")
def wrong_amount(t):
    """Amounts more than half off the price list; the list is joined, and broadcast only if Spark finds it small."""
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left")
    amount, expected = cents("l_extendedprice"), cents("p_retailprice") * F.col("l_quantity").cast("long")
    verdict = F.when(F.col("p_partkey").isNull(), "unchecked").when(F.abs(amount - expected) * 2 > expected, "conflict").otherwise("ok")
    return j.select("l_orderkey", "l_linenumber", amount.alias("amount_cents"), expected.alias("expected_cents"), verdict.alias("verdict"))


@entry("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT o_custkey, max(l_shipdate) AS last FROM x WHERE l_returnflag = 'N' GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND NOT coalesce(last > l_shipdate, false) THEN 'conflict' ELSE 'ok' END AS verdict FROM x LEFT JOIN k USING (o_custkey)
""")
def refund_not_reflected(t):
    """Returned lines that no later kept line of the customer supersedes: the greatest later date decides."""
    x = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "o_custkey")
    last = x.where("l_returnflag = 'N'").groupBy("o_custkey").agg(F.max("l_shipdate").alias("last"))
    fires = (F.col("l_returnflag") == "R") & ~F.coalesce(F.col("last") > F.col("l_shipdate"), F.lit(False))
    return x.join(last, "o_custkey", "left").select("l_orderkey", "l_linenumber", F.when(fires, "conflict").otherwise("ok").alias("verdict"))


@entry("SELECT r_regionkey, 'unchecked' AS verdict, 'no_rule_in_scope' AS reason FROM region")
def no_rule_in_scope(t):
    return t.region.select("r_regionkey", F.lit("unchecked").alias("verdict"), F.lit("no_rule_in_scope").alias("reason"))


# --- conflicts --------------------------------------------------------------------


@entry("""
WITH w AS (SELECT event_id, user_id, event_type, lag(event_type, 1) OVER p AS middle, lag(event_type, 2) OVER p AS before FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, event_type, middle FROM w WHERE event_type = before AND event_type <> middle
""")
def aba_oscillation(t):
    e = t.events.select("event_id", "user_id", "event_type", "ts")
    return r.flip_flops(e, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type", "middle")


def _conflicts(t) -> DataFrame:
    """A conflict set over customers: type, refs and conflict_id."""
    c = t.customer
    made = lambda kind, where: c.where(where).select(F.lit(kind).alias("type"), F.array(F.concat(F.lit("crm:contact:"), F.col("c_custkey").cast("string"))).alias("refs"))
    every = made("C14", "c_acctbal < 0").unionByName(made("C6", "c_nationkey < 10")).unionByName(made("C10", "c_custkey % 7 = 0")).unionByName(made("C5", "c_custkey % 5 = 0")).unionByName(made("C1", "c_nationkey > 12")).unionByName(made("C8", "c_custkey % 3 = 0"))
    return every.withColumn("conflict_id", F.concat_ws("|", "type", F.array_join("refs", ",")))


@entry("""
WITH c AS (
  SELECT 'C14' AS type, c_custkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'C6', c_custkey FROM customer WHERE c_nationkey < 10 UNION ALL SELECT 'C10', c_custkey FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'C5', c_custkey FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'C1', c_custkey FROM customer WHERE c_nationkey > 12 UNION ALL SELECT 'C8', c_custkey FROM customer WHERE c_custkey % 3 = 0),
a AS (SELECT * FROM c WHERE NOT (type = 'C6' AND k IN (SELECT k FROM c WHERE type = 'C14'))),
b AS (SELECT * FROM a WHERE NOT (type IN ('C6', 'C14', 'C4') AND k IN (SELECT k FROM a WHERE type = 'C10'))),
d AS (SELECT * FROM b WHERE NOT (type IN ('C1', 'C7') AND k IN (SELECT k FROM b WHERE type = 'C5'))),
e AS (SELECT * FROM d WHERE NOT (type = 'C5' AND k IN (SELECT k FROM d WHERE type = 'C10'))),
f AS (SELECT * FROM e WHERE NOT (type IN ('C1', 'C7') AND k IN (SELECT k FROM e WHERE type = 'C8')))
SELECT type, 'crm:contact:' || k AS ref FROM f
""")
def precedence_filter(t):
    """Winners suppress losers that share a ref; winners are taken anew from the survivors of each rule."""
    kept = r.precedence(_conflicts(t), dims.PRECEDENCE)
    return kept.select("type", F.element_at("refs", 1).alias("ref"))


@entry("""
WITH c AS (SELECT 'C5|crm:contact:' || c_custkey AS id, c_custkey AS k FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'C8|crm:contact:' || c_custkey, c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'C10|crm:contact:' || c_custkey, c_custkey FROM customer WHERE c_custkey % 7 = 0)
SELECT a.id AS conflict_id, string_agg(b.id, ',' ORDER BY b.id) AS others FROM c a JOIN c b ON a.k = b.k AND a.id <> b.id GROUP BY 1
""")
def compound_map(t):
    some = _conflicts(t).where(F.col("type").isin("C5", "C8", "C10"))
    return r.compound(some).select("conflict_id", F.array_join("others", ",").alias("others"))


@entry("SELECT c_custkey, sha256('C6|appdb:student:' || c_custkey || chr(31) || 'crm:contact:' || c_custkey || '|grade|left=' || c_mktsegment || chr(31) || 'right=' || c_name) AS fingerprint FROM customer")
def fingerprint(t):
    refs = F.array(F.concat(F.lit("crm:contact:"), F.col("c_custkey").cast("string")), F.concat(F.lit("appdb:student:"), F.col("c_custkey").cast("string")))
    print_ = s.fingerprint(F.lit("C6"), refs, F.array(F.lit("grade")), F.create_map(F.lit("right"), F.col("c_name"), F.lit("left"), F.col("c_mktsegment")))
    return t.customer.select("c_custkey", print_.alias("fingerprint"))


@entry("SELECT count(*) AS n_rows, CAST(coalesce(sum(CAST(CAST('0x' || substr(md5(c_acctbal || chr(31) || c_custkey || chr(31) || c_mktsegment || chr(31) || c_name || chr(31) || c_nationkey), 1, 15) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR) AS digest FROM customer")
def mirror_digest(t):
    return r.content_digest(t.customer)


@entry("""
WITH e AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT DISTINCT user_id AS k FROM events WHERE user_id IS NOT NULL)
SELECT coalesce(e.k, f.k) AS k, CASE WHEN e.k IS NULL THEN 'extra' WHEN f.k IS NULL THEN 'missing' ELSE 'matched' END AS verdict FROM e FULL JOIN f ON e.k = f.k
""")
def grading_diff(t):
    expected = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return r.compare_sets(expected, t.events.where("user_id is not null").select(F.col("user_id").alias("k")), ["k"])


@entry("""
WITH e AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT DISTINCT user_id AS k FROM events WHERE user_id IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE e.k IS NOT NULL AND f.k IS NOT NULL) AS matched, count(*) FILTER (WHERE f.k IS NULL) AS missing, count(*) FILTER (WHERE e.k IS NULL) AS extra FROM e FULL JOIN f ON e.k = f.k)
SELECT matched, missing, extra, CAST(matched / nullif(matched + extra, 0) AS DECIMAL(6,4)) AS "precision", CAST(matched / nullif(matched + missing, 0) AS DECIMAL(6,4)) AS recall FROM c
""")
def grading_counts(t):
    return r.precision_recall(grading_diff(t))


@entry("SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 3 = 0) AS touched FROM customer")
def clean_probe(t):
    """How many records a conflict touches: overlap of ref arrays through a semi-join."""
    every = t.customer.select(F.concat(F.lit("crm:contact:"), F.col("c_custkey").cast("string")).alias("ref"))
    hit = _conflicts(t).where("type = 'C8'").select(F.explode("refs").alias("ref")).distinct().withColumn("hit", F.lit(True))
    return every.join(hit, "ref", "left").agg(F.count("*").alias("n"), F.count("hit").alias("touched"))


# --- scalars ----------------------------------------------------------------------


@entry("""
SELECT c_custkey, replace(lower(replace(c_name, '#', '.')), '.', '') || '@gmail.com' AS short, lower(c_name) || 'é' || c_nationkey || '@schule.example' AS other FROM customer
""")
def norm_email(t):
    """Quotes, case, dots and tags of one provider; other addresses only lose quotes and case, also beyond ASCII."""
    dotted = F.concat(F.lit(" '"), F.upper(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("+tag@GMAIL.com' "))
    other = F.concat(F.lit('  "'), F.col("c_name"), F.lit("É"), F.col("c_nationkey").cast("string"), F.lit('@Schule.Example" '))
    return t.customer.select("c_custkey", s.norm_email(dotted).alias("short"), s.norm_email(other).alias("other"))


@entry("SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS name, strip_accents(lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g')))) || ' elan oconner' AS accented FROM part")
def norm_name(t):
    """Case, spaces, quotes and accents."""
    accented = F.concat(F.initcap("p_name"), F.lit("   ÉLAN\tO’Cönner "))
    return t.part.select("p_partkey", s.norm_name(F.concat(F.lit(" "), F.initcap("p_name"), F.lit("  "))).alias("name"), s.norm_name(accented).alias("accented"))


@entry("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dob, CAST(NULL AS DATE) AS bad FROM orders")
def norm_dob(t):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select("o_orderkey", s.norm_dob(F.concat(F.lit(" '"), text, F.lit("'"))).alias("dob"), s.norm_dob(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("bad"))


@entry("SELECT c_custkey, CASE WHEN c_custkey % 14 = 0 THEN 'K' WHEN c_custkey % 14 < 13 THEN CAST(c_custkey % 14 AS VARCHAR) END AS grade, CASE WHEN c_custkey % 14 < 13 THEN CAST(c_custkey % 14 AS INTEGER) END AS grade_ord FROM customer")
def norm_enum(t):
    n = F.col("c_custkey") % 14
    spelled = F.when(n == 0, "Kindergarten").otherwise(F.concat(F.lit("Grade "), n.cast("string")))
    grade = s.norm_enum("grade", spelled)
    return t.customer.select("c_custkey", grade.alias("grade"), s.grade_ord(grade).alias("grade_ord"))


@entry("""
WITH m AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(24,6)) * 1000000 AS HUGEINT) AS micros FROM orders)
SELECT o_orderkey, CAST(micros // 10000 + CASE WHEN micros % 10000 > 5000 OR micros % 10000 = 5000 AND (micros // 10000) % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS cents FROM m
""")
def money(t):
    """Dollars as text to whole cents, half to even."""
    return t.orders.select("o_orderkey", s.cents_from_dollars(F.col("o_totalprice").cast("decimal(24,6)").cast("string")).alias("cents"))


@entry("SELECT c_custkey, substr(sha256('appdb:student:' || c_custkey), 1, 16) AS prefix, md5(c_name) AS md5 FROM customer")
def hashes(t):
    name = F.concat(F.lit("appdb:student:"), F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", F.substring(F.sha2(name, 256), 1, 16).alias("prefix"), F.md5("c_name").alias("md5"))


@entry(f"""
WITH h AS (SELECT c_custkey, 'appdb:student:' || c_custkey AS name, sha1(from_hex('{s.NAMESPACE.replace("-", "")}') || encode('appdb:student:' || c_custkey)) AS h FROM customer)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS person_key,
  CAST(CAST('0x' || substr(sha256(name), 16, 1) AS INTEGER) % 2 AS INTEGER) AS shard FROM h
""")
def person_keys(t):
    """Name-based UUIDs and tenant shards of customers."""
    name = F.concat(F.lit("appdb:student:"), F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", s.uuid5(name).alias("person_key"), s.shard(name).alias("shard"))


_DETECTED = "text"
for _kind, _pattern in privacy.DETECTORS:
    _DETECTED = f"regexp_replace({_DETECTED}, '{_pattern}', '[pii:{_kind}]', 'g')"


@entry(f"SELECT conv_id, turn, {_DETECTED} AS text FROM (SELECT conv_id, turn, text || ' S-123456 HH-000001 2012-03-04' AS text FROM conversations)")
def redact_text(t):
    """Turns, with an identifier of each further kind at the end, without what the detectors know."""
    return t.conversations.select("conv_id", "turn", privacy.scrubbed(F.concat("text", F.lit(" S-123456 HH-000001 2012-03-04"))).alias("text"))


# --- ledgers ----------------------------------------------------------------------


@entry("""
SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS generation, count(*) AS expected, count(*) FILTER (WHERE o_orderstatus <> 'P') AS loaded, count(*) FILTER (WHERE o_orderstatus = 'P') AS rejected,
  count(*) = count(*) FILTER (WHERE o_orderstatus <> 'P') AS complete FROM orders GROUP BY 1
""")
def completeness_ledger(t):
    """Orders by month as generations: expected, loaded and rejected counts, complete if nothing is missing."""
    g = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("generation")
    done = F.count_if(F.col("o_orderstatus") != "P")
    return t.orders.groupBy(g).agg(F.count("*").alias("expected"), done.alias("loaded"), F.count_if(F.col("o_orderstatus") == "P").alias("rejected"), (F.count("*") == done).alias("complete"))


@entry("""
WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS generation, month(o_orderdate) AS m, bool_and(o_orderstatus <> 'P') AS complete FROM orders GROUP BY 1, 2)
SELECT generation, CASE WHEN bool_and(complete) THEN 'landed' ELSE 'pending' END AS state, count(*) AS slices FROM s GROUP BY 1
""")
def generation_plan(t):
    slices = t.orders.groupBy(F.year("o_orderdate").alias("generation"), F.month("o_orderdate").alias("m")).agg(F.bool_and(F.col("o_orderstatus") != "P").alias("complete"))
    return slices.groupBy("generation").agg(F.when(F.bool_and("complete"), "landed").otherwise("pending").alias("state"), F.count("*").alias("slices"))


@entry("""
WITH g AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS generation, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS good, count(*) FILTER (WHERE o_orderstatus = 'P') AS lost FROM orders GROUP BY 1)
SELECT generation, n AS expected_count, good AS loaded_count, lost AS rejected_count, n = good AS complete, n = good + lost AS accounted FROM g
""")
def ledger_identity(t):
    """The ledger over years as generations: what was expected is loaded or rejected, and complete if nothing is."""
    year = F.year("o_orderdate").alias("generation")
    keyed = [F.lit("shop").alias("source_id"), F.lit("order").alias("entity_type"), year]
    landed = t.orders.where("o_orderstatus <> 'P'").select(*keyed, F.col("o_orderkey").cast("string").alias("natural_key"))
    lost = t.orders.where("o_orderstatus = 'P'").groupBy(*keyed).agg(F.count("*").alias("n"))
    expected = t.orders.groupBy(*keyed).agg(F.count("*").alias("expected_count"))
    out = snapshots.ledger(landed, lost, expected)
    return out.select("generation", "expected_count", "loaded_count", "rejected_count", "complete", (F.col("expected_count") == F.col("loaded_count") + F.col("rejected_count")).alias("accounted"))


# --- pages and tops ---------------------------------------------------------------


@entry("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(t):
    return r.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@entry("SELECT o_custkey, o_orderkey, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def per_group_limit(t):
    return r.per_group(t.orders, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "place")


@entry("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def page_offset(t):
    return r.page(r.optional_filters(t.orders, o_orderstatus="F", o_custkey=None).select("o_orderkey", "o_custkey"), ["o_orderkey"], 3, 25)


@entry("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 40")
def page_keyset(t):
    return r.keyset_page(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 100, 40)


@entry("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 10")
def page_total(t):
    rows = t.orders.where("o_orderstatus = 'P'").select("o_orderkey")
    return r.with_total(r.page(rows, ["o_orderkey"], 1, 10), rows)


@entry("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, o_custkey LIMIT 20")
def count_descending(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20)


@entry("SELECT 'event_type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2")
def facets(t):
    return r.facets(t.events, ["event_type", "user_id"])


@entry("SELECT CAST(p AS INTEGER) AS percent, list_extract(v, greatest(1, CAST(ceil(p * len(v) / 100.0) AS BIGINT))) AS value FROM (SELECT list(o_orderkey ORDER BY o_orderkey) AS v FROM orders), (SELECT unnest([50, 95, 99]) AS p)")
def nearest_rank(t):
    return r.nearest_rank(t.orders, "o_orderkey", [50, 95, 99]).withColumn("value", F.col("value").cast("long"))


@entry("SELECT 'orders' AS name, count(*) AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'lines', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)")
def key_uniqueness(t):
    found = lambda df, k, n: r.duplicates(df, [k]).agg(F.lit(n).alias("name"), F.count("*").alias("n")).select("name", "n")
    return found(t.orders, "o_orderkey", "orders").unionByName(found(t.lineitem, "l_orderkey", "lines"))


# --- resolution -------------------------------------------------------------------


@entry("""
WITH k AS (SELECT c_custkey AS target, 'key' AS via, CAST(c_custkey AS VARCHAR) AS key FROM customer UNION ALL SELECT c_custkey, 'name', c_name FROM customer UNION ALL SELECT o_custkey, 'order', 'order-' || o_orderkey FROM orders),
g AS (SELECT key, count(DISTINCT target) AS n, min(target) AS target FROM k GROUP BY 1)
SELECT key, n, CASE WHEN n = 1 THEN target END AS target FROM g
""")
def key_resolution(t):
    """Keys of three kinds to the record that they name; ambiguous ones name none."""
    k = t.customer.select(F.col("c_custkey").alias("target"), F.explode(F.array(F.col("c_custkey").cast("string"), F.col("c_name"))).alias("key"))
    k = k.unionByName(t.orders.select(F.col("o_custkey").alias("target"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("key")))
    g = k.groupBy("key").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    return g.select("key", "n", F.when(F.col("n") == 1, F.col("target")).alias("target"))


@entry("""
WITH a AS (SELECT c_custkey, s_suppkey, 1 AS step FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 2 = 0),
b AS (SELECT c_custkey, min(s_suppkey) AS s_suppkey, 2 AS step FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_custkey NOT IN (SELECT c_custkey FROM a) AND s_suppkey NOT IN (SELECT s_suppkey FROM a) GROUP BY 1)
SELECT c_custkey, s_suppkey, CAST(step AS INTEGER) AS step FROM a UNION ALL SELECT c_custkey, s_suppkey, CAST(step AS INTEGER) FROM b
""")
def link_cascade(t):
    """First-match cascade: hard keys first, then the least candidate among those that no hard key owns."""
    hard = t.customer.where("c_custkey % 2 = 0").join(t.supplier, F.col("s_suppkey") == F.col("c_custkey")).select("c_custkey", "s_suppkey", F.lit(1).alias("step"))
    rest = t.customer.join(hard, "c_custkey", "left_anti")
    free = t.supplier.join(hard, "s_suppkey", "left_anti").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    soft = rest.join(free, F.col("s_nationkey") == F.col("c_nationkey")).select("c_custkey", "s_suppkey", F.lit(2).alias("step"))
    return hard.unionByName(soft)


@entry("""
SELECT c_nationkey, c_mktsegment, count(*) AS members, min(c_custkey) AS anchor, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS refs FROM customer GROUP BY 1, 2
""")
def households(t):
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("members"), F.min("c_custkey").alias("anchor"), r.sorted_text(F.col("c_custkey")).alias("refs"))


@entry("""
WITH o AS (SELECT o_custkey, count(*) AS orders, bool_or(o_orderstatus = 'F') AS paid, min(o_orderkey) AS first_order FROM orders GROUP BY 1),
e AS (SELECT user_id, count(*) AS events, max_by(event_type, (ts, event_id)) AS stage FROM events GROUP BY 1)
SELECT c_custkey, 'appdb:student:' || c_custkey AS anchor_ref, coalesce(orders, 0) AS orders, coalesce(paid, false) AS paid, first_order, coalesce(events, 0) AS events, stage,
  CASE WHEN user_id IS NULL AND o_custkey IS NULL THEN 'crm' WHEN user_id IS NULL THEN 'crm,orders' WHEN o_custkey IS NULL THEN 'crm,events' ELSE 'crm,events,orders' END AS sources
FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey
""")
def entity_view(t):
    """One row for each customer across three sources, with survivorship by least key."""
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.bool_or(F.col("o_orderstatus") == "F").alias("paid"), F.min("o_orderkey").alias("first_order"))
    e = t.events.groupBy("user_id").agg(F.count("*").alias("events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"))
    j = t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(e, F.col("user_id") == F.col("c_custkey"), "left")
    have = F.array_compact(F.array(F.lit("crm"), F.when(F.col("user_id").isNotNull(), "events"), F.when(F.col("o_custkey").isNotNull(), "orders")))
    return j.select("c_custkey", F.concat(F.lit("appdb:student:"), F.col("c_custkey").cast("string")).alias("anchor_ref"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("paid", F.lit(False)).alias("paid"), "first_order", F.coalesce("events", F.lit(0)).alias("events"), "stage", F.array_join(have, ",").alias("sources"))


@entry("""
SELECT 'appdb:student:' || o_custkey AS person, f AS field, CASE f WHEN 'status' THEN o_orderstatus ELSE o_orderpriority END AS value, CAST(year(o_orderdate) AS INTEGER) AS generation FROM orders, (SELECT unnest(['status', 'priority']) AS f)
""")
def lineage_long(t):
    """Field history as (person, field, value, generation): one pass, columns to rows."""
    each = F.array(F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")))
    return t.orders.select(F.concat(F.lit("appdb:student:"), F.col("o_custkey").cast("string")).alias("person"), F.inline(each), F.year("o_orderdate").alias("generation")).select("person", "field", "value", "generation")


# --- scores and gates -------------------------------------------------------------


def _scored(t) -> DataFrame:
    weight = lambda name, cond, table: F.when(cond, F.lit(dims.money(table[name]))).otherwise(F.lit(dims.money("0.00"))).cast("decimal(10,4)")
    k = F.col("c_custkey")
    kind = F.concat(F.lit("C"), (k % 14 + 1).cast("string"))
    rows = (k % 4).cast("decimal(10,0)")
    up = [weight("hard_external_id_agreement", k % 2 == 0, dims.POSITIVE), weight("normalized_email_agreement", k % 3 == 0, dims.POSITIVE), weight("name_dob_exact", k % 5 == 0, dims.POSITIVE)]
    down = [(rows * F.lit(dims.money(dims.NEGATIVE["disagreeing_field"]))).cast("decimal(10,4)"), weight("partial_evidence", k % 11 == 0, dims.NEGATIVE), weight("oscillation_observed", k % 13 == 0, dims.NEGATIVE)]
    return t.customer.select("c_custkey", kind.alias("type"), r.confidence(kind, up, down, dims.BASES).alias("confidence"))


_SCORED_SQL = """
WITH b AS (SELECT * FROM (VALUES %s) AS b(type, base)),
c AS (SELECT c_custkey, 'C' || (c_custkey %% 14 + 1) AS type,
  least(1.0, (SELECT base FROM b WHERE b.type = 'C' || (c_custkey %% 14 + 1)) + CASE WHEN c_custkey %% 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN c_custkey %% 3 = 0 THEN 0.25 ELSE 0 END + CASE WHEN c_custkey %% 5 = 0 THEN 0.20 ELSE 0 END) AS up,
  (c_custkey %% 4) * 0.10 + CASE WHEN c_custkey %% 11 = 0 THEN 0.15 ELSE 0 END + CASE WHEN c_custkey %% 13 = 0 THEN 0.25 ELSE 0 END AS down FROM customer),
scored AS (SELECT c_custkey, type, CAST(greatest(0.0, up - down) AS DECIMAL(5,4)) AS confidence FROM c)
""" % ", ".join(f"('{k}', {v})" for k, v in dims.BASES.items())


@entry(_SCORED_SQL + "SELECT c_custkey, type, confidence FROM scored")
def confidence_score(t):
    return _scored(t)


_targets = ", ".join(f"('{k}', '{v}')" for k, v in dims.FIX_TARGETS.items())
_quoted = lambda x: ", ".join(f"'{v}'" for v in sorted(x))


@entry(_SCORED_SQL + f", f AS (SELECT * FROM (VALUES {_targets}) AS f(type, target)) SELECT c_custkey, target, CASE WHEN type = 'C14' THEN 'hold' WHEN target IS NULL THEN 'escalated' WHEN target IN ({_quoted(dims.SENSITIVE)}) THEN 'hold' WHEN target IN ({_quoted(dims.AUTO_APPLY)}) THEN 'eligible' ELSE 'hold' END AS disposition FROM scored LEFT JOIN f USING (type)")
def classify(t):
    """Where a fix may go: sensitive targets wait for a person, types without a target are escalated."""
    target = dims.lookup(F.col("type"), dims.FIX_TARGETS)
    out = F.when(F.col("type") == "C14", "hold").when(target.isNull(), "escalated").when(target.isin(*dims.SENSITIVE), "hold").when(target.isin(*dims.AUTO_APPLY), "eligible").otherwise("hold")
    return _scored(t).select("c_custkey", target.alias("target"), out.alias("disposition"))


@entry(_SCORED_SQL + f", f AS (SELECT * FROM (VALUES {_targets}) AS f(type, target)) SELECT c_custkey, concat_ws(',', CASE WHEN target IS NULL THEN 'no_target' END, CASE WHEN target IN ({_quoted(dims.SENSITIVE)}) THEN 'sensitive' END, CASE WHEN target NOT IN ({_quoted(dims.AUTO_APPLY)}) THEN 'not_listed' END, CASE WHEN confidence < 0.95 THEN 'low_confidence' END) AS refusals FROM scored LEFT JOIN f USING (type)")
def auto_apply_gate(t):
    """All checks that an unattended fix fails, in order; none means that it may go."""
    target = dims.lookup(F.col("type"), dims.FIX_TARGETS)
    checks = F.array_compact(F.array(F.when(target.isNull(), "no_target"), F.when(target.isin(*dims.SENSITIVE), "sensitive"), F.when(~target.isin(*dims.AUTO_APPLY), "not_listed"), F.when(F.col("confidence") < F.lit(dims.money(dims.AUTO_APPLY_FLOOR)), "low_confidence")))
    return _scored(t).select("c_custkey", F.array_join(checks, ",").alias("refusals"))


# --- documents --------------------------------------------------------------------


def _documents(t) -> DataFrame:
    before = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("note"), F.lit("old"))
    change = F.create_map(F.lit("segment"), F.lit("BUILDING"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return t.customer.select("c_custkey", before.alias("before"), change.alias("change"))


_flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")


@entry("SELECT c_custkey, 'name=' || c_name || ';nation=' || c_nationkey || ';note=old;segment=BUILDING' AS after FROM customer")
def doc_merge(t):
    """before with the change on top; last value wins."""
    return _documents(t).select("c_custkey", _flat(documents.merged(F.col("before"), F.col("change"))).alias("after"))


@entry("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'nation' ELSE 'nation,segment' END AS paths FROM customer")
def write_set(t):
    """Paths that a change really writes."""
    return _documents(t).select("c_custkey", F.array_join(documents.written(F.col("before"), F.col("change")), ",").alias("paths"))


def _events(t) -> DataFrame:
    """Applied changes of one known field; customers with a low balance have one more on top."""
    d = _documents(t).select(F.col("c_custkey").alias("entity"), "before", F.create_map(F.lit("segment"), F.lit("BUILDING")).alias("change"), F.lit("approved").alias("status"), F.lit("segment").alias("target"))
    first = documents.apply(d).withColumn("event_id", F.col("entity") * 2)
    poor = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("entity"))
    again = first.join(poor, "entity").select("entity", F.col("after").alias("before"), F.create_map(F.lit("note"), F.lit("new")).alias("change"), F.lit("approved").alias("status"), F.lit("note").alias("target"))
    return first.unionByName(documents.apply(again).withColumn("event_id", F.col("entity") * 2 + 1))


@entry("""
WITH d AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal < 0 AS poor FROM customer),
e AS (SELECT c_custkey * 2 AS event_id, c_custkey AS entity, poor AS stale, 'name=' || c_name || ';note=old;segment=' || c_mktsegment AS doc FROM d WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT c_custkey * 2 + 1, c_custkey, false, 'name=' || c_name || ';note=old;segment=BUILDING' FROM d WHERE poor AND c_mktsegment <> 'BUILDING')
SELECT event_id, entity, CASE WHEN NOT stale THEN doc END AS doc, CASE WHEN stale THEN 'stale' END AS refused FROM e
""")
def rollback(t):
    """Apply, then reverse: the last write of each document is taken back, one under a later write is refused."""
    events = _events(t)
    current = r.latest(events.select("entity", "event_id", "after"), ["entity"], ["event_id"]).select("entity", F.col("after").alias("doc"))
    return documents.roll_back(events, current).select("event_id", "entity", _flat(F.col("doc")).alias("doc"), "refused")


@entry("""
WITH d AS (SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'not_approved' WHEN c_nationkey < 5 THEN 'would_introduce' WHEN c_mktsegment = 'BUILDING' THEN 'no_op' END AS refused FROM d
""")
def apply_refusals(t):
    """Why a change may not be applied: not approved, an unknown field, nothing to write."""
    change = F.when(F.col("c_nationkey") < 5, F.create_map(F.lit("unknown"), F.lit("x"))).otherwise(F.create_map(F.lit("segment"), F.lit("BUILDING")))
    d = _documents(t).select("c_custkey", "before").join(t.customer, "c_custkey").select("c_custkey", "before", change.alias("change"), F.when(F.col("c_acctbal") < 0, "pending").otherwise("approved").alias("status"), F.lit("segment").alias("target"))
    return documents.refusals(d).select("c_custkey", "refused")


# --- spend ------------------------------------------------------------------------


@entry("""
WITH RECURSIVE q AS (SELECT event_id, user_id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, amount <= 20000 AS granted, CASE WHEN amount <= 20000 THEN amount ELSE 0 END AS spent FROM q WHERE n = 1
  UNION ALL SELECT q.event_id, q.user_id, q.n, f.spent + q.amount <= 20000, CASE WHEN f.spent + q.amount <= 20000 THEN f.spent + q.amount ELSE f.spent END FROM f JOIN q ON q.user_id IS NOT DISTINCT FROM f.user_id AND q.n = f.n + 1)
SELECT event_id, granted, CAST(spent AS BIGINT) AS spent_after FROM f
""")
def cap_admission(t):
    """Requests under a cap, in order, one scope a user."""
    q = t.events.select("event_id", "user_id", "ts", cents("value").alias("amount"))
    return r.admit(q, ["user_id"], ["ts", "event_id"], "amount", 20000).select("event_id", "granted", "spent_after")


@entry("SELECT event_type, count(*) AS calls, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CASE WHEN value > 50 THEN CAST(floor(value * 100 + 0.5) AS BIGINT) ELSE 0 END) AS BIGINT) AS large_cents FROM events GROUP BY 1")
def spend_rollup(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(cents("value")).alias("cents"), F.sum(F.when(F.col("value") > 50, cents("value")).otherwise(0)).alias("large_cents"))


# --- vectors and retention --------------------------------------------------------


@entry("""
WITH f AS (SELECT label, i AS axis, avg(CAST(embedding[i + 1] AS DOUBLE)) AS m FROM embeddings, range(0, 64) AS r(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS size FROM f GROUP BY 1)
SELECT label, CAST(axis AS INTEGER) AS axis, round(m / size, 6) + 0.0 AS x FROM f JOIN n USING (label)
""")
def cosine_centroid(t):
    return r.centroid(t.embeddings, "label", "embedding").withColumn("x", F.col("x") + F.lit(0.0))


@entry("SELECT event_id, CASE WHEN NOT ts < TIMESTAMP '2024-01-15' THEN 'keep' WHEN user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'blocked' ELSE 'purge' END AS fate FROM events")
def retention_sweep(t):
    """Old rows go unless something still depends on them."""
    dependents = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return r.retained(t.events, "ts", F.lit("2024-01-15").cast("timestamp_ntz"), dependents, "user_id").select("event_id", "fate")


@entry("""
SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY 1, 2
""")
def event_hours(t):
    """Tumbling hours; the streaming twin is in streaming/slices.py."""
    return t.events.groupBy("event_type", F.floor(r.micros(F.col("ts")) / 3_600_000_000).cast("long").alias("hour")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, (v, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in CATALOG.items() if q}
