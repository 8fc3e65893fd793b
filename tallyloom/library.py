"""Registered queries that run the reconciliation operators themselves, with twins in SQL.

Each query takes the records of ``world`` through functions of ``operators``; its twin
states the rule anew, from the same records, as the survey describes it. Maps and lists
are shown as text, so that both engines hash the same values: entries in order of key,
a null as ``~``, list items between commas.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as s
from .operators import conflicts as c
from .operators import incidents, rules
from .operators import relational as r
from .operators.resolve import households, near, views
from .plans import dims
from .storage import stored
from .world import LINKS_SQL, RECORDS_SQL, context

LIBRARY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
HEAD = RECORDS_SQL + LINKS_SQL


def entry(sql: str | None, name: str | None = None):
    def add(f):
        LIBRARY[name or f.__name__] = (f, sql)
        return f

    return add


def listed(column: str) -> Column:
    return F.array_join(F.col(column), ",")


def shown(values: str = "observed") -> Column:
    """A map of observed values as text."""
    bare = lambda v: F.replace(F.regexp_replace(v, f"^{s.ITEM_SEP}+|{s.ITEM_SEP}+$", ""), F.lit(s.ITEM_SEP), F.lit(","))
    pairs = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(bare(e["value"]), F.lit("~"))))
    return F.array_join(pairs, ";")


def _seen(**values: str) -> str:
    """SQL of the text that ``shown`` gives for these expressions; two underscores in a name are a dot."""
    named = sorted((k.replace("__", "."), v) for k, v in values.items())
    return " || ';' || ".join(f"'{k}=' || coalesce(CAST({v} AS VARCHAR), '~')" for k, v in named)


_DAY = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_PAID_STAGES = ", ".join(f"'{x}'" for x in dims.PAID_STAGES)
_FEES = "fees AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{t}', {cents})" for p, fees in dims.FEES.items() for t, cents in zip(dims.PAYMENT_TYPES, fees, strict=True)) + ") AS f(program_norm, payment_type, expected))"

#: For each rule: further expressions and a query of (record_ref, verdict, reason, refs as a list, observed). refs and observed are of conflicts only.
_JOINED = "list_sort(list_distinct({}))"


def _rule(expressions: str, source: str, ref: str, fires: str, refs: str, seen: str, unchecked: str = "NULL") -> tuple[str, str]:
    case = f"CASE WHEN {fires} THEN 'conflict' WHEN ({unchecked}) IS NOT NULL THEN 'unchecked' ELSE 'ok' END"
    return expressions, f"SELECT {ref} AS record_ref, {case} AS verdict, CASE WHEN NOT coalesce({fires}, false) THEN {unchecked} END AS reason, CASE WHEN {fires} THEN {_JOINED.format(refs)} END AS refs, CASE WHEN {fires} THEN {seen} END AS observed FROM {source}"


_SIDES = """
sides AS (SELECT x.source_ref, p.identity_refs, coalesce(p.contact_count, 0) AS contacts,
    c.first_norm AS a1, c.first_name AS ra1, x.first_norm AS b1, x.first_name AS rb1, c.last_norm AS a2, c.last_name AS ra2, x.last_norm AS b2, x.last_name AS rb2,
    CAST(c.dob_norm AS VARCHAR) AS a3, c.dob AS ra3, CAST(x.dob_norm AS VARCHAR) AS b3, x.dob AS rb3, c.grade_norm AS a4, c.grade AS ra4, x.grade_norm AS b4, x.grade AS rb4,
    d.stage_funnel AS a5, d.stage AS ra5, e.stage_funnel AS b5, e.stage AS rb5, c.lifecycle_funnel AS a6, c.lifecycle_stage AS ra6, x.status_funnel AS b6, x.status AS rb6
  FROM w_students x LEFT JOIN persons p ON p.student_ref = x.source_ref LEFT JOIN w_contacts c ON c.source_ref = p.contact_ref LEFT JOIN w_deals d ON d.source_ref = p.deal_ref LEFT JOIN w_enrollments e ON e.source_ref = p.enrollment_ref),
pairs AS (""" + " UNION ALL ".join(f"SELECT source_ref, '{n}' AS logical, '{left}' AS left_path, '{right}' AS right_path, a{i} AS a, b{i} AS b, ra{i} AS ra, rb{i} AS rb, '{why}' AS why FROM sides" for i, (n, left, right, why) in enumerate(dims.COMPARED, 1)) + """),
rolled AS (SELECT source_ref, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS ran, count(*) FILTER (WHERE a <> b) AS differ, coalesce(bool_and(logical IN ('name_first', 'name_last', 'dob', 'stage')) FILTER (WHERE a <> b), false) AS wholly,
    bool_or(a IS NULL AND ra IS NULL OR b IS NULL AND rb IS NULL) FILTER (WHERE a IS NULL OR b IS NULL) AS missing,
    bool_or(why = 'unparseable_value' AND NOT (a IS NULL AND ra IS NULL OR b IS NULL AND rb IS NULL)) FILTER (WHERE a IS NULL OR b IS NULL) AS unparsed FROM pairs GROUP BY 1),
told AS (SELECT source_ref, string_agg(path || '=' || v, ';' ORDER BY path) AS observed, list(path ORDER BY path) AS paths FROM (SELECT source_ref, left_path AS path, a AS v FROM pairs WHERE a <> b UNION ALL SELECT source_ref, right_path, b FROM pairs WHERE a <> b) GROUP BY 1),
decided AS (SELECT s.source_ref, s.identity_refs, s.contacts, r.*, t.observed, t.paths FROM sides s JOIN rolled r USING (source_ref) LEFT JOIN told t USING (source_ref))
"""  # fmt: skip
_UNRUN = "CASE WHEN ran = 0 THEN CASE WHEN missing THEN 'missing_operand' WHEN unparsed THEN 'unparseable_value' ELSE 'unmapped_enum' END END"

_ATTRIBUTED = """
paid_for AS (SELECT p.*, l.student_ref, per.identity_refs, pe.enrollment_ref FROM w_payments p LEFT JOIN payment_links l ON l.payment_ref = p.source_ref LEFT JOIN persons per ON per.student_ref = l.student_ref LEFT JOIN payment_enrollments pe ON pe.payment_ref = p.source_ref)
"""

RULES_SQL: dict[str, tuple[str, str]] = {
    "R-000": _rule("", "w_deals", "source_ref", "false", "[source_ref]", "''", "'no_rule_in_scope'"),
    "R-001": _rule(
        "paid_once AS (SELECT l.student_ref, string_agg(p.source_ref, ',' ORDER BY p.source_ref) AS refs FROM payment_links l JOIN w_payments p ON p.source_ref = l.payment_ref WHERE p.payment_status = 'paid' GROUP BY 1)",
        "w_students x LEFT JOIN persons p ON p.student_ref = x.source_ref LEFT JOIN paid_once ON paid_once.student_ref = x.source_ref",
        "x.source_ref", "paid_once.refs IS NOT NULL AND enrollment_count > 0 AND deal_count = 0", "identity_refs", _seen(paid_payment_refs="paid_once.refs", enrollment_ref="enrollment_ref", d2_deal_count="deal_count"),
    ),
    "R-002": _rule("", "w_payments p LEFT JOIN payment_links l ON l.payment_ref = p.source_ref", "source_ref", "student_ref IS NULL", "[source_ref]", _seen(payer_email_norm="email_norm", external_ref="external_ref", metadata_name_pair_present="name_pair")),
    "R-003": _rule(
        """same_people AS (SELECT a.source_ref AS l, b.source_ref AS r, a.dob_norm AS da, b.dob_norm AS db FROM w_contacts a JOIN w_contacts b ON a.email_norm = b.email_norm AND a.first_norm = b.first_norm AND a.last_norm = b.last_norm AND a.source_ref < b.source_ref
           WHERE NOT coalesce(a.dob_norm <> b.dob_norm, false)), same_members AS (SELECT l AS ref, * FROM same_people UNION ALL SELECT r, * FROM same_people)""",
        "w_contacts c LEFT JOIN same_members m ON m.ref = c.source_ref", "source_ref", "l IS NOT NULL", "[l, r]", _seen(email_norm="email_norm", first_norm="first_norm", last_norm="last_norm", dob_norm_a="da", dob_norm_b="db"),
    ),
    "R-004": _rule(
        "",
        "w_contacts c LEFT JOIN contact_links l ON l.contact_ref = c.source_ref LEFT JOIN w_students x ON x.source_ref = l.student_ref LEFT JOIN persons p ON p.student_ref = l.student_ref",
        "c.source_ref", "method = 'L3' AND NOT coalesce(c.email_norm = x.email_norm, false) AND NOT coalesce(c.email_norm = x.guardian2_email_norm, false)", "identity_refs",
        _seen(contact_email_norm="c.email_norm", link_method="method", student_guardian_email_norms="array_to_string(list_sort(list_distinct([x.email_norm, x.guardian2_email_norm])), ',')"),
    ),
    "R-005": _rule(
        "", "w_students x LEFT JOIN persons p ON p.student_ref = x.source_ref", "source_ref", "status_funnel = 'enrolled' AND contact_count = 0 AND payment_count = 0", "identity_refs",
        _seen(status_funnel="status_funnel", linked_contact_count="contact_count", attributed_payment_count="payment_count"),
    ),
    "R-006": _rule(_SIDES, "decided", "source_ref", "contacts > 0 AND differ > 0 AND NOT wholly", "identity_refs", "observed", _UNRUN),
    "R-007": _rule(
        "paid_deposits AS (SELECT enrollment_ref, count(*) AS n FROM payment_enrollments JOIN w_payments p ON p.source_ref = payment_ref WHERE payment_status = 'paid' AND payment_type IN ('deposit', 'tuition') GROUP BY 1)",
        "w_enrollments e LEFT JOIN person_refs r ON r.ref = e.source_ref LEFT JOIN persons p ON p.anchor = r.anchor LEFT JOIN paid_deposits ON paid_deposits.enrollment_ref = e.source_ref",
        "e.source_ref", f"stage_funnel IN ({_PAID_STAGES}) AND identity_refs IS NOT NULL AND n IS NULL", "list_append(identity_refs, e.source_ref)",
        _seen(enrollment__stage_funnel="stage_funnel", enrollment__deposit_paid_at=_DAY.format("deposit_paid_at"), paid_deposit_payment_count="coalesce(n, 0)"),
    ),
    "R-008": _rule(
        """kids AS (SELECT x.source_ref, x.email_norm AS home, p.identity_refs, contact_count = 0 AS no_crm, payment_count = 0 AS no_pay, count(*) OVER (PARTITION BY x.email_norm) AS members,
             grade_ord >= 0 AND NOT coalesce(status_norm = 'withdrawn', false) AND NOT coalesce(e.stage_funnel IN ('withdrawn', 'refunded'), false) AS able
           FROM w_students x JOIN persons p ON p.student_ref = x.source_ref LEFT JOIN w_enrollments e ON e.source_ref = p.enrollment_ref WHERE x.email_norm IS NOT NULL),
           homes AS (SELECT home, count(*) AS n, count(*) FILTER (WHERE no_crm) AS nc, count(*) FILTER (WHERE no_pay) AS np FROM kids WHERE able AND members >= 2 GROUP BY 1),
           dropped AS (SELECT k.*, n, CASE WHEN nc = 1 AND np = 1 THEN NULL WHEN nc = 1 THEN 'crm' WHEN np = 1 THEN 'payments' END AS source FROM kids k JOIN homes USING (home) WHERE able AND n >= 2)""",
        "w_students x LEFT JOIN (SELECT * FROM dropped WHERE source = 'crm' AND no_crm OR source = 'payments' AND no_pay) d ON d.source_ref = x.source_ref", "x.source_ref", "d.source_ref IS NOT NULL", "d.identity_refs", _seen(household_key="home", dropped_source="source", eligible_member_count="n"),
    ),
    "R-009": _rule(
        """named AS (SELECT deal_id, string_agg(anchor, ',' ORDER BY anchor) AS anchors FROM (SELECT DISTINCT deal_id, anchor FROM deal_persons) GROUP BY 1),
           pointers AS (SELECT e.source_ref, e.crm_deal_id, p.identity_refs, e.crm_deal_id IN (SELECT deal_id FROM w_deals) AS there, anchors, (e.crm_deal_id, p.anchor) IN (SELECT (deal_id, anchor) FROM deal_persons) AS mine
             FROM w_enrollments e LEFT JOIN person_refs r ON r.ref = e.source_ref LEFT JOIN persons p ON p.anchor = r.anchor LEFT JOIN named n ON n.deal_id = e.crm_deal_id)""",
        "pointers", "source_ref", "crm_deal_id IS NOT NULL AND identity_refs IS NOT NULL AND (NOT there OR anchors IS NOT NULL AND NOT mine)", "list_append(identity_refs, source_ref)",
        _seen(enrollment__crm_deal_id="crm_deal_id", deal_present_gen3="there", deal_person_refs="coalesce(anchors, '')"),
        "CASE WHEN crm_deal_id IS NOT NULL AND identity_refs IS NOT NULL AND there AND anchors IS NULL THEN 'deal_unresolved' END",
    ),
    "R-010": _rule(
        "found AS (SELECT source_ref, count(*) FILTER (WHERE key_class = 'ext') AS ne, count(*) FILTER (WHERE key_class = 'namedob') AS nn, min(resolved_ref) FILTER (WHERE key_class = 'ext') AS ext, min(resolved_ref) FILTER (WHERE key_class = 'namedob') AS named FROM candidates GROUP BY 1)",
        "w_contacts c LEFT JOIN found f ON f.source_ref = c.source_ref", "c.source_ref", "ne = 1 AND nn = 1 AND ext <> named", "[c.source_ref, ext, named]", _seen(ext_resolved_ref="ext", namedob_resolved_ref="named", first_norm="first_norm", last_norm="last_norm", dob_norm="dob_norm"),
    ),
    "R-011": _rule(
        """keyed AS (SELECT p.source_ref, coalesce(email_norm, '') AS payer, amount_cents, coalesce(payment_type, '') AS kind, epoch(occurred_at) AS t, student_ref FROM w_payments p JOIN payment_links l ON l.payment_ref = p.source_ref),
           same_payments AS (SELECT a.source_ref AS l, b.source_ref AS r, CAST(abs(a.t - b.t) AS BIGINT) AS gap FROM keyed a JOIN keyed b USING (payer, amount_cents, kind, student_ref) WHERE a.source_ref < b.source_ref AND abs(a.t - b.t) < 600),
           payment_members AS (SELECT l AS ref, * FROM same_payments UNION ALL SELECT r, * FROM same_payments)""",
        "w_payments p LEFT JOIN payment_members m ON m.ref = p.source_ref", "source_ref", "l IS NOT NULL", "[l, r]", _seen(payer_email_norm="coalesce(email_norm, '')", amount_cents="amount_cents", type="coalesce(payment_type, '')", occurred_at_delta_seconds="gap"),
    ),
    "R-012": _rule(
        f"{_ATTRIBUTED}, {_FEES}, priced AS (SELECT p.*, coalesce(e.program_norm, p.program_norm) AS program FROM paid_for p LEFT JOIN w_enrollments e ON e.source_ref = p.enrollment_ref)",
        "priced p LEFT JOIN fees f ON f.program_norm = p.program AND f.payment_type = p.payment_type", "source_ref", "amount_cents <> expected", "list_append(coalesce(identity_refs, []), source_ref)",
        _seen(amount_cents="amount_cents", expected_amount_cents="expected", program_norm="program", type="p.payment_type"),
        "CASE WHEN program IS NULL THEN 'enrollment_unattributed' WHEN type_norm IS NULL AND p.payment_type IS NOT NULL THEN 'unmapped_enum' END",
    ),
    "R-013": _rule(
        f"""{_ATTRIBUTED}, refunds AS (SELECT p.*, e.stage_funnel, e.updated_at, x.status, x.status_funnel, p.payment_status = 'refunded' AS refunded,
             EXISTS (SELECT 1 FROM paid_for q WHERE q.student_ref = p.student_ref AND q.payment_type = p.payment_type AND q.payment_status = 'paid' AND q.occurred_at > p.occurred_at) AS superseded
           FROM paid_for p LEFT JOIN w_enrollments e ON e.source_ref = p.enrollment_ref LEFT JOIN w_students x ON x.source_ref = p.student_ref)""",
        "refunds", "source_ref", f"refunded AND student_ref IS NOT NULL AND enrollment_ref IS NOT NULL AND NOT superseded AND refunded_at > updated_at AND stage_funnel IN ({_PAID_STAGES}) AND status_funnel = 'enrolled'",
        "list_concat(identity_refs, [source_ref, enrollment_ref])", _seen(refunded_at=_DAY.format("refunded_at"), enrollment__updated_at=_DAY.format("updated_at"), enrollment__stage_funnel="stage_funnel", student__status="status"),
        "CASE WHEN refunded AND (student_ref IS NULL OR enrollment_ref IS NULL) THEN 'enrollment_unattributed' END",
    ),
    "R-014": _rule(_SIDES, "decided", "source_ref", "contacts > 0 AND differ > 0 AND wholly", "identity_refs", "observed", _UNRUN),
}


def _with(expressions: str) -> str:
    return HEAD + (", " + expressions if expressions.strip() else "")


def _add_rule(name: str) -> None:
    expressions, query = RULES_SQL[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rules.RULES[name](context(spark, sf_dir))
        return found.select("record_ref", "verdict", "reason", listed("refs").alias("refs"), F.when(F.col("verdict") == "conflict", shown()).alias("observed"))

    entry(_with(expressions) + f" SELECT record_ref, verdict, reason, array_to_string(refs, ',') AS refs, observed FROM ({query})", "rule_" + name.lower().replace("-", ""))(run)


for _name in sorted(rules.RULES):
    _add_rule(_name)


@entry(HEAD + "SELECT contact_ref AS source_ref, student_ref AS resolved_ref, method FROM contact_links UNION ALL SELECT payment_ref, student_ref, method FROM payment_links UNION ALL SELECT payment_ref, enrollment_ref, method FROM payment_enrollments UNION ALL SELECT deal_ref, anchor, 'D2' FROM deal_persons")
def er_links(spark, sf_dir):
    """All links: contacts and payments to students, payments to enrollments, deals to persons."""
    er = context(spark, sf_dir).er
    deals = er.deal_persons.join(er.persons.select("person_key", "anchor_ref"), "person_key").select("deal_ref", "anchor_ref", F.lit("D2").alias("method"))
    every = er.contact_links.select("contact_ref", "student_ref", "method").union(er.payment_links.select("payment_ref", "student_ref", "method")).union(er.payment_enrollments.select("payment_ref", "enrollment_ref", "method")).union(deals)
    return every.toDF("source_ref", "resolved_ref", "method")


@entry(HEAD + "SELECT anchor AS anchor_ref, array_to_string(identity_refs, ',') AS identity_refs, contact_count, payment_count, enrollment_count, deal_count, contact_ref AS survived_contact_ref, enrollment_ref AS survived_enrollment_ref, deal_ref AS survived_deal_ref FROM persons")
def er_persons(spark, sf_dir):
    p = context(spark, sf_dir).er.persons
    return p.select("anchor_ref", listed("identity_refs").alias("identity_refs"), "contact_count", "payment_count", "enrollment_count", "deal_count", "survived_contact_ref", "survived_enrollment_ref", "survived_deal_ref")


@entry(HEAD + "SELECT source_ref, key_class, resolved_ref FROM candidates")
def er_candidates(spark, sf_dir):
    return context(spark, sf_dir).er.candidates.select("source_ref", "key_class", "resolved_ref")


@entry(HEAD + """
, k AS (SELECT email_norm AS home, 0 AS rank, source_ref AS ref FROM w_students WHERE email_norm IS NOT NULL),
m AS (SELECT * FROM k UNION ALL SELECT email_norm, 1, source_ref FROM w_contacts WHERE email_norm IN (SELECT home FROM k))
SELECT home AS household_key, min(ref) FILTER (WHERE rank = 0) AS anchor, CAST(count(*) FILTER (WHERE rank = 0) AS INTEGER) AS children, string_agg(ref, ',' ORDER BY rank, ref) AS members FROM m GROUP BY 1
""")
def full_households(spark, sf_dir):
    """Students by primary guardian, then the contacts with that address."""
    st = context(spark, sf_dir).staged
    return households(st.students, st.contacts).select("household_key", "anchor", "children", listed("members").alias("members"))


@entry(HEAD + """
, ways AS (SELECT student_ref AS anchor, method FROM contact_links UNION SELECT student_ref, method FROM payment_links UNION SELECT l.student_ref, e.method FROM payment_enrollments e JOIN payment_links l USING (payment_ref) UNION SELECT anchor, 'D2' FROM deal_persons),
w AS (SELECT anchor, string_agg(method, ',' ORDER BY method) AS link_methods FROM ways GROUP BY 1),
m AS (SELECT l.student_ref, bool_or(payment_status = 'paid') AS paid, string_agg(p.source_ref || '/' || coalesce(payment_type, '~') || '/' || payment_status || '/' || amount_cents, ',' ORDER BY p.source_ref) AS payments FROM payment_links l JOIN w_payments p ON p.source_ref = l.payment_ref GROUP BY 1)
SELECT p.anchor AS anchor_ref, array_to_string(entity_refs, ',') AS entity_refs, array_to_string(identity_refs, ',') AS identity_refs, array_to_string(list_sort(list_distinct([split_part(r, ':', 1) FOR r IN entity_refs])), ',') AS sources, x.email_norm AS household_key,
  'appdb.enrollment.program=' || coalesce(e.program_norm, '~') || ';appdb.enrollment.stage=' || coalesce(e.stage_funnel, '~') || ';appdb.student.first_name=' || coalesce(x.first_norm, '~') || ';appdb.student.grade=' || coalesce(x.grade_norm, '~') || ';appdb.student.last_name=' || coalesce(x.last_norm, '~')
    || ';appdb.student.status=' || coalesce(x.status_norm, '~') || ';crm.contact.email=' || coalesce(c.email_norm, '~') || ';crm.contact.lifecycle_stage=' || coalesce(c.lifecycle_norm, '~') || ';crm.deal.stage=' || coalesce(d.stage_norm, '~') AS survived,
  enrollment_count > 0 AS registered, coalesce(m.paid, false) AS paid, e.stage_funnel, coalesce(m.payments, '') AS payments, array_to_string(list_filter(entity_refs, lambda r: starts_with(r, 'crm:deal:')), ',') AS deal_refs, coalesce(link_methods, '') AS link_methods
FROM persons p LEFT JOIN w ON w.anchor = p.anchor LEFT JOIN m ON m.student_ref = p.student_ref LEFT JOIN w_students x ON x.source_ref = p.student_ref LEFT JOIN w_contacts c ON c.source_ref = p.contact_ref LEFT JOIN w_deals d ON d.source_ref = p.deal_ref LEFT JOIN w_enrollments e ON e.source_ref = p.enrollment_ref
""")
def canonical_views(spark, sf_dir):
    """The fourteen fields of each person's view; keys follow from the anchor and are left out."""
    ctx = context(spark, sf_dir)
    v = views(ctx.staged, ctx.er)
    paid = F.transform("payments", lambda p: F.concat_ws("/", p["ref"], F.coalesce(p["type"], F.lit("~")), p["status"], p["amount_cents"].cast("string")))
    return v.select("anchor_ref", *(listed(k).alias(k) for k in ("entity_refs", "identity_refs", "sources", "deal_refs", "link_methods")), "household_key", shown("survived").alias("survived"), "registered", "paid", "stage_funnel", F.array_join(paid, ",").alias("payments"))


# --- the conflict set ---------------------------------------------------------------

_VERDICTS: dict[tuple, DataFrame] = {}


def joined_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct conflicts of all rules but those of payments set apart, with a number each; written rule by rule, once a session and folder. Of contradictory conflicts all stay, as in the SQL."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VERDICTS:
        ctx = context(spark, sf_dir)
        ctx = rules.Context(replace(ctx.staged, payments=near(ctx.staged.payments).drop("apart")), ctx.er, conflicts_only=True)
        ctx.compared = stored(rules.comparisons(ctx).select("source_ref", "identity_refs", "contact_count", "pairs"), "compared")
        parts = []
        for i, (name, rule) in enumerate(sorted(rules.RULES.items())):
            found = c.distinct(rule(ctx).withColumn("rule_id", F.lit(name)))
            parts.append(stored(found.withColumn("number", F.monotonically_increasing_id() + F.lit(i << 55)), "conflicts"))
        _VERDICTS[key] = c.union(parts)
    return _VERDICTS[key]


def apart_conflicts(spark: SparkSession, sf_dir: str, survivors: bool) -> DataFrame:
    """The conflicts of payments set apart: each names its payment alone, which occurs once and in no other conflict.

    They are read off the payments whenever they are asked for. Every such payment has a C2, so that by precedence
    no C12 of theirs survives.
    """
    found = rules.apart(context(spark, sf_dir))
    return c.of_verdicts(found["R-002"] if survivors else c.union(list(found.values())))


def surviving_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return c.surviving(joined_conflicts(spark, sf_dir), "number"), apart_conflicts(spark, sf_dir, True)


def surviving_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, alone = surviving_parts(spark, sf_dir)
    return kept.drop("number").unionByName(alone)


def _conflicts_sql() -> str:
    """raw: (type, refs, observed) of all rules; then the survivors of each precedence rule, the last one as kept."""
    parts, every = [], []
    for name in sorted(RULES_SQL)[1:]:
        expressions, query = RULES_SQL[name]
        if name == "R-013":
            expressions = expressions.replace(_ATTRIBUTED + ", ", "", 1)  # as in R-012
        if expressions and name != "R-014":  # its sides are those of R-006
            parts.append(expressions)
        short = name.replace("-", "").lower()
        kind = "C" + str(int(name[2:]))
        parts.append(f"{short} AS ({query})")
        paths = f"(SELECT paths FROM decided d WHERE d.source_ref = {short}.record_ref)" if name in ("R-006", "R-014") else "CAST([] AS VARCHAR[])"
        every.append(f"SELECT DISTINCT '{kind}' AS type, refs, observed, {paths} AS paths FROM {short} WHERE verdict = 'conflict'")
    sql = HEAD + ", " + ", ".join(parts) + ", raw AS (" + " UNION ALL ".join(every) + ")"
    wholly = ", ".join(f"'{p}'" for n, a, b, _ in dims.COMPARED if n in dims.WHOLLY_SENSITIVE for p in (a, b))
    sql += f", both_types AS (SELECT refs, bool_and(len(list_filter(paths, lambda p: p NOT IN ({wholly}))) = 0) AS wholly FROM raw WHERE type IN ('C6', 'C14') GROUP BY 1 HAVING count(DISTINCT type) = 2)"
    sql += ", k1 AS (SELECT * FROM raw r WHERE NOT EXISTS (SELECT 1 FROM both_types b WHERE b.refs = r.refs AND r.type = CASE WHEN b.wholly THEN 'C6' ELSE 'C14' END))"
    for number, winner, losers, prefix in dims.PRECEDENCE[1:]:
        quoted = ", ".join(f"'{x}'" for x in losers)
        like = f" AND starts_with(ref, '{prefix}')" if prefix else ""
        sql += f", f{number} AS (SELECT DISTINCT ref FROM (SELECT unnest(refs) AS ref FROM k{number - 1} WHERE type = '{winner}') WHERE true{like}), h{number} AS (SELECT DISTINCT type, refs FROM (SELECT type, refs, unnest(refs) AS ref FROM k{number - 1} WHERE type IN ({quoted})) WHERE ref IN (SELECT ref FROM f{number}))"
        sql += f", k{number} AS (SELECT * FROM k{number - 1} k WHERE NOT EXISTS (SELECT 1 FROM h{number} h WHERE h.type = k.type AND h.refs = k.refs))"
    return sql + f", kept AS (SELECT * FROM k{dims.PRECEDENCE[-1][0]})"


CONFLICTS_SQL = _conflicts_sql()


@entry(CONFLICTS_SQL + " SELECT type, array_to_string(refs, ',') AS refs, array_to_string(paths, ',') AS fields, observed FROM raw")
def conflict_set(spark, sf_dir):
    """The distinct conflicts of all rules."""
    every = joined_conflicts(spark, sf_dir).drop("number").unionByName(apart_conflicts(spark, sf_dir, False))
    return every.select("type", listed("refs").alias("refs"), listed("fields").alias("fields"), shown().alias("observed"))


@entry(CONFLICTS_SQL + " SELECT type, array_to_string(refs, ',') AS refs FROM kept")
def surviving_conflicts(spark, sf_dir):
    """What the precedence rules leave."""
    return surviving_frame(spark, sf_dir).select("type", listed("refs").alias("refs"))


@entry("SELECT CAST(NULL AS VARCHAR) AS problem, CAST(NULL AS VARCHAR) AS conflict_id WHERE false")
def precedence_checks(spark, sf_dir):
    """Rules 9 to 11 hold of the output: no conflict twice, nothing left that a winner suppresses. Any row is a fault."""
    kept, alone = surviving_parts(spark, sf_dir)
    every = c.identified(stored(kept.drop("number"), "surviving").unionByName(alone))
    return r.broken_precedence(every, [x for x in dims.PRECEDENCE if x[0] > 1], "fingerprint")


_BASES = ", ".join(f"('{k}', {v})" for k, v in dims.BASES.items())
_HOLES = "regexp_matches(coalesce(observed, ''), '=(~)?(;|$)')"
SCORES_SQL = CONFLICTS_SQL + f"""
, flat AS (SELECT type, refs, unnest(refs) AS ref FROM kept),
keys AS (SELECT f.type, f.refs, bool_or(key_class = 'ext') AS ext, bool_or(key_class = 'email') AS email, bool_or(key_class = 'namedob') AS namedob FROM flat f JOIN candidates n ON n.source_ref = f.ref WHERE list_contains(f.refs, n.resolved_ref) GROUP BY 1, 2),
classes AS (SELECT source_ref, key_class, list(resolved_ref) AS found FROM candidates GROUP BY 1, 2),
split AS (SELECT source_ref FROM (SELECT source_ref, count(*) AS n, list_reduce(list(found), lambda a, b: list_intersect(a, b)) AS common FROM classes GROUP BY 1) WHERE n > 1 AND len(common) = 0),
torn AS (SELECT DISTINCT type, refs FROM flat WHERE ref IN (SELECT source_ref FROM split)),
b AS (SELECT * FROM (VALUES {_BASES}) AS b(type, base)),
signals AS (SELECT k.type, k.refs, base, ext, email, namedob, len(paths) / 2 AS fields, t.type IS NOT NULL AS torn, len(list_distinct([split_part(r, ':', 1) FOR r IN k.refs])) < 2 AS single, {_HOLES} AS hole,
  CASE k.type WHEN 'C1' THEN NOT regexp_matches(observed, '(paid_payment_refs|enrollment_ref)=(~)?(;|$)') WHEN 'C11' THEN NOT regexp_matches(observed, '(amount_cents|occurred_at_delta_seconds)=(~)?(;|$)') WHEN 'C12' THEN NOT regexp_matches(observed, 'amount_cents=(~)?(;|$)') WHEN 'C13' THEN NOT regexp_matches(observed, '(refunded_at|enrollment.updated_at)=(~)?(;|$)') ELSE false END AS money
  FROM kept k JOIN b USING (type) LEFT JOIN keys y ON y.type = k.type AND y.refs = k.refs LEFT JOIN torn t ON t.type = k.type AND t.refs = k.refs)
"""


@entry(SCORES_SQL + """
SELECT type, array_to_string(refs, ',') AS refs, concat_ws(',', CASE WHEN hole THEN 'null_observed_value' END, CASE WHEN single THEN 'single_source' END, CASE WHEN torn THEN 'contradictory_match_keys' END) AS partial,
  CAST(greatest(0, least(1, base + CASE WHEN ext THEN 0.35 ELSE 0 END + CASE WHEN email THEN 0.25 ELSE 0 END + CASE WHEN namedob THEN 0.20 ELSE 0 END + CASE WHEN money THEN 0.10 ELSE 0 END) - CAST(fields AS INTEGER) * 0.10 - CASE WHEN hole OR single OR torn THEN 0.15 ELSE 0 END) AS DECIMAL(5,4)) AS confidence FROM signals
""")
def conflict_scores(spark, sf_dir):
    """Evidence and confidence of the surviving conflicts."""
    kept, alone = surviving_parts(spark, sf_dir)
    st = context(spark, sf_dir).staged
    kept = c.identified(stored(kept, "surviving"))
    shown_ = [c.scored(x).select("type", listed("refs").alias("refs"), listed("partial").alias("partial"), "confidence") for x in (c.evidence_of_records(kept, st.contacts, st.students, "number"), c.evidence_alone(c.identified(alone)))]
    return c.union(shown_)


_INCRM = "list_sort(list_transform(list_filter(paths, lambda p: {}), lambda p: CASE WHEN starts_with(p, 'crm.') THEN '0' ELSE '1' END || p))[1][2:]"
_IN = lambda names: "p IN (" + ", ".join(f"'{x}'" for x in sorted(names)) + ")"
_ROWS = {p for n, a, b, _ in dims.COMPARED if n in dims.WHOLLY_SENSITIVE for p in (a, b)}
_TWINS = "CASE target " + " ".join(f"WHEN '{a}' THEN '{b}' WHEN '{b}' THEN '{a}'" for _, a, b, _ in dims.COMPARED) + " END"
_STAGE_OF = {v: [k for k, x in dims.DEAL_STAGES.items() if x == v] for v in set(dims.DEAL_STAGES.values())}
_LIFE_OF = {v: [k for k, x in dims.LIFECYCLES.items() if x == v] for v in set(dims.LIFECYCLES.values()) if v}
_unique = lambda table: "CASE seen " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in table.items() if len(v) == 1) + " END"
_FIXED = ", ".join(f"('{k}', '{v}')" for k, v in dims.FIX_TARGETS.items())


@entry(CONFLICTS_SQL + f"""
, fixed AS (SELECT * FROM (VALUES {_FIXED}) AS f(type, field)),
aimed AS (SELECT k.*, coalesce(CASE WHEN k.type = 'C6' THEN coalesce({_INCRM.format(_IN(_ROWS))}, {_INCRM.format(_IN(dims.AUTO_APPLY))}) WHEN k.type = 'C14' THEN {_INCRM.format(_IN(dims.SENSITIVE))} END, field) AS target FROM kept k LEFT JOIN fixed USING (type)),
looked AS (SELECT *, CASE WHEN type IN ('C6', 'C14') THEN nullif(nullif(regexp_extract(';' || observed || ';', ';' || replace({_TWINS}, '.', '[.]') || '=([^;]*);', 1), ''), '~') END AS seen, regexp_extract(observed, 'student_guardian_email_norms=([^;]*)', 1) AS mails FROM aimed),
valued AS (SELECT *, CASE WHEN type = 'C4' THEN CASE WHEN mails NOT LIKE '%,%' AND mails NOT IN ('', '~') THEN mails END WHEN target = 'crm.deal.stage' THEN {_unique(_STAGE_OF)} WHEN target = 'crm.contact.lifecycle_stage' THEN {_unique(_LIFE_OF)} ELSE seen END AS value FROM looked)
SELECT type, array_to_string(refs, ',') AS refs, target, value, value IS NOT NULL OR type = 'C9' AS derivable,
  CASE WHEN type = 'C14' THEN 'hold' WHEN target IS NULL THEN 'escalated' WHEN target IN ({", ".join(f"'{x}'" for x in sorted(dims.SENSITIVE))}) THEN 'hold' WHEN target IN ({", ".join(f"'{x}'" for x in sorted(dims.AUTO_APPLY))}) THEN 'eligible' ELSE 'hold' END AS disposition FROM valued
""")
def fix_targets(spark, sf_dir):
    """Target, value and disposition of the fix of each surviving conflict."""
    return c.targeted(surviving_frame(spark, sf_dir)).select("type", listed("refs").alias("refs"), "target", "value", "derivable", "disposition")


@entry(CONFLICTS_SQL + " SELECT 'C' || i AS type, count(k.type) AS n FROM range(1, 15) AS t(i) LEFT JOIN kept k ON k.type = 'C' || i GROUP BY 1")
def counts_by_type(spark, sf_dir):
    """How many conflicts of each of the fourteen types survive, zeros too."""
    return c.counts_by_type(spark, surviving_frame(spark, sf_dir))


@entry(HEAD + """
SELECT (SELECT count(*) FROM persons) AS persons, (SELECT count(*) FROM contact_links) + (SELECT count(*) FROM payment_links) + (SELECT count(*) FROM payment_enrollments) + (SELECT count(*) FROM deal_persons) AS links,
  (SELECT count(*) FROM person_refs) AS refs, (SELECT count(*) FROM candidates) AS candidates, (SELECT count(*) FROM w_contacts) + (SELECT count(*) FROM w_students) + (SELECT count(*) FROM w_deals) + (SELECT count(*) FROM w_enrollments) + (SELECT count(*) FROM w_payments) AS records
""")
def count_bundle(spark, sf_dir):
    """The counts that a run reports about its identity layer, in one row."""
    ctx = context(spark, sf_dir)
    parts = {"persons": [ctx.er.persons], "links": [ctx.er.contact_links, ctx.er.payment_links, ctx.er.payment_enrollments, ctx.er.deal_persons], "refs": [ctx.er.person_refs], "candidates": [ctx.er.candidates], "records": [getattr(ctx.staged, n) for n in ("contacts", "students", "deals", "enrollments", "payments")]}
    counted = None
    for name, frames in parts.items():
        for f in frames:
            one = f.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            counted = one if counted is None else counted.unionByName(one)
    return counted.groupBy().pivot("name", list(parts)).agg(F.sum("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in LIBRARY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in LIBRARY.items() if q}
