"""Committed reference dimensions, as plain tables and as small broadcastable frames."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Vocabularies, lookup tables and weights that results depend on.
GRADE_ORDER = {"PK": -1, "K": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9, "10": 10, "11": 11, "12": 12}
PROGRAMS = ("Lower School", "Middle School", "Upper School", "Summer Academy")
FUNNEL = ("prospect", "applied", "waitlisted", "deposit_paid", "enrolled", "withdrawn", "refunded")
DEAL_STAGES = {"New Lead": "prospect", "Application Submitted": "applied", "Waitlisted": "waitlisted", "Deposit Received": "deposit_paid", "Closed Won": "enrolled", "Closed Lost": "withdrawn", "Refunded": "refunded"}
STATUSES = {"prospect": "prospect", "applied": "applied", "enrolled": "enrolled", "active": "enrolled", "withdrawn": "withdrawn"}
LIFECYCLES = {"subscriber": None, "lead": "prospect", "marketingqualifiedlead": "prospect", "MQL": "prospect", "salesqualifiedlead": "applied", "SQL": "applied", "opportunity": "applied", "customer": "enrolled", "evangelist": None, "other": None}
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri",
    "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio",
    "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont",
    "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
PAYMENT_TYPES = ("fee", "deposit", "tuition")
PAYMENT_STATUSES = ("paid", "refunded")
FEES = {"Lower School": (10000, 50000, 1200000), "Middle School": (10000, 60000, 1400000), "Upper School": (10000, 75000, 1600000), "Summer Academy": (10000, 25000, 300000)}
PAID_STAGES = ("deposit_paid", "enrolled")
DUPLICATE_SECONDS = 600
GRADE_FLOOR = GRADE_ORDER["K"]
#: Observed values that are lists, and those whose presence corroborates an amount or date.
LIST_VALUES = ("paid_payment_refs", "student_guardian_email_norms", "deal_person_refs")
CORROBORATING = {"C1": ("paid_payment_refs", "enrollment_ref"), "C11": ("amount_cents", "occurred_at_delta_seconds"), "C12": ("amount_cents", "expected_amount_cents"), "C13": ("refunded_at", "enrollment.updated_at")}
UNCHECKED = ("missing_operand", "unparseable_value", "unmapped_enum")
#: logical name, contact- or deal-side path, student- or enrollment-side path, reason when a present value can't be mapped.
COMPARED = (
    ("name_first", "crm.contact.first_name", "appdb.student.first_name", "unparseable_value"),
    ("name_last", "crm.contact.last_name", "appdb.student.last_name", "unparseable_value"),
    ("dob", "crm.contact.dob", "appdb.student.dob", "unparseable_value"),
    ("grade", "crm.contact.grade", "appdb.student.grade", "unmapped_enum"),
    ("stage", "crm.deal.stage", "appdb.enrollment.stage", "unmapped_enum"),
    ("lifecycle", "crm.contact.lifecycle_stage", "appdb.student.status", "unmapped_enum"),
)
SENSITIVE = frozenset({
    "crm.contact.first_name", "crm.contact.last_name", "crm.contact.dob", "appdb.student.first_name", "appdb.student.last_name",
    "appdb.student.dob", "appdb.student.student_number", "payments.payment.payer_email", "payments.payment.payer_name",
    "appdb.enrollment.billing_owner_email", "crm.contact.email", "appdb.student.guardian_email", "appdb.student.guardian2_email",
    "appdb.enrollment.stage", "appdb.enrollment.deposit_paid_at", "appdb.student.status", "payments.payment.status", "crm.deal.stage",
    "crm.contact.marketing_consent", "appdb.student.communication_opt_out",
})
AUTO_APPLY = frozenset({"appdb.enrollment.crm_deal_id", "payments.payment.external_ref", "crm.contact.external_id", "crm.contact.grade", "crm.contact.lifecycle_stage"})
#: Default field that a fix of each conflict type writes; the others write none.
FIX_TARGETS = {"C2": "payments.payment.external_ref", "C4": "crm.contact.email", "C6": "crm.contact.grade", "C9": "appdb.enrollment.crm_deal_id", "C14": "crm.contact.first_name"}
CONFLICT_TYPES = tuple(f"C{i}" for i in range(1, 15))
BASES = {"C1": "0.50", "C2": "0.35", "C3": "0.45", "C4": "0.50", "C5": "0.50", "C6": "0.40", "C7": "0.50", "C8": "0.45", "C9": "0.55", "C10": "0.30", "C11": "0.55", "C12": "0.55", "C13": "0.55", "C14": "0.40"}
POSITIVE = {"hard_external_id_agreement": "0.35", "normalized_email_agreement": "0.25", "name_dob_exact": "0.20", "amount_date_corroboration": "0.10"}
NEGATIVE = {"disagreeing_field": "0.10", "partial_evidence": "0.15", "oscillation_observed": "0.25"}
AUTO_APPLY_FLOOR = "0.95"
#: (rule number, winner, losers, prefix of the winner's refs that count or none).
PRECEDENCE = (
    (1, "C14", ("C6",), None),
    (2, "C10", ("C6", "C14", "C4"), "crm:contact:"),
    (3, "C2", ("C12", "C11"), None),
    (4, "C5", ("C1", "C7"), None),
    (5, "C13", ("C7",), None),
    (6, "C9", ("C1",), None),
    (7, "C10", ("C5",), None),
    (8, "C8", ("C1", "C7"), None),
)
ABSENCE_RULES = ("R-001", "R-002", "R-005", "R-007", "R-008", "R-009", "R-013")
#: (table, days, action, table whose rows must be gone first).
RETENTION = (
    ("staging", 30, "purge", None),
    ("link_candidates", 90, "purge", None),
    ("raw_records", 90, "purge", "staging"),
    ("source_generations", 90, "anonymize", None),
    ("field_lineage", 180, "purge", None),
    ("verdict_detail", 180, "anonymize", None),
    ("proposal_events", 365, "purge", None),
    ("proposals", 365, "purge", "proposal_events"),
    ("conflicts", 730, "purge", "proposals"),
    ("audit", 730, "purge", None),
)
TRANSITIONS = (
    ("decide", "pending", "approved"), ("decide", "pending", "rejected"), ("decide", "hold", "approved"), ("decide", "hold", "rejected"),
    ("apply", "approved", "applied"), ("apply", "applied", "rolled_back"),
)


#: Compared fields of which both sides are sensitive.
WHOLLY_SENSITIVE = tuple(n for n, left, right, _ in COMPARED if left in SENSITIVE and right in SENSITIVE)


def money(text: str) -> Decimal:
    return Decimal(text)


def lookup(value: Column, table: dict) -> Column:
    """The entry of a small committed table; null where there is none."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), value)


def fee_schedule(spark: SparkSession) -> DataFrame:
    """program_norm, payment_type, amount_cents: one row each, a dozen in all."""
    rows = [(p, t, c) for p, cents in FEES.items() for t, c in zip(PAYMENT_TYPES, cents, strict=True)]
    return spark.createDataFrame(rows, "program_norm string, payment_type string, amount_cents long")

