"""The fifteen invariants. Each stamps every record in its scope with a verdict.

A rule returns record_ref, entity_type, verdict (ok, conflict, unchecked), reason and,
for conflicts, type, refs, fields and observed values. Rules are plans over one
context and never filter their scope: a join that finds nothing leaves nulls, and the
verdict is decided by CASE.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import dims
from . import relational as r
from ..functions import scalars as s
from .resolve import Resolved, Staged, near, reached

RULES: dict[str, Callable[[Context], DataFrame]] = {}


@dataclass
class Context:
    staged: Staged
    er: Resolved
    conflicts_only: bool = False  # rows that can't be in conflict may be left out of joins
    compared: DataFrame | None = None  # ``comparisons``, if they are written

    @property
    def spark(self):
        return self.staged.contacts.sparkSession


def rule(number: int):
    def add(f):
        RULES[f"R-{number:03d}"] = f
        return f

    return add


def observed(**values: Column) -> Column:
    """Map of observed values as text; two underscores in a name are a dot. Lists are canonical text."""
    key = lambda k: k.replace("__", ".")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(key(k)), s.canon(v, "array") if key(k) in dims.LIST_VALUES else v.cast("string"))])


def utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stamped(df: DataFrame, entity: str, fires: Column, kind: str, refs: Column, values: Column, unchecked: Column | None = None, fields: Column | None = None) -> DataFrame:
    """The common output; ``unchecked``: the reason, or null."""
    fires = F.coalesce(fires, F.lit(False))
    reason = F.when(~fires, unchecked) if unchecked is not None else F.lit(None).cast("string")
    only = lambda c: F.when(fires, c)
    return df.select(
        F.col("source_ref").alias("record_ref"),
        F.lit(entity).alias("entity_type"),
        F.when(fires, "conflict").when(reason.isNotNull(), "unchecked").otherwise("ok").alias("verdict"),
        reason.alias("reason"),
        only(F.lit(kind)).alias("type"),
        only(F.array_sort(F.array_distinct(refs))).alias("refs"),
        only(fields if fields is not None else F.array().cast("array<string>")).alias("fields"),
        only(values).alias("observed"),
    )


def persons_of_students(ctx: Context) -> DataFrame:
    p = ctx.er.persons.select("student_ref", "person_key", "identity_refs", "contact_count", "payment_count", "enrollment_count", "deal_count", "survived_contact_ref", "survived_enrollment_ref", "survived_deal_ref")
    return ctx.staged.students.join(p.where("student_ref is not null").withColumnRenamed("student_ref", "source_ref"), "source_ref", "left")


def paid_by_student(ctx: Context) -> DataFrame:
    """student_ref, paid: refs of its paid payments."""
    pays = ctx.staged.payments.where("payment_status = 'paid'")
    return ctx.er.payment_links.join(pays.select(F.col("source_ref").alias("payment_ref")), "payment_ref").groupBy("student_ref").agg(F.array_sort(F.collect_set("payment_ref")).alias("paid"))


def spread(payments: DataFrame, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """joined(payments that a student may be found for), and the rest with nulls for what joins add: they stay where they are."""
    if "apart" not in payments.columns:
        return joined(payments)
    return joined(near(payments)).unionByName(payments.where("apart"), allowMissingColumns=True)


def holders(ctx: Context) -> DataFrame:
    """enrollment ref as source_ref, person_key and identity_refs of the person that it belongs to."""
    people = ctx.er.persons.select("person_key", "identity_refs")
    return ctx.er.person_refs.where(F.col("ref").startswith("appdb:enrollment:")).withColumnRenamed("ref", "source_ref").join(people, "person_key")


@rule(0)
def no_rule_in_scope(ctx):
    none = F.lit(None).cast("array<string>")
    return stamped(ctx.staged.deals, "deal", F.lit(False), "C0", none, F.create_map().cast("map<string,string>"), F.lit("no_rule_in_scope"))


@rule(1)
def paid_but_no_deal(ctx):
    j = persons_of_students(ctx).join(paid_by_student(ctx), F.col("student_ref") == F.col("source_ref"), "left")
    fires = (F.size(F.coalesce("paid", F.array().cast("array<string>"))) > 0) & (F.col("enrollment_count") > 0) & (F.col("deal_count") == 0)
    return stamped(j, "student", fires, "C1", F.col("identity_refs"), observed(paid_payment_refs=F.col("paid"), enrollment_ref=F.col("survived_enrollment_ref"), d2_deal_count=F.col("deal_count")))


@rule(2)
def payment_with_no_person(ctx):
    return _unlinked(spread(ctx.staged.payments, lambda p: p.join(ctx.er.payment_links.withColumnRenamed("payment_ref", "source_ref"), "source_ref", "left")))


def _unlinked(j: DataFrame) -> DataFrame:
    return stamped(j, "payment", F.col("student_ref").isNull(), "C2", F.array("source_ref"), observed(payer_email_norm=F.col("email_norm"), external_ref=F.col("external_ref"), metadata_name_pair_present=F.col("name_pair")))


@rule(3)
def duplicate_by_email(ctx):
    c = ctx.staged.contacts
    close = lambda a, b: F.col(f"{a}.dob_norm").isNull() | F.col(f"{b}.dob_norm").isNull() | (F.col(f"{a}.dob_norm") == F.col(f"{b}.dob_norm"))
    pairs = r.unordered_pairs(c, ["email_norm", "first_norm", "last_norm"], "source_ref", close)
    both = pairs.select(F.explode(F.array("left_id", "right_id")).alias("source_ref"), "left_id", "right_id", F.col("l.dob_norm").alias("dob_a"), F.col("r.dob_norm").alias("dob_b"))
    j = c.join(both, "source_ref", "left")
    return stamped(j, "contact", F.col("left_id").isNotNull(), "C3", F.array("left_id", "right_id"), observed(email_norm=F.col("email_norm"), first_norm=F.col("first_norm"), last_norm=F.col("last_norm"), dob_norm_a=F.col("dob_a"), dob_norm_b=F.col("dob_b")))


@rule(4)
def different_emails(ctx):
    st = ctx.staged
    links = ctx.er.contact_links.withColumnRenamed("contact_ref", "source_ref")
    homes = st.students.select(F.col("source_ref").alias("student_ref"), F.array_sort(F.array_distinct(F.array_compact(F.array("email_norm", "guardian2_email_norm")))).alias("guardian_mails"))
    people = ctx.er.persons.select("student_ref", "identity_refs")
    j = st.contacts.join(links, "source_ref", "left").join(homes, "student_ref", "left").join(people, "student_ref", "left")
    fires = (F.col("method") == "L3") & ~F.coalesce(F.array_contains("guardian_mails", F.col("email_norm")), F.lit(False))
    return stamped(j, "contact", fires, "C4", F.col("identity_refs"), observed(contact_email_norm=F.col("email_norm"), student_guardian_email_norms=F.col("guardian_mails"), link_method=F.col("method")))


@rule(5)
def one_source_only(ctx):
    fires = (F.col("status_funnel") == "enrolled") & (F.col("contact_count") == 0) & (F.col("payment_count") == 0)
    return stamped(persons_of_students(ctx), "student", fires, "C5", F.col("identity_refs"), observed(status_funnel=F.col("status_funnel"), linked_contact_count=F.col("contact_count"), attributed_payment_count=F.col("payment_count")))


#: For each compared field: the columns with its mapped and its raw value, on either side.
SIDES = {
    "name_first": ("c_first_norm", "c_first_name", "first_norm", "first_name"),
    "name_last": ("c_last_norm", "c_last_name", "last_norm", "last_name"),
    "dob": ("c_dob_norm", "c_dob", "dob_norm", "dob"),
    "grade": ("c_grade_norm", "c_grade", "grade_norm", "grade"),
    "stage": ("d_stage_funnel", "d_stage", "e_stage_funnel", "e_stage"),
    "lifecycle": ("c_lifecycle_funnel", "c_lifecycle_stage", "status_funnel", "status"),
}


def comparisons(ctx: Context) -> DataFrame:
    """Students with ``pairs``: for each compared field both mapped values, and why it can't be compared if it can't."""
    if ctx.compared is not None:
        return ctx.compared
    st = ctx.staged
    side = lambda df, kind, short, names: df.select(F.col("source_ref").alias(f"survived_{kind}_ref"), *(F.col(n).alias(f"{short}_{n}") for n in names))
    j = persons_of_students(ctx)
    if ctx.conflicts_only:
        j = j.where("contact_count > 0").select("source_ref", "identity_refs", "contact_count", "survived_contact_ref", "survived_deal_ref", "survived_enrollment_ref", *(c for n, cols in SIDES.items() if n != "stage" for c in cols[2:]))
    j = j.join(side(st.contacts, "contact", "c", ("first_norm", "first_name", "last_norm", "last_name", "dob_norm", "dob", "grade_norm", "grade", "lifecycle_funnel", "lifecycle_stage")), "survived_contact_ref", "left")
    j = j.join(side(st.deals, "deal", "d", ("stage_funnel", "stage")), "survived_deal_ref", "left")
    j = j.join(side(st.enrollments, "enrollment", "e", ("stage_funnel", "stage")), "survived_enrollment_ref", "left")
    each = []
    for n, left, right, why in dims.COMPARED:
        a, raw_a, b, raw_b = (F.col(c).cast("string") for c in SIDES[n])
        lost = F.when((a.isNull() & raw_a.isNull()) | (b.isNull() & raw_b.isNull()), "missing_operand").otherwise(why)
        each.append(F.struct(F.lit(n).alias("logical"), F.lit(left).alias("left_path"), F.lit(right).alias("right_path"), a.alias("a"), b.alias("b"), F.when(a.isNull() | b.isNull(), lost).alias("why")))
    return j.withColumn("pairs", F.array(*each))


def _disagreement(ctx: Context, wholly: bool) -> DataFrame:
    j = comparisons(ctx)
    j = j.withColumn("differ", F.filter("pairs", lambda p: p["why"].isNull() & (p["a"] != p["b"])))
    lost = F.transform("pairs", lambda p: p["why"])
    # Nothing could be compared: the gravest reason stands.
    none = F.when(~F.exists("pairs", lambda p: p["why"].isNull()), F.when(F.array_contains(lost, "missing_operand"), "missing_operand").when(F.array_contains(lost, "unparseable_value"), "unparseable_value").otherwise("unmapped_enum"))
    paths = F.array_sort(F.flatten(F.transform("differ", lambda p: F.array(p["left_path"], p["right_path"]))))
    sensitive = F.forall("differ", lambda p: p["logical"].isin(*dims.WHOLLY_SENSITIVE))
    fires = (F.col("contact_count") > 0) & (F.size("differ") > 0) & (sensitive if wholly else ~sensitive)
    values = F.map_from_entries(F.flatten(F.transform("differ", lambda p: F.array(F.struct(p["left_path"].alias("key"), p["a"].alias("value")), F.struct(p["right_path"].alias("key"), p["b"].alias("value"))))))
    return stamped(j, "student", fires, "C14" if wholly else "C6", F.col("identity_refs"), values, none, paths)


@rule(6)
def field_disagreement(ctx):
    return _disagreement(ctx, False)


@rule(7)
def enrolled_but_unpaid(ctx):
    st = ctx.staged
    pays = st.payments.where(F.col("payment_status").eqNullSafe("paid") & F.col("payment_type").isin("deposit", "tuition")).select(F.col("source_ref").alias("payment_ref"))
    paid = ctx.er.payment_enrollments.join(pays, "payment_ref").groupBy(F.col("enrollment_ref").alias("source_ref")).agg(F.count("*").alias("n_paid"))
    j = st.enrollments.join(holders(ctx), "source_ref", "inner" if ctx.conflicts_only else "left").join(paid, "source_ref", "left")
    fires = F.col("stage_funnel").isin(*dims.PAID_STAGES) & F.col("identity_refs").isNotNull() & F.col("n_paid").isNull()
    values = observed(enrollment__stage_funnel=F.col("stage_funnel"), enrollment__deposit_paid_at=utc(F.col("deposit_paid_at")), paid_deposit_payment_count=F.coalesce("n_paid", F.lit(0)))
    return stamped(j, "enrollment", fires, "C7", F.array_append("identity_refs", F.col("source_ref")), values)


@rule(8)
def dropped_sibling(ctx):
    j = persons_of_students(ctx).withColumn("household", F.col("email_norm"))  # the primary guardian's address alone
    e = ctx.staged.enrollments.select(F.col("source_ref").alias("survived_enrollment_ref"), F.col("stage_funnel").alias("e_stage"))
    j = j.join(e, "survived_enrollment_ref", "left")
    w = W.partitionBy("household")
    able = (F.col("grade_ord") >= dims.GRADE_FLOOR) & ~F.coalesce(F.col("status_norm") == "withdrawn", F.lit(False)) & ~F.coalesce(F.col("e_stage").isin("withdrawn", "refunded"), F.lit(False))
    able = F.coalesce(able, F.lit(False)) & F.col("household").isNotNull()
    j = j.withColumn("able", able).withColumns({"members": F.count("*").over(w), "n_able": F.count_if("able").over(w), "no_crm": F.count_if(F.col("able") & (F.col("contact_count") == 0)).over(w), "no_pay": F.count_if(F.col("able") & (F.col("payment_count") == 0)).over(w)})
    source = F.when((F.col("no_crm") == 1) & (F.col("no_pay") == 1), None).when(F.col("no_crm") == 1, "crm").when(F.col("no_pay") == 1, "payments")
    missing = ((source == "crm") & (F.col("contact_count") == 0)) | ((source == "payments") & (F.col("payment_count") == 0))
    fires = F.col("able") & (F.col("members") >= 2) & (F.col("n_able") >= 2) & missing
    return stamped(j, "student", fires, "C8", F.col("identity_refs"), observed(household_key=F.col("household"), dropped_source=source, eligible_member_count=F.col("n_able")))


@rule(9)
def stale_pointer(ctx):
    st, er = ctx.staged, ctx.er
    names = er.deal_persons.select("deal_id", "person_key").distinct().join(er.persons.select("person_key", "anchor_ref"), "person_key").groupBy("deal_id").agg(F.array_sort(F.collect_list("anchor_ref")).alias("anchors"))
    mine = er.deal_persons.select(F.col("deal_id").alias("crm_deal_id"), "person_key", F.lit(True).alias("mine")).distinct()
    deals = st.deals.select(F.col("deal_id").alias("crm_deal_id"), F.lit(True).alias("there")).distinct()
    j = st.enrollments.join(holders(ctx), "source_ref", "inner" if ctx.conflicts_only else "left").join(deals, "crm_deal_id", "left").join(names.withColumnRenamed("deal_id", "crm_deal_id"), "crm_deal_id", "left").join(mine, ["crm_deal_id", "person_key"], "left")
    known = F.col("crm_deal_id").isNotNull() & F.col("identity_refs").isNotNull()
    fires = known & (F.col("there").isNull() | (F.col("anchors").isNotNull() & F.col("mine").isNull()))
    lost = F.when(known & F.col("there").isNotNull() & F.col("anchors").isNull(), "deal_unresolved")
    values = observed(enrollment__crm_deal_id=F.col("crm_deal_id"), deal_present_gen3=F.col("there").isNotNull(), deal_person_refs=F.coalesce("anchors", F.array().cast("array<string>")))
    return stamped(j, "enrollment", fires, "C9", F.array_append("identity_refs", F.col("source_ref")), values, lost)


@rule(10)
def merge_collapsed(ctx):
    g = reached(ctx.staged.contacts, ctx.staged.students).withColumnsRenamed({"ext_least": "ext_ref", "named_least": "named_ref"})
    fires = (F.col("ext_ref") == F.col("ext_most")) & (F.col("named_ref") == F.col("named_most")) & (F.col("ext_ref") != F.col("named_ref"))
    return stamped(ctx.staged.contacts.join(g, "source_ref", "left"), "contact", fires, "C10", F.array("source_ref", "ext_ref", "named_ref"), observed(ext_resolved_ref=F.col("ext_ref"), namedob_resolved_ref=F.col("named_ref"), first_norm=F.col("first_norm"), last_norm=F.col("last_norm"), dob_norm=F.col("dob_norm")))


@rule(11)
def duplicate_payment(ctx):
    linked = lambda p: p.join(ctx.er.payment_links.withColumnRenamed("payment_ref", "source_ref").select("source_ref", "student_ref"), "source_ref", "left")
    keyed = linked(near(ctx.staged.payments)).where("student_ref is not null and amount_cents is not null").select("source_ref", "occurred_at", "student_ref", "amount_cents", F.coalesce("email_norm", F.lit("")).alias("payer"), F.coalesce("payment_type", F.lit("")).alias("kind"))
    pairs = r.interval_pairs(keyed, ["payer", "amount_cents", "kind", "student_ref"], "occurred_at", "source_ref", dims.DUPLICATE_SECONDS)
    both = pairs.select(F.explode(F.array("left_id", "right_id")).alias("source_ref"), "left_id", "right_id", "gap_micros")
    values = observed(payer_email_norm=F.coalesce("email_norm", F.lit("")), amount_cents=F.col("amount_cents"), type=F.coalesce("payment_type", F.lit("")), occurred_at_delta_seconds=F.round(F.col("gap_micros") / 1e6).cast("long"))
    paired = lambda p: linked(p).join(both, "source_ref", "inner" if ctx.conflicts_only else "left")
    return stamped(spread(ctx.staged.payments, paired), "payment", F.col("left_id").isNotNull(), "C11", F.array("left_id", "right_id"), values)


def attributed(ctx: Context, payments: DataFrame) -> DataFrame:
    """payments with student_ref, identity_refs and enrollment_ref, where they have them."""
    er = ctx.er
    people = er.payment_links.select(F.col("payment_ref").alias("source_ref"), "student_ref").join(er.persons.select("student_ref", "identity_refs"), "student_ref")
    return payments.join(people, "source_ref", "left").join(er.payment_enrollments.select(F.col("payment_ref").alias("source_ref"), "enrollment_ref"), "source_ref", "left")


@rule(12)
def wrong_amount(ctx):
    e = ctx.staged.enrollments.select(F.col("source_ref").alias("enrollment_ref"), F.col("program_norm").alias("e_program"))
    return _amounts(ctx, spread(ctx.staged.payments, lambda p: attributed(ctx, p).join(e, "enrollment_ref", "left")))


def _amounts(ctx: Context, j: DataFrame) -> DataFrame:
    j = j.withColumn("program", F.coalesce("e_program", "program_norm"))
    fees = dims.fee_schedule(ctx.spark).select(F.col("program_norm").alias("program"), "payment_type", F.col("amount_cents").alias("expected"))
    j = j.join(F.broadcast(fees), ["program", "payment_type"], "left")  # a dozen rows
    why = F.when(F.col("program").isNull(), "enrollment_unattributed").when(F.col("type_norm").isNull() & F.col("payment_type").isNotNull(), "unmapped_enum")
    refs = F.concat(F.coalesce("identity_refs", F.array().cast("array<string>")), F.array("source_ref"))
    return stamped(j, "payment", F.col("amount_cents") != F.col("expected"), "C12", refs, observed(amount_cents=F.col("amount_cents"), expected_amount_cents=F.col("expected"), program_norm=F.col("program"), type=F.col("payment_type")), why)


@rule(13)
def refund_not_reflected(ctx):
    st = ctx.staged
    later = attributed(ctx, near(st.payments)).where("payment_status = 'paid' and student_ref is not null").groupBy("student_ref", "payment_type").agg(F.max("occurred_at").alias("paid_last"))
    e = st.enrollments.select(F.col("source_ref").alias("enrollment_ref"), "stage_funnel", F.col("updated_at").alias("enrolled_at"))
    x = st.students.select(F.col("source_ref").alias("student_ref"), "status", "status_funnel")
    j = spread(st.payments, lambda p: attributed(ctx, p).join(later, ["student_ref", "payment_type"], "left").join(e, "enrollment_ref", "left").join(x, "student_ref", "left"))
    refunded = F.coalesce(F.col("payment_status") == "refunded", F.lit(False))
    superseded = F.coalesce(F.col("paid_last") > F.col("occurred_at"), F.lit(False))
    whole = F.col("student_ref").isNotNull() & F.col("enrollment_ref").isNotNull()
    fires = refunded & whole & ~superseded & (F.col("refunded_at") > F.col("enrolled_at")) & F.col("stage_funnel").isin(*dims.PAID_STAGES) & (F.col("status_funnel") == "enrolled")
    values = observed(refunded_at=utc(F.col("refunded_at")), enrollment__updated_at=utc(F.col("enrolled_at")), enrollment__stage_funnel=F.col("stage_funnel"), student__status=F.col("status"))
    return stamped(j, "payment", fires, "C13", F.concat("identity_refs", F.array("source_ref", "enrollment_ref")), values, F.when(refunded & ~whole, "enrollment_unattributed"))


@rule(14)
def sensitive_disagreement(ctx):
    return _disagreement(ctx, True)


def apart(ctx: Context) -> dict[str, DataFrame]:
    """The verdicts of R-002 and R-012 on payments for which there is no student: plans without a join. R-011 and R-013 need a student."""
    rows = ctx.staged.payments.where("apart")
    none = {c: F.lit(None).cast(kind) for c, kind in (("student_ref", "string"), ("identity_refs", "array<string>"), ("e_program", "string"))}
    return {name: f(rows.withColumns(none)).withColumn("rule_id", F.lit(name)) for name, f in (("R-002", _unlinked), ("R-012", lambda j: _amounts(ctx, j)))}


def gated(verdicts: DataFrame) -> DataFrame:
    """What an absence rule says when a source is incomplete: nothing was checked."""
    blank = {c: F.lit(None).cast(verdicts.schema[c].dataType) for c in ("type", "refs", "fields", "observed")}
    return verdicts.withColumns({"verdict": F.lit("unchecked"), "reason": F.lit("source_incomplete"), **blank}).dropDuplicates(["record_ref"])


def evaluate(ctx: Context, complete: bool = True) -> DataFrame:
    """rule_id and the verdicts of all rules; absence rules are gated unless every slice is complete."""
    found = []
    for name, f in sorted(RULES.items()):
        out = f(ctx)
        found.append((gated(out) if not complete and name in dims.ABSENCE_RULES else out).withColumn("rule_id", F.lit(name)))
    return reduce(DataFrame.unionByName, found)


def report(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("rule_id", "verdict").agg(F.count("*").alias("n"))


def broken_contracts(verdicts: DataFrame) -> DataFrame:
    """Rows that must not exist: a reason without unchecked or the reverse, a conflict without refs or type."""
    return verdicts.where((F.col("reason").isNotNull() != (F.col("verdict") == "unchecked")) | ((F.col("verdict") == "conflict") & (F.col("type").isNull() | (F.size("refs") < 1))))


#: Tokens that rule text may not use: normalisation belongs to staging, and comparisons are three-valued.
FORBIDDEN = ("lower(", "upper(", "trim(", "replace(", "regexp", " ilike ", "is distinct from", "collate unicode")


def lint(sql: str) -> list[str]:
    """Forbidden tokens in rule text, outside comments and literals."""
    import re

    bare = re.sub(r"/\*.*?\*/", " ", re.sub(r"--[^\n]*", " ", sql), flags=re.S)
    bare = re.sub(r"'(?:[^']|'')*'", "''", bare)
    flat = " ".join(bare.lower().split())
    return [x.strip() for x in FORBIDDEN if x in flat]
