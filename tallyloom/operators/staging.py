"""Typed staging frames: source fields, normalised twins, ordinals and what could not be mapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..plans import dims


def _unchecked(**pairs: tuple[Column, Column, str]) -> Column:
    """Map of path to reason for values that are there but map to nothing."""
    found = F.array(*(F.when(raw.isNotNull() & (raw != "") & mapped.isNull(), F.struct(F.lit(path).alias("key"), F.lit(why).alias("value"))) for path, (raw, mapped, why) in pairs.items()))
    return F.map_from_entries(F.array_compact(found))


def _common(source: str, entity: str) -> list[Column]:
    return [F.col("generation"), s.ref(source, entity, F.col("natural_key")).alias("source_ref"), F.col("row_hash")]


def contacts(landed: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"p.{c}")
    grade, life, dob = s.norm_enum("grade", p("grade")), s.norm_enum("lifecycle", p("lifecycle_stage")), s.norm_dob(p("dob"))
    return landed.select(
        *_common("crm", "contact"), "p.crm_id", "p.external_id", "p.email", "p.first_name", "p.last_name", "p.dob", "p.grade", "p.lifecycle_stage", p("updated_at").try_cast("timestamp").alias("updated_at"),
        s.norm_email(p("email")).alias("email_norm"), s.norm_name(p("first_name")).alias("first_norm"), s.norm_name(p("last_name")).alias("last_norm"), dob.alias("dob_norm"),
        grade.alias("grade_norm"), s.grade_ord(grade).alias("grade_ord"), s.norm_enum("state", p("state")).alias("state_norm"), life.alias("lifecycle_norm"), dims.lookup(life, dims.LIFECYCLES).alias("lifecycle_funnel"),
        _unchecked(**{"crm.contact.dob": (p("dob"), dob.cast("string"), "unparseable_value"), "crm.contact.grade": (p("grade"), grade, "unmapped_enum"), "crm.contact.lifecycle_stage": (p("lifecycle_stage"), life, "unmapped_enum")}).alias("unchecked_fields"),
    )


def deals(landed: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"p.{c}")
    stage, cents = s.norm_enum("deal_stage", p("stage")), s.cents_from_dollars(p("amount"))
    funnel = dims.lookup(stage, dims.DEAL_STAGES)
    return landed.select(
        *_common("crm", "deal"), "p.deal_id", "p.stage", p("amount").alias("amount_raw"), cents.alias("amount_cents"), s.micro_usd(cents).alias("amount_microusd"), p("associated_contact_ids").alias("contact_ids"),
        stage.alias("stage_norm"), funnel.alias("stage_funnel"), s.funnel_ord(funnel).alias("stage_funnel_ord"), s.norm_enum("program", p("pipeline")).alias("pipeline_norm"),
        _unchecked(**{"crm.deal.stage": (p("stage"), funnel, "unmapped_enum")}).alias("unchecked_fields"),
    )


def students(landed: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"p.{c}")
    grade, status, dob = s.norm_enum("grade", p("grade")), s.norm_enum("status", p("status")), s.norm_dob(p("dob"))
    return landed.select(
        *_common("appdb", "student"), p("id").alias("student_id"), "p.first_name", "p.last_name", "p.dob", "p.grade", "p.status", "p.household_id", "p.student_number",
        s.norm_email(p("guardian_email")).alias("email_norm"), s.norm_email(p("guardian2_email")).alias("guardian2_email_norm"), s.norm_name(p("first_name")).alias("first_norm"), s.norm_name(p("last_name")).alias("last_norm"),
        dob.alias("dob_norm"), grade.alias("grade_norm"), s.grade_ord(grade).alias("grade_ord"), status.alias("status_norm"), dims.lookup(status, dims.STATUSES).alias("status_funnel"),
        _unchecked(**{"appdb.student.dob": (p("dob"), dob.cast("string"), "unparseable_value"), "appdb.student.grade": (p("grade"), grade, "unmapped_enum"), "appdb.student.status": (p("status"), status, "unmapped_enum")}).alias("unchecked_fields"),
    )


def enrollments(landed: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"p.{c}")
    stage = s.norm_enum("stage", p("stage"))
    return landed.select(
        *_common("appdb", "enrollment"), p("id").alias("enrollment_id"), "p.student_id", "p.crm_deal_id", "p.stage", p("deposit_paid_at").try_cast("timestamp").alias("deposit_paid_at"), p("updated_at").try_cast("timestamp").alias("updated_at"), stage.alias("stage_funnel"), s.funnel_ord(stage).alias("stage_funnel_ord"),
        s.norm_enum("program", p("program")).alias("program_norm"), s.norm_email(p("billing_owner_email")).alias("billing_owner_email_norm"),
        _unchecked(**{"appdb.enrollment.stage": (p("stage"), stage, "unmapped_enum")}).alias("unchecked_fields"),
    )


def payments(landed: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"p.{c}")
    cents, kind = p("amount_cents").try_cast("long"), s.norm_enum("payment_type", p("type"))
    return landed.select(
        *_common("payments", "payment"), "p.payment_id", "p.external_ref", p("type").alias("payment_type"), p("status").alias("payment_status"), (p("metadata.student_first_name").isNotNull() & p("metadata.student_last_name").isNotNull()).alias("name_pair"), cents.alias("amount_cents"), s.micro_usd(cents).alias("amount_microusd"), p("occurred_at").try_cast("timestamp").alias("occurred_at"), p("refunded_at").try_cast("timestamp").alias("refunded_at"),
        s.norm_email(p("payer_email")).alias("email_norm"), s.norm_name(p("metadata.student_first_name")).alias("first_norm"), s.norm_name(p("metadata.student_last_name")).alias("last_norm"), s.norm_enum("program", p("metadata.program")).alias("program_norm"),
        kind.alias("type_norm"), s.norm_enum("payment_status", p("status")).alias("status_norm"), _unchecked(**{"payments.payment.type": (p("type"), kind, "unmapped_enum")}).alias("unchecked_fields"),
    )


BUILDERS = {("crm", "contact"): contacts, ("crm", "deal"): deals, ("appdb", "student"): students, ("appdb", "enrollment"): enrollments, ("payments", "payment"): payments}
