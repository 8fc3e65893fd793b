"""Schemas of the five source entities and of the landing table."""

from __future__ import annotations

from pyspark.sql import types as T


def fields(entity: dict) -> list[T.StructField]:
    """Fields of an entity; parsing needs a running session."""
    return T.StructType.fromDDL(entity["schema"]).fields


ENTITIES: dict[tuple[str, str], dict] = {
    ("crm", "contact"): {
        "key": "crm_id",
        "schema": "crm_id string, email string, first_name string, last_name string, lifecycle_stage string, external_id string, dob string, grade string, state string, marketing_consent boolean, created_at string, updated_at string",
        "required": ("crm_id", "email", "first_name", "last_name", "lifecycle_stage", "created_at", "updated_at"),
    },
    ("crm", "deal"): {
        "key": "deal_id",
        "schema": "deal_id string, name string, pipeline string, stage string, amount string, associated_contact_ids array<string>, created_at string, updated_at string",
        "required": ("deal_id", "name", "pipeline", "stage", "amount", "associated_contact_ids", "created_at", "updated_at"),
    },
    ("appdb", "student"): {
        "key": "id",
        "schema": "id string, first_name string, last_name string, dob string, grade string, guardian_email string, status string, guardian2_email string, student_number string, household_id string, enrollment_year string, communication_opt_out boolean, created_at string, updated_at string",
        "required": ("id", "first_name", "last_name", "dob", "grade", "guardian_email", "status", "enrollment_year", "created_at", "updated_at"),
    },
    ("appdb", "enrollment"): {
        "key": "id",
        "schema": "id string, student_id string, program string, stage string, deposit_paid_at string, crm_deal_id string, billing_owner_email string, created_at string, updated_at string",
        "required": ("id", "student_id", "program", "stage", "created_at", "updated_at"),
    },
    ("payments", "payment"): {
        "key": "payment_id",
        "schema": "payment_id string, payer_email string, payer_name string, currency string, type string, status string, amount_cents string, occurred_at string, external_ref string, refunded_at string, metadata struct<student_first_name: string, student_last_name: string, program: string>",
        "required": ("payment_id", "payer_email", "payer_name", "currency", "type", "status", "amount_cents", "occurred_at"),
    },
}
#: Fields that hold timestamps, whole numbers of 32 bits, cents and dollars.
TIMESTAMPS = ("created_at", "updated_at", "occurred_at", "refunded_at", "deposit_paid_at")
INTS, CENTS, DOLLARS = ("enrollment_year",), ("amount_cents",), ("amount",)

RAW = "source_id string, entity_type string, natural_key string, generation int, payload string, row_hash string, load_id string"
LEDGER = "source_id string, entity_type string, generation int, expected_count long, loaded_count long, rejected_count long, complete boolean"
