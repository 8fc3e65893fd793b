"""A small deterministic set of snapshots with planted conflicts, for tests and trials.

Families are clean by construction; each plant then breaks one thing. Driver-side and
tiny on purpose: it makes fixtures, not load.
"""

from __future__ import annotations

import os
import uuid

from ..plans.dims import FEES
from .sinks import canonical_json

NAMES = ("Ada", "Ben", "Cleo", "Dov", "Elif", "Finn", "Gia", "Hugo", "Iris", "Jon", "Kira", "Leo")
T0 = "2024-03-01T10:00:00Z"


def _student(n: int, house: int, **more) -> dict:
    return {"id": str(uuid.uuid5(uuid.NAMESPACE_OID, f"student-{n}")), "first_name": NAMES[n % len(NAMES)], "last_name": f"Family{house}", "dob": f"2012-{n % 12 + 1:02d}-{n % 27 + 1:02d}", "grade": "5", "guardian_email": f"home{house}@mail.example", "status": "active", "student_number": f"S-{n:06d}", "household_id": f"HH-{house:06d}", "enrollment_year": 2023, "created_at": T0, "updated_at": T0} | more


def _contact(n: int, s: dict, **more) -> dict:
    return {"crm_id": f"CRM-{n:07d}", "email": s["guardian_email"], "first_name": s["first_name"], "last_name": s["last_name"], "lifecycle_stage": "customer", "external_id": s["id"], "dob": s["dob"], "grade": "5th", "state": "ca", "created_at": T0, "updated_at": T0} | more


def _enrollment(n: int, s: dict, deal: str | None, **more) -> dict:
    return {"id": str(uuid.uuid5(uuid.NAMESPACE_OID, f"enrollment-{n}")), "student_id": s["id"], "program": "Lower School", "stage": "enrolled", "crm_deal_id": deal, "created_at": T0, "updated_at": T0} | more


def _deal(n: int, contacts: list[str], **more) -> dict:
    return {"deal_id": f"DEAL-{n:07d}", "name": f"deal {n}", "pipeline": "lower-school", "stage": "Closed Won", "amount": 12000.0, "associated_contact_ids": contacts, "created_at": T0, "updated_at": T0} | more


def _payment(n: int, s: dict, **more) -> dict:
    return {"payment_id": f"pi_{n:07d}", "payer_email": s["guardian_email"], "payer_name": "Payer", "currency": "usd", "type": "tuition", "status": "paid", "amount_cents": FEES["Lower School"][2], "occurred_at": T0, "external_ref": s["id"], "metadata": {"student_first_name": s["first_name"], "student_last_name": s["last_name"], "program": "Lower School"}} | more


def build(clean: int = 10) -> tuple[dict[tuple[str, str], list[dict]], dict[str, list[str]]]:
    """(records by entity, planted: conflict type to the key of one record that it must name)."""
    rows: dict[tuple[str, str], list[dict]] = {k: [] for k in (("crm", "contact"), ("crm", "deal"), ("appdb", "student"), ("appdb", "enrollment"), ("payments", "payment"))}
    planted: dict[str, list[str]] = {}
    counter = iter(range(1, 100_000))

    def family(contact=None, deal=None, student=None, enrollment=None, payment=None, house=None):
        n = next(counter)
        s = _student(n, house or n, **(student or {}))
        rows["appdb", "student"].append(s)
        cid = f"CRM-{n:07d}"
        if contact is not False:
            rows["crm", "contact"].append(_contact(n, s, **(contact or {})))
        if deal is not False:
            rows["crm", "deal"].append(_deal(n, [cid] if contact is not False else [], **(deal or {})))
        if enrollment is not False:
            rows["appdb", "enrollment"].append(_enrollment(n, s, f"DEAL-{n:07d}" if deal is not False else None, **(enrollment or {})))
        if payment is not False:
            rows["payments", "payment"].append(_payment(n, s, **(payment or {})))
        return n, s

    def plant(kind: str, key: str) -> None:
        planted.setdefault(kind, []).append(key)

    for _ in range(clean):
        family()
    n, s = family(deal=False)
    plant("C1", s["id"])
    n, s = family()
    rows["payments", "payment"].append(_payment(90_001, s, payer_email="nobody@mail.example", external_ref=None, metadata=None))
    plant("C2", "pi_0090001")
    n, s = family()
    rows["crm", "contact"].append(_contact(90_002, s, external_id=None, dob=None))
    plant("C3", "CRM-0090002")
    n, s = family(contact={"external_id": None, "email": "other@mail.example"})
    plant("C4", f"CRM-{n:07d}")
    n, s = family(contact=False, deal=False, payment=False, enrollment=False)
    plant("C5", s["id"])
    n, s = family(contact={"grade": "7"})
    plant("C6", s["id"])
    n, s = family(payment={"type": "fee", "amount_cents": FEES["Lower School"][0]})
    plant("C7", s["id"])
    n, a = family()
    m, b = family(house=n, payment=False, student={"guardian_email": a["guardian_email"]})
    plant("C8", b["id"])
    n, s = family(enrollment={"crm_deal_id": "DEAL-9999999"})
    plant("C9", s["id"])
    n, a = family()
    m, b = family(contact=False, deal=False, payment=False, enrollment=False, student={"status": "prospect"})
    rows["crm", "contact"].append(_contact(90_010, a, first_name=b["first_name"], last_name=b["last_name"], dob=b["dob"], email="x@mail.example"))
    plant("C10", "CRM-0090010")
    n, s = family()
    rows["payments", "payment"].append(_payment(90_011, s, occurred_at="2024-03-01T10:09:59.999Z"))
    plant("C11", "pi_0090011")
    n, s = family(payment={"amount_cents": 1})
    plant("C12", f"pi_{n:07d}")
    n, s = family(payment={"status": "refunded", "refunded_at": "2024-03-05T00:00:00Z"})
    plant("C13", f"pi_{n:07d}")
    n, s = family(contact={"first_name": "Zed", "lifecycle_stage": "customer"})
    plant("C14", s["id"])
    return rows, planted


MALFORMED = {
    ("crm", "contact"): ['{"crm_id": "CRM-X1", ', "", "[1, 2]", '{"email": "a@b.c"}', '{"crm_id": "CRM-X2", "email": "a@b.c", "first_name": "A", "last_name": "B", "lifecycle_stage": "lead", "created_at": "yesterday", "updated_at": "2024-03-01T10:00:00Z"}'],
    ("payments", "payment"): ['{"payment_id": "pi_x", "amount_cents": 1e400}', "{" + '"a":' + "[" * 40 + "]" * 40 + "}"],
}


def write(folder: str, generations: tuple[int, ...] = (1, 2, 3), malformed: bool = False, clean: int = 10) -> dict[str, list[str]]:
    """Write snapshots and a manifest; grades of one contact flip over the generations. Returns the plants."""
    rows, planted = build(clean)
    counts: dict[str, dict[str, int]] = {}
    flip = planted["C6"][0]
    for g in generations:
        for (source, entity), records in rows.items():
            out = []
            for rec in records:
                if entity == "contact" and rec.get("external_id") == flip and g == 2:
                    rec = rec | {"grade": "5"}
                out.append(canonical_json({k: v for k, v in rec.items() if v is not None}))
            counts.setdefault(f"gen{g}", {})[f"{source}.{entity}"] = len(out)
            out += MALFORMED.get((source, entity), []) if malformed else []
            path = f"{folder}/{source}/gen{g}"
            os.makedirs(path, exist_ok=True)
            with open(f"{path}/{entity}.jsonl", "w") as f:
                f.write("\n".join(out) + "\n")
    with open(f"{folder}/manifest.json", "w") as f:
        f.write(canonical_json({"expected_counts": counts}))
    return planted
