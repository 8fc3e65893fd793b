"""Entity resolution: a deterministic cascade of equi-joins, then stars around one anchor.

No transitive closure: a person is a student, or a contact that no student owns, with
what links to it. Every step joins on equal keys; "first" is a minimum by id and
"exactly one" a count, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from . import relational as r


@dataclass
class Staged:
    contacts: DataFrame
    deals: DataFrame
    students: DataFrame
    enrollments: DataFrame
    payments: DataFrame

    def at(self, generation: int) -> Staged:
        return Staged(*(getattr(self, n).where(F.col("generation") == generation) for n in ("contacts", "deals", "students", "enrollments", "payments")))


@dataclass
class Resolved:
    contact_links: DataFrame  # contact_ref, student_ref, method
    payment_links: DataFrame  # payment_ref, student_ref, method
    payment_enrollments: DataFrame  # payment_ref, enrollment_ref, method
    deal_persons: DataFrame  # deal_ref, deal_id, person_key
    candidates: DataFrame  # source_ref, key_class, resolved_ref
    persons: DataFrame
    person_refs: DataFrame  # person_key, ref


def guardians(students: DataFrame) -> DataFrame:
    """student_ref with each of its guardians' addresses."""
    mails = F.array_distinct(F.array_compact(F.array("email_norm", "guardian2_email_norm")))
    return students.select(F.col("source_ref").alias("student_ref"), F.col("first_norm"), F.col("last_norm"), F.explode(mails).alias("mail"))


def link_contacts(contacts: DataFrame, students: DataFrame) -> DataFrame:
    """By external id; else by guardian's address and name; else by name and date of birth.

    The last two pass over students that an external id has claimed, and take the least
    student where several fit. Several contacts may reach one student.
    """
    c = contacts.select(F.col("source_ref").alias("contact_ref"), "external_id", "email_norm", "first_norm", "last_norm", "dob_norm")
    owned = c.join(students.select(F.col("student_id").alias("external_id"), F.col("source_ref").alias("student_ref")), "external_id").select("contact_ref", "student_ref", F.lit("L1").alias("method"))
    free = students.join(owned.select(F.col("student_ref").alias("source_ref")).distinct(), "source_ref", "left_anti")
    rest = c.join(owned, "contact_ref", "left_anti")
    by_mail = rest.join(guardians(free).withColumnRenamed("mail", "email_norm"), ["email_norm", "first_norm", "last_norm"]).groupBy("contact_ref").agg(F.min("student_ref").alias("student_ref")).withColumn("method", F.lit("L2"))
    left = rest.join(by_mail, "contact_ref", "left_anti")
    by_name = left.join(free.select(F.col("source_ref").alias("student_ref"), "first_norm", "last_norm", "dob_norm"), ["first_norm", "last_norm", "dob_norm"]).groupBy("contact_ref").agg(F.min("student_ref").alias("student_ref")).withColumn("method", F.lit("L3"))
    return owned.unionByName(by_mail).unionByName(by_name)


def link_payments(payments: DataFrame, students: DataFrame) -> DataFrame:
    """By external reference; else the one child of the payer with that name; else the payer's only child.

    The payer's children are those with that primary guardian; a second guardian's address links no payment.
    """
    p = payments.select(F.col("source_ref").alias("payment_ref"), "external_ref", "email_norm", "first_norm", "last_norm")
    hard = p.join(students.select(F.col("student_id").alias("external_ref"), F.col("source_ref").alias("student_ref")), "external_ref").select("payment_ref", "student_ref", F.lit("P1").alias("method"))
    rest = p.join(hard, "payment_ref", "left_anti")
    homes = students.where("email_norm is not null").select(F.col("source_ref").alias("student_ref"), "email_norm", "first_norm", "last_norm")
    one = lambda df, m: df.groupBy("payment_ref").agg(F.min("student_ref").alias("student_ref"), F.countDistinct("student_ref").alias("n")).where("n = 1").select("payment_ref", "student_ref", F.lit(m).alias("method"))
    named = one(rest.join(homes, ["email_norm", "first_norm", "last_norm"]), "P2")
    only = homes.groupBy("email_norm").agg(F.min("student_ref").alias("student_ref"), F.countDistinct("student_ref").alias("n")).where("n = 1").drop("n")
    alone = rest.join(named, "payment_ref", "left_anti").join(only, "email_norm").select("payment_ref", "student_ref", F.lit("P3").alias("method"))
    return hard.unionByName(named).unionByName(alone)


def attribute_payments(links: DataFrame, payments: DataFrame, enrollments: DataFrame, students: DataFrame) -> DataFrame:
    """payment to enrollment: the one with its program, else the student's only one."""
    return _attributed(links, payments, owned_enrollments(enrollments, students))


def owned_enrollments(enrollments: DataFrame, students: DataFrame) -> DataFrame:
    return enrollments.join(students.select("student_id", F.col("source_ref").alias("student_ref")), "student_id").select("student_ref", F.col("source_ref").alias("enrollment_ref"), "program_norm")


def _attributed(links: DataFrame, payments: DataFrame, own: DataFrame) -> DataFrame:
    p = links.join(payments.select(F.col("source_ref").alias("payment_ref"), "program_norm"), "payment_ref")
    one = lambda df, m: df.groupBy("payment_ref").agg(F.min("enrollment_ref").alias("enrollment_ref"), F.count("*").alias("n")).where("n = 1").select("payment_ref", "enrollment_ref", F.lit(m).alias("method"))
    same = one(p.join(own, ["student_ref", "program_norm"]), "E1")
    rest = p.join(same, "payment_ref", "left_anti").select("payment_ref", "student_ref")
    return same.unionByName(one(rest.join(own, "student_ref"), "E2"))


def near(payments: DataFrame) -> DataFrame:
    """The payments that a student may be found for: all, unless ``apart`` marks those of which it is known that there is none."""
    return payments.where("not apart") if "apart" in payments.columns else payments


def with_apart(payments: DataFrame, students: DataFrame) -> DataFrame:
    """payments with apart in place of repeated: its ref occurs once, and no student has its external reference or payer's address."""
    ask = lambda kind, c: r.hashed(kind, F.col(c))
    marks = students.select(F.explode(F.array(ask("ext", "student_id"), ask("mail", "email_norm"))).alias("h")).where("h is not null").distinct()
    found = r.may_hold(payments, "reached", [ask("ext", "external_ref"), ask("mail", "email_norm")], marks)
    return found.withColumn("apart", ~(F.col("reached") | F.col("repeated"))).drop("reached", "repeated")


def reached(contacts: DataFrame, students: DataFrame) -> DataFrame:
    """source_ref of contacts with the least and the greatest student that its external id (ext_least, ext_most) and its
    name and date of birth (named_least, named_most) reach; equal if it is one student. Candidates are not listed."""
    out = None
    for kind, mine, theirs in (("ext", ["external_id"], ["student_id"]), ("named", ["first_norm", "last_norm", "dob_norm"], ["first_norm", "last_norm", "dob_norm"])):
        groups = students.groupBy(*(F.col(t).alias(m) for m, t in zip(mine, theirs, strict=True))).agg(F.min("source_ref").alias(f"{kind}_least"), F.max("source_ref").alias(f"{kind}_most"))
        found = contacts.select("source_ref", *mine).join(groups, mine).groupBy("source_ref").agg(F.min(f"{kind}_least").alias(f"{kind}_least"), F.max(f"{kind}_most").alias(f"{kind}_most"))
        out = found if out is None else out.join(found, "source_ref")
    return out


def agreeing(pairs: DataFrame, contacts: DataFrame, students: DataFrame) -> DataFrame:
    """(ref, resolved_ref) that are a contact and a student, with the key classes ext, email and namedob by which they agree: at least one."""
    c = contacts.select(F.col("source_ref").alias("ref"), "external_id", F.col("email_norm").alias("c_mail"), *(F.col(n).alias(f"c_{n}") for n in ("first_norm", "last_norm", "dob_norm")))
    x = students.select(F.col("source_ref").alias("resolved_ref"), "student_id", "email_norm", "guardian2_email_norm", "first_norm", "last_norm", "dob_norm")
    j = pairs.select("ref", "resolved_ref").distinct().join(c, "ref").join(x, "resolved_ref")
    same = {"ext": F.col("external_id") == F.col("student_id"), "email": (F.col("c_mail") == F.col("email_norm")) | (F.col("c_mail") == F.col("guardian2_email_norm")), "namedob": reduce(lambda a, b: a & b, (F.col(f"c_{n}") == F.col(n) for n in ("first_norm", "last_norm", "dob_norm")))}
    return j.groupBy("ref", "resolved_ref").agg(*(F.bool_or(F.coalesce(v, F.lit(False))).alias(k) for k, v in same.items())).where("ext or email or namedob")


def contradictory_contacts(contacts: DataFrame, students: DataFrame) -> DataFrame:
    """source_ref of contacts whose key classes share no student. The students of one class are listed, the external id's or else the address's, and the others' keys compared with theirs."""
    c = contacts.select(F.col("source_ref").alias("ref"), "external_id", "email_norm", "first_norm", "last_norm", "dob_norm")
    mails = guardians(students).select("mail", F.col("student_ref").alias("resolved_ref"))
    by_ext = c.join(students.select(F.col("student_id").alias("external_id"), F.col("source_ref").alias("resolved_ref")), "external_id").select("ref", "resolved_ref").distinct()
    has = lambda df, k: df.select("ref").distinct().withColumn(k, F.lit(1))
    named = c.join(students.select("first_norm", "last_norm", "dob_norm").distinct(), ["first_norm", "last_norm", "dob_norm"], "left_semi")
    mailed = c.join(mails.select(F.col("mail").alias("email_norm")).distinct(), "email_norm", "left_semi")
    classes = has(by_ext, "n_ext").join(has(mailed, "n_email"), "ref", "full").join(has(named, "n_named"), "ref", "full").na.fill(0)
    several = classes.where("n_ext + n_email + n_named > 1")
    by_mail = c.join(several.where("n_ext = 0").select("ref"), "ref", "left_semi").join(mails, F.col("email_norm") == F.col("mail")).select("ref", "resolved_ref")
    agreed = agreeing(by_ext.join(several.select("ref"), "ref", "left_semi").unionByName(by_mail), contacts, students).join(several, "ref")
    shared = agreed.where("(n_ext = 0 or ext) and (n_email = 0 or email) and (n_named = 0 or namedob)").select("ref").distinct()
    return several.join(shared, "ref", "left_anti").select(F.col("ref").alias("source_ref"))


def match_candidates(contacts: DataFrame, students: DataFrame) -> DataFrame:
    """Every student that any key of a contact reaches, by key class; repeats once."""
    keys = lambda ext, mails: s.match_keys(ext, mails, F.col("first_norm"), F.col("last_norm"), F.col("dob_norm"))
    a = contacts.select("source_ref", F.inline(keys(F.col("external_id"), [F.col("email_norm")])))
    b = students.select(F.col("source_ref").alias("resolved_ref"), F.inline(keys(F.col("student_id"), [F.col("email_norm"), F.col("guardian2_email_norm")])))
    return a.join(b, ["key_class", "value"]).select("source_ref", "key_class", "resolved_ref").dropDuplicates()


def resolve(st: Staged, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Resolved:
    """All links of one generation, and the persons that they make.

    keep(frame, name) may write each result, so that those which follow read it. Candidates are left as a
    plan: where many records have one name, they grow with its square, and few need them listed.
    """
    payments = near(st.payments)
    links = keep(link_contacts(st.contacts, st.students), "contact_links")
    paid = keep(link_payments(payments, st.students), "payment_links")
    own = keep(owned_enrollments(st.enrollments, st.students), "own_enrollments")
    attributed = keep(_attributed(paid, payments, own), "payment_enrollments")
    seeds = st.students.select(F.col("source_ref").alias("seed"), F.col("student_id"))
    alone = st.contacts.select(F.col("source_ref").alias("contact_ref")).join(links, "contact_ref", "left_anti")
    owner = links.select("contact_ref", F.col("student_ref").alias("seed")).unionByName(alone.select("contact_ref", F.col("contact_ref").alias("seed")))
    enrolled = own.select(F.col("student_ref").alias("seed"), F.col("enrollment_ref").alias("ref"))
    deals = st.deals.select(F.col("source_ref").alias("deal_ref"), "deal_id", F.explode("contact_ids").alias("crm_id"))
    of_deal = deals.join(st.contacts.select("crm_id", F.col("source_ref").alias("contact_ref")), "crm_id").join(owner, "contact_ref").select("deal_ref", "deal_id", "seed").distinct()
    every = (
        seeds.select("seed", F.col("seed").alias("ref"))
        .unionByName(owner.select("seed", F.col("contact_ref").alias("ref")))
        .unionByName(paid.select(F.col("student_ref").alias("seed"), F.col("payment_ref").alias("ref")))
        .unionByName(enrolled)
        .unionByName(of_deal.select("seed", F.col("deal_ref").alias("ref")))
    )
    every = keep(every.repartition("seed").distinct(), "members")
    kind = lambda prefix: F.when(F.col("ref").startswith(prefix), F.col("ref"))
    grouped = every.groupBy("seed").agg(
        F.array_sort(F.collect_set(F.when(s.is_identity(F.col("ref")), F.col("ref")))).alias("identity_refs"),
        F.min(kind("appdb:student:")).alias("student_ref"),
        *(F.count(kind(p)).alias(f"{n}_count") for n, p in (("contact", "crm:contact:"), ("payment", "payments:payment:"), ("enrollment", "appdb:enrollment:"), ("deal", "crm:deal:"))),
        *(F.min(kind(p)).alias(f"survived_{n}_ref") for n, p in (("contact", "crm:contact:"), ("enrollment", "appdb:enrollment:"), ("deal", "crm:deal:"))),
    )
    persons = keep(grouped.withColumn("anchor_ref", s.anchor(F.col("identity_refs"))).withColumn("person_key", s.uuid5(F.col("anchor_ref"))), "persons")
    keyed = persons.select("seed", "person_key")
    of_deal, refs = of_deal.join(keyed, "seed").select("deal_ref", "deal_id", "person_key"), every.join(keyed, "seed").select("person_key", "ref")
    return Resolved(links, paid, attributed, keep(of_deal, "deal_persons"), match_candidates(st.contacts, st.students), persons.drop("seed"), keep(refs, "person_refs"))


def households(students: DataFrame, contacts: DataFrame) -> DataFrame:
    """household_key, anchor, children, members: students by primary guardian, then contacts with that address.

    The least student ref is the anchor. Contacts whose address is no student's make no household.
    """
    kids = students.where("email_norm is not null").select(F.col("email_norm").alias("household_key"), F.lit(0).alias("rank"), F.col("source_ref").alias("ref"))
    others = contacts.join(kids.select(F.col("household_key").alias("email_norm")).distinct(), "email_norm", "left_semi").select(F.col("email_norm").alias("household_key"), F.lit(1).alias("rank"), F.col("source_ref").alias("ref"))
    grouped = kids.unionByName(others).groupBy("household_key").agg(F.array_sort(F.collect_list(F.struct("rank", "ref"))).alias("all"))
    return grouped.select("household_key", F.col("all")[0]["ref"].alias("anchor"), F.size(F.filter("all", lambda x: x["rank"] == 0)).alias("children"), F.transform("all", lambda x: x["ref"]).alias("members"))


#: Fields of a canonical view that survive, with the staged column each is read from.
SURVIVED = {
    "appdb.student.first_name": "x_first",
    "appdb.student.last_name": "x_last",
    "appdb.student.grade": "x_grade",
    "appdb.student.status": "x_status",
    "crm.contact.email": "c_email",
    "crm.contact.lifecycle_stage": "c_lifecycle",
    "crm.deal.stage": "d_stage",
    "appdb.enrollment.program": "e_program",
    "appdb.enrollment.stage": "e_stage",
}


def views(st: Staged, er: Resolved) -> DataFrame:
    """One canonical document for each person: fourteen fields, values normalised.

    Of several records of one kind the least ref survives; raw payment types and
    statuses are shown as the source has them.
    """
    refs = er.person_refs.groupBy("person_key").agg(F.array_sort(F.collect_set("ref")).alias("entity_refs"), F.array_sort(F.collect_set(F.when(F.col("ref").startswith("crm:deal:"), F.col("ref")))).alias("deal_refs"))
    spent = er.payment_enrollments.select("payment_ref", "method").join(er.payment_links.select("payment_ref", "student_ref"), "payment_ref")
    ways = er.contact_links.select("student_ref", "method").unionByName(er.payment_links.select("student_ref", "method")).unionByName(spent.select("student_ref", "method")).distinct()
    ways = ways.join(er.persons.select("student_ref", "person_key"), "student_ref").select("person_key", "method").unionByName(er.deal_persons.select("person_key", F.lit("D2").alias("method")))
    ways = ways.groupBy("person_key").agg(F.array_sort(F.collect_set("method")).alias("link_methods"))
    paid = er.payment_links.join(st.payments.select(F.col("source_ref").alias("payment_ref"), "payment_status", "payment_type", "amount_cents"), "payment_ref")
    money = paid.groupBy("student_ref").agg(F.coalesce(F.bool_or(F.col("payment_status") == "paid"), F.lit(False)).alias("paid"), F.array_sort(F.collect_list(F.struct(F.col("payment_ref").alias("ref"), F.col("payment_type").alias("type"), F.col("payment_status").alias("status"), "amount_cents"))).alias("payments"))
    one = lambda df, kind, **columns: df.select(F.col("source_ref").alias(f"survived_{kind}_ref"), *(F.col(v).alias(k) for k, v in columns.items()))
    c = one(st.contacts, "contact", c_email="email_norm", c_lifecycle="lifecycle_norm")
    d = one(st.deals, "deal", d_stage="stage_norm")
    e = one(st.enrollments, "enrollment", e_program="program_norm", e_stage="stage_funnel")
    x = st.students.select(F.col("source_ref").alias("student_ref"), F.col("first_norm").alias("x_first"), F.col("last_norm").alias("x_last"), F.col("grade_norm").alias("x_grade"), F.col("status_norm").alias("x_status"), F.col("email_norm").alias("household_key"))
    j = er.persons.join(refs, "person_key").join(money, "student_ref", "left").join(ways, "person_key", "left")
    j = j.join(c, "survived_contact_ref", "left").join(d, "survived_deal_ref", "left").join(e, "survived_enrollment_ref", "left").join(x, "student_ref", "left")
    survived = F.create_map(*[v for k, n in SURVIVED.items() for v in (F.lit(k), F.col(n))])
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return j.select(
        "person_key", F.col("person_key").alias("canonical_id"), "anchor_ref", "entity_refs", "identity_refs", s.sources_of(F.col("entity_refs")).alias("sources"), "household_key", survived.alias("survived"),
        (F.col("enrollment_count") > 0).alias("registered"), F.coalesce("paid", F.lit(False)).alias("paid"), F.col("e_stage").alias("stage_funnel"),
        none("payments", "struct<ref:string,type:string,status:string,amount_cents:bigint>").alias("payments"), "deal_refs", none("link_methods", "string").alias("link_methods"),
    )


def lineage(st: Staged, er: Resolved) -> DataFrame:
    """(person_key, field, value_text, source_ref, generation) of each contact and student field."""
    member = er.person_refs
    fields = lambda names: F.array(*(F.struct(F.lit(p).alias("field"), F.col(c).cast("string").alias("value_text")) for p, c in names))
    a = st.contacts.select("source_ref", "generation", F.inline(fields([("crm.contact.grade", "grade"), ("crm.contact.lifecycle_stage", "lifecycle_stage"), ("crm.contact.email", "email")])))
    b = st.students.select("source_ref", "generation", F.inline(fields([("appdb.student.grade", "grade"), ("appdb.student.status", "status")])))
    return a.unionByName(b).join(member.withColumnRenamed("ref", "source_ref"), "source_ref").select("person_key", "field", "value_text", "source_ref", "generation")
