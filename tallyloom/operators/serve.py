"""Lookups and pages over the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..plans import dims
from . import privacy
from . import relational as r


class Ambiguous(LookupError):
    """A key names more than one entity."""


def lookups(views: DataFrame, contacts: DataFrame, students: DataFrame, payments: DataFrame) -> DataFrame:
    """key, person_key: person keys, refs, natural keys and addresses of three sources."""
    refs = views.select("person_key", F.explode("entity_refs").alias("ref"))
    direct = views.select(F.col("person_key").alias("key"), "person_key")
    natural = refs.select(F.explode(F.array(F.col("ref"), s.ref_part(F.col("ref"), 2))).alias("key"), "person_key")
    mails = contacts.select(F.col("source_ref").alias("ref"), F.col("email_norm").alias("key")).unionByName(students.select(F.col("source_ref").alias("ref"), F.col("email_norm").alias("key"))).unionByName(payments.select(F.col("source_ref").alias("ref"), F.col("email_norm").alias("key")))
    return direct.unionByName(natural).unionByName(mails.where("key is not null").join(refs, "ref").select("key", "person_key")).distinct()


def entity(key: str, index: DataFrame, views: DataFrame, lineage: DataFrame | None = None) -> dict | None:
    """The view that a key names, with its history on request; None if there is none, an error if there are two."""
    found = [x.person_key for x in index.where(F.col("key") == key).select("person_key").distinct().limit(2).collect()]
    if len(found) > 1:
        raise Ambiguous(key)
    if not found:
        return None
    row = views.where(F.col("person_key") == found[0]).first().asDict(recursive=True)
    if lineage is not None:
        row["lineage"] = [x.asDict() for x in lineage.where(F.col("person_key") == found[0]).orderBy("field", "generation", "source_ref").collect()]
    return row


def list_entities(views: DataFrame, limit: int = 50, after: str | None = None) -> DataFrame:
    return r.keyset_page(views, "person_key", after, limit)


def list_conflicts(conflicts: DataFrame, source: str | None = None, type: str | None = None, status: str | None = None, page: int = 1, page_size: int = 50) -> tuple[DataFrame, int]:
    """A page by fingerprint and the total; unknown filter values raise."""
    r.checked(source, ("crm", "appdb", "payments"), "source")
    r.checked(type, dims.CONFLICT_TYPES, "type")
    rows = r.optional_filters(conflicts, type=type, status=status)
    if source is not None:
        rows = rows.where(F.array_contains("sources", source))
    return r.page(rows, ["fingerprint"], page, page_size), rows.count()


def list_proposals(proposals: DataFrame, conflicts: DataFrame, source: str | None = None, type: str | None = None, status: str | None = None, page: int = 1, page_size: int = 50) -> tuple[DataFrame, int]:
    """Filters on source and type look at the joined conflict."""
    r.checked(status, ("pending", "hold", "escalated", "approved", "rejected", "applied", "rolled_back"), "status")
    j = proposals.join(conflicts.select("fingerprint", F.col("sources").alias("__sources"), F.col("type").alias("__type")), "fingerprint")
    j = r.optional_filters(j, __type=type, status=status)
    if source is not None:
        j = j.where(F.array_contains("__sources", source))
    j = j.drop("__sources", "__type")
    return r.page(j, ["proposal_id"], page, page_size), j.count()


def list_audit(audit: DataFrame, actor: str | None = None, action: str | None = None, subject: str | None = None, page: int = 1, page_size: int = 50) -> tuple[DataFrame, int, DataFrame]:
    """The newest rows first, the total, and facet counts of actor and action.

    An actor is found by the spelling that is stored or by the one that it had before
    redaction; an actor that nothing matches gives an empty page, not all rows.
    """
    rows = r.optional_filters(audit, action=action, subject=subject)
    if actor is not None:
        rows = rows.where(F.col("actor").isin(actor) | (F.col("actor") == privacy.token("email", F.lit(actor))))
    return r.page(rows, [F.desc("id")], page, page_size), rows.count(), r.facets(rows, ["actor", "action"])


def visible(df: DataFrame, role: str, tenant: int, column: str = "tenant") -> DataFrame:
    """Admins see every row, clients those of their shard."""
    return df if role == "admin" else df.where(F.col(column) == tenant)


def visible_refs(df: DataFrame, owners: DataFrame, role: str, tenant: int, key: str = "conflict_id", refs: str = "refs") -> DataFrame:
    """Rows of which at least one ref belongs to the tenant; admins see all. owners: ref, tenant.

    The refs are exploded once and met with the tenant's refs in a semi-join.
    """
    if role == "admin":
        return df
    mine = owners.where(F.col("tenant") == tenant).select("ref")
    seen = df.select(key, F.explode(refs).alias("ref")).join(mine, "ref", "left_semi").select(key).distinct()
    return df.join(seen, key, "left_semi")


def rendered_status(status: Column, reason: Column) -> Column:
    return F.when(status == "escalated", F.concat(F.lit("escalated:"), F.coalesce(reason, F.lit("no_target")))).otherwise(status)
