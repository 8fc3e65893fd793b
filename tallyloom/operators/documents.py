"""Versioned documents: apply, roll back, transitions, and checks that return violating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..plans import dims


def merged(before: Column, change: Column) -> Column:
    """Shallow merge of two maps; the change wins."""
    return F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(change, k)), change)


def text(doc: Column) -> Column:
    """Canonical text of a map: entries in key order, nulls as a token, content escaped."""
    pairs = F.transform(F.map_entries(doc), lambda e: F.concat(s.escaped(e["key"]), F.lit("="), F.coalesce(s.escaped(e["value"]), F.lit(s.NULL_TOKEN))))
    return F.array_join(F.array_sort(pairs), s.FIELD_SEP)


def digest(doc: Column) -> Column:
    return F.sha2(text(doc), 256)


def differing(a: Column, b: Column) -> Column:
    """Keys whose value differs between two maps, or that only one has, in order."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.array_sort(F.filter(keys, lambda k: (F.map_contains_key(a, k) != F.map_contains_key(b, k)) | ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))))


def written(before: Column, change: Column) -> Column:
    """Paths that a change really writes."""
    return differing(before, merged(before, change))


def preview(before: Column, change: Column) -> Column:
    """What applying would erase to null, collapse from an object to a plain value, or introduce."""
    nested = lambda v: F.coalesce(F.trim(v).startswith("{"), F.lit(False))
    return F.struct(
        F.array_sort(F.filter(F.map_keys(change), lambda k: F.map_contains_key(before, k) & F.try_element_at(change, k).isNull() & F.try_element_at(before, k).isNotNull())).alias("erased"),
        F.array_sort(F.filter(F.map_keys(change), lambda k: nested(F.try_element_at(before, k)) & ~nested(F.try_element_at(change, k)) & F.try_element_at(change, k).isNotNull())).alias("collapsed"),
        F.array_sort(F.array_except(F.map_keys(change), F.map_keys(before))).alias("introduced"),
        (F.size(written(before, change)) == 0).alias("no_op"),
    )


def refusals(proposals: DataFrame) -> DataFrame:
    """proposals (status, target, before, change) with the first reason for which applying is refused, or null."""
    p = preview(F.col("before"), F.col("change"))
    reason = (
        F.when(F.col("status") != "approved", "not_approved")
        .when(F.col("target").isNull(), "no_target")
        .when(F.size("change") == 0, "empty_action")
        .when(F.col("before").isNull(), "entity_missing")
        .when(F.size(p["erased"]) > 0, "would_erase")
        .when(F.size(p["collapsed"]) > 0, "would_collapse")
        .when(F.size(p["introduced"]) > 0, "would_introduce")
        .when(p["no_op"], "no_op")
    )
    return proposals.withColumn("refused", reason)


def apply(proposals: DataFrame) -> DataFrame:
    """Events of the proposals that may be applied: before, after and both digests."""
    ok = refusals(proposals).where("refused is null").drop("refused")
    return ok.withColumn("after", merged(F.col("before"), F.col("change"))).withColumns({"before_digest": digest(F.col("before")), "after_digest": digest(F.col("after")), "status": F.lit("applied")})


def roll_back(events: DataFrame, current: DataFrame) -> DataFrame:
    """Restored documents of events that are the last write of their entity.

    events: event_id, entity, before, before_digest, after_digest; current: entity, doc.
    A reversal under a later write is refused (stale), and so is one whose stored
    document no longer has its digest (damaged).
    """
    last = events.groupBy("entity").agg(F.max("event_id").alias("last"))
    j = events.join(last, "entity").join(current, "entity")
    reason = F.when(F.col("event_id") != F.col("last"), "stale").when(digest(F.col("doc")) != F.col("after_digest"), "stale").when(digest(F.col("before")) != F.col("before_digest"), "damaged")
    return j.select("event_id", "entity", F.when(reason.isNull(), F.col("before")).alias("doc"), reason.alias("refused"))


def bad_transitions(moves: DataFrame) -> DataFrame:
    """Moves (role, old, new) that the matrix does not allow."""
    allowed = moves.sparkSession.createDataFrame(list(dims.TRANSITIONS), "role string, old string, new string")
    return moves.join(allowed, ["role", "old", "new"], "left_anti")


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals after decisions (proposal_id, verdict): only those still pending or on hold move."""
    d = decisions.select("proposal_id", "verdict").dropDuplicates(["proposal_id"])
    j = proposals.join(d, "proposal_id", "left")
    move = F.col("verdict").isin("approved", "rejected") & F.col("status").isin("pending", "hold")
    return j.withColumn("status", F.when(F.coalesce(move, F.lit(False)), F.col("verdict")).otherwise(F.col("status"))).drop("verdict")


def boundary_violations(events: DataFrame, proposals: DataFrame) -> DataFrame:
    """event_id and rule of events that break the write boundary: no citation, wrong content, used twice."""
    known = proposals.select("proposal_id", F.col("change").alias("cited"))
    j = events.join(known, "proposal_id", "left")
    uses = events.groupBy("proposal_id").agg(F.count("*").alias("uses"))
    j = j.join(uses, "proposal_id")
    checks = F.array_compact(F.array(F.when(F.col("cited").isNull(), "no_citation"), F.when(F.size(differing(F.col("after"), merged(F.col("before"), F.col("cited")))) > 0, "content"), F.when(F.col("uses") > 1, "used_twice")))
    return j.select("event_id", F.explode(checks).alias("rule"))


def proposal_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """proposal_id and rule of changes to proposals that must not happen.

    Both: proposal_id, status, target, change, fingerprint. New ones are born pending, on
    hold or escalated; what a proposal says never changes; none disappears.
    """
    old = before.select("proposal_id", F.lit(True).alias("known"), F.col("target").alias("t0"), F.col("change").alias("c0"), F.col("fingerprint").alias("f0"))
    j = after.withColumn("there", F.lit(True)).join(old, "proposal_id", "full")
    moved = ~F.col("t0").eqNullSafe(F.col("target")) | ~F.col("f0").eqNullSafe(F.col("fingerprint")) | (F.size(differing(F.coalesce("c0", F.create_map().cast("map<string,string>")), F.coalesce("change", F.create_map().cast("map<string,string>")))) > 0)
    checks = F.array(
        F.when(F.col("known").isNull() & ~F.col("status").isin("pending", "hold", "escalated"), "born_decided"),
        F.when(F.col("known") & F.col("there") & moved, "payload_changed"),
        F.when(F.col("there").isNull(), "deleted"),
        F.when(F.col("there") & F.col("fingerprint").isNull(), "no_provenance"),
    )
    return j.select("proposal_id", F.explode(F.array_compact(checks)).alias("rule"))
