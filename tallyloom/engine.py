"""One run: snapshots to staging, persons, verdicts, conflicts and proposals."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import conflicts as c
from .operators import rules, staging
from .operators.resolve import Resolved, Staged, lineage, resolve, views
from .plans.schemas import ENTITIES
from .sources import snapshots
from .storage import cut


@dataclass
class Run:
    staged: Staged
    er: Resolved
    views: DataFrame
    lineage: DataFrame
    verdicts: DataFrame
    raw_conflicts: DataFrame
    conflicts: DataFrame
    proposals: DataFrame
    ledger: DataFrame
    rejected: DataFrame


def load(spark: SparkSession, root: str, generations: list[int]) -> tuple[Staged, DataFrame, DataFrame]:
    """(staging of all generations, ledger, rejected lines). Each slice is read and checked once, then typed."""
    def one(key: tuple[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        source, entity = key
        landed, lost = snapshots.read_all(spark, root, source, entity, generations)
        named = lost.withColumns({"source_id": F.lit(source), "entity_type": F.lit(entity)})
        return cut(staging.BUILDERS[key](landed)), landed.select("source_id", "entity_type", "generation", "natural_key"), named

    # The five entities are loaded side by side, so that one with few files doesn't hold up the rest.
    with ThreadPoolExecutor(len(ENTITIES)) as pool:
        built, landed_all, lost_all = map(list, zip(*pool.map(one, (("crm", "contact"), ("crm", "deal"), ("appdb", "student"), ("appdb", "enrollment"), ("payments", "payment"))), strict=True))
    lost = cut(c.union(lost_all))
    counts = lost.groupBy("source_id", "entity_type", "generation").agg(F.count("*").alias("n"))
    return Staged(*built), cut(snapshots.ledger(c.union(landed_all), counts, snapshots.manifest(spark, f"{root}/manifest.json"))), lost


def identity_layer(run: Run) -> dict[str, DataFrame]:
    """The four tables of a run's identity layer: entities, links, refs and lineage."""
    er = run.er
    named = lambda df, source, target, kind: df.select(F.col(source).alias("source_ref"), F.col(target).alias("resolved_ref"), F.lit(kind).alias("link_class"), "method")
    deals = er.deal_persons.withColumn("method", F.lit("D2"))
    links = named(er.contact_links, "contact_ref", "student_ref", "contact_student").unionByName(named(er.payment_links, "payment_ref", "student_ref", "payment_person"))
    links = links.unionByName(named(er.payment_enrollments, "payment_ref", "enrollment_ref", "payment_enrollment")).unionByName(named(deals, "deal_ref", "person_key", "deal_person"))
    return {"entities": run.views, "links": links, "refs": er.person_refs, "lineage": run.lineage}


def sync(spark: SparkSession, root: str, generation: int, history: list[int] | None = None, proposals: DataFrame | None = None) -> Run:
    """Detect over one generation; earlier ones give the history that oscillation needs."""
    history = history or [generation]
    every, ledger, rejected = load(spark, root, history)
    st = every.at(generation)
    er = resolve(st)
    er = Resolved(*(cut(getattr(er, n)) for n in ("contact_links", "payment_links", "payment_enrollments", "deal_persons", "candidates", "persons", "person_refs")))
    past = c.union([lineage(every.at(g), er) for g in history])
    complete = not ledger.where(~F.col("complete")).where(F.col("generation") == generation).limit(1).collect() and not ledger.isEmpty()
    verdicts = cut(rules.evaluate(rules.Context(st, er), complete))
    raw = cut(c.assemble(verdicts))
    kept = c.marked(c.surviving(raw), c.oscillating(past), er.persons)
    signals = c.scored(c.evidence(kept, er.candidates, complete)).select("conflict_id", "confidence", "partial")
    ready = cut(c.targeted(kept.join(signals, "conflict_id")))
    open_ = proposals if proposals is not None else spark.createDataFrame([], "fingerprint string")
    return Run(st, er, views(st, er), past, verdicts, raw, ready, c.propose(ready, open_), ledger, rejected)
