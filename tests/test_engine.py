import pytest
from pyspark.sql import functions as F

from tallyloom import engine
from tallyloom.operators import conflicts as c
from tallyloom.operators import incidents, rules, serve
from tallyloom.operators.resolve import Resolved, Staged, resolve
from tallyloom.sources import generator, snapshots
from tallyloom.storage import cut


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("snapshots"))
    planted = generator.write(folder, malformed=True)
    return planted, engine.sync(spark, f"file://{folder}", 3, [1, 2, 3]), folder


def test_every_plant_is_found_and_nothing_clean_is_flagged(world):
    planted, run, _ = world
    found = {}
    for x in run.conflicts.select("type", "refs").collect():
        found.setdefault(x.type, []).append(x.refs)
    assert set(found) == set(planted)
    for kind, keys in planted.items():
        assert any(any(ref.endswith(k) for ref in refs) for refs in found[kind] for k in keys), kind
    expected = {"C8": 1, "C10": 1, "C3": 1, "C11": 1, "C14": 1, "C6": 1, "C13": 1, "C12": 1, "C2": 1, "C1": 1, "C5": 1}
    assert {k: len(found[k]) for k in expected} == expected


def test_verdicts_stamp_every_record_and_keep_their_contract(world):
    _, run, _ = world
    assert rules.broken_contracts(run.verdicts).isEmpty()
    counts = {r.rule_id: r.n for r in run.verdicts.groupBy("rule_id").agg(F.countDistinct("record_ref").alias("n")).collect()}
    students, payments = run.staged.students.count(), run.staged.payments.count()
    assert counts["R-001"] == counts["R-005"] == counts["R-008"] == students and counts["R-002"] == counts["R-012"] == payments
    assert {r.verdict for r in run.verdicts.where("rule_id = 'R-000'").select("verdict").distinct().collect()} == {"unchecked"}


def test_precedence_suppresses(world):
    _, run, _ = world
    raw, kept = ({x.conflict_id for x in df.select("conflict_id").collect()} for df in (run.raw_conflicts, run.conflicts))
    assert kept < raw
    assert not any(k.startswith("C7") and "refunded" in k for k in kept)


def test_incomplete_sources_gate_absence_rules(spark, world):
    _, run, _ = world
    gated = rules.evaluate(rules.Context(run.staged, run.er), complete=False)
    rows = gated.where(F.col("rule_id").isin("R-001", "R-013")).select("verdict", "reason").distinct().collect()
    assert [(r.verdict, r.reason) for r in rows] == [("unchecked", "source_incomplete")]


def test_rejects_and_ledger(spark, world):
    _, run, folder = world
    kinds = {(r.entity_type, r.reject): r.n for r in run.rejected.where("generation = 3").groupBy("entity_type", "reject").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("contact", "bad_json"): 2, ("contact", "not_object"): 1, ("contact", "missing_key"): 1, ("contact", "wrong_type"): 1, ("payment", "non_finite"): 1, ("payment", "too_deep"): 1}
    assert run.ledger.where("not complete").isEmpty()
    assert snapshots.generations(spark, f"file://{folder}", "crm") == [1, 2, 3]
    assert snapshots.probe(spark, f"file://{folder}") == {"appdb": "ok", "crm": "ok", "payments": "ok"}
    assert [r.state for r in snapshots.plan(run.ledger).collect()] == ["landed"] * 3


def test_second_pass_proposes_nothing(spark, world):
    _, run, _ = world
    first = run.proposals.select("fingerprint", "status", "confidence").collect()
    assert len(first) == run.conflicts.count() and all(0 <= x.confidence <= 1 for x in first)
    assert c.propose(run.conflicts, run.proposals).isEmpty()
    gated = c.gate(run.proposals.withColumn("status", F.lit("approved"))).select("type", "refusals").collect()
    assert all("no_target" in g.refusals for g in gated if g.type in ("C1", "C5", "C7"))


def test_oscillation_marks_the_flipping_grade(world):
    planted, run, _ = world
    rows = run.conflicts.where("oscillating").select("type", "refs").collect()
    assert [r.type for r in rows] == ["C6"] and any(x.endswith(planted["C6"][0]) for x in rows[0].refs)


def test_results_do_not_depend_on_partitioning(spark, world):
    _, run, _ = world
    dealt = Staged(*(getattr(run.staged, n).repartition(3) for n in ("contacts", "deals", "students", "enrollments", "payments")))
    er = resolve(dealt)
    er = Resolved(*(cut(getattr(er, f)) for f in Resolved.__dataclass_fields__))
    again = c.assemble(cut(rules.evaluate(rules.Context(dealt, er))))
    assert c.digest(again) == c.digest(run.raw_conflicts)


def test_incidents_and_pages(spark, world):
    _, run, _ = world
    members = incidents.cluster(run.conflicts)
    assert members.count() == run.conflicts.count()
    rows = incidents.listed(members, run.conflicts, 2).collect()
    assert sum(r["size"] for r in rows) == run.conflicts.count() and all(len(r.members) <= 2 for r in rows)
    page, total = serve.list_conflicts(run.conflicts, source="crm", type="C6")
    assert total == page.count() == 1
    with pytest.raises(ValueError):
        serve.list_conflicts(run.conflicts, type="C99")
    index = serve.lookups(run.views, run.staged.contacts, run.staged.students, run.staged.payments).cache()
    key = run.views.select("person_key").first().person_key
    assert serve.entity(key, index, run.views, run.lineage)["person_key"] == key
    assert serve.entity("nobody", index, run.views) is None


def test_rule_lint():
    assert rules.lint("select lower(x) from t -- upper(\nwhere y = 'trim('") == ["lower("]


def test_contradictory_keys_and_incomplete_sources_are_partial_evidence(world):
    _, run, _ = world
    reasons = lambda df: {r.conflict_id: set(r.partial) for r in df.select("conflict_id", "partial").collect()}
    merged = [r.conflict_id for r in run.conflicts.where("type = 'C10'").select("conflict_id").collect()]
    kept = run.conflicts.drop("partial", "confidence")
    whole, degraded = (reasons(c.evidence(kept, run.er.candidates, x)) for x in (True, False))
    assert whole == reasons(run.conflicts)
    assert merged and all("contradictory_match_keys" in whole[k] for k in merged)
    assert degraded == {k: v | {"incomplete_sources"} for k, v in whole.items()}
