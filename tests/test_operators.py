"""Documents, spend, privacy, sinks, streaming and generic operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import conflicts as c
from tallyloom.operators import documents as d
from tallyloom.operators import incidents, privacy, serve, spend
from tallyloom.operators import relational as r
from tallyloom.sources import sinks, snapshots
from tallyloom.streaming import slices


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_apply_and_roll_back(spark):
    p = spark.createDataFrame(
        [(1, "approved", "crm.contact.grade", {"grade": "5", "x": "1"}, {"grade": "6"}), (2, "pending", "t", {"a": "1"}, {"a": "2"}), (3, "approved", None, {"a": "1"}, {"a": "2"}), (4, "approved", "t", {"a": "1"}, {"a": "1"}), (5, "approved", "t", {"a": "1"}, {"b": "2"}), (6, "approved", "t", {"a": "1"}, {"a": None}), (7, "approved", "t", None, {"a": "1"}), (8, "approved", "t", {"a": "1"}, {})],
        "proposal_id int, status string, target string, before map<string,string>, change map<string,string>",
    )
    assert {x.proposal_id: x.refused for x in d.refusals(p).collect()} == {1: None, 2: "not_approved", 3: "no_target", 4: "no_op", 5: "would_introduce", 6: "would_erase", 7: "entity_missing", 8: "empty_action"}
    e = d.apply(p).select(F.col("proposal_id").alias("event_id"), "proposal_id", F.lit("e1").alias("entity"), "before", "after", "before_digest", "after_digest")
    assert [x.after for x in e.collect()] == [{"grade": "6", "x": "1"}]
    now = e.select("entity", F.col("after").alias("doc"))
    back = d.roll_back(e, now).first()
    assert back.refused is None and back.doc == {"grade": "5", "x": "1"}
    later = e.unionByName(e.withColumn("event_id", F.lit(9)))
    assert {x.event_id: x.refused for x in d.roll_back(later, now).collect()}[1] == "stale"
    assert d.boundary_violations(e, p).isEmpty()
    assert {x.rule for x in d.boundary_violations(later.withColumn("after", F.create_map(F.lit("z"), F.lit("1"))), p).collect()} == {"content", "used_twice"}


def test_transitions_and_decisions(spark):
    moves = spark.createDataFrame([("decide", "pending", "approved"), ("apply", "pending", "applied")], "role string, old string, new string")
    assert rows(d.bad_transitions(moves)) == [("apply", "pending", "applied")]
    p = spark.createDataFrame([(1, "pending"), (2, "applied"), (3, "hold")], "proposal_id int, status string")
    v = spark.createDataFrame([(1, "approved"), (2, "rejected"), (3, "nonsense")], "proposal_id int, verdict string")
    assert rows(d.decide(p, v)) == [(1, "approved"), (2, "applied"), (3, "hold")]


def test_differing_paths(spark):
    df = spark.createDataFrame([({"a": "1", "b": None}, {"a": "2", "c": None})], "x map<string,string>, y map<string,string>")
    assert df.select(d.differing(F.col("x"), F.col("y"))).first()[0] == ["a", "b", "c"]


def test_admission_is_a_fold(spark):
    rnd = random.Random(5)
    data = [(i, f"s{i % 3}", i, rnd.randint(1, 50)) for i in range(90)]
    got = spend.admitted(spark.createDataFrame(data, "request_id int, scope string, at int, reserve long"), 300).collect()
    spent = {}
    for i, scope, _, x in data:
        ok = spent.get(scope, 0) + x <= 300
        spent[scope] = spent.get(scope, 0) + (x if ok else 0)
        assert next(g for g in got if g.request_id == i).granted == ok
    both = spend.admitted_both(spark.createDataFrame([(1, "d", "r1", 1, 60), (2, "d", "r1", 2, 60), (3, "d", "r2", 3, 60), (4, "d", "r2", 4, 30)], "request_id int, day string, run string, at int, reserve long"), 100, 150)
    assert {x.request_id: x.granted for x in both.collect()} == {1: True, 2: False, 3: True, 4: True}


def test_settlement(spark):
    prices = spark.createDataFrame([("m", 1.5, 2.0, 0.1, 2.0)], "model string, input_rate double, output_rate double, cache_read_rate double, cache_write_rate double").selectExpr("model", *(f"cast({c} as decimal(12,6)) {c}" for c in ("input_rate", "output_rate", "cache_read_rate", "cache_write_rate")))
    res = spark.createDataFrame([(1, "m", 100, "usage", 10, 5), (2, "m", 100, "never_sent", None, None), (3, "m", 100, "lost", None, None), (4, "m", 10, "usage", 10, 5), (5, "m", 100, "usage", 0, 0)], "id int, model string, reserve long, evidence string, input_tokens long, output_tokens long").selectExpr("*", "cast(null as long) cache_read_tokens", "cast(null as long) cache_write_tokens")
    assert {x.id: (x.charged, x.halts) for x in spend.settled(res, prices).collect()} == {1: (25, False), 2: (0, False), 3: (100, False), 4: (10, True), 5: (100, False)}
    ask = spark.createDataFrame([("m", 10, 3)], "model string, max_input long, max_output long")
    assert spend.worst_case(ask, prices).first().reserve == 26
    audit = spark.createDataFrame([(1, "a", "halt"), (2, "a", "resume"), (3, "b", "halt")], "id int, scope string, action string")
    assert rows(spend.halted(audit)) == [("b",)]


def test_redaction(spark):
    df = spark.createDataFrame([("Ann Lee x@y.zz S-123456 HH-000001 2020-01-02", {"name": "Ann", "type": "C1", "n": None})], "t string, m map<string,string>")
    row = df.select(privacy.scrubbed(F.col("t")), privacy.redacted(F.col("m")), privacy.token("email", F.lit("A@b")), privacy.token("email", F.lit("a@B ")), privacy.without_known(F.col("t"), F.array(F.lit("Ann"), F.lit("Ann Lee"))), privacy.token("x", F.lit("[pii:x]"))).first()
    assert row[0] == "Ann Lee [pii:email] [pii:student_number] [pii:household] [pii:date]"
    assert row[1]["type"] == "C1" and row[1]["n"] is None and row[1]["name"].startswith("[pii:value:") and row[1]["name"].endswith(":aaa]")
    assert row[2] == row[3] and row[4].startswith("[pii:known] x@") and row[5] == "[pii:x]"


def test_retention_order(spark):
    t = lambda data, cols: spark.createDataFrame(data, cols).withColumn("ts", F.col("ts").cast("timestamp"))
    out = privacy.sweep({"staging": t([(1, "2024-01-01", 10), (2, "2024-05-30", 11)], "id int, ts string, parent int"), "raw_records": t([(10, "2023-01-01"), (11, "2023-01-01"), (12, "2024-05-30")], "id int, ts string")}, F.lit("2024-06-01").cast("timestamp"))
    assert {x.id: x.fate for x in out["raw_records"].collect()} == {10: "purge", 11: "blocked", 12: "keep"}


def test_sinks(spark, tmp_path):
    new = spark.createDataFrame([("crm", "contact", "k1", 1, "{}", "h")], "source_id string, entity_type string, natural_key string, generation int, payload string, row_hash string")
    load = sinks.load_id("run", "crm", "contact", 1)
    assert sinks.land(new, f"{tmp_path}/raw", load) == 1 and sinks.land(new, f"{tmp_path}/raw", load) == 0
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 1
    old, now = spark.createDataFrame([("f1", "a", 1, 2)], "fingerprint string, v string, first_seen_run int, last_seen_run int"), spark.createDataFrame([("f1", "a", 3, 3), ("f2", "b", 3, 3)], "fingerprint string, v string, first_seen_run int, last_seen_run int")
    assert rows(sinks.upsert_conflicts(old, now)) == [("f1", "a", 1, 3), ("f2", "b", 3, 3)]
    ledger = lambda n, m: spark.createDataFrame([("c", "e", 1, n, m)], "source_id string, entity_type string, generation int, expected_count long, slices map<string,long>")
    assert rows(sinks.merge_ledger(ledger(5, {"a": 1, "b": 2}), ledger(None, {"b": 3}))) == [("c", "e", 1, 5, {"a": 1, "b": 3})]
    runs = spark.createDataFrame([("r", "ok"), ("r", "partial"), ("q", "running")], "run string, status string")
    assert rows(sinks.worst_status(runs, ["run"])) == [("q", "running"), ("r", "partial")]
    assert rows(sinks.replace_keys(spark.createDataFrame([("a", 1), ("b", 1)], "source_ref string, v int"), spark.createDataFrame([("b", 2)], "source_ref string, v int"))) == [("a", 1), ("b", 2)]
    sinks.emit_jsonl(spark.createDataFrame([(2, "x"), (1, None)], "b int, a string"), ["b"], f"{tmp_path}/out")
    assert [x.value for x in spark.read.text(f"{tmp_path}/out").collect()] == ['{"a":null,"b":1}', '{"a":"x","b":2}']
    assert sinks.canonical_json({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'
    sinks.write_once(new, f"{tmp_path}/layer")
    with pytest.raises(Exception):
        sinks.write_once(new, f"{tmp_path}/layer")


def test_duplicate_keys_reject_all_members(spark):
    checked = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None), (4, "a", "bad_json")], "line_no int, natural_key string, reject string")
    assert [(x.line_no, x.reject) for x in snapshots.reject_duplicates(checked).orderBy("line_no").collect()] == [(1, "duplicate_key"), (2, "duplicate_key"), (3, None), (4, "bad_json")]


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("crm", "contact", "k1", 1, "{}", "h")], "source_id string, entity_type string, natural_key string, generation int, payload string, row_hash string")
    df.write.parquet(f"{tmp_path}/inbox")
    for _ in range(2):
        slices.ingest(spark, f"{tmp_path}/inbox", f"{tmp_path}/raw", f"{tmp_path}/ck", df.schema, "run").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 1
    df.write.mode("append").parquet(f"{tmp_path}/inbox")
    slices.ingest(spark, f"{tmp_path}/inbox", f"{tmp_path}/raw", f"{tmp_path}/ck", df.schema, "run").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 2


def test_hourly_windows_equal_the_batch(spark, tmp_path):
    ev = spark.range(50).select(F.col("id").alias("event_id"), (F.lit(1_700_000_000) + F.col("id") * 600).cast("timestamp").alias("ts"), F.lit("click").alias("event_type"))
    ev.write.parquet(f"{tmp_path}/ev")
    stream = slices.hourly(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev"))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = ev.groupBy(F.date_trunc("hour", "ts").alias("hour")).count()
    assert {(x.hour, x.n) for x in spark.table("hours").collect()} == {(x.hour, x["count"]) for x in want.collect()}


def test_leader_clusters_equal_a_plain_pass(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(4, 8))
    vecs = [v / np.linalg.norm(v) for v in (base[i % 4] + rnd.normal(scale=0.1, size=8) for i in range(40))]
    df = spark.createDataFrame([("b", f"k{i:02d}", v.tolist()) for i, v in enumerate(vecs)], "block string, k string, vector array<double>")
    leaders, want = [], {}
    for i, v in enumerate(vecs):
        near = [(round(1 - float(vecs[j] @ v), 8), n) for n, j in enumerate(leaders)]
        if near and min(near)[0] <= 0.1:
            want[f"k{i:02d}"] = f"k{leaders[min(near)[1]]:02d}"
        else:
            leaders.append(i)
            want[f"k{i:02d}"] = f"k{i:02d}"
    assert {x.k: x.cluster for x in incidents.leader_clusters(df, "block", "k").collect()} == want


def test_embedding_and_distance(spark):
    v = incidents.embed(spark.createDataFrame([("a b c",), ("a b c",), ("",)], "descriptor string")).collect()
    assert len(v) == 2 and all(len(x.vector) == 256 for x in v)
    assert abs(sum(y * y for y in next(x for x in v if x.descriptor).vector) - 1) < 1e-9


def test_pages_filters_and_audit(spark):
    audit = spark.createDataFrame([(i, f"u{i % 2}", "x", f"s{i % 3}") for i in range(10)], "id int, actor string, action string, subject string")
    page, total, facets = serve.list_audit(audit, actor="u1", page=1, page_size=3)
    assert [x.id for x in page.collect()] == [9, 7, 5] and total == 5 and ("action", "x", 5) in rows(facets)
    assert {x.subject: x.id for x in c.latest_state(audit).collect()} == {"s0": 9, "s1": 7, "s2": 8}
    assert serve.visible(audit.withColumn("tenant", F.col("id") % 2), "client", 1).count() == 5
    assert rows(r.compound(spark.createDataFrame([("a", ["1"]), ("b", ["1", "2"]), ("c", ["3"])], "conflict_id string, refs array<string>"))) == [("a", ["b"]), ("b", ["a"])]
    assert {x.fate for x in r.retained(audit.withColumn("ts", F.lit(None).cast("timestamp")), "ts", F.current_timestamp()).collect()} == {"keep"}


def test_interval_pairs_equal_all_pairs(spark):
    rnd = random.Random(1)
    data = [(i, rnd.randint(0, 2), rnd.randint(0, 4000)) for i in range(200)]
    df = spark.createDataFrame(data, "id int, k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(x.left_id, x.right_id) for x in r.interval_pairs(df, ["k"], "ts", "id", 600).collect()}
    assert got == {(a, b) for a, ka, sa in data for b, kb, sb in data if a < b and ka == kb and abs(sa - sb) < 600}


def test_nested_redaction(spark):
    text = '{"type":"C1 of Ann Lee","who":{"name":"Ann Lee","status":"seen x@y.zz","age":3,"n":null},"tags":["Bob",1,{"verdict":"ok"}]}'
    df = spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", privacy.redacted_json(F.col("t")).alias("x")).collect()}
    import json

    doc = json.loads(got[1])
    assert doc["who"]["name"] == spark.range(1).select(privacy.token("value", F.lit("Ann Lee"))).first()[0]
    assert doc["who"]["status"] == "seen [pii:email]" and doc["who"]["age"] == "[pii:flag]" and doc["who"]["n"] is None
    assert doc["tags"][2] == {"verdict": "ok"} and doc["tags"][0].startswith("[pii:value:") and doc["tags"][1] == "[pii:flag]"
    assert got[2].startswith("[pii:value:") and got[3] is None


def test_proposal_boundary(spark):
    schema = "proposal_id int, status string, target string, change map<string,string>, fingerprint string"
    old = spark.createDataFrame([(1, "pending", "t", {"a": "1"}, "f"), (2, "pending", "t", {"a": "1"}, "f2"), (3, "pending", None, None, "f3")], schema)
    new = spark.createDataFrame([(1, "approved", "t", {"a": "1"}, "f"), (2, "pending", "t", {"a": "2"}, "f2"), (4, "applied", "t", None, None)], schema)
    assert rows(d.proposal_violations(old, new)) == [(2, "payload_changed"), (3, "deleted"), (4, "born_decided"), (4, "no_provenance")]


def test_bounded_reads_and_faults(spark, tmp_path):
    import time

    assert snapshots.bounded(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ValueError):
        snapshots.bounded(spark, 60, lambda: int("x"))
    slow = F.pandas_udf(lambda s: time.sleep(30) or s, "long")
    with pytest.raises(snapshots.SourceTimeout):
        snapshots.bounded(spark, 1, lambda: spark.range(1).select(slow("id")).collect())
    lines = spark.createDataFrame([(1, "a"), (2, "b")], "line_no int, raw string")
    assert snapshots.failing(lines, 3).count() == 2
    with pytest.raises(Exception, match="injected"):
        snapshots.failing(lines, 2).collect()


def test_audit_is_stored_redacted_and_found_by_either_spelling(spark):
    ev = spark.createDataFrame([(1, "a@b.cc", "view", "s", {"name": "Ann", "type": "C1"}), (2, "job", "sync", "s", {})], "id int, actor string, action string, subject string, body map<string,string>")
    stored = privacy.audit_rows(ev).cache()
    assert "Ann" not in str(stored.collect()) and "a@b.cc" not in str(stored.collect())
    assert [serve.list_audit(stored, actor=a)[1] for a in ("a@b.cc", stored.where("id = 1").first().actor, "job", "nobody")] == [1, 1, 1, 0]
