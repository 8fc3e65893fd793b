"""What the conflict queries write and deal out: payments without a student take no part, and candidates are not listed."""

import pytest
from pyspark.sql import functions as F

from tallyloom import library, world
from tallyloom.operators import relational as r
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("survivors", [False, True])
def test_conflicts_of_payments_set_apart_need_no_shuffle(spark, survivors):
    assert "hashpartitioning" not in plan_of(library.apart_conflicts(spark, SF, survivors))


def test_written_conflicts_hold_few_of_the_payments(spark):
    ctx = world.context(spark, SF)
    apart = ctx.staged.payments.where("apart")
    assert 2 * apart.count() > ctx.staged.payments.count()
    assert apart.join(ctx.er.payment_links, F.col("payment_ref") == F.col("source_ref")).isEmpty()
    written = library.joined_conflicts(spark, SF)
    assert written.select(F.explode("refs").alias("source_ref")).join(apart, "source_ref").isEmpty()
    assert {"fingerprint", "conflict_id"}.isdisjoint(written.columns)


def test_candidates_stay_a_plan(spark):
    assert not hasattr(world.context(spark, SF).er.candidates, "_stored_at")


def test_bitmaps_lose_nothing(spark):
    marks = spark.range(0, 90_000, 3).select(r.hashed("n", F.col("id")).alias("h"))
    found = r.may_hold(spark.range(90_000), "maybe", [r.hashed("n", F.col("id"))], marks)
    assert found.where("id % 3 = 0 and not maybe").isEmpty()
    assert found.where("id % 3 > 0 and maybe").count() < 9_000
