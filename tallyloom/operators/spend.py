"""Spend in whole micro-dollars: reservations under caps, settlement, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational as r


def worst_case(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """requests (model, max_input, max_output) with reserve: the dearest way to read the input plus the whole output, rounded up."""
    j = requests.join(prices, "model")
    dear = F.greatest("input_rate", "cache_read_rate", "cache_write_rate")
    return j.withColumn("reserve", F.ceil((dear * F.col("max_input") + F.col("output_rate") * F.col("max_output")).cast("decimal(30,6)")).cast("long")).drop("input_rate", "cache_read_rate", "cache_write_rate", "output_rate")


def admitted(requests: DataFrame, cap: int, scope: list[str] | None = None) -> DataFrame:
    """Requests in order of arrival under the cap of their scope; a refused one adds nothing."""
    return r.admit(requests, scope or ["scope"], ["at", "request_id"], "reserve", cap)


def admitted_both(requests: DataFrame, run_cap: int, day_cap: int) -> DataFrame:
    """Requests that both their run's and their day's cap admit; day scopes hold their runs, so one fold sees both.

    requests: request_id, day, run, at, reserve.
    """

    def step(state: dict, run: str, x: int) -> tuple[bool, int]:
        ok = state["day"] + x <= day_cap and state["runs"].get(run, 0) + x <= run_cap
        if ok:
            state["day"] += x
            state["runs"][run] = state["runs"].get(run, 0) + x
        return ok, state["day"]

    return r.folded(requests, ["day"], ["at", "request_id"], ["run", "reserve"], lambda: {"day": 0, "runs": {}}, step, "granted boolean, day_spent long")


def usage_cost() -> Column:
    """Micro-dollars of what the provider reports, rounded up."""
    total = F.col("input_rate") * F.col("input_tokens") + F.col("output_rate") * F.col("output_tokens") + F.col("cache_read_rate") * F.coalesce("cache_read_tokens", F.lit(0)) + F.col("cache_write_rate") * F.coalesce("cache_write_tokens", F.lit(0))
    return F.ceil(total.cast("decimal(30,6)")).cast("long")


def settled(reservations: DataFrame, prices: DataFrame) -> DataFrame:
    """reservations with charged and halts: never sent costs nothing, plausible usage its price, anything else the whole reserve.

    Usage above the reserve is charged at the reserve and halts the scope.
    """
    j = reservations.join(prices, "model", "left")
    cost = usage_cost()
    real = (F.col("evidence") == "usage") & F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull() & ((F.col("input_tokens") + F.col("output_tokens")) > 0)
    charged = F.when(F.col("evidence") == "never_sent", 0).when(real & (cost <= F.col("reserve")), cost).otherwise(F.col("reserve"))
    return j.select(*reservations.columns, charged.cast("long").alias("charged"), F.coalesce(real & (cost > F.col("reserve")), F.lit(False)).alias("halts"))


def swept(reservations: DataFrame, now: Column) -> DataFrame:
    """Open reservations whose lease is over are charged in full."""
    over = F.col("settled_at").isNull() & (F.col("lease_until") < now)
    return reservations.withColumn("charged", F.when(over, F.col("reserve")).otherwise(F.col("charged"))).withColumn("settled_at", F.when(over, now).otherwise(F.col("settled_at")))


def halted(audit: DataFrame) -> DataFrame:
    """scope of those whose last halt or resume says halt."""
    return r.latest(audit.where(F.col("action").isin("halt", "resume")).select("scope", "action", "id"), ["scope"], ["id"]).where("action = 'halt'").select("scope")


def rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scope").agg(F.count("*").alias("requests"), F.coalesce(F.sum("reserve"), F.lit(0)).alias("reserved"), F.coalesce(F.sum("charged"), F.lit(0)).alias("charged"))
