"""Incidents: descriptors of conflicts, hashed embeddings, leader clusters, labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as s

DIMENSIONS = 256
THRESHOLD = 0.10


def descriptors(conflicts: DataFrame) -> DataFrame:
    """conflict_id, descriptor: type, sources, fields and the shapes of observed values, in order; no values."""
    shapes = F.array_sort(F.transform(F.map_entries("observed"), lambda e: F.concat(e["key"], F.lit(":"), s.value_shape(e["value"]))))
    return conflicts.select("conflict_id", F.concat_ws("\n", "type", F.array_join("sources", ","), F.array_join(F.array_sort("fields"), ","), F.array_join(shapes, "\n")).alias("descriptor"))


def embed(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """descriptor, vector: signed counts of hashed tokens, length one. Equal descriptors are embedded once."""
    each = rows.select("descriptor").distinct()
    tokens = each.select("descriptor", F.explode(F.split(F.lower("descriptor"), r"[^\p{L}\p{N}_.]+")).alias("token")).where("token != ''")
    h = F.xxhash64("token")
    axis, sign = F.pmod(h, F.lit(dimensions)).cast("int"), F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)
    sums = tokens.groupBy("descriptor", axis.alias("axis")).agg(F.sum(sign).alias("x"))
    maps = sums.groupBy("descriptor").agg(F.map_from_entries(F.collect_list(F.struct("axis", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)))
    return each.join(maps, "descriptor", "left").select("descriptor", s.l2_normalised(F.when(F.col("m").isNotNull(), dense).otherwise(F.array_repeat(F.lit(0.0), dimensions))).alias("vector"))


def leader_clusters(vectors: DataFrame, block: str, order: str, threshold: float = THRESHOLD) -> DataFrame:
    """vectors with cluster and distance: one ordered pass, each vector joins the nearest leader within the threshold.

    The pass is sequential within a block (conflicts of one type), so blocks run in
    parallel and equal vectors are collapsed before it: what one task holds are the
    distinct descriptors of a type, a number set by vocabulary and not by rows.
    """
    schema = f"{block} string, {order} string, cluster string, distance double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        leaders: list[str] = []
        matrix = np.zeros((0, 0))
        out = []
        for key, v in zip(rows[order], rows["vector"], strict=True):
            v = np.asarray(v, float)
            if leaders:
                d = np.round(1 - matrix @ v, 8)
                best = int(d.argmin())
                if d[best] <= threshold:
                    out.append((leaders[best], float(d[best])))
                    continue
            leaders.append(key)
            matrix = v[None] if len(leaders) == 1 else np.vstack((matrix, v))
            out.append((key, 0.0))
        return rows[[block, order]].assign(cluster=[c for c, _ in out], distance=[d for _, d in out])

    return vectors.select(block, order, "vector").groupBy(block).applyInPandas(run, schema)


def leaders(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """descriptor and ``turns``: from which fingerprint on which leader is its nearest, in one ordered pass over all types.

    vectors: descriptor, first (its least fingerprint), vector. Conflicts come in order
    of fingerprint; one joins the nearest leader within the threshold or becomes one.
    Only the first conflict of a descriptor can become a leader, so the pass goes over
    distinct descriptors, whose number follows the vocabulary and not the rows; a later
    leader may take over the descriptors that it is nearer to.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first")
        names, matrix = rows["descriptor"].tolist(), np.array(rows["vector"].tolist(), float)
        firsts, heads = rows["first"].tolist(), []
        nearest = np.full(len(rows), np.inf)
        turns: list[list[dict]] = [[] for _ in names]
        for i in range(len(names)):
            if nearest[i] <= threshold:
                continue
            heads.append(i)
            d = np.round(1 - matrix @ matrix[i], 8)
            d[i] = 0.0
            for j in np.flatnonzero((d < nearest) & (d <= threshold)).tolist():
                turns[j].append({"at": firsts[i], "leader": names[i], "distance": float(d[j])})
            nearest = np.minimum(nearest, d)
        return pd.DataFrame({"descriptor": names, "turns": turns})

    return vectors.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(run, "descriptor string, turns array<struct<at:string,leader:string,distance:double>>")


def cluster(conflicts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """conflict_id, incident, distance of every conflict; conflicts: with conflict_id and fingerprint."""
    text = descriptors(conflicts).join(conflicts.select("conflict_id", "fingerprint"), "conflict_id")
    firsts = text.groupBy("descriptor").agg(F.min("fingerprint").alias("first"))
    turns = leaders(embed(text).join(firsts, "descriptor"), threshold)
    own = text.join(turns, "descriptor").withColumn("turn", F.element_at(F.filter("turns", lambda t: t["at"] <= F.col("fingerprint")), -1))
    return own.select("conflict_id", F.sha2("turn.leader", 256).alias("incident"), F.col("turn.distance").cast("decimal(10,8)").alias("distance"))


def listed(members: DataFrame, conflicts: DataFrame, n: int = 10) -> DataFrame:
    """incident, label, size and its n nearest members; the size is the true count."""
    j = members.join(conflicts.select("conflict_id", "type", "sources"), "conflict_id")
    w = W.partitionBy("incident").orderBy("distance", "conflict_id")
    sizes = j.groupBy("incident").agg(F.count("*").alias("size"), F.min("type").alias("type"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))), "+").alias("sources"))
    near = j.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "conflict_id"))), lambda x: x["conflict_id"]).alias("members"))
    return sizes.join(near, "incident").select("incident", F.concat_ws(" ", "type", "sources").alias("label"), "size", "members").orderBy(F.desc("size"), "incident")
