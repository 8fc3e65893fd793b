"""Writing: append-only landing, keyed staging, idempotent loads, merges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDING_KEY = ["source_id", "entity_type", "generation"]
#: Worst first: what a run's status becomes when slices differ.
SEVERITY = ("failed", "partial", "running", "ok")


def load_id(run: str, source: str, entity: str, generation: int) -> str:
    return f"{run}:{source}:{entity}:{generation}"


def _existing(spark: SparkSession, path: str, schema) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def land(rows: DataFrame, path: str, load: str) -> int:
    """Append landing rows under a load id; a load that is there already writes nothing. Returns rows written."""
    spark = rows.sparkSession
    new = rows.withColumn("load_id", F.lit(load))
    seen = _existing(spark, path, new.schema).where(F.col("load_id") == load)
    if not seen.isEmpty():
        return 0
    expected = new.count()
    new.write.mode("append").partitionBy(*LANDING_KEY).parquet(path)
    written = spark.read.parquet(path).where(F.col("load_id") == load).count()
    if written != expected:
        raise IOError(f"load {load}: {expected} rows were to be written, {written} are there")
    return written


def replace_keys(old: DataFrame, new: DataFrame, key: str = "source_ref") -> DataFrame:
    """Staging after a slice: its keys are replaced, all others stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """By fingerprint: a known conflict only advances last_seen_run; first_seen_run stays."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in ("fingerprint", "first_seen_run", "last_seen_run")]
    return both.groupBy("fingerprint").agg(*(F.min_by(c, "first_seen_run").alias(c) for c in rest), F.min("first_seen_run").alias("first_seen_run"), F.max("last_seen_run").alias("last_seen_run")).select(*old.columns)


def merge_ledger(old: DataFrame, new: DataFrame) -> DataFrame:
    """Slice maps merged by key, later ones winning; an expected count once known is kept."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    entries = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.map_entries("slices").alias("e")))), lambda x: x["e"]))
    merged = F.aggregate(entries, F.create_map().cast("map<string,bigint>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_entries(F.array(e))))
    return both.groupBy(*LANDING_KEY).agg(F.first("expected_count", ignorenulls=True).alias("expected_count"), merged.alias("slices"))


def worst_status(rows: DataFrame, key: list[str], status: str = "status") -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col(status))
    return rows.groupBy(*key).agg(F.min_by(status, rank).alias(status))


def append_incidents(members: DataFrame, path: str, batch: str) -> int:
    """Append one batch of incidents with their members: incidents and members carry the batch's name.

    members: conflict_id, incident, distance. A batch that is there already writes nothing.
    """
    spark = members.sparkSession
    new = members.withColumn("batch", F.lit(batch))
    sized = new.groupBy("batch", "incident").agg(F.count("*").alias("size"))
    if not _existing(spark, f"{path}/incidents", sized.schema).where(F.col("batch") == batch).isEmpty():
        return 0
    new.write.mode("append").parquet(f"{path}/members")
    sized.write.mode("append").parquet(f"{path}/incidents")  # last, so that a batch without it is not complete
    return sized.count()


def materialise(tables: dict[str, DataFrame], path: str, generation: int) -> dict[str, int]:
    """Write the tables of the identity layer once for a generation; rows written by table, zero if they are there.

    tables: entities, links, refs, lineage. Each is partitioned by generation; a marker
    is written last, so a run that failed half-way starts over.
    """
    spark = next(iter(tables.values())).sparkSession
    done = spark.createDataFrame([(generation, n) for n in sorted(tables)], "generation int, name string")
    if not _existing(spark, f"{path}/done", done.schema).where(F.col("generation") == generation).isEmpty():
        return dict.fromkeys(tables, 0)
    written = {}
    for name, df in tables.items():
        place = f"{path}/{name}/generation={generation}"
        df.drop("generation").write.mode("overwrite").parquet(place)
        written[name] = spark.read.parquet(place).count()
    done.coalesce(1).write.mode("append").parquet(f"{path}/done")
    return written


def append(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path) if by else rows.write.mode("append").parquet(path)


def write_once(rows: DataFrame, path: str) -> None:
    """A generation's identity layer: a second write of it is refused."""
    rows.write.mode("errorifexists").parquet(path)


def canonical_json(value) -> str:
    """Sorted keys, ASCII, no spaces."""
    return json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":"))


def emit_jsonl(rows: DataFrame, order: list[str], path: str) -> None:
    """Rows as canonical JSON lines in order, through Spark's text sink; columns are written in name order."""
    fields = F.struct(*sorted(rows.columns))
    text = F.to_json(fields, {"ignoreNullFields": "false"})
    rows.select(*order, text.alias("value")).sort(*order).select("value").write.mode("errorifexists").text(path)
