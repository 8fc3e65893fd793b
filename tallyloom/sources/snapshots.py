"""Reading snapshot files: physical lines, validation, duplicate keys, manifests.

A source writes one file of JSON lines for each (source, entity, generation). Every
line gets exactly one outcome, accepted or a kind of reject; nothing throws.
Readers have no writing member.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as s
from ..operators import relational as r
from ..storage import cut
from ..plans.schemas import CENTS, DOLLARS, ENTITIES, INTS, TIMESTAMPS, fields

T_ = TypeVar("T_")

MAX_BYTES, MAX_DEPTH, MAX_KEY = 262_144, 32, 256
#: Reject kinds in the order in which they are looked for, with their status codes.
KINDS = {"too_large": 413, "bad_json": 400, "too_deep": 400, "non_finite": 422, "not_object": 400, "missing_key": 422, "wrong_type": 422, "bad_key": 422, "unstorable_text": 422}
DUPLICATE = ("duplicate_key", 409)


def lines(spark: SparkSession, root: str, source: str, entity: str, generation: int) -> DataFrame:
    """line_no, raw: physical lines of one snapshot. Blank lines inside are lines too.

    Lines of a file are numbered by position within the file's one read, so the order
    holds at any size; snapshots are dealt into many files by their writers.
    """
    path = f"{root}/{source}/gen{generation}/{entity}.jsonl"
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    # Numbers run on over the partitions: a running sum of one count each.
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return rows.withColumn("part", part).join(F.broadcast(before), "part").select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("line_no"), "raw")


def generations(spark: SparkSession, root: str, source: str) -> list[int]:
    """Sorted numbers of the gen<N> folders of a source, from any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{source}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(place) if x.isDirectory()]
    return sorted(int(n[3:]) for n in names if n.startswith("gen") and n[3:].isdigit())


def probe(spark: SparkSession, root: str) -> dict[str, str]:
    """ok, degraded or down for each source, from the first line of its latest snapshots."""
    out = {}
    for source in sorted({x for x, _ in ENTITIES}):
        found = generations(spark, root, source)
        state = "ok" if found else "down"
        for _, entity in (k for k in ENTITIES if k[0] == source) if found else ():
            try:
                first = validate(lines(spark, root, source, entity, found[-1]).limit(1), source, entity).select("reject").collect()
                state = "degraded" if not first or first[0].reject else state
            except Exception:
                state = "degraded"
        out[source] = state
    return out


@F.udf(returnType=T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("finite", T.BooleanType())]))
def _deep(raw: str | None):
    """Depth and finiteness of a document; only lines that look suspicious come here."""
    try:
        document = json.loads(raw)
    except (ValueError, RecursionError):
        return (MAX_DEPTH + 1 if raw and raw.count("[") + raw.count("{") > MAX_DEPTH else 0, True)
    deepest, finite, todo = 0, True, [(document, 1)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, (dict, list)):
            deepest = max(deepest, depth)
            todo += [(x, depth + 1) for x in (node.values() if isinstance(node, dict) else node)]
        elif isinstance(node, float) and (node != node or node in (float("inf"), float("-inf"))):
            finite = False
    return (deepest, finite)


def _typed(entity: dict) -> Column:
    """Whether all fields have the shapes that their names ask for."""
    ok = F.lit(True)
    for field in fields(entity):
        value = F.col(f"p.{field.name}")
        if field.name in entity["required"] and field.name != entity["key"]:
            ok = ok & value.isNotNull()
        if field.name in TIMESTAMPS:
            ok = ok & (value.isNull() | (value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})\z") & value.try_cast("timestamp").isNotNull()))
        elif field.name in INTS:
            ok = ok & (value.isNull() | value.try_cast("int").isNotNull())
        elif field.name in CENTS:
            ok = ok & (value.isNull() | (value.rlike(r"\A-?[0-9]+\z") & F.coalesce(F.abs(value.try_cast("decimal(38,0)")) <= (2**63 - 1) // 10_000, F.lit(False))))
        elif field.name in DOLLARS:
            ok = ok & (value.isNull() | value.try_cast("decimal(24,6)").isNotNull())
    return ok


def validate(rows: DataFrame, source: str, entity: str) -> DataFrame:
    """rows (line_no, raw) with payload fields p, natural_key and reject (null if accepted)."""
    spec = ENTITIES[source, entity]
    parsed = rows.withColumn("p", F.from_json("raw", spec["schema"], {"mode": "PERMISSIVE"})).withColumn("tree", F.try_parse_json("raw"))
    nested = F.length("raw") - F.length(F.translate("raw", "[{", "")) > MAX_DEPTH  # linear, unlike a counting pattern
    suspicious = nested | F.col("raw").rlike(r"NaN|Infinity|[0-9][eE]\+?[0-9]{3}")
    parsed = parsed.withColumn("deep", F.when(suspicious & (F.octet_length("raw") <= MAX_BYTES), _deep("raw")))
    key = F.col(f"p.{spec['key']}")
    text_types = F.col("tree").isNull() | (F.schema_of_variant("tree").startswith("OBJECT"))
    reject = (
        F.when(F.octet_length("raw") > MAX_BYTES, "too_large")
        .when(F.col("deep.depth") > MAX_DEPTH, "too_deep")
        .when(~F.coalesce(F.col("deep.finite"), F.lit(True)), "non_finite")
        .when(F.col("tree").isNull(), "bad_json")
        .when(~text_types, "not_object")
        .when(key.isNull() | (key == ""), "missing_key")
        .when(~F.coalesce(_typed(spec), F.lit(False)), "wrong_type")
        .when(key.rlike(r"[\x00-\x1f\x7f]") | (F.length(key) > MAX_KEY), "bad_key")
        .when(F.col("raw").contains("\\u0000"), "unstorable_text")
    )
    return parsed.select("line_no", "raw", "p", "tree", key.alias("natural_key"), reject.alias("reject"))


def reject_duplicates(checked: DataFrame) -> DataFrame:
    """Every member of a repeated key is rejected, not only the later ones."""
    n = F.count("*").over(W.partitionBy("natural_key"))
    good = F.col("reject").isNull()
    seen = checked.where(good).withColumn("__n", n)
    marked = seen.withColumn("reject", F.when(F.col("__n") > 1, DUPLICATE[0]).otherwise(F.col("reject"))).drop("__n")
    return marked.unionByName(checked.where(~good))


def outcomes(checked: DataFrame, source: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """(accepted records with landing columns, rejected lines) of checked lines with a generation."""
    good = checked.where("reject is null")
    payload = F.to_json("tree")  # all keys of the source, also those without a column, in order of name
    landed = good.select(
        F.lit(source).alias("source_id"), F.lit(entity).alias("entity_type"), "natural_key", "generation", payload.alias("payload"),
        s.row_hash(F.lit(source), F.lit(entity), F.col("natural_key"), payload).alias("row_hash"), "p",
    )
    codes = F.create_map(*[F.lit(x) for kv in [*KINDS.items(), DUPLICATE] for x in kv])
    return landed, checked.where("reject is not null").select("line_no", "raw", "reject", F.try_element_at(codes, F.col("reject")).alias("status"), "generation")


def read(spark: SparkSession, root: str, source: str, entity: str, generation: int) -> tuple[DataFrame, DataFrame]:
    """(accepted records with landing columns, rejected lines) of one slice."""
    checked = reject_duplicates(validate(lines(spark, root, source, entity, generation), source, entity)).withColumn("generation", F.lit(generation))
    landed, lost = outcomes(checked, source, entity)
    return landed, lost.drop("generation")


def read_all(spark: SparkSession, root: str, source: str, entity: str, generations: list[int]) -> tuple[DataFrame, DataFrame]:
    """The same of several generations; their lines are parsed and checked once and written before they are parted."""
    slices = [reject_duplicates(validate(lines(spark, root, source, entity, g), source, entity)).withColumn("generation", F.lit(g)) for g in generations]
    return outcomes(cut(reduce(DataFrame.unionByName, slices)), source, entity)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """source_id, entity_type, generation, expected_count; a manifest that can't be read is an empty one."""
    empty = spark.createDataFrame([], "source_id string, entity_type string, generation int, expected_count long")
    try:
        rows = spark.read.schema("expected_counts map<string, map<string, long>>").json(path, multiLine=True)
        flat = rows.select(F.explode("expected_counts").alias("gen", "slices")).select("gen", F.explode("slices").alias("slice", "n"))
        out = flat.select(F.substring_index("slice", ".", 1).alias("source_id"), F.substring_index("slice", ".", -1).alias("entity_type"), F.regexp_extract("gen", "([0-9]+)", 1).try_cast("int").alias("generation"), F.col("n").alias("expected_count"))
        out.isEmpty()
        return out
    except Exception:
        return empty


def golden(spark: SparkSession, path: str) -> DataFrame:
    """type, entity_refs, disagreeing_fields of the expected conflicts, a JSON array in one file."""
    rows = spark.read.schema("type string, entity_refs array<string>, disagreeing_fields array<string>").json(path, multiLine=True)
    return rows.select("type", F.array_sort("entity_refs").alias("entity_refs"), F.array_sort(F.coalesce("disagreeing_fields", F.array().cast("array<string>"))).alias("disagreeing_fields"))


def graded(conflicts: DataFrame, expected: DataFrame) -> DataFrame:
    """Each (type, refs) key with its verdict: matched, missing or extra. conflicts: type, refs."""
    key = lambda refs: F.array_join(F.array_sort(refs), s.FIELD_SEP).alias("refs")
    return r.compare_sets(expected.select("type", key("entity_refs")), conflicts.select("type", key("refs")), ["type", "refs"])


def ledger(landed: DataFrame, rejected: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each slice; complete only if an expectation exists and is met exactly.

    landed: landing rows; rejected: source_id, entity_type, generation, n.
    """
    key = ["source_id", "entity_type", "generation"]
    loaded = landed.groupBy(*key).agg(F.countDistinct("natural_key").alias("loaded_count"))
    lost = rejected.groupBy(*key).agg(F.sum("n").alias("rejected_count"))
    j = expected.join(loaded, key, "full").join(lost, key, "left")
    done = F.coalesce(F.col("expected_count") == F.col("loaded_count"), F.lit(False))
    return j.select(*key, "expected_count", F.coalesce("loaded_count", F.lit(0)).alias("loaded_count"), F.coalesce("rejected_count", F.lit(0)).alias("rejected_count"), done.alias("complete"))


def plan(slices: DataFrame) -> DataFrame:
    """generation, state: landed if all of its slices are complete."""
    return slices.groupBy("generation").agg(F.when(F.bool_and("complete"), "landed").otherwise("pending").alias("state"))


class SourceTimeout(TimeoutError):
    """A read did not end within its bound."""


def bounded(spark: SparkSession, seconds: float, read_: Callable[[], T_]) -> T_:
    """Run an action with a time limit; its Spark jobs are cancelled when the time is over."""
    group = f"bounded-{uuid.uuid4().hex}"
    out: list = []

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "bounded read", interruptOnCancel=True)
        try:
            out.append((True, read_()))
        except Exception as e:  # handed to the caller below
            out.append((False, e))

    thread = InheritableThread(target=run, session=spark)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        raise SourceTimeout(f"no result within {seconds} s")
    good, value = out[0]
    if not good:
        raise value
    return value


def failing(rows: DataFrame, at: int) -> DataFrame:
    """Fault injection for tests: the read raises when it comes to this line."""
    return rows.withColumn("raw", F.when(F.col("line_no") >= at, F.raise_error(F.lit("injected fault")).cast("string")).otherwise(F.col("raw")))
