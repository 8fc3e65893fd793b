"""Table-agnostic operators; column names are parameters.

Scale notes are given where a plan is not a plain hash aggregate or equi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp, zoned or not, in UTC."""
    return F.unix_micros(c.cast("timestamp"))


def sorted_text(c: Column, sep: str = ",") -> Column:
    """Aggregate: values in order, as one text. Bounded by the group's size."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.cast("string")), sep)


def unordered_pairs(df: DataFrame, keys: list[str], key_id: str, residual=None) -> DataFrame:
    """(left_id, right_id) of rows with equal non-null keys, the smaller id first.

    An equi-join on all keys, so a skewed key is split by adaptive execution.
    residual(left, right): a further condition on the two sides.
    """
    a = df.select(*(F.col(k).alias(f"__{k}") for k in keys), F.struct("*").alias("l"))
    b = df.select(*(F.col(k).alias(f"__{k}") for k in keys), F.struct("*").alias("r"))
    out = a.join(b, [f"__{k}" for k in keys]).where(F.col(f"l.{key_id}") < F.col(f"r.{key_id}"))
    if residual is not None:
        out = out.where(residual("l", "r"))
    return out.select(F.col(f"l.{key_id}").alias("left_id"), F.col(f"r.{key_id}").alias("right_id"), "l", "r")


def interval_pairs(df: DataFrame, keys: list[str], ts: str, key_id: str, seconds: int) -> DataFrame:
    """(left_id, right_id, gap_micros) of rows with equal keys strictly less than ``seconds`` apart.

    Time is cut into buckets of that width and each row also visits the next bucket,
    so the join is on (keys, bucket): a hot key is spread over time instead of
    meeting itself in full.
    """
    width = seconds * 1_000_000
    rows = df.select(*keys, F.col(key_id).alias("id"), micros(F.col(ts)).alias("t")).where(F.col("t").isNotNull())
    left = rows.withColumn("bucket", F.floor(F.col("t") / width)).select(*keys, "bucket", F.col("id").alias("a"), F.col("t").alias("ta"))
    right = rows.withColumn("bucket", F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) + 1))).select(*keys, "bucket", F.col("id").alias("b"), F.col("t").alias("tb"))
    near = left.join(right, [*keys, "bucket"]).where((F.col("tb") <= F.col("ta")) & (F.col("ta") - F.col("tb") < width) & ((F.col("tb") < F.col("ta")) | (F.col("b") < F.col("a"))))
    return near.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), (F.col("ta") - F.col("tb")).alias("gap_micros"))


def flip_flops(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows whose value equals the one before last and differs from the last: A, B, A."""
    w = W.partitionBy(*keys).orderBy(*order)
    seen = df.withColumn("__last", F.lag(value, 1).over(w)).withColumn("__before", F.lag(value, 2).over(w))
    return seen.where((F.col(value) == F.col("__before")) & (F.col(value) != F.col("__last"))).withColumnRenamed("__last", "middle").drop("__before")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the greatest by ``order``. An aggregate, so nothing is sorted."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group with their place; Spark limits groups before the shuffle."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` from 1; sizes are clamped to 1..100."""
    size = max(1, min(100, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next page after a key; None begins."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(max(1, min(100, size)))


def with_total(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """A page with the number of rows there are; the total is one aggregate, not a window over everything."""
    return rows.crossJoin(F.broadcast(whole.agg(F.count("*").alias("total"))))  # one row


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n for each column; one pass over exploded pairs with partial sums."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def content_digest(df: DataFrame) -> DataFrame:
    """n_rows and digest of a table as a multiset: the sum of 60-bit row hashes.

    Equal tables have equal digests in any order; sums combine, so no task sees all rows.
    """
    escaped = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\x1f"), F.lit("\\u001f"))
    text = F.concat_ws("\x1f", *(F.coalesce(escaped(F.col(c).cast("string")), F.lit("\\N")) for c in sorted(df.columns)))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the parameters that are not None."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def checked(value: str | None, allowed, what: str) -> str | None:
    """A filter value that is in the vocabulary, or an error: never an ignored filter."""
    if value is not None and value not in allowed:
        raise ValueError(f"unknown {what}: {value!r}")
    return value


def folded(df: DataFrame, scope: list[str], order: list[str], read: list[str], start: Callable[[], object], step: Callable[..., tuple], schema: str) -> DataFrame:
    """df with the columns of ``schema`` that a sequential fold gives each row of a scope, in order.

    start() makes the state of a scope, step(state, *values of ``read``) changes it and
    returns the new columns. Rows come sorted and batch by batch, so a task holds one
    batch and one state, whatever the size of a scope. Scopes run in parallel.
    """
    added = T.StructType.fromDDL(schema).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[list] = [[] for _ in added]
            keys = zip(*(batch.column(c).to_pylist() for c in scope), strict=True)
            for key, values in zip(keys, zip(*(batch.column(c).to_pylist() for c in read), strict=True), strict=True):
                if key != now:
                    now, state = key, start()
                for column, value in zip(out, step(state, *values), strict=True):
                    column.append(value)
            kinds = [pa.bool_() if f.dataType == T.BooleanType() else pa.int64() for f in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [*batch.schema.names, *(f.name for f in added)])

    return df.repartition(*scope).sortWithinPartitions(*scope, *order).mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def admit(df: DataFrame, scope: list[str], order: list[str], amount: str, cap: int) -> DataFrame:
    """df with granted and spent_after: requests of a scope in order, each granted if it still fits under the cap.

    A refused request adds nothing, so this is a fold and no running sum.
    """

    def step(spent: list[int], x: int) -> tuple[bool, int]:
        ok = spent[0] + x <= cap
        spent[0] += x if ok else 0
        return ok, spent[0]

    return folded(df, scope, order, [amount], lambda: [0], step, "granted boolean, spent_after long")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows chosen by hash of the key: the same ones on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def compare_sets(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Each key with verdict matched, missing (expected only) or extra (found only)."""
    a = expected.select(*key).distinct().withColumn("__e", F.lit(True))
    b = found.select(*key).distinct().withColumn("__f", F.lit(True))
    verdict = F.when(F.col("__e") & F.col("__f"), "matched").when(F.col("__e"), "missing").otherwise("extra")
    return a.join(b, key, "full").select(*key, verdict.alias("verdict"))


def precision_recall(compared: DataFrame) -> DataFrame:
    counts = compared.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("matched", "missing", "extra")))
    share = lambda other: (F.col("matched").cast("decimal(18,0)") / F.nullif(F.col("matched") + F.col(other), F.lit(0))).cast("decimal(6,4)")
    return counts.select("*", share("extra").alias("precision"), share("missing").alias("recall"))


def nearest_rank(df: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """percent, value: exact nearest-rank percentiles."""
    found = F.array(*(F.struct(F.lit(p).alias("percent"), F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").alias("value")) for p in percents))
    return df.agg(found.alias("f")).select(F.inline("f"))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; empty if they are unique."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def centroid(df: DataFrame, key: str, vector: str, places: int = 6) -> DataFrame:
    """key, centroid: component means scaled to length one, rounded."""
    flat = df.select(key, F.posexplode(vector).alias("axis", "x")).groupBy(key, "axis").agg(F.avg(F.col("x").cast("double")).alias("m"))
    size = flat.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("size"))
    return flat.join(size, key).select(key, "axis", F.round(F.col("m") / F.col("size"), places).alias("x"))


def confidence(kind: Column, positive: list[Column], negative: list[Column], bases: dict[str, str]) -> Column:
    """clamp(clamp(base + sum of positive) - sum of negative), exact decimals, four places."""
    dec = lambda x: F.lit(Decimal(x)).cast("decimal(10,4)")
    table = F.create_map(*[y for k, v in bases.items() for y in (F.lit(k), dec(v))])
    clamp = lambda x: F.greatest(dec("0"), F.least(dec("1"), x))
    total = F.try_element_at(table, kind)
    for p in positive:
        total = (total + p).cast("decimal(10,4)")
    total = clamp(total)
    for n in negative:
        total = (total - n).cast("decimal(10,4)")
    return F.bround(clamp(total), 4).cast("decimal(5,4)")


#: Bits of one bitmap, and of all bitmaps at most (32 MB).
_BITMAP, _BITMAPS = 1 << 15, 1 << 28


def hashed(kind: str, value: Column) -> Column:
    """A hash of a value of this kind for ``may_hold``; null stays null."""
    return F.when(value.isNotNull(), F.xxhash64(F.lit(kind), value))


def may_hold(rows: DataFrame, name: str, asked: list[Column], marks: DataFrame) -> DataFrame:
    """rows with the boolean ``name``: false only if none of the hashes asked for is the ``h`` of a mark.

    Bitmaps of bounded size are sent to the rows, so that those without any mark need not be dealt out to
    meet them. True is no proof; an exact join must follow.
    """
    count = max(1, min(_BITMAPS, 16 * marks.count()) // _BITMAP)
    where = lambda h: F.pmod(F.shiftright(h, 15), F.lit(count))
    word = lambda h: F.shiftright(h.bitwiseAND(_BITMAP - 1), 6)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    h, size = F.col("h"), _BITMAP // 64
    every = marks.sparkSession.range(count * size).select(F.pmod("id", F.lit(count)).alias("p"), F.floor(F.col("id") / count).cast("long").alias("w"), F.lit(0).cast("long").alias("b"))
    set_ = marks.where("h is not null").select(where(h).alias("p"), word(h).alias("w"), bit(h).alias("b"))
    words = set_.unionByName(every).groupBy("p", "w").agg(F.bit_or("b").alias("b"))
    maps = words.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("all")).select("p", F.transform("all", lambda x: x["b"]).alias("words"))
    found = F.lit(False)
    for i, a in enumerate(asked):
        rows = rows.withColumn(f"__h{i}", a).withColumn(f"__p{i}", where(F.col(f"__h{i}")))
        rows = rows.join(F.broadcast(maps.select(F.col("p").alias(f"__p{i}"), F.col("words").alias(f"__w{i}"))), f"__p{i}", "left")
        at = F.col(f"__h{i}")
        found = found | F.coalesce(F.get(f"__w{i}", word(at).cast("int")).bitwiseAND(bit(at)) != 0, F.lit(False))
    return rows.withColumn(name, found).drop(*(f"__{k}{i}" for i in range(len(asked)) for k in "hpw"))


def partition(conflicts: DataFrame, sensitive_rows: tuple[str, ...], row_of: Column) -> DataFrame:
    """Of a C6 and a C14 with exactly the same refs one stays: C14 if all fields of both are of sensitive rows, else C6.

    row_of: map of a field to its comparison row. A lone one always stays.
    """
    key = F.array_sort(F.array_distinct("refs"))
    disputes = F.coalesce(F.col("type").isin("C6", "C14"), F.lit(False))
    pairs = conflicts.where(disputes).groupBy(key.alias("__refs")).agg(F.countDistinct("type").alias("n"), F.flatten(F.collect_set("fields")).alias("paths")).where("n = 2")
    wholly = (F.size("paths") > 0) & F.forall("paths", lambda p: F.coalesce(F.try_element_at(row_of, p).isin(*sensitive_rows), F.lit(False)))
    drop = pairs.select("__refs", F.when(wholly, "C6").otherwise("C14").alias("type"))
    # All other types pass by the join.
    return conflicts.where(~disputes).unionByName(conflicts.where(disputes).withColumn("__refs", key).join(drop, ["type", "__refs"], "left_anti").select(*conflicts.columns))


def suppress(conflicts: DataFrame, winner: str, losers: tuple[str, ...], prefix: str | None = None) -> DataFrame:
    """Without the losers that share a ref with a winner. conflicts: conflict_id, type, refs.

    The refs are exploded for the one winner type and its losers only; the anti-join is on ref.
    """
    refs = conflicts.where(F.col("type") == winner).select(F.explode("refs").alias("ref"))
    if prefix:
        refs = refs.where(F.col("ref").startswith(prefix))
    hit = conflicts.where(F.col("type").isin(*losers)).select("conflict_id", F.explode("refs").alias("ref")).join(refs.distinct(), "ref").select("conflict_id").distinct()
    return conflicts.join(hit, "conflict_id", "left_anti")


def precedence(conflicts: DataFrame, rules, key: str = "conflict_id") -> DataFrame:
    """The rules one after another, each on the survivors of the one before.

    The refs of the types that take part are exploded once and written; the rules then
    work on these narrow rows, and the conflicts are read once more at the end, where
    types that never lose pass by the join. ``key`` tells conflicts apart; a short one keeps the rows
    narrow where a conflict has many refs, of which conflict_id is made.
    """
    types = {row.type for row in conflicts.select("type").distinct().collect()}
    able = [x for x in rules if x[1] in types and types.intersection(x[2])]
    if not able:
        return conflicts
    part = sorted({t for _, winner, losers, _ in able for t in (winner, *losers)})
    flat = stored(conflicts.where(F.col("type").isin(*part)).select(key, "type", F.explode("refs").alias("ref")), "precedence")
    lost: dict[str, list[DataFrame]] = {}

    def left(*kinds: str) -> DataFrame:
        rows = [(flat.where(F.col("type") == t), lost.get(t)) for t in kinds if t in types]
        return reduce(DataFrame.unionByName, (x.join(reduce(DataFrame.unionByName, gone), key, "left_anti") if gone else x for x, gone in rows)).select(key, "type", "ref")

    for _, winner, losers, prefix in able:
        won = left(winner).select("ref")
        if prefix:
            won = won.where(F.col("ref").startswith(prefix))
        hit = stored(left(*losers).join(won.distinct(), "ref", "left_semi").select(key, "type").distinct(), "suppressed")
        for t in losers:
            lost.setdefault(t, []).append(hit.where(F.col("type") == t).select(key))
    loses = F.coalesce(F.col("type").isin(*lost), F.lit(False))
    gone = reduce(DataFrame.unionByName, (x for all_ in lost.values() for x in all_))
    return conflicts.where(~loses).unionByName(conflicts.where(loses).join(gone, key, "left_anti"))


def broken_precedence(conflicts: DataFrame, rules, key: str | None = None) -> DataFrame:
    """What must not be left after the rules: (problem, conflict_id).

    Repeated keys, which are (type, refs) or the column ``key`` where contradictory conflicts are kept, and losers that still share a ref with a winner; types
    that no rule orders may share refs freely. Rows are first counted by a hash of (type, refs), and the winners' refs asked
    for in a bitmap of the losers', so that few rows are dealt out whole.
    """
    h = F.xxhash64("type", F.array_sort("refs"))
    marks = stored(conflicts.select(h.alias("h")).groupBy("h").count().where("count > 1").select("h"), "repeated")
    again = may_hold(conflicts, "__again", [h], marks).where("__again").drop("__again")
    keys = again.groupBy(*([key] if key else ["type", F.array_sort("refs").alias("refs")])).agg(F.count("*").alias("n"), F.min("conflict_id").alias("conflict_id")).where("n > 1").select(F.lit("repeated_key").alias("problem"), "conflict_id")
    flat = conflicts.select("conflict_id", "type", F.explode("refs").alias("ref"))
    order = [(w, x, p or "") for _, w, losers, p in rules for x in losers]
    table = F.array(*(F.struct(F.lit(w).alias("winner"), F.lit(x).alias("loser"), F.lit(p).alias("prefix")) for w, x, p in order))
    losers = flat.where(F.col("type").isin(*{x for _, x, _ in order})).select("conflict_id", "ref", F.explode(F.filter(table, lambda r: r["loser"] == F.col("type"))).alias("r"))
    exposed = stored(losers.select(hashed("ref", F.col("ref")).alias("h")).distinct(), "exposed")
    winners = may_hold(flat.where(F.col("type").isin(*{w for w, _, _ in order})).select("ref", F.col("type").alias("winner")), "__met", [hashed("ref", F.col("ref"))], exposed).where("__met").select("ref", "winner")
    left = losers.join(winners.distinct(), "ref").where((F.col("r.winner") == F.col("winner")) & F.col("ref").startswith(F.col("r.prefix")))
    return keys.unionByName(left.select(F.lit("unsuppressed").alias("problem"), "conflict_id").distinct())


def compound(conflicts: DataFrame) -> DataFrame:
    """conflict_id, others: other conflicts that share a ref with it."""
    flat = conflicts.select("conflict_id", F.explode("refs").alias("ref")).distinct()
    other = flat.select(F.col("conflict_id").alias("other"), "ref")
    return flat.join(other, "ref").where("conflict_id != other").groupBy("conflict_id").agg(F.array_sort(F.collect_set("other")).alias("others"))


def merge_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keyed replace: rows of ``new`` take the place of those with their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def retained(df: DataFrame, ts: str, cutoff: Column, dependents: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """df with fate: purge for rows older than the cutoff on which nothing depends, blocked if something does, else keep."""
    old = F.col(ts) < cutoff
    if dependents is None:
        return df.withColumn("fate", F.when(old, "purge").otherwise("keep"))
    held = dependents.select(F.col(key).alias("__k")).distinct().withColumn("__held", F.lit(True))
    joined = df.join(held, F.col(key) == F.col("__k"), "left")
    return joined.withColumn("fate", F.when(~old | F.col(ts).isNull(), "keep").when(F.col("__held"), "blocked").otherwise("purge")).drop("__k", "__held")
