"""Jaccard self-join on word n-grams: a size-aware heavy-light join, exact.

A text's set holds the 64-bit hashes of its distinct five-word shingles. Two sets of
sizes s and t link if their overlap o has 7 o >= 3 (s + t), which is a similarity of
0.75 or more.

1. Equal sets are one class, by an order-free signature. All later work is on
   classes, so a group of copies of any size costs one class.
2. Corpus-wide, each shingle learns how many classes have it (see blocks.py; one
   row a block and key range). Only shingles in two classes or more go on.
3. Small sets (size <= boundary) enumerate their subsets of the fixed size that two
   linked sets must share. Large sets go on the inverted lists of their rarest
   shingles, so many that linked sets meet in one. The boundary is where
   enumerating costs more than scanning lists as long as all sets of like size.
4. Sets that meet in a list or subset form coarse groups (connected components).
   Inside a group, overlaps are counted by scanning the inverted lists of one set
   after another, until those not yet scanned are all in one component: every link
   between components has then been looked at. No pair list is made.
5. A group too large for one task is dealt out by salt; up to ``PIVOTS`` sets are sent
   to all of its parts at once, again and again, with the same rule for when to stop.

Key ranges and parts grow in number with the input, so none of them grows. Joins on a
class, list or label that a large share of the rows has go through ``join_hot``.

Texts without words have the empty set and link with nothing; null counts as empty.
Rows that repeat, also with one id, are members like others. Null ids are kept, and
don't name a component. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import bucket_cuts, grouped
from .graph import components
from .shared import buckets, checkpoint, discard, hot_keys, join_hot, located, scanned, stored
from .textkernel import distinct, lean, mix, pack_counts, pack_sorted, release, shingles, slices, tune, unpack_counts, unpack_sorted, utf8, word_hashes

_U = np.uint64
WORDS = 5
#: Shingles of a coarse group that one task may hold.
GROUP_SHINGLES = 1_000_000
#: Subsets of one set that a task may hold; beyond it a set is large, whatever lists cost.
SET_SUBSETS = 1 << 16
#: Bytes of input files for each key range and part, and sets sent to a large group at once.
RANGE_BYTES, PIVOTS = 4 << 20, 4096


def needed(s: int, t: int) -> int:
    """The least overlap of two linked sets of these sizes."""
    return -(-3 * (s + t) // 7)


def sets_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes by row in order, row of each, set size by row, signature by row)."""
    n = len(offsets) - 1
    keys, rows = distinct(*shingles(*word_hashes(raw, offsets), WORDS))
    sizes = np.bincount(rows, minlength=n)
    sums = np.zeros(n, np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))[full]
        sums[full] = np.add.reduceat(mix(keys + _U(0x51ED270B)), begins)
    return keys, rows, sizes, mix(sums + sizes.astype(np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the text, with the size and signature of its set."""
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        sizes, names = [], []
        for lo, hi in slices(offsets):
            _, _, size, name = sets_of(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sizes.append(size), names.append(name)
        one = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), one(sizes), one(names)], [*kept, "n_shingles", "class"])


def _post(n_buckets: int):
    """Rows of (bucket, shingles in order, index of each one's class, classes) for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        met: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if held[0]:
                keys, names = np.concatenate(held[0]), np.concatenate(held[1])
                order = np.argsort(keys, kind="stable")
                keys, names = keys[order], names[order]
                cuts, rows = bucket_cuts(keys, n_buckets), []
                for k in range(n_buckets):
                    if cuts[k] < cuts[k + 1]:
                        those, index = np.unique(names[cuts[k] : cuts[k + 1]], return_inverse=True)
                        rows.append((k, pack_sorted(keys[cuts[k] : cuts[k + 1]]), pack_counts(index), those.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["bucket", "keys", "index", "classes"])
            for x in (*held, met):
                x.clear()

        for _, raw, offsets, first in grouped(batches, "text"):
            if first:
                yield from flush()
            keys, rows, sizes, names = sets_of(raw, offsets)
            new = np.zeros(len(sizes), bool)  # one text of each class in a block
            for i in np.flatnonzero(sizes).tolist():
                if (name := int(names[i])) not in met:
                    met.add(name)
                    new[i] = True
            those = new[rows]
            held[0].append(keys[those]), held[1].append(names[rows[those]])
        yield from flush()

    return run


def _share(n_parts: int):
    """Of one key range: the shingles that two classes or more have, dealt out by class."""

    def run(group: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in group["keys"].to_pylist()]
        names = [np.frombuffer(c, np.int64)[unpack_counts(i)] for i, c in zip(group["index"].to_pylist(), group["classes"].to_pylist(), strict=True)]
        key, name = np.concatenate(keys), np.concatenate(names)
        del keys, names
        order = np.argsort(key, kind="stable")
        key, name = key[order], name[order]
        same = key[1:] == key[:-1]
        again = np.zeros(len(key), bool)
        again[1:] |= same
        again[:-1] |= same
        name, key = distinct(name[again], key[again])
        found, times = np.unique(key, return_counts=True)
        each = np.repeat(times, times)
        keep = each > 1
        key, name, each = key[keep], name[keep], each[keep]
        part = name % n_parts
        order = np.lexsort((key, name, part))
        key, name, each, part = key[order], name[order], each[order], part[order]
        rows = []
        cuts = np.searchsorted(part, np.arange(n_parts + 1))
        for p in range(n_parts):
            a, b = cuts[p], cuts[p + 1]
            if a < b:
                those, size = np.unique(name[a:b], return_counts=True)
                rows.append((p, those.tobytes(), pack_counts(size), key[a:b].tobytes(), pack_counts(each[a:b])))
        del key, name, each, part, order
        release()
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), *[pa.binary()] * 4))], names=["part", "classes", "sizes", "keys", "times"])

    return run


def subset_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Key of each subset of this size; order does not matter."""
    if size > len(hashes):
        return np.zeros(0, np.uint64)
    pick = np.array(list(itertools.combinations(range(len(hashes)), size)), np.int64).reshape(-1, size)
    with np.errstate(over="ignore"):
        return mix(mix(hashes + _U(0x7F4A7C15))[pick].sum(1, dtype=np.uint64) + _U(size) * _U(0xD6E8FEB86659FD93))


def prefix_length(n: int) -> int:
    """So many of a set's shingles, in one fixed order, meet any linked set."""
    return n - -(-3 * n // 4) + 1


def meeting_keys(n: int, keys: np.ndarray, times: np.ndarray, boundary: int) -> np.ndarray:
    """Lists and subsets that a set of size n goes on; keys: those of its shingles that other sets have too."""
    out = []
    if n <= boundary:
        partners = range(-(-3 * n // 4), min(boundary, 4 * n // 3) + 1)
        out = [subset_keys(keys, o) for o in sorted({needed(n, t) for t in partners})]
    if n > boundary or n >= 3 * (boundary + 1) / 4:
        alone = n - len(keys)  # the rarest shingles of all, on nobody else's list
        room = prefix_length(n) - alone
        if room > 0:
            out.append(keys[np.lexsort((keys, times))[:room]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _meet(boundary: int):
    """Of one part of the classes: where each class can meet others, and its shared shingles."""

    def run(group: pa.Table, classes: pa.Table) -> pa.Table:
        rows = []
        if group.num_rows and classes.num_rows:
            names = [np.repeat(np.frombuffer(c, np.int64), unpack_counts(s)) for c, s in zip(group["classes"].to_pylist(), group["sizes"].to_pylist(), strict=True)]
            name = np.concatenate(names)
            key = np.concatenate([np.frombuffer(x, np.uint64) for x in group["keys"].to_pylist()])
            times = np.concatenate([unpack_counts(x) for x in group["times"].to_pylist()])
            order = np.lexsort((key, name))
            name, key, times = name[order], key[order], times[order]
            those, begins, count = np.unique(name, return_index=True, return_counts=True)
            known = classes["class"].to_numpy()
            by = np.argsort(known)
            sizes = classes["n_shingles"].to_numpy()[by][np.searchsorted(known[by], those)]
            # A set with as many shingles of its own as its prefix is long meets nobody.
            able = (count > sizes - (sizes - -(-3 * sizes // 4) + 1)) & (count >= -(-3 * sizes // 4))
            for i in np.flatnonzero(able).tolist():
                a, b = begins[i], begins[i] + count[i]
                meets = meeting_keys(int(sizes[i]), key[a:b], times[a:b], boundary)
                if len(meets):
                    rows.append((int(those[i]), int(sizes[i]), meets.view(np.int64), pack_sorted(key[a:b]), int(count[i])))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        release()
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64()), strict=True)], names=["class", "n_shingles", "meets", "shared", "n_shared"])

    return run


class Scanner:
    """Overlaps of sets with a bounded group of sets, by inverted lists."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray]):
        self.sizes, self.sets = sizes, sets
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def linked(self, size: int, keys: np.ndarray) -> np.ndarray:
        """Members of the group that link with a set."""
        lo, hi = np.searchsorted(self.flat, keys), np.searchsorted(self.flat, keys, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        overlap = np.bincount(self.owner[at], minlength=len(self.sets))
        return np.flatnonzero(7 * overlap >= 3 * (self.sizes + size))


def join_group(sizes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Component of each set (an index of a member), exactly, looking at as few sets as the rule allows."""
    n = len(sets)
    label, done = np.arange(n), np.zeros(n, bool)
    if n == 2:
        if 7 * len(np.intersect1d(*sets, assume_unique=True)) >= 3 * sizes.sum():
            label[1] = 0
        return label
    scanner = Scanner(sizes, sets)
    common = np.bincount(scanner.owner, np.repeat((c := np.unique(scanner.flat, return_counts=True)[1]), c), n)  # sets that resemble most others first
    for i in np.argsort(-common, kind="stable").tolist():
        rest = label[~done]
        if len(rest) and (rest == rest[0]).all():
            break
        if not done.all() and label[i] == np.bincount(label).argmax() and done.any():
            continue
        done[i] = True
        joined = np.unique(label[np.append(scanner.linked(int(sizes[i]), sets[i]), i)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    # Sets passed over because they were in the largest component may no longer be.
    while True:
        top = np.bincount(label).argmax()
        open_ = np.flatnonzero(~done & (label != top))
        if not len(open_) or len(np.unique(label[~done])) <= 1:
            return label
        i = int(open_[0])
        done[i] = True
        joined = np.unique(label[np.append(scanner.linked(int(sizes[i]), sets[i]), i)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]


def _join_groups(group: pa.Table) -> pa.Table:
    """Edges (class, a class of its component) of all coarse groups in one part."""
    g, names, sizes = (group[c].to_numpy() for c in ("g", "class", "n_shingles"))
    blobs, order = group["shared"].to_pylist(), np.lexsort((group["class"].to_numpy(), group["g"].to_numpy()))
    out: tuple[list, list] = ([], [])
    for own in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
        label = join_group(sizes[own], [unpack_sorted(blobs[i]) for i in own.tolist()])
        far = label != np.arange(len(own))
        out[0].extend(names[own[far]].tolist()), out[1].extend(names[own[label[far]]].tolist())
    return pa.table([pa.array(x, pa.int64()) for x in out], names=["a", "b"])


def _join_salted(key: tuple, members: pa.Table, pivots: pa.Table) -> pa.Table:
    """A spanning forest of the links between one part of a large group and the sets sent to it."""
    edges = []
    if members.num_rows and pivots.num_rows:
        names = members["class"].to_numpy()
        scanner = Scanner(members["n_shingles"].to_numpy(), [unpack_sorted(x) for x in members["shared"].to_pylist()])
        label = np.arange(len(names) + pivots.num_rows)
        for i, (name, size, blob) in enumerate(zip(pivots["class"].to_pylist(), pivots["n_shingles"].to_pylist(), pivots["shared"].to_pylist(), strict=True)):
            found = scanner.linked(size, unpack_sorted(blob))
            labels, first = np.unique(label[found], return_index=True)
            own = len(names) + i
            new = labels != label[own]
            edges += [(int(names[found[k]]), name) for k in first[new].tolist()]
            label[np.isin(label, labels)] = label[own]
    return pa.table([pa.array([e[i] for e in edges if e[0] != e[1]], pa.int64()) for i in (0, 1)], names=["a", "b"])


EDGES = "a long, b long"


def join_large(members: DataFrame, limit: int, first: int = 64) -> DataFrame | None:
    """Edges inside groups that no task may hold. members: g, class, n_shingles, shared, total (shingles of the group)."""
    salts = F.ceil(F.col("total") / limit).cast("int")
    dealt = stored(members.withColumn("salt", F.pmod(F.xxhash64("class"), salts).cast("int")).withColumn("salts", salts), "large-groups")
    state = stored(dealt.select("g", "class", F.col("class").alias("label"), F.lit(False).alias("done")), "state")
    groups = hot_keys(state.groupBy("g").agg(F.count("*").alias("n")), "g", state.count())
    edges, send = None, first
    while True:
        top = state.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
        waiting = join_hot(state.where("not done"), top, "g", hot=groups).where("label != top")
        # Those of one component wait for nothing but others outside it; none outside: all links are known.
        # Spark keeps the first rows of each group before the shuffle, so no task sorts a whole group.
        order = W.partitionBy("g").orderBy(F.xxhash64("class"))
        chosen = stored(waiting.withColumn("k", F.row_number().over(order)).where(F.col("k") <= send).select("g", "class"), "pivots")
        if chosen.isEmpty():
            return edges
        sent = dealt.join(chosen, ["g", "class"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).selectExpr("g as g", "salt as salt", "class as class", "n_shingles as n_shingles", "shared as shared")
        new = stored(dealt.groupBy("g", "salt").cogroup(sent.toDF(*sent.columns).groupBy("g", "salt")).applyInArrow(_join_salted, EDGES), "links")
        edges = new if edges is None else edges.unionByName(new)
        label = components(edges).withColumnRenamed("v", "class").withColumnRenamed("label", "now")
        sent_now = chosen.select("class", F.lit(True).alias("sent"))
        moved = stored(state.join(label, "class", "left").join(sent_now, "class", "left").select("g", "class", F.coalesce("now", "label").alias("label"), (F.col("done") | F.coalesce("sent", F.lit(False))).alias("done")), "state")
        discard(state, chosen)
        state, send = moved, min(4 * send, PIVOTS)


def choose_boundary(histogram: dict[int, int]) -> int:
    """The largest set size up to which enumerating subsets is cheaper than scanning lists.

    A list can be as long as there are sets of a size that may link; a set scans one
    for each place of its prefix.
    """
    n = 1
    while True:
        near = range(-(-3 * n // 4), 4 * n // 3 + 1)
        enumerate_ = sum(math.comb(n, o) for o in {needed(n, t) for t in near} if o <= n)
        scan = prefix_length(n) * sum(histogram.get(t, 0) for t in near)
        if enumerate_ > min(scan, SET_SUBSETS):
            return n - 1
        n += 1


def classes(docs: DataFrame, group_shingles: int = GROUP_SHINGLES, boundary: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs without text but with n_shingles and class, the label of each class that has shingles).

    docs: a text and columns that tell its rows. Classes with one label are linked,
    directly or through others. Two passes over the texts, which needn't agree in order.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = scanned(docs)
    n = buckets(rows, RANGE_BYTES)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    signed = stored(rows.mapInArrow(lean(_sign), f"{kept}, n_shingles long, class long"), "signatures")
    known = signed.where("n_shingles > 0").groupBy("class").agg(F.first("n_shingles").alias("n_shingles"))
    if boundary is None:
        most = next(k for k in range(1, 1 << 20) if math.comb(k, needed(k, k)) > SET_SUBSETS)  # no set this large is enumerated
        boundary = choose_boundary({r.n_shingles: r["count"] for r in known.where(F.col("n_shingles") <= 4 * most // 3 + 1).groupBy("n_shingles").count().collect()})
    posted = rows.select("text").mapInArrow(lean(_post(n)), "bucket int, keys binary, index binary, classes binary")
    shared = posted.repartition(n, "bucket").groupBy("bucket").applyInArrow(_share(n), "part int, classes binary, sizes binary, keys binary, times binary")
    sized = known.select(F.pmod("class", F.lit(n)).cast("int").alias("part"), "class", "n_shingles")
    meets = stored(shared.repartition(n, "part").groupBy("part").cogroup(sized.repartition(n, "part").groupBy("part")).applyInArrow(_meet(boundary), "class long, n_shingles long, meets array<long>, shared binary, n_shared long"), "meets")

    posts = meets.select("class", F.explode("meets").alias("key"))
    hubs = stored(posts.groupBy("key").agg(F.min("class").alias("hub"), F.max("class").alias("other"), F.count("*").alias("n")).where("hub != other"), "hubs")
    long_lists = hot_keys(hubs, "key", hubs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    stars = join_hot(posts, hubs.select("key", "hub"), "key", hot=long_lists).where(F.col("class") != F.col("hub")).select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()
    coarse = components(stars).select(F.col("v").alias("class"), F.col("label").alias("g"))
    weighed = checkpoint(coarse.join(meets.select("class", "n_shared"), "class"))
    totals = weighed.groupBy("g").agg(F.sum("n_shared").alias("total"))
    members = stored(join_hot(weighed.select("class", "g"), totals, "g").join(meets.select("class", "n_shingles", "shared", "n_shared"), "class").select("g", "class", "n_shingles", "shared", "total"), "members")
    small = members.where(F.col("total") <= group_shingles)
    edges = small.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(4 * n)).cast("int")).repartition(n, "part").groupBy("part").applyInArrow(_join_groups, EDGES)
    large = members.where(F.col("total") > group_shingles)
    if not large.isEmpty():
        edges = edges.unionByName(join_large(large, group_shingles))
    linked = components(stored(edges, "edges"))
    discard(meets, members, hubs)
    return signed, known.select("class").join(linked, F.col("class") == F.col("v"), "left").select("class", F.coalesce("label", "class").alias("label"))


def firsts(signed: DataFrame, labels: DataFrame, order: Column) -> DataFrame:
    """class and ``first``: the least ``order`` among the rows of all classes with its label."""
    own = stored(signed.where("n_shingles > 0").groupBy("class").agg(F.min(order).alias("own")).join(labels, "class"), "labels")
    least = own.groupBy("label").agg(F.min("own").alias("first"))
    return join_hot(own.select("class", "label"), least, "label").select("class", "first")


def near_duplicates(docs: DataFrame, group_shingles: int = GROUP_SHINGLES, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    signed, labels = classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), group_shingles, boundary)
    named = firsts(signed, labels, F.col("doc_id")).select("class", F.col("first").alias("component_id"))
    full, empty = signed.where("n_shingles > 0"), signed.where("n_shingles = 0")
    return join_hot(full, named, "class").select("doc_id", "n_shingles", "component_id").unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, the least doc_id's, and one of repeated rows.

    Rows are told apart by their place in the files they are read from, which no
    change of the cluster between two scans can move. Texts without words all stay.
    """
    rows = located(docs)
    signed, labels = classes(rows.select("doc_id", "__file", "__at", "text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__file", "__at")
    met = join_hot(signed.where("n_shingles > 0"), firsts(signed, labels, order), "class")
    gone = stored(met.where(~(F.col("first.__file").eqNullSafe(F.col("__file")) & F.col("first.__at").eqNullSafe(F.col("__at")))).select("__file", "__at"), "duplicates")
    return rows.join(gone, ["__file", "__at"], "left_anti").drop("__file", "__at")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (
  SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v
)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY 1) ON v = doc_id
"""
