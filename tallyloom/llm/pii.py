"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Base spans come from four fixed patterns (email, ip, card, phone), leftmost and not
overlapping within a kind; matches that fail their check are dropped. They are the
seeds. The word before an instance is a lexical pattern; pairs of a pattern and an
instance form a graph, in which the two sides teach each other for up to ``ROUNDS``
rounds. A seed has score 1 for its kind. A pattern is trusted for a kind if enough
different instances with a high score stand after it (``SUPPORT``) and their mean
score, with one neutral one, is high (``CONFIDENCE``). Text of a fitting shape that no
base pattern takes, such as a number without its country code, gets the noisy or of
the trusted patterns that it stands after; with a high score it is an instance like a
seed, and induces patterns from the other places where it stands. What stands after
patterns trusted in the end is added.

Java regular expressions recurse in repeated groups, so the patterns run on copies
of the text in which single separators are one private character of equal length:
no group repeats without bound, and long runs of digits or dots cost linear time.

Offsets are in code points, ends exclusive. Null texts are empty and have no span.
Rows are told apart by their place in the files, so repeated rows and ids are kept.
Documents with many spans cost memory for their spans only. Extra columns, and ones
that clash with names used here, are ignored by the spans and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import PLACE, checkpoint, hot_keys, join_hot, located, stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 6
SUPPORT, CONFIDENCE, DAMPING = 5, 0.75, 0.9
SEP = "\x01"
#: The base patterns, in the form that runs on the prepared copies.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9\x01])[0-9](?:\x01?[0-9]){13,18}(?![0-9\x01])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What a candidate may look like: addresses written out, numbers with separators, hexadecimal groups.
CANDIDATE = r"(?<![^\s(\[\x22'])(?:[^\s@(]++(?:@|\(at\))[^\s@]++|\(?[0-9][0-9 ().:/-]{5,}[0-9]|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![0-9A-Za-z])"
FITS = {
    "email": r"^[^\s@]++(?:@|\(at\))[^\s@]++$|^[^\s@(]++\(at\)[^\s@]++$",
    "ip": r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?:[:/][0-9]{1,5})?|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})$",
    "card": r"^[0-9](?:[ -]?[0-9]){11,18}$",
    "phone": r"^\(?[0-9](?:[ ().-]{0,3}[0-9]){6,14}$",
}
FOUND = "array<struct<start:int,end:int,hit:string,context:string>>"
CHUNK = 256


def context(before: Column) -> Column:
    """The lexical pattern that the text before an instance ends in: its last word, lower-case, digits as 0."""
    word = F.substring_index(F.rtrim(F.translate(before, "\t\n\x0b\f\r", "     ")), " ", -1)
    return F.translate(F.lower(word), "123456789", "000000000")


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit, context) of a pattern's matches.

    Starts are running sums of the lengths between matches. They are built in chunks,
    so that thousands of matches in a text don't cost their square.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("p"), F.length(h).alias("h"), h.alias("hit"), context(p).alias("context")))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y["p"] + y["h"])
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, CHUNK))
    sums = F.transform(chunks, total)
    bases = F.transform(sums, lambda _, i: F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), lambda a, y: a + y))
    placed = F.zip_with(chunks, bases, lambda c, b: F.transform(c, lambda x, i: F.struct((b + total(F.slice(c, F.lit(1), i)) + x["p"]).alias("start"), x["h"].alias("n"), x["hit"].alias("hit"), x["context"].alias("context"))))
    flat = F.transform(F.flatten(placed), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("end"), x["hit"].alias("hit"), x["context"].alias("context")))
    return F.when(F.size(hits) > 0, flat).otherwise(F.array().cast(FOUND))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    turned = F.reverse(_digits(hit))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


def _ip(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda part: part.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_places(text: Column) -> dict[str, Column]:
    """Array of (start, end, hit, context) for each kind, in order."""
    none = F.array().cast(FOUND)
    free = F.translate(text, SEP, "\x02")
    dotted = F.regexp_replace(free, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", SEP)
    joined = F.regexp_replace(free, r"(?<=[0-9])[ -](?=[0-9])", SEP)
    return {
        "email": F.when(F.contains(text, F.lit("@")), _places(dotted, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), F.filter(_places(text, IP), lambda x: _ip(x["hit"]))).otherwise(none),
        "card": F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){13}"), F.filter(_places(joined, CARD), lambda x: _luhn(x["hit"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(_places(text, PHONE), lambda x: F.length(_digits(x["hit"])).between(10, 15))).otherwise(none),
    }


SPANS = "array<struct<start:int,rank:int,end:int,kind:string,hit:string,context:string>>"


def extract(docs: DataFrame) -> DataFrame:
    """The columns PLACE, doc_id, base and candidates of each text; one narrow pass over whole texts."""
    text = F.coalesce("text", F.lit(""))
    rows = located(docs.select("doc_id", "text")).select(*PLACE, "doc_id", text.alias("text"))
    found = rows.select(*PLACE, "doc_id", "text", *(c.alias(k) for k, c in base_places(F.col("text")).items()))
    shaped = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), x["end"].alias("end"), F.lit(k).alias("kind"), x["hit"].alias("hit"), x["context"].alias("context")))
    found = found.withColumn("base", F.array_sort(F.concat(*(shaped(k) for k in KINDS))))
    able = F.when(F.col("text").rlike(r"@|\(at\)|[0-9:][0-9 ().:/-]{4}|[0-9A-Fa-f]:[0-9A-Fa-f]*:"), _places(F.col("text"), CANDIDATE)).otherwise(F.array().cast(FOUND))
    found = found.withColumn("able", able)
    free = F.filter("able", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return found.select(*PLACE, "doc_id", "base", free.alias("candidates"))


def fitting(hit: Column) -> Column:
    """Kinds whose shape a text has."""
    return F.array_compact(F.array(*(F.when(hit.rlike(pattern), k) for k, pattern in FITS.items())))


def induce(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """context, kind and trust of the patterns that the graph ends up trusting.

    Nodes are numbered by 64-bit hashes of (context, kind) and (instance, kind), edges
    are distinct, and the graph has contexts only that could have enough support. A
    frequent word or instance is no hot key: see ``join_hot``.
    """
    seeds = found.select(F.explode("base").alias("x")).select("x.context", F.lower("x.hit").alias("instance"), "x.kind", F.lit(1).alias("seed"))
    others = found.select(F.explode("candidates").alias("x")).select("x.context", F.lower("x.hit").alias("instance"), F.explode(fitting(F.col("x.hit"))).alias("kind"), F.lit(0).alias("seed"))
    pairs = seeds.unionByName(others).where("context != ''").groupBy("context", F.xxhash64("instance").alias("instance"), "kind").agg(F.max("seed").alias("seed"))
    pairs = stored(pairs, "pairs")
    sizes = pairs.groupBy("context", "instance").agg(F.lit(1).alias("one")).groupBy("context").agg(F.count("*").alias("size")).where(F.col("size") >= SUPPORT)
    number = lambda of: F.xxhash64(of, "kind")
    patterns = stored(pairs.select("context", "kind").distinct().join(sizes, "context").select(number("context").alias("c"), "context", "kind", "size"), "patterns")
    # What an instance is from the start: 1 for the kind that it is a seed of, 0 for others; unknown if it is no seed.
    nodes = pairs.groupBy("instance", "kind").agg(F.max("seed").alias("seed"))
    taken = nodes.where("seed = 1").select("instance").distinct()
    fixed = checkpoint(nodes.join(taken, "instance", "left_semi").select(number("instance").alias("i"), F.col("seed").cast("double").alias("fixed")))
    edges = pairs.select(number("context").alias("c"), number("instance").alias("i"))
    hot_c = hot_keys(patterns.select("c", F.col("size").alias("n")), "c", pairs.count())
    edges = checkpoint(join_hot(edges, patterns.select("c", "size"), "c", hot=hot_c))
    hot_i = hot_keys(edges.groupBy("i").agg(F.count("*").alias("n")), "i", edges.count())
    scores = fixed.where("fixed = 1").select("i", F.col("fixed").alias("score"))
    before = None
    for _ in range(rounds):
        heard = join_hot(edges, scores, "i", hot=hot_i).groupBy("c").agg((F.sum("score") / (F.first("size") + 1)).alias("trust"), F.count_if(F.col("score") >= CONFIDENCE).alias("support"))
        trusted = checkpoint(heard.where((F.col("support") >= SUPPORT) & (F.col("trust") >= CONFIDENCE)).select("c", "trust"))
        now = trusted.agg(F.count("*"), F.round(F.sum("trust"), 6)).first()
        if now == before:
            break
        before = now
        far = F.sum(F.log1p(-F.lit(DAMPING) * F.col("trust")))
        told = join_hot(edges, trusted, "c", hot=hot_c).groupBy("i").agg((1 - F.exp(far)).alias("score")).join(fixed, "i", "left_anti")
        scores = checkpoint(fixed.where("fixed = 1").select("i", F.col("fixed").alias("score")).unionByName(told))
    return patterns.join(trusted, "c").select("context", "kind", "trust")


def discover(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """The columns PLACE and added: spans that trusted patterns find; rows without any are missing.

    A candidate after a word that is trusted for two kinds goes to the more trusted one.
    """
    rows = found.select(*PLACE, F.explode("candidates").alias("x")).select(*PLACE, "x.*")
    by_word = patterns.groupBy("context").agg(F.collect_list(F.struct("trust", "kind")).alias("trusted"))  # a few kinds each
    able = F.filter("trusted", lambda p: F.array_contains(fitting(F.col("hit")), p["kind"]))
    one = join_hot(rows, by_word, "context").select(*PLACE, "start", "end", F.array_max(able)["kind"].alias("kind")).where("kind is not null")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    return one.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("added"))


def spans(docs: DataFrame) -> DataFrame:
    """PLACE, doc_id, base and spans (base and added) of each document: arrays of (start, rank, end, kind), in order."""
    found = stored(extract(docs), "spans")
    added = discover(found, induce(found))
    bare = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    base = found.select(*PLACE, "doc_id", bare.alias("base"))
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(base.schema["base"].dataType))))
    return base.join(added, list(PLACE), "left").select(*PLACE, "doc_id", "base", every.alias("spans"))


def listed(places: Column) -> Column:
    return F.array_join(F.transform(places, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; null texts stay null.

    Overlapping spans become one, named by the first. Texts meet their spans by their
    place in the files, which is the same in every scan.
    """
    source = located(docs)
    found = spans(source.select(*PLACE, F.lit(0).alias("doc_id"), F.col(text).alias("text"))).where(F.size("spans") > 0).select(*PLACE, F.col("spans").alias("__spans"))
    joined = source.join(found, list(PLACE), "left")
    out = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("__spans")))
    return joined.withColumn(text, out).select(*docs.columns)


def masked(text: Column, places: Column) -> Column:
    """The text with its spans masked; spans in order of start."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").cast("string").alias("out"))

    def step(state: Column, x: Column) -> Column:
        piece = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        inside = x["start"] < state["at"]
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], piece, F.lit("<"), x["kind"], F.lit(">"))).alias("out"))

    return F.aggregate(places, empty, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def query(docs: DataFrame) -> DataFrame:
    found = spans(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
