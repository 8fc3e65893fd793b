"""Normalisers, references, money, canonical values and fingerprints.

All run inside the JVM, except Unicode folding of non-ASCII text, for which Spark
has no function: ``folded`` sends only those values through an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import dims

#: Fixed value: the quote characters that normalisers take off.
QUOTES = "'\"`‘’“”"
FIELD_SEP, ITEM_SEP = "\x1f", "\x1e"
NULL_TOKEN = "\\N"
#: Namespace of person keys; any fixed UUID serves, this one is the library's own.
NAMESPACE = "5b6f0c52-4c0e-5d53-9a3c-7a1f9d2f8e11"


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def stripped(c: Column) -> Column:
    """Without white space and one layer of surrounding quotes."""
    space = r"[\s\u001c-\u001f\u0085   -     　]+"
    bare = lambda x: F.regexp_replace(x, f"^{space}|{space}$", "")
    return bare(F.regexp_replace(bare(c), f"^[{QUOTES}]+|[{QUOTES}]+$", ""))


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        parts = unicodedata.normalize("NFKD", x.casefold())
        return "".join(c for c in parts if not unicodedata.combining(c)).casefold()

    return s.map(one)


def _ascii_else(c: Column, udf) -> Column:
    plain = c.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, F.lower(c)).otherwise(udf(F.when(~plain, c)))


def casefolded(c: Column, unicode: bool = True) -> Column:
    return _ascii_else(c, _casefold) if unicode else F.lower(c)


def folded(c: Column, unicode: bool = True) -> Column:
    return _ascii_else(c, _fold) if unicode else F.lower(c)


def norm_email(c: Column, unicode: bool = True) -> Column:
    """Stripped and case-folded; for two providers without dots and plus tags. Empty is null."""
    x = casefolded(stripped(c), unicode)
    domain = F.substring_index(x, "@", -1)
    local = F.substring(x, F.lit(1), F.length(x) - F.length(domain) - 1)
    short = F.regexp_replace(F.substring_index(local, "+", 1), r"\.", "")
    return empty_to_null(F.when(x.contains("@") & domain.isin("gmail.com", "googlemail.com"), F.concat(short, F.lit("@"), domain)).otherwise(x))


def norm_name(c: Column, unicode: bool = True) -> Column:
    """Folded, without quotes or combining marks, single spaces. Empty is null."""
    x = F.regexp_replace(folded(c, unicode), f"[{QUOTES}]", "")
    return empty_to_null(F.trim(F.regexp_replace(x, r"\s+", " ")))


def norm_dob(c: Column) -> Column:
    """A date in exactly the form YYYY-MM-DD, else null."""
    x = stripped(c)
    return F.when(x.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(x, "yyyy-MM-dd"))


def variant_key(c: Column) -> Column:
    """The form under which spellings of one vocabulary entry meet: folded, without quotes, spaces, hyphens and underscores."""
    return F.regexp_replace(F.regexp_replace(folded(c), f"[{QUOTES}]", ""), r"[\s\u001c-\u001f\u0085\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000_\-]+", "")


def _vocabulary(values, aliases: dict[str, str] | None = None) -> dict[str, str]:
    key = lambda v: "".join(x for x in v.lower() if x not in " _-")
    return {key(v): v for v in values} | {key(k): v for k, v in (aliases or {}).items()}


#: Other spellings that sources use.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth")
GRADE_ALIASES = {"prek": "PK", "prekindergarten": "PK", "kg": "K", "kindergarten": "K", "grade k": "K"}
for _n, _word in enumerate(ORDINALS, 1):
    _short = f"{_n}{ {1: 'st', 2: 'nd', 3: 'rd'}.get(_n, 'th') }"
    GRADE_ALIASES |= {f"{p}{x}": str(_n) for p, x in (("grade ", str(_n)), ("", _short), ("", _word), ("grade ", _short), ("grade ", _word))}
VOCABULARIES = {
    "grade": _vocabulary(dims.GRADE_ORDER, GRADE_ALIASES),
    "program": _vocabulary(dims.PROGRAMS),
    "stage": _vocabulary(dims.FUNNEL),
    "deal_stage": _vocabulary(dims.DEAL_STAGES),
    "status": _vocabulary(dims.STATUSES),
    "lifecycle": _vocabulary(dims.LIFECYCLES),
    "state": _vocabulary(dims.STATES, {name: code for code, name in dims.STATES.items()}),
    "payment_type": _vocabulary(dims.PAYMENT_TYPES),
    "payment_status": _vocabulary(dims.PAYMENT_STATUSES),
}


def norm_enum(field: str, c: Column) -> Column:
    """The committed entry that a spelling stands for; null if there is none. Unknown fields raise."""
    if field not in VOCABULARIES:
        raise KeyError(field)
    return dims.lookup(variant_key(c), VOCABULARIES[field])


def grade_ord(grade: Column) -> Column:
    return dims.lookup(grade, dims.GRADE_ORDER).cast("int")


def funnel_ord(stage: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, dims.FUNNEL)), stage), F.lit(0)).cast("int") - 1


def cents_from_dollars(text: Column) -> Column:
    """Whole cents of a decimal dollar text, half to even; null if it is no number."""
    return F.bround(text.try_cast("decimal(24,6)") * 100, 0).cast("long")


def micro_usd(cents: Column) -> Column:
    return cents * F.lit(10000).cast("long")


def ref(source: str, entity: str, key: Column) -> Column:
    """source:entity:key; keys with control characters have none."""
    return F.when(~key.rlike(r"[\x00-\x1f\x7f]"), F.concat_ws(":", F.lit(source), F.lit(entity), key))


def ref_part(c: Column, part: int) -> Column:
    """Source (0), entity (1) or key (2) of a reference; keys may hold colons."""
    return F.try_element_at(F.split(c, ":", 3), F.lit(part + 1))


def sources_of(refs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(refs, lambda r: ref_part(r, 0))))


def is_identity(c: Column) -> Column:
    return c.startswith("crm:contact:") | c.startswith("appdb:student:")


def anchor(refs: Column) -> Column:
    """The ref that names a person: students before contacts before payments, then in byte order."""
    rank = lambda r: F.when(r.startswith("appdb:student:"), 0).when(r.startswith("crm:contact:"), 1).when(r.startswith("payments:payment:"), 2).otherwise(3)
    return F.array_min(F.transform(refs, lambda r: F.struct(rank(r).alias("rank"), r.alias("ref"))))["ref"]


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5, from SHA-1 of namespace and name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def shard(key: Column, shards: int = 2) -> Column:
    """Tenant shard: the first eight bytes of sha256 as a number, modulo the shards."""
    number = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit(shards).cast("decimal(20,0)")).cast("int")


def escaped(c: Column) -> Column:
    """Text of which separators can't be mistaken for content; backslash first."""
    x = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(x, F.lit(FIELD_SEP), F.lit("\\u001f")), F.lit(ITEM_SEP), F.lit("\\u001e"))


def canon(c: Column, kind: str) -> Column:
    """Canonical text of a value; floats have none. kind: string, boolean, long, date, timestamp, array."""
    if kind in ("float", "double"):
        raise TypeError("floating-point values have no canonical text")
    if kind == "array":
        text = F.concat(F.lit(ITEM_SEP), F.array_join(F.array_sort(F.transform(c, escaped)), ITEM_SEP), F.lit(ITEM_SEP))
    elif kind == "date":
        text = F.date_format(c, "yyyy-MM-dd")
    elif kind == "timestamp":
        text = F.date_format(F.date_trunc("second", c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        text = escaped(c.cast("string"))
    return F.coalesce(text, F.lit(NULL_TOKEN))


def fingerprint(kind: Column, refs: Column, fields: Column, values: Column) -> Column:
    """sha256 over type, refs, fields and observed values; order of the inputs doesn't matter.

    Separators inside refs, fields and values are escaped, and null differs from every text.
    """
    listed = lambda a: F.array_join(F.array_sort(F.transform(F.coalesce(a, F.array().cast("array<string>")), escaped)), FIELD_SEP)
    # Lists come as canonical text, of which the items are escaped; all else is escaped here.
    text = lambda e: F.coalesce(F.when(e["key"].isin(*dims.LIST_VALUES), e["value"]).otherwise(escaped(e["value"])), F.lit(NULL_TOKEN))
    entries = F.array_sort(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,string>"))))
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), text(e)))
    return F.sha2(F.concat_ws("|", kind, listed(refs), listed(fields), F.array_join(pairs, FIELD_SEP)), 256)


def row_hash(source: Column, entity: Column, key: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws(FIELD_SEP, source, entity, key, payload), 256)


def match_keys(ext: Column, emails: list[Column], first: Column, last: Column, dob: Column) -> Column:
    """Distinct (key_class, value) in order: hard id, emails, name with date of birth if all of it is there."""
    pair = lambda k, v: F.when(v.isNotNull(), F.struct(F.lit(k).alias("key_class"), v.alias("value")))
    whole = F.when(first.isNotNull() & last.isNotNull() & dob.isNotNull(), F.concat_ws(FIELD_SEP, first, last, F.date_format(dob, "yyyy-MM-dd")))
    return F.array_distinct(F.array_compact(F.array(pair("ext", ext), *(pair("email", e) for e in emails), pair("namedob", whole))))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def l2_normalised(a: Column) -> Column:
    size = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(size > 0, F.transform(a, lambda v: v.cast("double") / size)).otherwise(a.cast("array<double>"))


def quantised(c: Column, places: int = 4) -> Column:
    return F.bround(c, places)


def clamped(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def magnitude(c: Column) -> Column:
    """Size bucket of a number: its sign-free power of ten."""
    return F.when(c == 0, "num.0").otherwise(F.concat(F.lit("num.1e"), F.floor(F.log10(F.abs(c.cast("double")))).cast("string")))


def value_shape(c: Column) -> Column:
    """What kind of thing a text value is, without the value."""
    return (
        F.when(c.isNull(), "null")
        .when(c.isin("true", "false"), "bool")
        .when(c.rlike(r"\A-?[0-9]{1,18}(\.[0-9]{1,18})?\z"), magnitude(c.try_cast("double")))
        .when(c.rlike(r"\A\[.*\]\z"), "list")
        .when(c.rlike(r"\A\{.*\}\z"), "map")
        .when(c.rlike(r"\A\[?pii:"), "pii")
        .when(c.rlike(r"\A(crm|appdb|payments):[a-z]+:"), "ref")
        .when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date")
        .otherwise("text")
    )
