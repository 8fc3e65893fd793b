"""Redaction tokens, scrubbing of text and documents, retention windows."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import dims

#: The library's own salt; a deployment sets another.
SALT = "tallyloom"
#: Shapes that are taken for personal data wherever they stand, in order.
DETECTORS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("student_number", r"\bS-[0-9]{6}\b"),
    ("household", r"\bHH-[0-9]{6}\b"),
    ("date", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"),
)
#: Keys whose values may be shown; everything else is masked.
OPEN_KEYS = ("type", "status", "rule_id", "generation", "verdict", "reason", "source_id", "entity_type")


def shape(c: Column) -> Column:
    """Letters as a, digits as 9, a few marks as they are, the rest as ?; 24 characters at most."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(c, 1, 24), r"[^\p{L}0-9@.\-_+:/ ]", "?"), r"\p{L}", "a"), "[0-9]", "9")
    return x


def token(kind: str, c: Column, salt: str = SALT) -> Column:
    """[pii:kind:12 hex:shape], the same for equal values in any case; values that are tokens stay."""
    plain = F.lower(F.trim(c))
    made = F.concat(F.lit(f"[pii:{kind}:"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(salt), F.lit(kind), plain), 256), 1, 12), F.lit(":"), shape(plain), F.lit("]"))
    return F.when(c.startswith("[pii:"), c).otherwise(made)


def scrubbed(c: Column) -> Column:
    """Text with everything that a detector knows replaced by [pii:kind]."""
    for kind, pattern in DETECTORS:
        c = F.regexp_replace(c, pattern, f"[pii:{kind}]")
    return c


def redacted(doc: Column, salt: str = SALT) -> Column:
    """A map with closed keys' values as tokens and open keys' text scrubbed."""
    return F.transform_values(doc, lambda k, v: F.when(v.isNull(), v).when(k.isin(*OPEN_KEYS), scrubbed(v)).otherwise(token("value", v, salt)))


def without_known(c: Column, known: Column) -> Column:
    """Text in which values known from sibling fields are masked too, longest first."""
    order = F.reverse(F.array_sort(F.transform(F.filter(known, lambda v: F.length(v) >= 3), lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    return F.aggregate(order, c, lambda text, x: F.replace(text, x["v"], F.lit("[pii:known]")))


def audit_rows(events: DataFrame, salt: str = SALT) -> DataFrame:
    """Audit rows as they may be stored: bodies redacted, with the digest of what was redacted.

    events: id, ts, actor, action, subject, body (map). The one way into the audit table.
    """
    whole = F.array_join(F.array_sort(F.transform(F.map_entries("body"), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("\\N"))))), "\x1f")
    return events.withColumn("body_sha256", F.sha2(whole, 256)).withColumn("body", redacted(F.col("body"), salt)).withColumn("actor", F.when(F.col("actor").contains("@"), token("email", F.col("actor"), salt)).otherwise(F.col("actor")))


def sweep(tables: dict[str, DataFrame], now: Column, ts: str = "ts", key: str = "id") -> dict[str, DataFrame]:
    """Each table of the schedule with fate: keep, purge, anonymize or blocked.

    A table whose rows others depend on goes after them: rows that a dependent table
    still names (column ``parent``) are blocked. The dry run is these counts.
    """
    out = {}
    for name, days, action, first in dims.RETENTION:
        if name not in tables:
            continue
        df = tables[name]
        old = F.col(ts) < now - F.make_dt_interval(F.lit(days))
        fate = F.when(F.coalesce(old, F.lit(False)), action).otherwise("keep")
        if first in out and "parent" in out[first].columns:
            held = out[first].where("fate != 'purge'").select(F.col("parent").alias("__k")).distinct().withColumn("__held", F.lit(True))
            df = df.join(held, F.col(key) == F.col("__k"), "left").withColumn("fate", F.when((fate == "purge") & F.col("__held"), "blocked").otherwise(fate)).drop("__k", "__held")
        else:
            df = df.withColumn("fate", fate)
        out[name] = df
    return out


MAX_DEPTH = 16


def _token(kind: str, value: str, salt: str) -> str:
    """The same token as ``token`` makes in a plan."""
    if value.startswith("[pii:"):
        return value
    plain = value.strip(" ").lower()
    mark = hashlib.sha256("\x1f".join((salt, kind, plain)).encode()).hexdigest()[:12]
    kept = "".join("9" if c in "0123456789" else "a" if c.isalpha() else c if c in "@.-_+:/ " else "?" for c in plain[:24])
    return f"[pii:{kind}:{mark}:{kept}]"


def _walk(node, salt: str, known: tuple[str, ...], depth: int = 0):
    if depth > MAX_DEPTH:
        return "[pii:deep]"
    if isinstance(node, dict):
        closed = [v for k, v in node.items() if k not in OPEN_KEYS and isinstance(v, str) and len(v) >= 3]
        seen = tuple(sorted({*known, *closed}, key=lambda v: (-len(v), v)))
        return {k: _walk(v, salt, seen, depth + 1) if k in OPEN_KEYS or isinstance(v, (dict, list)) else (_token("value", v, salt) if isinstance(v, str) else None if v is None else "[pii:flag]") for k, v in node.items()}
    if isinstance(node, list):
        return [_walk(x, salt, known, depth + 1) if isinstance(x, (dict, list)) else _token("value", x, salt) if isinstance(x, str) else None if x is None else "[pii:flag]" for x in node]
    if isinstance(node, str):
        for value in known:
            node = node.replace(value, "[pii:known]")
        for kind, pattern in DETECTORS:
            node = re.sub(pattern, f"[pii:{kind}]", node)
    return node


def redacted_json(c: Column, salt: str = SALT) -> Column:
    """Nested documents as JSON text: closed keys become tokens at any depth, open text loses what siblings know.

    A walk has no built-in form, so this is an Arrow UDF. Text that is no JSON is masked whole.
    """

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                node = json.loads(text)
            except (ValueError, RecursionError):
                return _token("value", text, salt)
            return json.dumps(_walk(node, salt, ()), sort_keys=True, separators=(",", ":"))

        return texts.map(one)

    return run(c)
