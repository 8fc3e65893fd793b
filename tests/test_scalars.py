import hashlib
import unicodedata
import uuid
from datetime import date

from pyspark.sql import functions as F

from tallyloom.functions import scalars as s


def column(spark, values, kind, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_emails_and_names_fold_like_python(spark):
    texts = [" 'A.b+x@GMAIL.com' ", "STRASSE@x.de", "Straße@x.de", "", None, "“Q”@y@googlemail.com", "no at", "Ä.Ö+1@gmail.com", "İ@x"]
    got = column(spark, texts, "string", s.norm_email(F.col("v")))
    assert [g[0] for g in got] == ["ab@gmail.com", "strasse@x.de", "strasse@x.de", None, None, "q”@y@googlemail.com", "no at", "äö@gmail.com", "i̇@x"]
    names = ["  O'Brien ", "Ａnn  Marie", "ÉLODIE", "ﬁona", "'", None, "ẞ x"]

    def plain(x):
        if x is None:
            return None
        x = "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c)).casefold()
        return " ".join("".join(c for c in x if c not in s.QUOTES).split()) or None

    assert [g[0] for g in column(spark, names, "string", s.norm_name(F.col("v")))] == [plain(n) for n in names]


def test_dates_enums_and_money(spark):
    assert [g[0] for g in column(spark, ["2012-02-03", "'2012-02-03'", "2012-2-3", "2012-02-30", "x", None], "string", s.norm_dob(F.col("v")))] == [date(2012, 2, 3), date(2012, 2, 3), None, None, None, None]
    assert column(spark, ["pre-k", "Kindergarten", "3rd", "Grade 12", "13", None], "string", s.norm_enum("grade", F.col("v")), s.grade_ord(s.norm_enum("grade", F.col("v")))) == [("PK", -1), ("K", 0), ("3", 3), ("12", 12), (None, None), (None, None)]
    assert column(spark, ["enrolled", "prospect", "x"], "string", s.funnel_ord(F.col("v"))) == [(4,), (0,), (None,)]
    assert column(spark, ["0.29", "1.005", "1.015", "x", "10", None], "string", s.cents_from_dollars(F.col("v"))) == [(29,), (100,), (102,), (None,), (1000,), (None,)]


def test_references_and_keys(spark):
    name = "appdb:student:1"
    got = column(spark, [["payments:payment:1", "crm:contact:9", name], ["payments:payment:1"]], "array<string>", s.anchor(F.col("v")), s.uuid5(s.anchor(F.col("v"))), s.sources_of(F.col("v")))
    assert got[0] == (name, str(uuid.uuid5(uuid.UUID(s.NAMESPACE), name)), ["appdb", "crm", "payments"])
    digest = hashlib.sha256(b"k").digest()
    assert column(spark, ["k"], "string", s.shard(F.col("v"))) == [(int.from_bytes(digest[:8], "big") % 2,)]
    assert column(spark, ["a:b:c:d"], "string", s.ref_part(F.col("v"), 2), s.ref("crm", "deal", F.lit("x\x01"))) == [("c:d", None)]
    keys = column(spark, ["x"], "string", s.match_keys(F.lit("e1"), [F.lit("a"), F.lit("a"), F.lit(None).cast("string")], F.lit("f"), F.lit("l"), F.lit(None).cast("date")))
    assert [(k.key_class, k.value) for k in keys[0][0]] == [("ext", "e1"), ("email", "a")]


def test_canonical_text_and_fingerprint(spark):
    assert column(spark, ["a\\b\x1fc", None], "string", s.canon(F.col("v"), "string")) == [("a\\\\b\\u001fc",), ("\\N",)]
    one = s.fingerprint(F.lit("C1"), F.array(F.lit("b"), F.lit("a")), F.array().cast("array<string>"), F.create_map(F.lit("y"), F.lit(None).cast("string"), F.lit("x"), F.lit("1")))
    want = hashlib.sha256(b"C1|a\x1fb||x=1\x1fy=\\N").hexdigest()
    assert column(spark, ["z"], "string", one) == [(want,)]
    assert [g[0] for g in column(spark, [None, "true", "120", "0", "crm:contact:1", "2020-01-01", "zz", "[1]"], "string", s.value_shape(F.col("v")))] == ["null", "bool", "num.1e2", "num.0", "ref", "date", "text", "list"]
