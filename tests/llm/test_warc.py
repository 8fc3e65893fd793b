import hashlib

from tallyloom.llm import warc
from tallyloom.llm.shared import temporary

LONG = "<p>x</p>" * 40
TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 5 + "é\x00\n"
ROWS = [(3, "http://a/", LONG), (1, "http://b/ c", LONG), (2, None, TRICKY), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", TRICKY), (9, "u", "z" * 300_000), (10, "x\ny", LONG), (None, "n", LONG)]


def test_round_trip_and_revisits(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "html as digest").repartition(3)
    got = {r.page_id: r for r in warc.query(df).collect()}
    assert len(got) == len(ROWS)
    for page, _, html in ROWS:
        data = (html or "").encode()
        first = min((p for p, _, h in ROWS if p is not None and h == html), default=None) if len(data) >= 100 else page
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == page else ("revisit", first))


def test_repeated_rows_and_payloads(spark):
    rows = [(1, "a", LONG), (1, "a", LONG), (1, "b", "tiny"), (1, "b", "tiny")]
    path = temporary(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = warc.records(spark, path)
    assert found.count() == 12
    t = warc.transactions(found).collect()
    assert sorted(x.response.kind for x in t) == ["response", "response", "response", "revisit"]
    assert sorted(bytes(x.response.payload).decode() for x in t if x.response.kind == "response") == sorted([LONG, "tiny", "tiny"])
    assert all(x.request.target == x.response.target and x.metadata.fields["page_id"] == "1" for x in t)


def test_many_marks_go_through_the_bitmap(spark, monkeypatch):
    rows = [(i, f"u{i}", f"{i % 40} {LONG}" if i % 2 else f"{i} {LONG}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = sorted(map(tuple, warc.query(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 10)
    assert sorted(map(tuple, warc.query(df).collect())) == want
    asked = warc._maybe(df.selectExpr("page_id", "sha2(html, 256) digest"), df.where("page_id % 2 = 1").selectExpr("page_id of", "sha2(html, 256) payload"), 1500)
    found = {r.page_id for r in asked.where("maybe").collect()}
    assert found >= set(range(1, 3000, 2)) and len(found) < 1700


def test_empty_table(spark):
    assert warc.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_size_classes(spark, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", ((10, 2), (100, 1), (1 << 31, 1)))
    rows = [(i, "u", "x" * n) for i, n in enumerate((0, 5, 10, 11, 99, 150, 150, 2000))]
    path = temporary(spark, "warc-sizes")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    assert files.count() == 2 + 2 + 3
    t = warc.transactions(warc.records(spark, path)).collect()
    assert sorted((x.metadata.fields["page_id"], x.response.kind) for x in t) == [(str(i), "revisit" if i == 6 else "response") for i in range(8)]
