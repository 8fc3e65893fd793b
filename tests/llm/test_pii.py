import hashlib
import random
import re

from tallyloom.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        total = sum((2 * int(d) - 9 * (int(d) > 4)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    out = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if good(k, m.group()))
    return [f"{k}:{a}:{b}" for a, _, b, k in out]


def fuzz(seed):
    r = random.Random(seed)
    parts = ["a@b.c", "x.y+z@m-1.example.com", "@", ".", "..", "é", "😀", " ", "-", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "192.168.0.1", "999.1.1.1", "1.2.3.4.5", "0001.02.255.256", "+49 (170) 123-4567", "+1", "12", "7", "\n", "\x01", "word", "_d@e.f", "(", ")"]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 40)))


def test_base_spans_equal_the_patterns(spark):
    texts = [fuzz(i) for i in range(1500)] + [None, "", "a@b.c_d@e.f.@x.y", "4" * 3000, "1 " * 3000, "a." * 3000 + "@" + "b." * 3000 + "c", "+1" + " " * 5000, "x" * 100_000, "5 4111111111111111 " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a@b.c"), (3, texts[3])], "doc_id long, text string").selectExpr("*", "text base", "1 row").repartition(4)
    rows = pii.query(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = brute(texts[r.doc_id] if r.doc_id is not None else "a@b.c")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id or 0]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert not set(want) - set(r.spans.split(","))


def test_trusted_contexts_find_unseen_identifiers(spark):
    r = random.Random(4)
    rows = [(i, f"talk {i} with us, mobile: +49 170 {r.randint(1000000, 9999999)} or so. code {r.randint(100000, 999999)}") for i in range(30)]
    rows += [(100, "mobile: 0170 5556677 please"), (101, "number 0170 5556677 please"), (102, "é mobile: (0171) 222-3344."), (103, "see 30 mobile: x")]
    found = {x.doc_id: x.spans for x in pii.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == "phone:8:20" and found[102] == "phone:10:25"
    assert found[101] == found[103] == ""
    assert all(found[i].count(":") == 2 for i in range(30))


def test_redaction_keeps_columns_and_clean_texts(spark):
    rows = [(1, "mail a@b.cc now", "x"), (2, "nothing", None), (3, None, "y"), (4, "é: 4111111111111111 é 10.0.0.1", "z"), (1, "mail a@b.cc now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in pii.redact(df).collect()), key=str)
    want = [(1, "mail <email> now", "x"), (2, "nothing", None), (3, None, "y"), (4, "é: <card> é <ip>", "z"), (1, "mail <email> now", "x")]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.query(empty).count() == 0 and pii.redact(empty).count() == 0


def test_found_instances_induce_further_patterns(spark):
    """mobile: is learned from seeds; numbers found after it teach ring:, whose own numbers no seed ever had."""
    r = random.Random(7)
    plain = [f"0170 {r.randint(1000000, 9999999)}" for _ in range(30)]
    rows = [(i, f"mobile: +49 170 {r.randint(1000000, 9999999)} x") for i in range(100)]
    rows += [(100 + i, f"mobile: {p} x") for i, p in enumerate(plain)] + [(200 + i, f"ring: {p} x") for i, p in enumerate(plain)]
    rows += [(300, "ring: 0160 1112223 x"), (301, "other: 0160 1112223 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.query(df).collect()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for a, _, b, k in plain_spans(rows)[i]) for i, _ in rows}
    assert got[300] == "phone:6:18" and got[301] == "" and all(got[200 + i] for i in range(30))
    first = pii.stored(pii.extract(df), "spans")
    assert {x.context for x in pii.induce(first, 1).collect()} == {"mobile:"}


def plain_spans(rows):
    """The method of the module in plain Python, for texts whose candidates are plain words."""
    def context(before):
        words = before.split()
        return re.sub("[0-9]", "0", words[-1].lower()) if words else ""

    shapes = {k: re.compile(v.replace("++", "+")) for k, v in pii.FITS.items()}
    candidate = re.compile(pii.CANDIDATE.replace("++", "+"))
    base, able, edges = {}, {}, {}
    for i, text in rows:
        base[i] = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in p.finditer(text) if good(k, m.group()))
        able[i] = [m for m in candidate.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b, _ in base[i])]
        for a, _, b, k in base[i]:
            edges[context(text[:a]), text[a:b].lower(), k] = 1
        for m in able[i]:
            for k, p in shapes.items():
                if p.search(m.group()):
                    edges.setdefault((context(text[: m.start()]), m.group().lower(), k), 0)
    edges = {e: s for e, s in edges.items() if e[0]}
    seeds = {e[1:] for e, s in edges.items() if s}
    taken = {x for x, _ in seeds}
    size = {}
    for c, x, _ in edges:
        size.setdefault(c, set()).add(x)
    score, trust = dict.fromkeys(seeds, 1.0), {}
    for _ in range(pii.ROUNDS):
        heard = {}
        for c, x, k in edges:
            heard.setdefault((c, k), []).append(score.get((x, k), 0))
        trust = {ck: sum(v) / (len(size[ck[0]]) + 1) for ck, v in heard.items() if sum(s >= pii.CONFIDENCE for s in v) >= pii.SUPPORT}
        trust = {ck: t for ck, t in trust.items() if t >= pii.CONFIDENCE}
        score = dict.fromkeys(seeds, 1.0)
        for x, k in {e[1:] for e in edges if e[1] not in taken}:
            miss = 1.0
            for c in {e[0] for e in edges if e[1:] == (x, k)}:
                miss *= 1 - pii.DAMPING * trust.get((c, k), 0)
            score[x, k] = 1 - miss
    out = {}
    for i, text in rows:
        more = []
        for m in able[i]:
            best = max(((t, k) for (c, k), t in trust.items() if c == context(text[: m.start()]) and shapes[k].search(m.group())), default=None)
            if best:
                more.append((m.start(), list(BASE).index(best[1]), m.end(), best[1]))
        out[i] = sorted(base[i] + more)
    return out


def test_long_words_and_numbers_are_no_limit(spark):
    """Contexts, hosts and numbers may be of any length."""
    host, word = "h" * 300 + ".example", "w" * 70
    rows = [(i, f"{word} a{i}@{host} x") for i in range(8)] + [(50, f"{word} name(at){host} x"), (51, "1 2 " * 3000 + "x"), (52, "9" * 50_000 + " y")]
    got = {r.doc_id: r.spans for r in pii.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == f"email:71:{71 + 8 + len(host)}" and got[52] == ""


def test_redaction_with_scans_split_otherwise(spark, tmp_path):
    rows = [(i, f"t{i} mail a{i}@b.cc now" if i % 3 else f"nothing {i}") for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "d"))
    source = spark.read.parquet(str(tmp_path / "d"))
    masked = pii.redact(source.where("doc_id >= 0"))
    spark.conf.set("spark.sql.files.minPartitionNum", "50")
    try:
        got = {r.doc_id: r.text for r in masked.collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == {i: re.sub("a[0-9]+@b.cc", "<email>", t) for i, t in rows}
