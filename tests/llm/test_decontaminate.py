import random

import numpy as np

from tallyloom.llm import decontaminate as dc


def word(r):
    return "".join(r.choices("abcdefghij", k=5))


def world(n_items=40):
    r = random.Random(8)
    common = [word(r) for _ in range(30)]
    prose = lambda n: [r.choice(common) if r.random() < 0.4 else word(r) for _ in range(n)]
    items = [(i, " ".join(prose(r.randint(15, 60)))) for i in range(n_items)]
    docs, truth = [], set()
    for d in range(150):
        words = prose(r.choice([5, 40, 120, 700]))
        if d % 3 == 0:
            i = r.randrange(n_items)
            passage = items[i][1].split()
            if d % 6 == 0:  # a paraphrase: some words replaced, one left out
                for _ in range(len(passage) // 8):
                    passage[r.randrange(len(passage))] = word(r)
                del passage[r.randrange(len(passage))]
            at = r.randrange(len(words))
            words[at:at] = [w.upper() if r.random() < 0.2 else w for w in passage]
            truth.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, items, truth


def test_leaks_are_found_and_clean_texts_left_alone(spark):
    docs, items, truth = world()
    odd = [(900, None), (901, ""), (902, "\n"), (None, items[3][1]), (903, "x " * 30_000 + items[4][1]), (904, items[5][1]), (904, items[5][1])]
    more = [(100, None), (101, ""), (102, items[0][1]), (103, "tiny one"), (None, "a b c")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "text leaks", "1 item_id").repartition(3)
    got = [(r.doc_id, r.item_id) for r in dc.query(df, spark.createDataFrame(items + more, "item_id long, text string").selectExpr("*", "1 chunk")).collect()]
    want = truth | {(None, 3), (903, 4), (904, 5)} | {(d, 102) for d, i in truth if i == 0}
    assert set(got) == want and got.count((904, 5)) == 2


def test_several_chunks_and_answers(spark, monkeypatch):
    docs, items, truth = world(12)
    found = dc.passages(spark.createDataFrame(items, "item_id long, text string"))
    assert found.count() == 12 + sum(len(t.split()) > 64 for _, t in items)
    answered = spark.createDataFrame([(i, t, "nowhere" if i % 2 else t.split()[2]) for i, t in items], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in dc.query(spark.createDataFrame(docs, "doc_id long, text string"), answered).collect()}
    assert got <= truth and {i for _, i in got} and not any(i % 2 for _, i in got)


def test_svd_spans_the_passages(spark):
    docs, items, _ = world(20)
    idf = dc.document_frequencies(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = dc.passages(spark.createDataFrame(items, "item_id long, text string"))
    words = [np.frombuffer(r.words, np.uint64) for r in rows.collect()]
    at, dense = dc._matrix([dc.weights(w, idf) for w in words])
    for rank in (4, 20):
        basis = dc.randomised_svd(rows.select("words"), spark.sparkContext.broadcast(idf), rank)
        kept = np.linalg.norm(dense @ dc.rows_of(basis, at)) ** 2
        best = (np.linalg.svd(dense, compute_uv=False)[:rank] ** 2).sum()
        assert 0.9 * best <= kept <= 1.001 * best


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.query(docs.limit(0), items).count() == 0
    assert dc.query(docs, items.limit(0)).count() == 0
    assert dc.query(docs, items).count() == 1


def test_lcs_equals_the_table_method():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 40))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert dc.lcs(a, b) == t[-1][-1]


def test_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(dc, "CHUNK", 2)
    docs, items, truth = world(24)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.query(df, bench).collect()} == truth


def test_a_passage_that_a_third_of_the_documents_hold(spark):
    r = random.Random(4)
    fresh = lambda n: ["".join(r.choices("klmnopqrst", k=9)) for _ in range(n)]
    passage, others = fresh(15), [(i, " ".join(fresh(30))) for i in range(1, 20)]
    docs = []
    for d in range(300):
        words, copy = fresh(120), list(passage)
        if d % 9 == 0:  # each third word replaced, so that no run of three is left
            for i in range(d // 9 % 3, 15, 3):
                copy[i] = fresh(1)[0]
        if d % 3 == 0:
            at = r.randrange(100)
            words[at:at] = copy
        docs.append((d, " ".join(words)))
    items = spark.createDataFrame([(0, " ".join(passage)), *others], "item_id long, text string")
    got = {x.doc_id: x.overlap for x in dc.query(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert {d for d, overlap in got.items() if overlap == 1} == {d for d in range(0, 300, 3) if d % 9}
    assert all(d % 3 == 0 for d in got)
    changed = [d for d in range(0, 300, 9) if d in got]
    assert changed and all(got[d] == 10 / 15 for d in changed)


def searched(index, texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    return {(d, x["item_id"]) for d, xs in index.search(raw, np.cumsum([0, *(len(t) for t in texts)])).items() for x in xs}


def test_candidates_equal_all_pairs_and_recall_by_cosine_alone(spark, monkeypatch):
    docs, items, truth = world()
    (model,), = dc.indexes(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "text")
    index, texts = model.value, [t for _, t in docs]
    assert index.vectors.shape[1] == dc.rank_of(len(index.items)) < len(index.items)
    found = searched(index, texts)
    monkeypatch.setattr(dc.Index, "shared", lambda self, words, rows, cut: np.zeros((0, 2), np.int64))
    by_cosine = searched(index, texts)
    changed = {(d, i) for d, i in truth if d % 6 == 0}
    assert len(by_cosine & changed) >= 0.9 * len(changed) and by_cosine <= found
    # Every window against every passage: no candidate search at all.
    monkeypatch.setattr(dc, "COSINE", -1e9)
    assert searched(index, texts) == found == truth


def test_more_chunks_than_a_pass_takes(spark, monkeypatch):
    docs, items, truth = world(30)
    df = spark.createDataFrame(docs + [(904, items[5][1])] * 2, "doc_id long, text string").repartition(3)
    rows = spark.createDataFrame(items + items, "item_id long, text string")
    whole = sorted((r.doc_id, r.item_id, r.overlap) for r in dc.query(df, rows).collect())
    monkeypatch.setattr(dc, "CHUNK", 8)
    monkeypatch.setattr(dc, "TOGETHER", 2)
    assert sorted((r.doc_id, r.item_id, r.overlap) for r in dc.query(df, rows).collect()) == whole
    assert dc.annotate(df, rows).columns == ["doc_id", "text", "leaks"] and {(d, i) for d, i, _ in whole} == truth | {(904, 5)}
