import random

import numpy as np
import pyarrow as pa

from tallyloom.llm import language_id as li
from tallyloom.llm import toxicity as tx

WORDS = {"en": "the and of thing water house ing".split(), "fr": "le les été où garçon eau maison".split(), "de": "der und straße über haus wasser".split()}


def corpus(n=240):
    r = random.Random(1)
    return [(i, " ".join(r.choices(WORDS[lang := list(WORDS)[i % 3]], k=30)), lang) for i in range(n)]


def test_language_id_held_out_accuracy_and_odd_rows(spark):
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", None), (903, "the water of the house", None), (None, "les garçon été", "fr"), (904, "the " * 50_000, "en"), (904, "the " * 50_000, "en")]
    df = spark.createDataFrame(corpus() + odd, "doc_id long, text string, lang string").selectExpr("*", "lang score")
    rows = li.query(df).collect()
    assert len(rows) == 247
    by = {r.doc_id: r for r in rows}
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and all(r.lang_pred == list(WORDS)[r.doc_id % 3] for r in held)
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert by[903].lang_pred == "en" and by[None].lang_pred == "fr" and by[904].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_without_anything_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.query(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in li.query(unlabelled).collect()] == [("und", 0.0)]


def test_a_text_is_predicted_alike_in_any_batch():
    texts = ["the water", "été où", "straße", "x"]
    alone = [next(iter(li.vectors(pa.array([t])))) for t in texts]
    for a, b in zip(alone, li.vectors(pa.array(texts)), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    whole = tx.bag(*tx.utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        assert sorted(whole[0][whole[1] == i]) == sorted(tx.bag(*tx.utf8(pa.array([t])))[0])


def test_empty_and_null_texts_change_nothing_around_them():
    texts = ["the water", "", "été où", None, "", "x", "straße"]
    alone = [next(iter(li.vectors(pa.array([t], pa.string())))) for t in texts]
    for tail in ([""], [None], ["", None], [None, ""]):
        together = list(li.vectors(pa.array(["", *texts, *tail], pa.string())))
        assert len(together) == 1 + len(texts) + len(tail)
        for a, b in zip(alone, together[1:], strict=False):
            assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_language_id_of_batches_that_end_in_empty_or_null_texts(spark):
    rows = corpus() + [(900, "", "en"), (901, None, "en")]
    for tail in (rows, rows[:-1]):
        df = spark.createDataFrame(tail, "doc_id long, text string, lang string").coalesce(1)
        got = {r.doc_id: r.lang_pred for r in li.query(df).collect()}
        assert got[900] == "und" and len(got) == len(tail)
        assert sum(got[i] == lang for i, _, lang in corpus()) >= 235


def toxic_corpus(n=600):
    r = random.Random(2)
    out = []
    for i in range(n):
        words = ["".join(r.choices(["ba", "do", "ri", "ne", "su", "ta"], k=3)) for _ in range(60)]
        if i % 3 == 0:
            for _ in range(4):
                words[r.randrange(60)] = r.choice(["wretch", "vilescum", "wretched", "vilescumm"])
        out.append((i, " ".join(words), int(i % 3 == 0)))
    return out


def test_toxicity_held_out_accuracy_misspellings_and_odd_rows(spark):
    rows = toxic_corpus()
    odd = [(900, None), (901, ""), (902, "?!"), (903, " ".join(["bado rine"] * 10 + ["wretchh vilescun"] * 2)), (905, "bado rine " * 20_000), (905, "bado rine " * 20_000), (None, "bado")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string").selectExpr("*", "text score")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (900, None), (901, 5), (0, 1)], "doc_id long, toxic int")
    got = tx.query(docs, labels).collect()
    assert len(got) == 607 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    wrong = sum((r.score >= 0.5) != (r.doc_id % 3 == 0) for r in held)
    assert wrong <= 0.02 * len(held)
    by = {r.doc_id: r.score for r in got}
    assert by[903] > 0.5 > by[905]
    assert by[900] == by[901] == by[902]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in tx.query(docs, none).collect()] == [0]
    assert tx.query(docs.limit(0), none).count() == 0


def test_characters_are_code_points():
    texts = ["aé日😀", "", "z", "ß"]
    points, _, offsets = li.characters(*li.utf8(pa.array(texts)))
    assert points.tolist() == [ord(c) for t in texts for c in t] and offsets.tolist() == [0, 4, 4, 5, 6]


def test_every_language_is_learned_however_many(spark, monkeypatch):
    monkeypatch.setattr(li, "WEIGHTS", 1 << 18)
    r = random.Random(5)
    stems = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzéßжд日", k=6)) for _ in range(260)]
    rows = [(i, f"{stems[i % 260]} " * 8, f"x{i % 260:03d}") for i in range(1040)]
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 260 and model.weights.size <= 1 << 18
    names, _ = model.predict(pa.array([t for _, t, _ in rows[:260]]))
    assert sum(a == b for a, (_, _, b) in zip(names, rows, strict=False)) >= 250


def test_conflicting_labels_of_one_id(spark):
    rows = toxic_corpus(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, y) for i, _, y in rows]
    one = spark.createDataFrame(labels, "doc_id long, toxic int")
    more = spark.createDataFrame(labels + [(i, 0) for i, y in labels if y], "doc_id long, toxic int").repartition(5)
    a, b = ({r.doc_id: r.score for r in tx.query(docs, x).collect()} for x in (one, more))
    assert a == b
