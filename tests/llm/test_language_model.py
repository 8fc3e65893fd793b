import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import language_model as lm
from tallyloom.llm.shared import fold


def brute(rows, strengths=lm.STRENGTHS):
    split = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({x: " " for x in range(9, 14)}).split(" ") if w] + [None]
    train = [split(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    order = len(strengths) + 1
    grams = Counter(tuple((["<s>", *t])[max(0, i - k) : i + 1]) for t in train for i in range(1, len(t) + 1) for k in range(1, order) if k <= i)
    contexts = Counter()
    for g, k in grams.items():
        contexts[g[:-1]] += k
    n, v = sum(c.values()), len(c)

    def chance(w, h):
        if not h:
            return (c[w] + 1) / (n + v + 1)
        m = strengths[len(h) - 1]
        return (grams[(*h, w)] + m * chance(w, h[1:])) / (contexts[h] + m)

    out = []
    for i, t in rows:
        ws = split(t)
        base = [(c[w] + 1) / (n + v + 1) for w in ws]
        with_start = ["<s>", *ws]
        full = [chance(w, tuple(with_start[max(0, k + 1 - len(strengths)) : k + 1])) for k, w in enumerate(ws)]
        out.append((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(map(math.log10, base)), 6), round(sum(map(math.log10, full)), 6)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=str)


ROWS = [(i, f"The cat {i % 5} sat\ton the  mat é{i % 3}\n") for i in range(60)] + [(100, None), (101, ""), (102, "  "), (None, "the cat"), (7, "The cat again"), (7, "The cat again"), (103, "z" * 5000 + " the " * 3000), (2, "\x00</s> zz"), (104, "a b c d e " * 200)]


@pytest.mark.parametrize(("strengths", "block"), [((20.0,), 1 << 23), ((20.0, 4.0), 1 << 23), ((20.0, 4.0), 300), ((5.0, 3.0, 0.5), 1000)])
def test_scores_equal_a_plain_model(spark, strengths, block):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    scored = lm.score_texts(df, fold("doc_id", 7) == 2, len(strengths) + 1, strengths, block)
    assert got(scored) == brute(ROWS, strengths)


def test_query_with_scans_split_otherwise(spark, tmp_path):
    rows = [(i, f"w{i % 13} the cat {i % 7} sat " * (i % 9)) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "d"))
    out = lm.query(spark.read.parquet(str(tmp_path / "d")))
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "40")
    try:
        assert got(out) == brute(rows, lm.STRENGTHS[: lm.ORDER - 1])
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)


def test_sentinels_are_no_words():
    raw = "\x00</s> \n</s> <s>".encode()
    word, _, _ = lm.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert (word == lm.END).tolist() == [False, False, False, True] and lm.START not in word


def test_empty_table(spark):
    assert lm.query(spark.createDataFrame([], "doc_id long, text string, block string")).count() == 0
