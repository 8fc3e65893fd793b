import math
import random

from tallyloom.llm import topk_search as tk


def brute(rows, queries, k):
    def ints(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(1024 * x) for x in v]

    use = [(i, e) for i, v in rows if i is not None and (e := ints(v)) is not None]
    out = []
    for q, v in queries:
        if q is None or (e := ints(v)) is None:
            continue
        found = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in use if i != q and len(f) == len(e))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_equal_to_brute_force(spark):
    r = random.Random(9)
    rows = [(i, [r.choice([r.uniform(-2, 2), 0.0, 1.0, -0.5]) for _ in range(r.choice([6, 6, 6, 3]))]) for i in range(230)]
    rows += [(i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 340)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (600, []), (700, []), (800, [9.0]), (0, rows[0][1]), (900, [3e12, -2e9, 0.0, 0.0, 0.0, 0.0])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id block").repartition(3)
    for k, size in ((10, 64), (3, 1000), (1000, 16)):
        got = sorted(tuple(x) for x in tk.top_k(df, df.where("vec_id % 20 = 0"), k, size).collect())
        assert got == brute(rows, [x for x in rows if x[0] is not None and x[0] % 20 == 0], k)


def test_empty_table(spark):
    assert tk.query(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
