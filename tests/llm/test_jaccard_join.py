import random

import numpy as np
import pytest

from tallyloom.llm import jaccard_join as jj


def sets(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({x: " " for x in range(9, 14)}).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    s = [(i, sets(t)) for i, t in rows]
    group = list(range(len(s)))
    find = lambda x: x if group[x] == x else find(group[x])
    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                group[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(s):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, len(x), least.get(find(a)) if x else i) for a, (i, x) in enumerate(s)), key=str)


def corpus(seed=0, groups=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    line = [word() for _ in range(12)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([1, 2, 5, 6, 7, 8, 9, 11, 14, 20, 60, 200]))]
        if g % 4 == 0:
            base += line
        for _ in range(r.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                copy = copy[: max(1, len(copy) - 2)]
            rows.append((len(rows) * 7 % 1000, " ".join(copy).title() if r.random() < 0.3 else "\t".join(copy)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (rows[1][0], rows[1][1]), (6000, "x"), (6001, "X"), (6002, "word " * 9000)]


@pytest.mark.parametrize(("seed", "limit", "boundary"), [(0, jj.GROUP_SHINGLES, None), (1, 60, None), (2, jj.GROUP_SHINGLES, 0), (3, 200, 12)])
def test_components_equal_brute_force(spark, seed, limit, boundary):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as class").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(df, limit, boundary).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert jj.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_group_join_equals_all_pairs():
    r = np.random.default_rng(4)
    for _ in range(60):
        base = r.integers(0, 1 << 60, 40, dtype=np.uint64)
        sets_ = [np.unique(np.concatenate((r.choice(base, r.integers(20, 40), replace=False), r.integers(0, 1 << 60, r.integers(0, 6), dtype=np.uint64)))) for _ in range(r.integers(2, 30))]
        sizes = np.array([len(x) + int(r.integers(0, 3)) for x in sets_])
        label = jj.join_group(sizes, sets_)
        want = np.arange(len(sets_))
        for a in range(len(sets_)):
            for b in range(a):
                if 7 * len(np.intersect1d(sets_[a], sets_[b])) >= 3 * (sizes[a] + sizes[b]):
                    want[want == want[a]] = want[b]
        assert len(set(zip(label.tolist(), want.tolist()))) == len(set(label.tolist())) == len(set(want.tolist()))
