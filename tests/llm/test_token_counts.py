import random

import public_tokenizers
from tokenizers import Tokenizer

from tallyloom.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's we'll !'s ''s 's's don't", "<|startoftext|> a<|endoftext|>b <|endof", "ΑΣ Σ İstanbul ǅ é", "１２3 ½", "日本 😀👍🏽", "", "  ", "\x00\x01a", "'", "aaaa" * 50, "!!!???" * 30]


def expected(texts):
    return [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("abeinorst'  !.éΣ'12") for _ in range(rnd.randint(1, 60))) for _ in range(2000)]
    assert tc.count_texts(PATH, texts) == expected(texts)


def test_chunk_maps_compose_to_the_same_count():
    tc.count_texts(PATH, ["x"])
    machine = tc._MACHINES[PATH]
    for text in ODD:
        if "<|" not in text:
            whole = tc.count_texts(PATH, [text])[0]
            assert all(tc.count_normalised(machine, [tc.normalise(text)], n)[0] == whole for n in (1, 2, 3, 7))


def test_maps_are_functions_of_the_state():
    """Composition is associative and equals applying the maps one after another."""
    tc.count_texts(PATH, ["x"])
    machine, rnd = tc._MACHINES[PATH], random.Random(8)
    for _ in range(200):
        a, b, c = tc.state_maps(machine, ["".join(rnd.choice("abs' é1!") for _ in range(rnd.randint(0, 9))) for _ in range(3)])
        one = lambda x, y: tc.compose(machine, [(x, y)])[0]
        assert one(one(a, b), c) == one(a, one(b, c))
        word, n = "wor", 0
        for m in (a, b, c):
            word, more = m.apply(machine, word)
            n += more
        assert one(one(a, b), c).apply(machine, "wor") == (word, n)


def test_long_texts_and_full_tables(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdeé'1") for _ in range(rnd.randint(1, 12))) for _ in range(5000)]
    texts = [" ".join(rnd.choices(words, k=40_000)), "x" * 150_000 + " y", "<|endoftext|>" + "ab " * 60_000, " " * 200_000]
    assert max(map(len, texts)) > 3 * tc.CHUNK
    want = expected(texts)
    monkeypatch.setattr(tc, "TABLE", 100)
    tc._MACHINES.clear()
    assert tc.count_texts(PATH, texts) == want == tc.count_texts(PATH, texts)
    tc._MACHINES.clear()
    rows = tc.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert [r.n_tokens for r in sorted(rows)] == want


def test_query_handles_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "hello world", None), (4, "a b", "z"), (4, "a b", "z")], "doc_id long, text string, n_tokens string")
    rows = sorted(tc.query(docs, PATH, 1).collect(), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows), key=str) == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 11, 2, True), (4, 3, 2, True), (4, 3, 2, True)], key=str)
    assert tc.query(docs.limit(0), PATH).count() == 0
