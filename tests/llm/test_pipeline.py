import random
import re

import public_tokenizers
import sentencepiece

import corpus_pipeline as cp
from tests.llm.test_jaccard_join import brute


def test_pipeline_against_plain_versions(spark, tmp_path):
    r = random.Random(12)
    words = {"en": "the and of thing water house ing light".split(), "fr": "le les été où garçon eau maison lumière".split()}
    prose = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "s", "a", "er", "on"]) + r.choice(["", "ba", "du", "mi"]) for _ in range(n))
    items = [(i, prose("en", 30)) for i in range(6)]
    rows = [(i, prose(lang, r.choice([20, 60, 150])), lang, "s", 0) for i in range(120) for lang in [["en", "fr"][i % 2]]]
    leaks = {200 + i: items[i % 6][1] for i in range(4)}
    rows += [(k, prose("en", 40) + " " + t + " " + prose("en", 30), "en", "s", 0) for k, t in leaks.items()]
    rows += [(300 + i, rows[i][1], "en", "t", 0) for i in range(10)] + [(310, rows[3][1] + " extra", "fr", "t", 0), (5, rows[5][1], "fr", "t", 0)]
    rows += [(400, "12 !! 34", "en", "u", 0), (401, None, None, "u", 0), (402, "", "fr", "u", 0), (403, "the house mail x.y@a.example and water", "en", None, 0), (None, "the light of water", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    text = [(i, t) for i, t, *_ in rows if t and re.search("[^\\W\\d]", t)]
    comp = {}
    for (i, _, c) in brute(text):
        comp.setdefault(c, i)
    want = {i for i, _, c in brute(text) if i == c} | {None}
    want -= set(leaks)
    assert sorted((x.doc_id for x in got), key=str) == sorted(want, key=str)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    by = {i: t for i, t, *_ in rows}
    by[403] = "the house mail <email> and water"
    assert all(x.ids == model.encode(by[x.doc_id]) and x.n_pieces == len(x.ids) for x in got)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema and out.count() == 0
    assert cp.encoded(spark, docs, str(tmp_path)).count() == 0
