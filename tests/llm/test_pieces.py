import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from tallyloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  Hello   wörld\n\ntab\tx  ", "\n", " \n  \n", "a▁b", "\x00a", "ﬁ ① Ａ 日本 😀👍🏽", "x" + " " * 40 + "y" + " " * 15, " " * 300, "</s> <0x41>", "the" * 400]


def test_ids_equal_the_library_and_texts_come_back():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(6)
    texts = ODD + ["".join(r.choice("abeinorst  \n.,éΣ1") for _ in range(r.randint(1, 80))) for _ in range(1500)]
    codec = pieces.Codec(PATH)
    for part in (texts[:700], texts[700:], texts):
        flat, offsets = codec.encode(part)
        for text, a, b in zip(part, offsets[:-1], offsets[1:], strict=True):
            assert flat[a:b].tolist() == model.encode(text), text
        assert codec.decode(flat, offsets) == [model.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "abc"), (1, " ")]
    got = sorted(pieces.query(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text ids").repartition(2), PATH).collect(), key=str)
    want = [(i, len(x := model.encode(t or "")), hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest(), "▁" not in (t or "")) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = pieces.decode(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH), PATH).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") and r.ids == model.encode(r.text or "") for r in back)
    assert pieces.query(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def segmentations(word, by_text):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in by_text:
            yield from ([by_text[word[:n]], *rest] for rest in segmentations(word[n:], by_text))


def test_unigram_paths_have_the_best_score():
    r = random.Random(11)
    texts = ["▁", "a", "b", "c", "▁a", "ab", "abc", "bc", "▁ab", "ca", "cab", "\n", "▁▁"]
    pieces = {300 + i: t for i, t in enumerate(texts)}
    scores = {i: -r.uniform(1, 6) for i in pieces}
    codec = pieces_of(pieces, scores)
    by_text = {t: i for i, t in pieces.items()}
    docs = ["".join(r.choice("abc  \n") for _ in range(r.randint(1, 12))) for _ in range(400)]
    flat, offsets = codec.encode(docs)
    for doc, a, b in zip(docs, offsets[:-1], offsets[1:], strict=True):
        marked = "▁" + doc.replace(" ", "▁")
        best = max(sum(scores[i] for i in path) for path in segmentations(marked, by_text))
        got = flat[a:b].tolist()
        assert "".join(pieces[i] for i in got) == marked and abs(sum(scores[i] for i in got) - best) < 1e-9
    assert codec.decode(flat, offsets) == docs
    flat, offsets = codec.encode(["axé"])
    assert codec.decode(flat, offsets) == ["axé"] and {x for x in flat.tolist() if x < 300} == {ord("x"), 0xC3, 0xA9}


def pieces_of(found, scores, kind=pieces.UNIGRAM):
    return pieces.Codec(pieces.Vocabulary(found, scores, list(range(256)), 400, kind))


def test_other_vocabularies_are_refused():
    for bad in (lambda: pieces_of({300: "a"}, {300: 0.0}, 4), lambda: pieces_of({300: "a▁b"}, {300: 0.0})):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError


def test_full_tables_begin_anew(monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    monkeypatch.setattr(pieces, "TABLE", 50)
    codec, r = pieces.Codec(PATH), random.Random(12)
    for _ in range(20):
        texts = ["".join(r.choice("abeinorst  ") for _ in range(60)) for _ in range(20)]
        flat, offsets = codec.encode(texts)
        assert [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == model.encode(texts)
