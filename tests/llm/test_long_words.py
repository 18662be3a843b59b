"""Expected piece counts of words too long to be counted together with others."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa

from gridloom.llm import language


def byte_by_byte(model, word):
    """The forward algorithm on one word, rescaled at each byte."""
    table, lifted = language.pieces(model.path), model.lifted()
    recent, scale = [np.ones(len(model.languages))], np.zeros(len(model.languages))
    for end in range(1, len(word) + 1):
        value = np.zeros(len(model.languages))
        for n in range(1, min(len(recent), table.longest) + 1):
            piece = table.number.get(word[end - n : end])
            if piece is not None:
                value += recent[-n] * lifted[piece]
        scale += np.log(value)
        recent = [r / value for r in recent[1 - table.longest :]] + [np.ones(len(model.languages))]
    return scale - len(word) * np.log(language.LIFT)


def test_long_words_train(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    table = language.pieces(path)
    chance = np.random.default_rng(4).random((len(table.number), 2))
    model = SimpleNamespace(value=language.Model(path, ["aa", "zz"], chance / chance.sum(axis=0)))
    words = ["語" * 18 + "文字" * 4, "abcdefgh" * 7]

    def counts(words):
        batch = pa.RecordBatch.from_arrays([pa.array(["aa", "zz"][: len(words)]), pa.array(words), pa.array([3, 2][: len(words)])], names=["lang", "word", "n"])
        out = next(language._expectation(model)(iter([batch]))).to_pydict()
        return dict(zip(zip(out["lang"], out["piece"], strict=True), out["n"], strict=True))

    got = counts(words)
    monkeypatch.setattr(language, "SHORT", 100)
    want = counts(words)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, want[k]) for k in want)
    covered = sum(n * table.length[piece] for (_, piece), n in got.items())
    assert abs(covered - 3 * len(language.spelled(words[0])) - 2 * len(language.spelled(words[1]))) < 0.01
    assert len(next(language._expectation(model)(iter([pa.RecordBatch.from_arrays([pa.array(["aa"]), pa.array(["語" * 40000]), pa.array([1])], names=["lang", "word", "n"])])))) > 0


def test_many_languages_take_bounded_memory():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    size = len(language.pieces(path).number)
    scorer = language.Scorer(language.Model(path, [f"l{i:03}" for i in range(300)], np.full((size, 300), 1 / size)))
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(30_000))
    tracemalloc.start()
    assert scorer([text, "", "same words"])[0] == ["l000", "und", "l000"]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6


def test_pieces_of_any_length_count():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    table = language.pieces(path)
    longest = max((p for p in table.number if p.isalpha()), key=len)
    assert len(longest) > 12
    chance = np.full((len(table.number), 1), 1e-9)
    chance[table.number[longest]] = 0.5
    model = language.Model(path, ["a"], chance)
    for score in (model.score_words([longest], model.lifted())[0, 0], byte_by_byte(model, longest)[0]):
        assert abs(score - np.log(0.5)) < 0.01


def test_words_of_any_length_score_as_byte_by_byte(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rng, size = np.random.default_rng(1), len(language.pieces(path).number)
    chance = rng.random((size, 3))
    model = language.Model(path, ["a", "b", "c"], chance / chance.sum(axis=0))
    han = [chr(c) for c in rng.integers(0x4E00, 0x9000, 300)] + list("的一是不了人我在有他这中大来上国") * 20
    texts = ["".join(rng.choice(han, n)) for n in (1, 5, 20, 60, 400)] + ["a" * 300, "wort" * 40, "x", "schiff" * 12 + "ß" * 9, "ไทยภาษาคนที่นี่" * 9]
    words = [language.spelled(t) for t in texts]
    want = np.array([byte_by_byte(model, w) for w in words])
    np.testing.assert_allclose(model.score_words(words, model.lifted()), want, rtol=1e-9)
    assert [b"".join(p) for p in language.pieces(path).parts(words)] == words
    for name, value in (("SHORT", 4), ("TOGETHER", 6), ("TOGETHER_BYTES", 100)):
        monkeypatch.setattr(language, name, value)
        np.testing.assert_allclose(model.score_words(words, model.lifted()), want, rtol=1e-9)


def test_a_rare_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_DOCS", 60)
    rows = [(i, f"the common words of one language number {i}", "en") for i in range(3000)] + [(5000 + i, "die seltene sprache ist auch hier", "xx") for i in range(12)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert model.languages == ["en", "xx"]
    assert language.Scorer(model)(["die sprache ist hier", "the words of a language"])[0] == ["xx", "en"]
