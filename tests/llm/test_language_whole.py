"""Language prediction from counts to posterior, with every segmentation written out."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from conftest_llm import make_docs
from test_learned import held_out

from gridloom.llm import language

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_predictions_equal_brute_force(spark):
    rng = random.Random(11)
    own = {"aa": ["the", "hau", "ti", "so"], "bb": ["der", "hau", "un", "so"]}
    rows = []
    for i in range(90):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join(rng.choices(own[lang], k=rng.choice([1, 4, 9]))), lang, "s"))
    number = language.pieces(PATH).number

    def segmentations(word):
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            if all(p in number for p in parts):
                yield parts

    spelled = {w: list(segmentations(b" " + w.encode())) for words in own.values() for w in words}
    counts = {lang: Counter(w for i, t, l, _ in rows if l == lang and not held_out(i) for w in t.split()) for lang in own}
    chance = {lang: defaultdict(lambda: 1 / len(number)) for lang in own}
    for _ in range(language.PASSES):
        soft = {lang: Counter() for lang in own}
        for lang in own:
            for word, n in counts[lang].items():
                weights = [math.prod(chance[lang][p] for p in parts) for parts in spelled[word]]
                for parts, w in zip(spelled[word], weights, strict=True):
                    for p in parts:
                        soft[lang][p] += n * w / sum(weights)
        both = soft["aa"] + soft["bb"]
        total = sum(both.values()) + 0.01 * len(number)
        for lang in own:
            size = sum(soft[lang].values()) + language.BACKGROUND
            floor = language.BACKGROUND * 0.01 / total / size
            new = defaultdict(lambda floor=floor: floor)
            new.update({p: (soft[lang][p] + language.BACKGROUND * (both[p] + 0.01) / total) / size for p in both})
            chance[lang] = new
    docs = make_docs(spark, rows)
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs, PATH), keep=["doc_id"]).collect()}
    for i, text, _, _ in rows:
        logs = {lang: sum(math.log(sum(math.prod(chance[lang][p] for p in parts) for parts in spelled[w])) for w in text.split()) for lang in own}
        best = min(own, key=lambda lang: (-logs[lang], lang))
        top = 1 / sum(math.exp(x - logs[best]) for x in logs.values())
        assert got[i].lang_pred == best or abs(logs["aa"] - logs["bb"]) < 1e-6
        np.testing.assert_allclose(got[i].score, top, rtol=1e-4)


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "same words", ["zz", "mm"][i % 2], "s") for i in range(40)]
    rows = [r for r in rows if not held_out(r[0])]
    pairs = min(sum(r[2] == x for r in rows) for x in ("zz", "mm"))
    rows = [r for x in ("zz", "mm") for r in [r for r in rows if r[2] == x][:pairs]]
    docs = make_docs(spark, rows)
    got = language.predict(docs, language.fit(docs, PATH), keep=["doc_id"]).collect()
    assert {r.lang_pred for r in got} == {"mm"} and all(abs(r.score - 0.5) < 1e-9 for r in got)
