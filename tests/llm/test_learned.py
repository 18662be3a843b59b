"""Language, toxicity and quality: held-out results on small corpora, exact parts against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from conftest_llm import make_docs, sample_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import language, learning, quality, toxicity

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = {"en": "the house and water with which thing other people through".split(), "de": "das Haus und Wasser mit welches Ding andere Menschen durch".split()}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_forward_sums_all_segmentations():
    table = language.pieces(VOCABULARY)
    rng = np.random.default_rng(1)
    p = rng.random((len(table.number), 2))
    model = language.Model(VOCABULARY, ["a", "b"], p / p.sum(axis=0))
    for word in (b" the", b" ab", b"z", b" stra\xc3\x9fe"):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            if all(x in table.number for x in parts):
                total += np.prod([model.probability[table.number[x]] for x in parts], axis=0)
        got = model.score_words([word], model.lifted())[0]
        np.testing.assert_allclose(got, np.log(total), rtol=1e-9)


def test_language(spark, no_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=15)), lang if i % 5 else None, "s") for i, lang in ((i, rng.choice(["en", "de"])) for i in range(150))]
    truth = {i: "en" if set(t.split()) & set(WORDS["en"]) else "de" for i, t, _, _ in rows}
    rows += [(900, None, "en", "s"), (901, "12 34 !?", "de", "s"), (902, "²", "de", "s"), (903, "Wasser" * 40, None, "s")]
    docs = make_docs(spark, rows)
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs, VOCABULARY), keep=["doc_id"]).collect()}
    assert all(got[i].lang_pred == lang for i, lang in truth.items() if held_out(i))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "de"
    nothing = language.fit(no_docs, VOCABULARY)
    assert language.predict(docs, nothing, keep=["doc_id"]).where("lang_pred != 'und'").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segments_are_the_maximal_ones(values):
    """Ruzzo and Tompa's definition, by repeatedly taking the best contiguous run."""

    def brute(a, b):
        best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return brute(a, i) + [(i, j, float(best[0]))] + brute(j, b)

    # Distinct cumulative sums leave no ties between runs.
    distinct = [v + 1e-3 * math.sin(7.0 * i + 1) for i, v in enumerate(values)]
    values[:] = distinct
    got = toxicity.segments(np.array(distinct))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(0, len(distinct))]


def test_lambda_solves_its_equation():
    v, p = np.array([-0.1, 5.0]), np.array([0.999, 0.001])
    assert abs((p * np.exp(toxicity.karlin_lambda(v, p) * v)).sum() - 1) < 1e-6


def test_toxicity(spark, no_docs):
    rng = random.Random(5)
    clean = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        words = rng.choices(clean, k=40)
        if toxic:
            for k in rng.sample(range(40), 5):
                words[k] = rng.choice(["grumblex", "vilequax"]) + rng.choice(["", "a", "o"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (None, "word1 word2", "en", "s"), (902, "grumblexy word1", "en", "s")]
    labels += [(5000, 1, 1), (None, 1, 1), (2, None, None)]
    docs = make_docs(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = {r.doc_id: r for r in toxicity.score(docs, model, keep=["doc_id"], with_segments=True).collect()}
    for i in range(400):
        if held_out(i):
            assert (got[i].score >= 0.7) == (i % 8 == 0)
    assert got[900].score == got[901].score < 0.1 and not got[900].segments
    spans = got[0].segments
    assert spans and all(s.start < s.stop and s.score > 0 for s in spans)
    assert not toxicity.fit(docs, table.where("false")).forms and not toxicity.fit(no_docs, table).forms


def test_toxicity_equals_brute_force(spark):
    """The whole score again by plain loops: counts, credits, scan, lambda and K, statistic and calibration."""
    rng = random.Random(9)
    clean = [f"{chr(97 + i // 9) * 2}{chr(97 + i % 9)}" for i in range(80)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 7 == 0
        words = rng.choices(clean, k=rng.choice([5, 30, 60]))
        for k in rng.sample(range(len(words)), 4 if toxic else 0):
            words[k] = rng.choice(["grumblex", "vilequax", "vilequon"]) + rng.choice(["", "ab", "cde"])
        if i % 90 == 7:
            words.append("grumblex")
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    docs, table = make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    aside = {r.doc_id for r in docs.where(f"pmod(xxhash64(cast(doc_id as string), 'aside'), {toxicity.ASIDE}) = 0").collect()}
    text = {i: t for i, t, _, _ in rows}
    label = {i: y for i, _, y in labels if not held_out(i)}
    train = [i for i in label if i not in aside]

    def forms(word):
        return [word] + [word[:n] + "*" for n in (6, 5, 4) if len(word) > n]

    n = [sum(label[i] == y for i in train) for y in (0, 1)]
    seen = [Counter(f for i in train if label[i] == y for f in {f for w in text[i].split() for f in forms(w)}) for y in (0, 1)]
    odds = {}
    for f in set(seen[0]) | set(seen[1]):
        if seen[0][f] + seen[1][f] >= max(toxicity.LEAST_DOCS, toxicity.LEAST_SHARE * sum(n)):
            a, b = seen[1][f] + 0.5, seen[0][f] + 0.5
            x = math.log(a / (n[1] + 1)) - math.log(b / (n[0] + 1))
            odds[f] = math.copysign(max(0.0, abs(x) - toxicity.ERRORS * math.sqrt(1 / a + 1 / b)), x)
    share = Counter()
    for i in train:
        if label[i]:
            strength = {w: max([odds[f] for f in forms(w) if odds.get(f, 0) > 0], default=0) for w in set(text[i].split())}
            top = max(strength.values())
            for f in odds:
                with_f = [x for w, x in strength.items() if f in forms(w)]
                if odds[f] > 0 and with_f:
                    share[f] += math.exp(max(with_f) - top)
    score = {f: x * min(1, share[f] / seen[1][f]) if x > 0 else x for f, x in odds.items()}

    def scan(i):
        return [next((score[f] for f in forms(w) if f in score), 0.0) - toxicity.GAP for w in text[i].split()]

    def best_runs(values):
        if not values:
            return []
        sums = [0, *itertools.accumulate(values)]
        gain, a, b = max(((sums[b] - sums[a], a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), key=lambda x: (x[0], x[1] - x[2]))
        return [*best_runs(values[:a]), gain, *best_runs(values[b:])] if gain > 1e-12 else []

    kept = [i for i in label if i in aside]
    tally = Counter(round(x, 1) for i in kept if not label[i] for x in scan(i))
    tally_max = Counter({max(score.values()): 0.5}) + tally
    decay = toxicity.karlin_lambda(np.array(list(tally_max)), np.array(list(tally_max.values())))
    karlin = sum(not label[i] for i in kept) / sum(max(2, len(scan(i))) * math.exp(-decay * max(best_runs(scan(i)), default=0)) for i in kept if not label[i])

    def total(i):
        normal = [decay * s - math.log(karlin * max(2, len(scan(i)))) for s in best_runs(scan(i))]
        good = [x for x in normal if x > -math.log(toxicity.SIGNIFICANT)]
        return sum(good) if good else max(normal, default=-math.inf)

    bins = Counter((math.floor(math.asinh(total(i)) * toxicity.BINS), label[i]) for i in kept if total(i) > -math.inf)
    at = sorted({b for b, _ in bins})
    slope, base = learning.logistic((np.array(at) + 0.5) / toxicity.BINS, np.array([float(bins[b, 1]) for b in at]), np.array([float(bins[b, 0]) for b in at]))
    empty = [label[i] for i in kept if total(i) == -math.inf]
    without = min(0.5, (sum(empty) + 0.5) / (len(empty) + 1))
    model = toxicity.fit(docs, table)
    assert set(score) == set(model.forms), (sorted(set(score) ^ set(model.forms))[:9], len(score), len(model.forms))
    assert max(abs(score[f] - x) for f, x in model.forms.items()) < 1e-5
    assert abs(decay - model.decay) < 1e-3, (decay, model.decay)
    assert abs(karlin / model.karlin - 1) < 1e-2
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    for i in range(900):
        x = total(i)
        want = without if x == -math.inf else 1 / (1 + math.exp(-max(-40, min(40, slope * math.asinh(x) + base))))
        assert abs(got[i] - want) < 1e-3, (i, got[i], want, x, decay, karlin, slope, base, model.decay, model.karlin, model.slope, model.base)
        if held_out(i):
            assert (got[i] >= 0.7) == (i % 7 == 0) or i % 90 == 7


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab #|\né ", max_size=80), max_size=6))
def test_counts(texts):
    got = quality.count_texts(texts)
    for i, text in enumerate(texts):
        assert tuple(int(got[c][i]) for c in quality.COUNTS[:5]) == brute_counts(text)


def test_binomial_bound():
    n, p = 40, 0.1
    for k in range(0, 12):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality.binomial_tail(k, n, p) - want) < 1e-12
    assert quality.admitted([0, 0, 1, 30], 1000, 0.02, 0.01) == 3 and quality.admitted([0], 10, 0.02, 0.01) == 0 and quality.admitted([0], 0, 0.02, 0.01) == 0


def test_binomial_tail_of_large_counts():
    n, p = 3_000_000, 0.02
    assert abs(quality.binomial_tail(60_000, n, p) - 0.5) < 0.01 and quality.binomial_tail(59_000, n, p) < 1e-4


def test_false_rejections_exceed_the_risk_no_more_often_than_the_level():
    """Rules that catch bad documents but reject good ones at rates around the risk, chosen and tested over and over."""
    rng = np.random.default_rng(3)
    rules = len(quality.RULES)
    rates = np.linspace(0.012, 0.03, 5)  # of good documents, by cutoff
    exceed = used = 0
    runs = 300
    for _ in range(runs):
        # A document can exceed cutoffs of one rule.
        good = (rng.random(4000) < 0.5).astype(int)
        rule, strong = rng.integers(0, rules, 4000), rng.random(4000) * np.where(good, 1, 0.05)
        marks = np.zeros((4000, rules), np.int64)
        marks[np.arange(4000), rule] = (strong[:, None] < rates).sum(axis=1)
        best = quality.certified(marks, good, 1 - good, rng.integers(0, 2, 4000), quality.LEVEL)
        if best:
            used += 1
            reach = [len(c) - u + 1 for (_, c), u in zip(quality.RULES, best, strict=True)]  # cutoffs exceeded by what is rejected
            exceed += sum(rates[5 - j] if j <= 5 else 0 for j in reach) / rules > quality.RISK
    assert used > runs / 2 and exceed / runs <= quality.LEVEL + 0.02


def test_quality_equals_brute_force(spark):
    """Cutoffs and ``kept`` again by plain loops over the documents."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 3 == 0
        words = ["w%d" % rng.randrange(5000) + ("#" * rng.choice([0, 1, 2]) if bad or rng.random() < 0.004 else "") for _ in range(25)]
        rows.append((i, " ".join(words) + (" !!" * rng.choice([0, 5, 9]) if bad else ""), "en", "s"))
        labels.append((i, 0 if bad else 1, 0))
    docs, table = make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    half = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "cast(pmod(xxhash64(cast(doc_id as string), 'half'), 2) as int) as h").collect()}
    counts = quality.count_texts([t for _, t, _, _ in rows])
    c = {k: v.tolist() for k, v in counts.items()}
    value = [
        {"symbols": c["n_symbols"][i] / c["n_words"][i], "repeats": c["n_repeat_words"][i] / c["n_words"][i], "dup_lines": c["n_dup_lines"][i] / c["n_lines"][i], "shouts": c["n_shouts"][i] / c["n_words"][i], "upper": c["n_upper"][i] / c["word_chars"][i], "long_words": c["word_chars"][i] / c["n_words"][i]}
        for i in range(len(rows))
    ]
    base = [c["n_words"][i] < 10 or 100 * c["n_repeat_words"][i] > 20 * c["n_words"][i] for i in range(len(rows))]
    known = [i for i in range(len(rows)) if not held_out(i) and not base[i]]

    def fails(i, cutoffs):
        return any(value[i][r] > x for r, x in cutoffs.items())

    def tally(ids, cutoffs):
        out = [i for i in ids if fails(i, cutoffs)]
        return sum(labels[i][1] for i in out), sum(1 - labels[i][1] for i in out)

    choose, test = [i for i in known if not half[i]], [i for i in known if half[i]]
    goods, bads = sum(labels[i][1] for i in choose), sum(1 - labels[i][1] for i in choose)
    cutoffs, best = {}, {}
    while True:
        g0, b0 = tally(choose, cutoffs)
        options = []
        for r, (rule, steps) in enumerate(quality.RULES):
            for used, x in enumerate(steps):
                if x < cutoffs.get(rule, math.inf):
                    g, b = tally(choose, cutoffs | {rule: x})
                    if (b - b0) / bads > quality.PENALTY * (g - g0) / goods:
                        options.append(((b - b0) / (g - g0 + 1), -r, -used, rule, x))
        if not options:
            break
        *_, rule, x = max(options)
        cutoffs = cutoffs | {rule: x}
        n, k = sum(labels[i][1] for i in test), tally(test, cutoffs)[0]
        if sum(math.comb(n, j) * quality.RISK**j * (1 - quality.RISK) ** (n - j) for j in range(k + 1)) > quality.LEVEL:
            break
        best = cutoffs
    got = {r.doc_id: r.kept for r in quality.judge(docs, table).collect()}
    assert best and got == {i: not base[i] and not fails(i, best) for i in range(len(rows))}


def test_quality(spark, no_docs):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(2400):
        bad = i % 6 == 0
        words = ["w%d" % rng.randrange(5000) + ("###" if bad else "") for _ in range(30)]
        rows.append((i, " ".join(words), "en" if i % 50 else None, "s"))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(9000, None, "en", "s"), (9001, "a b c d e f g h i j " * 3, "en", "s"), (9002, "short", "xx", "s")]
    docs, table = make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, table).collect()}
    english = [i for i in range(2400) if i % 50]
    assert all(got[i].kept == (i % 6 != 0) for i in english)
    assert all(got[i].kept for i in range(0, 2400, 50))  # too few labels to reject anything
    assert got[9000].base_failed and got[9001].base_failed and got[9002].base_failed
    assert quality.judge(docs, table.where("false")).where("kept = base_failed").count() == 0
    assert quality.judge(no_docs, table).count() == 0


def test_bounded_sample(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert learning.bounded(rows, "doc_id", 10_000).count() == 5000
    assert 350 < learning.bounded(rows, "doc_id", 500).count() < 650


def test_sample_rows_survive(docs):
    """Nulls, empty and very long texts pass through every learned operator."""
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 2 as int) as toxic")
    count = len(sample_rows())
    assert quality.judge(docs, labels).count() == count
    assert toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"]).count() == count
    assert language.predict(docs, language.fit(docs, VOCABULARY), keep=["doc_id"]).count() == count


def test_a_null_stratum_is_apart_from_an_empty_one(spark):
    """The empty stratum has marks in good documents, the null one only in bad ones: cutoffs differ."""
    text = "plain words of a text that goes on for a while with no mark at all {}"
    rows, marks = [], []
    for i in range(6000):
        stratum, good = (None, "")[i % 2], i % 4 < 2
        noisy = i % 8 in (0, 1, 2, 3) if stratum == "" else not good
        rows.append((i, text.format(i) + (" " + "#" * 40 if noisy else ""), stratum))
        marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = quality.judge(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    kept = {s: [r.kept for r in judged if r.stratum == s and "#" in rows[r.doc_id][1]] for s in (None, "")}
    assert {r.stratum for r in judged} == {None, ""} and not any(kept[None]) and all(kept[""])
