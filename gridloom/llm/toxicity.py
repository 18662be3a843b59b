"""Toxic passages by maximum-scoring segment search.

Tokens carry log-odds of toxic against other labelled documents under a symmetric Dirichlet prior, learnt for every
frequent word and word beginning and drawn towards zero by their standard error; a token takes those of its most specific
form that is frequent. Positive log-odds are weighted by the share of a form's toxic documents that need it: a document
credits each of its words by its odds over those of its strongest word, so words that merely repeat with a copied
document drop out. All maximal scoring segments of a document are found in one linear scan over the positive tokens.
Their scores are put on the scale of the extreme-value law of the best segment of clean text, whose lambda and K are
estimated on labelled documents kept aside; the significant ones are summed, and a logistic curve fitted on the documents
kept aside turns the sum into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import materialize

from .batches import BATCH_BYTES, map_texts, release, strings
from .learning import labelled, logistic

#: Labelled documents that a model is fitted on, at most about; of how many one is kept aside for the calibration.
SAMPLE_DOCS, ASIDE = 40_000, 4
#: Prior count of each form in each class; documents, and share of them, that a frequent form occurs in; standard errors.
PRIOR, LEAST_DOCS, LEAST_SHARE, ERRORS = 0.5, 8, 1 / 4000, 2.0
#: Lengths of word beginnings that are forms of their own.
STEMS = (4, 5, 6)
#: Taken off each token's log-odds, so that clean text drifts downwards; expected number of equally good segments in clean
#: text of the same length up to which one is significant.
GAP, SIGNIFICANT = 0.1, 0.02
#: Bins of the calibration per unit of its scale; words of a task's score cache.
BINS, CACHE_WORDS = 20, 100_000

_WORDS = re.compile(r"[^\W\d_]+").findall

SEGMENT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("score", T.DoubleType())])


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def forms_of(text: str) -> set[str]:
    """Words of a text and their beginnings."""
    own = set(words(text))
    return own | {w[:n] + "*" for w in own for n in STEMS if len(w) > n}


def spellings(word: str) -> list[str]:
    """The forms of a word, the most specific first."""
    return [word, *[word[:n] + "*" for n in reversed(STEMS) if len(word) > n]]


class Scores(dict):
    """Score of a word, by its most specific known form; itself the cache."""

    def __init__(self, forms: dict[str, float]):
        super().__init__()
        self.forms = forms

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        score = self[word] = next((self.forms[f] for f in spellings(word) if f in self.forms), 0.0) - GAP
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in linear time (Ruzzo and Tompa)."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    upto = np.cumsum(scores)
    before = (upto[positive] - scores[positive]).tolist()
    after = upto[positive].tolist()
    found: list[list] = []  # start, stop, sum before, sum after, nearest one to the left with a smaller sum before
    for at, low, high in zip(positive.tolist(), before, after, strict=True):
        new = [at, at + 1, low, high, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def statistic(found: list[tuple[int, int, float]], tokens: int, decay: float, karlin: float) -> float:
    """Sum of the significant normalised segment scores, or the best one; minus infinity without segments."""
    if not found:
        return -math.inf
    shift = math.log(karlin * max(tokens, 2))
    normal = [decay * s - shift for _, _, s in found]
    significant = [x for x in normal if x > -math.log(SIGNIFICANT)]
    return sum(significant) if significant else max(normal)


def karlin_lambda(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * value)) = 1 over the token scores of clean text."""
    shares = counts / counts.sum()
    if not (values > 0).any() or (values * shares).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while np.log(np.sum(shares * np.exp(np.minimum(high * values, 600)))) < 0:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        if np.log(np.sum(shares * np.exp(np.minimum(mid * values, 600)))) > 0:
            high = mid
        else:
            low = mid
    return (low + high) / 2


class Model:
    """Log-odds of forms, the extreme-value law (lambda and K), the calibration curve, and the share of toxic documents
    among those without a segment."""

    def __init__(self, forms: dict[str, float], decay: float = 1.0, karlin: float = 1.0, slope: float = 1.0, base: float = -4.0, without: float = 0.02):
        self.forms, self.decay, self.karlin, self.slope, self.base, self.without = forms, decay, karlin, slope, base, without

    def scan(self, text: str, cache: Scores) -> tuple[list[tuple[int, int, float]], int, np.ndarray]:
        tokens = words(text)
        scores = np.fromiter(map(cache.__getitem__, tokens), np.float64, len(tokens))
        return segments(scores), len(tokens), scores

    def probability(self, value: float) -> float:
        if value == -math.inf:
            return self.without
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * math.asinh(value) + self.base))))


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log-odds of forms by the documents they occur in, under a symmetric Dirichlet prior, ERRORS nearer to zero."""
    odds = np.log((toxic + PRIOR) / (n_toxic + 2 * PRIOR)) - np.log((other + PRIOR) / (n_other + 2 * PRIOR))
    error = np.sqrt(1 / (toxic + PRIOR) + 1 / (other + PRIOR))
    return np.sign(odds) * np.maximum(np.abs(odds) - ERRORS * error, 0)


def credits(own: set[str], odds: dict[str, float]) -> dict[str, float]:
    """What a toxic document credits the forms of its words ``own``: each word's odds over those of the strongest one."""
    best: dict[str, float] = {}
    for word in own:
        found = [f for f in spellings(word) if f in odds]
        if found:
            most = max(odds[f] for f in found)
            for form in found:
                best[form] = max(best.get(form, 0.0), most)
    top = max(best.values(), default=0.0)
    return {f: math.exp(x - top) for f, x in best.items()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on about SAMPLE_DOCS labelled documents outside the held-out fold; without both classes nothing is toxic.

    What reaches the driver is bounded by the sample: document counts of the frequent forms, their credits, the distinct
    token scores, and the calibration counts by bin.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sample = labelled(docs, labels, label_col, SAMPLE_DOCS, id_col, text_col)
    aside = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("aside")), F.lit(ASIDE)) == 0
    sample = materialize(sample.select(aside.alias("aside"), F.coalesce("text", F.lit("")).alias("text"), (F.col("label") > 0).cast("int").alias("label")), "toxicity-sample")
    train, kept_aside = sample.where("not aside").select("text", "label"), sample.where("aside").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_label = (Counter(), Counter())
            sizes = [0, 0]
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_label[label].update(forms_of(text))
                sizes[label] += 1
            forms = list(by_label[0] | by_label[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([*forms, None], pa.string()), pa.array([*[by_label[1][f] for f in forms], sizes[1]], pa.int64()), pa.array([*[by_label[0][f] for f in forms], sizes[0]], pa.int64())],
                names=["form", "toxic", "other"],
            )
        release()

    counts = train.mapInArrow(count, "form string, toxic long, other long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = materialize(counts.where(F.col("form").isNull() | (F.col("toxic") + F.col("other") >= LEAST_DOCS)), "toxicity-forms")
    totals = counts.where("form is null").collect()
    if not totals or not totals[0].toxic or not totals[0].other:
        return Model({})
    n_toxic, n_other = totals[0].toxic, totals[0].other
    rows = counts.where(F.col("form").isNotNull() & (F.col("toxic") + F.col("other") >= LEAST_SHARE * (n_toxic + n_other))).toPandas()
    odds = dict(zip(rows.form, log_odds(rows.toxic.to_numpy(float), rows.other.to_numpy(float), n_toxic, n_other).tolist(), strict=True))
    strong = spark.sparkContext.broadcast({f: x for f, x in odds.items() if x > 0})

    def credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positive = strong.value
        for batch in batches:
            tally: dict[str, float] = defaultdict(float)
            for text in batch.column(0).to_pylist():
                for form, share in credits(set(words(text)), positive).items():
                    tally[form] += share
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.float64())], names=["form", "n"])
        release()

    credited = train.where("label = 1").select("text").mapInArrow(credit, "form string, n double").groupBy("form").agg(F.sum("n").alias("n")).toPandas()
    toxic_docs = dict(zip(rows.form, rows.toxic, strict=True))
    share = {f: min(1.0, n / toxic_docs[f]) for f, n in zip(credited.form, credited.n, strict=True)}
    # Rounded, so that the order in which floating sums meet cannot show.
    model = Model({f: round(x * share.get(f, 0.0) if x > 0 else x, 6) for f, x in odds.items()})
    forms = spark.sparkContext.broadcast(model.forms)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (label, tokens, segment scores), and rows that count the token scores of clean ones."""
        own = Model(forms.value)
        cache = Scores(own.forms)
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
        for batch in batches:
            tally: Counter = Counter()
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, tokens, scores = own.scan(text, cache)
                out.append((label, tokens, [x for _, _, x in found], None))
                if not label:
                    tally.update(np.round(scores, 1).tolist())
            out += [(None, n, None, x) for x, n in tally.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["label", "n", "found", "score"])
        release()

    measured = materialize(kept_aside.mapInArrow(measure, "label int, n long, found array<double>, score double"), "toxicity-measured")
    tokens = measured.where("label is null").groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").toPandas()
    if not len(tokens):
        return Model({})
    # Half a token of the highest score stands for what clean text has not shown yet.
    model.decay = round(karlin_lambda(np.append(tokens.score, max(model.forms.values(), default=0.0)), np.append(tokens.n, 0.5)), 6)
    best = F.coalesce(F.array_max("found"), F.lit(0.0))
    law = measured.where("label = 0").agg(F.count("*").alias("docs"), F.sum(F.greatest("n", F.lit(2)) * F.exp(-model.decay * best)).alias("tail")).first()
    model.karlin = round(law.docs / law.tail, 9)
    normal = F.transform("found", lambda x: model.decay * x - F.log(model.karlin * F.greatest("n", F.lit(2))))
    significant = F.filter(normal, lambda x: x > -math.log(SIGNIFICANT))
    total = F.when(F.size(significant) > 0, F.aggregate(significant, F.lit(0.0), lambda a, x: a + x)).otherwise(F.array_max(normal))
    bins = measured.where("label is not null").groupBy(F.floor(F.asinh(total) * BINS).alias("bin"), "label").agg(F.count("*").alias("n")).toPandas()
    # Labels of documents without a segment say nothing about the scale: they get a rate of their own.
    none, some = bins[bins.bin.isnull()], bins[~bins.bin.isnull()]
    at = np.sort(some.bin.unique())
    by = [np.bincount(np.searchsorted(at, some.bin[some.label == y]), weights=some.n[some.label == y], minlength=len(at)) for y in (0, 1)]
    model.slope, model.base = logistic((at + 0.5) / BINS, by[1], by[0])
    model.without = min((none.n[none.label == 1].sum() + 0.5) / (none.n.sum() + 1), 0.5)
    strong.unpersist()
    forms.unpersist()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, with_segments: bool = False) -> DataFrame:
    """Add ``score`` (0 to 1) and, with ``with_segments``, ``segments`` (word ranges and scores) to the columns ``keep``.

    Null and empty texts have no segment and so the lowest score. Texts are scanned whole, in time linear in their length.
    Rows are independent: repeated rows, ties and empty tables need no care; ``score`` and ``segments`` take the place of
    kept columns of those names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("score", T.DoubleType())] + ([T.StructField("segments", T.ArrayType(SEGMENT))] if with_segments else [])

    def make():
        model = shared.value
        cache = Scores(model.forms)

        def run(batch: pa.RecordBatch) -> dict[str, object]:
            scanned = [model.scan(text, cache)[:2] for text in strings(batch.column(0))]
            out = {"score": pa.array([model.probability(statistic(found, n, model.decay, model.karlin)) for found, n in scanned], pa.float64())}
            if with_segments:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
                out["segments"] = pa.array([[{"start": a, "stop": b, "score": s} for a, b, s in found] for found, _ in scanned], kind)
            return out

        return run

    return map_texts(docs, {"text": text_col}, make, T.StructType(added), docs.columns if keep is None else keep)
