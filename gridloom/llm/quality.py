"""Quality rules whose cutoffs are chosen under a bound on false rejections.

A rule rejects documents whose measure lies above a cutoff. The labelled documents of each stratum are split in two. One
half chooses a sequence of policies, each a set of cutoffs that contains the one before: step by step the cutoff that
rejects most bad documents for each good one is tightened. The other half, which had no part in that, tests the sequence
in order: a policy is admitted while an exact binomial test on the good documents shows, at a level divided by the number
of strata, that it rejects less than RISK of them. As the first failure ends the sequence, the policies of a stratum share
its level, and all guarantees hold together with probability 1 - LEVEL. The last policy admitted is used.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import materialize

from .batches import map_texts, named, strings
from .text import fold

#: Words of a window that counts as repeated, symbols, and the white space between words.
WINDOW, SYMBOLS, BLANKS = 5, "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Base rule: fewest words, and percentage of words in repeated windows.
LEAST_WORDS, REPEAT_PERCENT = 10, 20
#: Share of a stratum's good documents that may be rejected, level of the guarantee, weight of a good document.
RISK, LEVEL, PENALTY = 0.02, 0.05, 5.0
#: Terms of a continued fraction, which converges long before.
TERMS = 1000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")

#: Rules in order: measure, and cutoffs from the loosest to the strictest.
RULES: tuple[tuple[str, tuple[float, ...]], ...] = (
    ("symbols", (4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1)),
    ("repeats", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    ("dup_lines", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("shouts", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    ("upper", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    ("long_words", (30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
)


def measures() -> dict[str, Column]:
    """The measure of each rule over the columns COUNTS."""
    count = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / count,
        "repeats": F.col("n_repeat_words") / count,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "shouts": F.col("n_shouts") / count,
        "upper": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "long_words": F.col("word_chars") / count,
    }


def repeated_words(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of WINDOW words that its document has twice or more."""
    covered = np.zeros(len(words), bool)
    count = len(words) - WINDOW + 1
    if count <= 0:
        return covered
    start = np.flatnonzero(doc[:count] == doc[WINDOW - 1 :])
    if len(start) < 2:
        return covered
    key = doc[start].astype(np.uint64)
    for k in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[start + k].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    twin = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(twin):
        return covered
    a, b = start[order[twin]], start[order[twin + 1]]
    same = doc[a] == doc[b]
    for k in range(WINDOW):
        same &= words[a + k] == words[b + k]
    if same.all():
        found = np.concatenate([a, b])
    else:  # two different windows share a key: compare the windows themselves
        rows = np.stack([doc[start], *[words[start + k] for k in range(WINDOW)]], axis=1)
        _, group, sizes = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        found = start[sizes[group.ravel()] > 1]
    for k in range(WINDOW):
        covered[found + k] = True
    return covered


def count_texts(texts: list[str]) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    numbers: dict[bytes, int] = {}
    columns = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    ids: list[np.ndarray] = []
    for i, text in enumerate(texts):
        words = text.encode("utf-8").split()
        ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        columns["n_words"][i] = len(words)
        filled = columns["word_chars"][i] = len(text) - sum(map(text.count, BLANKS))
        columns["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        columns["n_lines"][i] = len(lines)
        columns["n_dup_lines"][i] = len(lines) - len(set(lines))
        columns["n_shouts"][i] = text.count("!!")
        columns["n_upper"][i] = filled - len(_without_capitals(text))
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    if sizes.sum():
        doc = np.repeat(np.arange(len(texts)), sizes)
        covered = repeated_words(np.concatenate(ids), doc)
        columns["n_repeat_words"] = np.bincount(doc, weights=covered, minlength=len(texts)).astype(np.int64)
    return columns


def _without_capitals(text: str) -> bytes:
    """The bytes of the text, one for each character other than a capital (A-Z) or white space."""
    return text.encode("latin-1", "replace").translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ \t\n\x0b\x0c\r")


def counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add COUNTS of the whole text (null: empty) to the columns ``keep``."""

    def make():
        return lambda batch: {k: pa.array(v) for k, v in count_texts(strings(batch.column(0))).items()}

    return map_texts(docs, {"text": text_col}, make, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]), docs.columns if keep is None else keep)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial count: the regularised incomplete beta function at 1 - p, by its continued fraction."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x > (a + 1) / (a + b + 2):
        return max(0.0, 1 - front * _fraction(b, a, p) / b)
    return min(1.0, front * _fraction(a, b, x) / a)


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value = d
    for m in range(1, TERMS):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def exceeded(value: Column, cutoffs: tuple[float, ...]) -> Column:
    """How many of a rule's cutoffs a measure exceeds."""
    return sum(((value > c).cast("int") for c in cutoffs), F.lit(0))


def rejected(marks: np.ndarray, policy: tuple[int, ...]) -> np.ndarray:
    """Whether each row of cutoffs exceeded, a column per rule, is rejected: a policy uses so many cutoffs of each rule,
    from the loosest on."""
    sizes = np.array([len(c) for _, c in RULES])
    return (marks > sizes - np.array(policy)).any(axis=1)


def policies(marks: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple[int, ...]]:
    """The sequence of policies that counts of good and bad documents choose, from the mildest to the strictest."""
    found: list[tuple[int, ...]] = []
    policy = [0] * len(RULES)
    all_good, all_bad = max(1, good.sum()), max(1, bad.sum())
    while True:
        left = ~rejected(marks, tuple(policy))
        best = None
        for r, (_, cutoffs) in enumerate(RULES):
            by = [np.bincount(marks[left, r], weights=n[left], minlength=len(cutoffs) + 1)[::-1].cumsum() for n in (good, bad)]
            for used in range(policy[r] + 1, len(cutoffs) + 1):
                # Rows that exceed at least size - used + 1 cutoffs are the first ``used`` of the reversed counts.
                g, b = by[0][used - 1], by[1][used - 1]
                if b / all_bad > PENALTY * g / all_good:
                    rank = (b / (g + 1), -r, -used)
                    best = max(best, (rank, r, used)) if best else (rank, r, used)
        if best is None:
            return found
        policy[best[1]] = best[2]
        found.append(tuple(policy))


def admitted(rejections: list[int], good: int, risk: float, level: float) -> int:
    """How many policies, mildest first, are shown to reject less than ``risk`` of good documents."""
    for i, k in enumerate(rejections):
        if not good or k > good * risk or binomial_tail(k, good, risk) > level:
            return i
    return len(rejections)


def certified(marks: np.ndarray, good: np.ndarray, bad: np.ndarray, half: np.ndarray, level: float) -> tuple[int, ...] | None:
    """The last admitted policy: chosen on the rows of half 0, tested on the good documents of half 1."""
    sequence = policies(marks[half == 0], good[half == 0], bad[half == 0])
    marks, good = marks[half == 1], good[half == 1]
    passed = admitted([int(good[rejected(marks, p)].sum()) for p in sequence], int(good.sum()), RISK, level)
    return sequence[passed - 1] if passed else None


def choose_cutoffs(labelled: DataFrame) -> DataFrame:
    """(stratum, a cutoff per rule or null) from (stratum, good, half, measures).

    Documents are counted first by the cutoffs they exceed, so a stratum is a table of bounded size however many labels
    it has; strata are chosen apart from one another.
    """
    names = [r for r, _ in RULES]
    marks = labelled.select("stratum", "half", "good", *[exceeded(F.col(r), c).alias(r) for r, c in RULES])
    counted = materialize(marks.groupBy("stratum", "half", *names).agg(F.sum("good").alias("n_good"), F.sum(1 - F.col("good")).alias("n_bad")), "quality-counts")
    strata = max(1, counted.select("stratum").distinct().count())

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        best = certified(rows[names].to_numpy(np.int64), rows.n_good.to_numpy(np.int64), rows.n_bad.to_numpy(np.int64), rows.half.to_numpy(), LEVEL / strata)
        cutoffs = [c[used - 1] if used else None for (_, c), used in zip(RULES, best or [0] * len(RULES), strict=True)]
        return pd.DataFrame([[rows.stratum.iloc[0], *cutoffs]], columns=["stratum", *names])

    schema = "stratum string, " + ", ".join(f"{n} double" for n in names)
    return materialize(counted.groupBy("stratum").applyInPandas(choose, schema), "quality-cutoffs")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Per input row: doc_id, COUNTS, stratum, base_failed, kept.

    Null texts count as empty and fail the base rule (too few words); a null stratum is one of its own; strata without
    enough good labels keep all that pass the base rule. Labels of the held-out fold and null labels are not used. Whole
    texts are counted, however long. A measure equal to a cutoff is not rejected; of cutoffs that choose equally well the
    first rule's loosest is taken. Rows that repeat an id are judged each by its text; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    rows = docs.select(named(id_col).alias("doc_id"), named(stratum_col).cast("string").alias("stratum"), named(text_col).alias("text"))
    counted = counts(rows, keep=["doc_id", "stratum"])
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    counted = materialize(counted.withColumn("base_failed", base), "text-counts")
    known = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 1)).groupBy(F.col(id_col).alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("good"))
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)).cast("int")
    holdout = counted.where(~F.col("base_failed")).join(known, "doc_id").select("stratum", "good", half.alias("half"), *[c.alias(n) for n, c in measures().items()])
    cutoffs = choose_cutoffs(holdout).select(F.col("stratum").alias("of"), *[F.col(r).alias(f"{r}_cutoff") for r, _ in RULES])
    judged = counted.join(cutoffs, counted["stratum"].eqNullSafe(cutoffs["of"]), "left")
    fails = [F.coalesce(measures()[r] > F.col(f"{r}_cutoff"), F.lit(False)) for r, _ in RULES]
    return judged.select(*counted.columns, (~F.col("base_failed") & ~reduce(Column.__or__, fails)).alias("kept"))
