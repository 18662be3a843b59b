"""Labelled samples of bounded size, and one-dimensional calibration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import fold


def bounded(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """Rows whose hashed id falls below the share that keeps about ``bound`` of them: all rows where they are fewer."""
    count = rows.count()
    if count <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * bound / count))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of a bounded sample of labelled documents outside the held-out fold.

    The sample of ids has a proven bound, so it is broadcast and the texts are not shuffled.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 1))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    sample = bounded(known, "doc_id", bound)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")


def logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through counts of positives and negatives at ``x``."""
    n = positive + negative
    slope, base = 0.0, math.log((positive.sum() + 1) / (negative.sum() + 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * x + base, -30, 30)))
        w = n * p * (1 - p)
        r = positive - n * p
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(r * x).sum() - ridge * slope, r.sum()]))
        step = np.clip(step, -2, 2)
        slope, base = slope + step[0], base + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(base)
