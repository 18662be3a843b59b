"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the byte pieces of a fixed public vocabulary. The likelihood of a word is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The probabilities
are fitted by expectation-maximisation over the word counts of a bounded sample of labelled documents, each pass one
Spark job whose expected piece counts are summed by language and piece.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import discard, materialize

from .batches import BATCH_BYTES, map_texts, release, strings
from .byte_bpe import load_ranks
from .text import fold

#: Labelled documents that a model is fitted on, at most about; passes of EM; weight of the background distribution.
SAMPLE_DOCS, PASSES, BACKGROUND = 6_000, 2, 200.0
#: Documents of a language at least, if it has them.
LEAST_DOCS = 20
#: Bytes of the longest word that is not cut into parts; words times languages, and bytes, that are scored together; bytes
#: after which forward sums are brought back into range.
SHORT, TOGETHER, TOGETHER_BYTES, RESCALE = 48, 120_000, 4 << 20, 16
#: Factor per byte that keeps forward sums within range, log-likelihoods that a task's cache holds, and words of a text
#: that are summed at a time.
LIFT, CACHE_VALUES, SUM_WORDS = 30.0, 1_000_000, 20_000

_LETTERS = regex.compile(r"\p{L}+").findall


def words(text: str) -> list[str]:
    return _LETTERS(text.lower())


#: A piece that a spelled word can contain: bytes of small letters, and a space before them.
_OF_WORDS = re.compile(rb" ?[a-z\x80-\xff]*").fullmatch


class Pieces:
    """The byte pieces of a vocabulary file that words can contain, all single bytes among them, as a trie over sorted
    edges."""

    def __init__(self, path: str):
        self.number = {p: i for i, p in enumerate(sorted({p for p in load_ranks(path) if p and _OF_WORDS(p)} | {bytes([b]) for b in range(256)}))}
        self.longest = max(map(len, self.number))
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[tuple[int, int]] = []
        for piece in self.number:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    edges.append((nodes[piece[: n - 1]] * 256 + piece[n - 1], nodes[piece[:n]]))
        edges.sort()
        self.edges = np.array([a for a, _ in edges], np.int64)
        self.targets = np.array([b for _, b in edges], np.int32)
        self.piece = np.full(len(nodes), -1, np.int32)
        for piece, i in self.number.items():
            self.piece[nodes[piece]] = i
        self.length = np.array([len(p) for p in self.number], np.int32)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.targets[at], -1)

    def matches(self, words: list[bytes]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each start, the (end, words, pieces) of all pieces that occur in the words there."""
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        width = int(sizes.max())
        chars = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        for start in range(width):
            alive = np.flatnonzero(sizes > start)
            node = np.zeros(len(alive), np.int32)
            found = []
            for end in range(start + 1, min(width, start + self.longest) + 1):
                node = self.step(node, chars[alive, end - 1])
                on = (node >= 0) & (sizes[alive] >= end)
                alive, node = alive[on], node[on]
                if not len(alive):
                    break
                piece = self.piece[node]
                here = piece >= 0
                found.append((end, alive[here], piece[here]))
            yield found

    def parts(self, words: list[bytes]) -> list[list[bytes]]:
        """Each word cut wherever no piece that occurs in it lies across, so that its segmentations are those of its parts.

        All starts are looked up together, some bytes of text at a time. A byte that no longer piece holds stands between
        words.
        """
        text = b"\0".join(words)
        crossed = np.zeros(len(text) + 2, np.int32)
        chars = np.frombuffer(text, np.uint8)
        for first in range(0, len(text), TOGETHER_BYTES):
            at = np.arange(first, min(first + TOGETHER_BYTES, len(text)))
            node = np.zeros(len(at), np.int32)
            for n in range(self.longest):
                inside = at + n < len(text)
                at, node = at[inside], self.step(node[inside], chars[at[inside] + n])
                at, node = at[node >= 0], node[node >= 0]
                if not len(at):
                    break
                whole = at[self.piece[node] >= 0] if n else at[:0]
                np.add.at(crossed, whole + 1, 1)
                np.add.at(crossed, whole + n + 1, -1)
        cuts = np.flatnonzero(np.cumsum(crossed[: len(text)]) == 0).tolist()
        out: list[list[bytes]] = [[]]
        for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
            if text[a] == 0:
                out.append([])
            else:
                out[-1].append(text[a:b])
        return out


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def spelled(word: str) -> bytes:
    """A word as the vocabulary spells it: UTF-8 after a space."""
    return b" " + word.encode("utf-8")


class Model:
    """Languages and their piece probabilities (pieces x languages)."""

    def __init__(self, path: str, languages: list[str], probability: np.ndarray):
        self.path, self.languages, self.probability = path, languages, probability

    def lifted(self) -> np.ndarray:
        return self.probability * LIFT ** pieces(self.path).length[:, None].astype(float)

    def score_words(self, given: list[bytes], lifted: np.ndarray) -> np.ndarray:
        """Log-likelihoods (words x languages): the forward algorithm over all segmentations. Long words are the sums of
        their parts, each distinct one scored once."""
        sizes = np.fromiter(map(len, given), np.int64, len(given))
        long = np.flatnonzero(sizes > SHORT)
        if not len(long):
            return self._forward(given, lifted)
        out = np.empty((len(given), len(self.languages)))
        cut = pieces(self.path).parts([given[i] for i in long])
        number: dict[bytes, int] = {}
        for word in cut:
            for part in word:
                number.setdefault(part, len(number))
        short = np.flatnonzero(sizes <= SHORT)
        scored = self._forward([given[i] for i in short] + list(number), lifted)
        out[short] = scored[: len(short)]
        for i, word in zip(long, cut, strict=True):
            own = np.fromiter(map(number.__getitem__, word), np.int64, len(word))
            out[i] = sum(scored[len(short) + own[at : at + SUM_WORDS]].sum(axis=0) for at in range(0, len(own), SUM_WORDS))
        return out

    def _forward(self, given: list[bytes], lifted: np.ndarray) -> np.ndarray:
        """Words of like length together. Only as many sums are held as the longest piece reaches, and every RESCALE bytes
        those of a word are divided by the largest."""
        table = pieces(self.path)
        sizes = np.fromiter(map(len, given), np.int64, len(given))
        order = np.argsort(sizes, kind="stable")
        out = np.empty((len(given), len(self.languages)))
        ring = table.longest + 1
        at = 0
        while at < len(order):
            # As many as fit by number and, padded to the longest of them, by bytes.
            most = order[at : at + max(1, TOGETHER // len(self.languages))]
            some = most[: max(1, int(np.searchsorted(np.arange(1, len(most) + 1) * sizes[most], TOGETHER_BYTES, "right")))]
            at += len(some)
            size = sizes[some]
            forward = np.zeros((min(ring, int(size[-1]) + 1), len(some), len(self.languages)))
            scale = np.zeros((len(some), len(self.languages)))
            forward[0] = 1
            n = len(forward)
            for start, found in enumerate(table.matches([given[i] for i in some])):
                if start and start % RESCALE == 0:
                    alive = size >= start
                    top = np.maximum(forward[:, alive].max(axis=0), 1e-300)
                    forward[:, alive] /= top
                    scale[alive] += np.log(top)
                here = forward[start % n]
                for end, word, piece in found:
                    forward[end % n, word] += here[word] * lifted[piece]
                ended = np.flatnonzero(size == start + 1)
                here[...] = 0
                if len(ended):
                    out[some[ended]] = np.log(np.maximum(forward[(start + 1) % n, ended], 1e-300)) + scale[ended]
        out -= sizes[:, None] * math.log(LIFT)
        return out


def fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about SAMPLE_DOCS labelled documents outside the held-out fold, an equal number of each language or all that
    there are; LEAST_DOCS of each where languages are many.

    The driver gets one number per language and piece: the vocabulary's size times the number of languages.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    counts = materialize(known.groupBy("lang").agg(F.count("*").alias("docs")), "language-counts")
    quota = max(SAMPLE_DOCS // max(1, counts.count()), LEAST_DOCS)
    ids = known.join(counts, "lang").where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 40)) < F.lit(quota * float(1 << 40)) / F.col("docs"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                for word in words(text):
                    tally[lang, word] = tally.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in tally], pa.string()), pa.array([x for _, x in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], names=["lang", "word", "n"])

    counted = ids.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "word-counts")
    discard(counts)
    languages = [r.lang for r in counted.select("lang").distinct().orderBy("lang").collect()]
    table = pieces(path)
    probability = np.full((len(table.number), max(1, len(languages))), 1.0) / len(table.number)
    for _ in range(PASSES if languages else 0):
        model = spark.sparkContext.broadcast(Model(path, languages, probability))
        expected = counted.mapInArrow(_expectation(model), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        model.unpersist()
        soft = np.zeros_like(probability)
        soft[expected.piece.to_numpy(), expected.lang.to_numpy()] = expected.n.to_numpy()
        background = soft.sum(axis=1) + 0.01
        background /= background.sum()
        probability = (soft + BACKGROUND * background[:, None]) / (soft.sum(axis=0) + BACKGROUND)
    discard(counted)
    return Model(path, languages, probability)


def _expectation(model):
    """Expected piece counts of a batch of counted words under the model: forward and backward sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        table, lifted = pieces(own.path), own.lifted()
        place = {lang: i for i, lang in enumerate(own.languages)}
        soft = np.zeros((len(own.languages), len(table.number)))
        for batch in batches:
            rows = [(place[lang], spelled(w), n) for lang, w, n in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            long = [r for r in rows if len(r[1]) > SHORT]
            parts: dict[tuple[int, bytes], float] = {}
            for (lang, _, n), cut in zip(long, table.parts([r[1] for r in long]) if long else [], strict=True):
                for part in cut:
                    parts[lang, part] = parts.get((lang, part), 0) + n
            rows = [r for r in rows if len(r[1]) <= SHORT] + [(lang, part, n) for (lang, part), n in parts.items()]
            for lang, word, n in rows:
                if len(word) > SHORT:
                    _add_long(soft[lang], word, n, lifted[:, lang], table)
            rows = sorted((r for r in rows if len(r[1]) <= SHORT), key=lambda r: len(r[1]))
            for at in range(0, len(rows), TOGETHER // 4):
                some = rows[at : at + TOGETHER // 4]
                lang = np.array([r[0] for r in some])
                sizes = np.array([len(r[1]) for r in some])
                matched = list(table.matches([r[1] for r in some]))
                forward = np.zeros((len(matched) + 1, len(some)))
                backward = np.zeros_like(forward)
                forward[0] = 1
                backward[sizes, np.arange(len(some))] = 1
                for start, found in enumerate(matched):
                    for end, word, piece in found:
                        forward[end, word] += forward[start, word] * lifted[piece, lang[word]]
                for start in range(len(matched) - 1, -1, -1):
                    for end, word, piece in matched[start]:
                        backward[start, word] += backward[end, word] * lifted[piece, lang[word]]
                weight = np.array([r[2] for r in some]) / np.maximum(backward[0], 1e-300)
                for start, found in enumerate(matched):
                    for end, word, piece in found:
                        np.add.at(soft, (lang[word], piece), forward[start, word] * lifted[piece, lang[word]] * backward[end, word] * weight[word])
        lang, piece = np.nonzero(soft > 1e-6)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(soft[lang, piece])], names=["lang", "piece", "n"])
        release()

    return run


def _add_long(soft: np.ndarray, word: bytes, times: float, lifted: np.ndarray, table: Pieces) -> None:
    """Add the expected piece counts of a part that cannot be cut, of any length: forward sums rescaled at each byte, then the share of
    each piece in the sum at its end, carried back from the word's end."""
    growth = [1.0] * (len(word) + 1)
    recent = [1.0]
    for end in range(1, len(word) + 1):
        value = 0.0
        for n in range(1, min(len(recent), table.longest) + 1):
            piece = table.number.get(word[end - n : end])
            if piece is not None:
                value += recent[-n] * lifted[piece]
        growth[end] = value = max(value, 1e-300)
        recent = [r / value for r in recent[1 - table.longest :]] + [1.0]
    visits = [0.0] * len(word) + [float(times)]
    for end in range(len(word), 0, -1):
        share = visits[end]
        for n in range(1, min(end, table.longest) + 1):
            share /= growth[end - n + 1]
            piece = table.number.get(word[end - n : end])
            if piece is not None:
                visits[end - n] += share * lifted[piece]
                soft[piece] += share * lifted[piece]


class Scorer:
    """Scores texts; keeps the log-likelihoods of words that it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.lifted = model, model.lifted()
        self.entries = max(1000, CACHE_VALUES // max(1, len(model.languages)))
        self.number: dict[str, int] = {}
        self.fresh: list[str] = []
        self.known = np.zeros((1024, len(model.languages)))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        languages = self.model.languages
        totals = np.zeros((len(texts), len(languages)))
        lettered = [False] * len(texts)
        waiting: list[tuple[int, np.ndarray]] = []
        for i, text in enumerate(texts if languages else []):
            own = words(text)
            lettered[i] = bool(own)
            for at in range(0, len(own), SUM_WORDS):
                waiting.append((i, self._numbers(own[at : at + SUM_WORDS])))
                if len(self.fresh) >= self.entries:
                    self._settle(waiting, totals)
        self._settle(waiting, totals)
        predicted, scores = ["und"] * len(texts), [0.0] * len(texts)
        for i in range(len(texts)):
            if lettered[i]:
                best = int(totals[i].argmax())
                predicted[i] = languages[best]
                scores[i] = float(1 / np.exp(totals[i] - totals[i, best]).sum())
        return predicted, scores

    def _numbers(self, own: list[str]) -> np.ndarray:
        number = self.number
        for word in set(own):
            if word not in number:
                number[word] = len(number)
                self.fresh.append(word)
        return np.fromiter(map(number.__getitem__, own), np.int64, len(own))

    def _settle(self, waiting: list[tuple[int, np.ndarray]], totals: np.ndarray) -> None:
        """Score the words that are new, and add what waits to the texts it comes from."""
        if self.fresh:
            first = len(self.number) - len(self.fresh)
            if len(self.number) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros((max(len(self.known), len(self.number)), totals.shape[1]))])
            self.known[first : len(self.number)] = self.model.score_words([spelled(w) for w in self.fresh], self.lifted)
            self.fresh = []
        for i, own in waiting:
            totals[i] += self.known[own].sum(axis=0)
        waiting.clear()
        if len(self.number) >= self.entries:
            self.number.clear()


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its posterior among the learnt languages, all equally likely) to ``keep``.

    Null texts and texts without a letter get ``und`` and 0, as do all texts where no language was learnt. Ties go to the
    first language by code point. Whole texts are scored, however long, some words at a time. Rows are independent, so
    repeated rows and empty tables need no care; ``lang_pred`` and ``score`` take the place of kept columns of those names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def run(batch: pa.RecordBatch) -> dict[str, object]:
            predicted, scores = scorer(strings(batch.column(0)))
            return {"lang_pred": pa.array(predicted, pa.string()), "score": pa.array(scores, pa.float64())}

        return run

    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_texts(docs, {"text": text_col}, make, added, docs.columns if keep is None else keep)
