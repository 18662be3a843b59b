"""Alignment of two tokenizers: shared byte cuts, groups of tokens between them, and how often ids are linked.

A text is cut into spans before each space that follows a non-space, which neither tokenizer joins across; so token ends
of both coincide there, and a span's alignment is the same wherever it occurs. Per distinct span, bitsets mark the byte
offsets where tokens of either side end; their AND gives the shared cuts, popcounts below a cut give the ranks of the
tokens that end there, and the tokens between two cuts are a group whose links are expanded by distinct ids.

Documents are gathered in blocks with a dictionary of their id pairs. Only the dictionaries are shuffled: corpus-wide
counts are sums over blocks, and go back to each block for its own pairs.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import storage
from gridloom.session import materialize

from .batches import BATCH_BYTES, release, strings

#: Bytes of a worker's cache of spans (about), characters that a tokenizer encodes at a time, (document, pair) entries of
#: a block, and links of a group that are expanded one by one; larger groups are expanded by distinct ids.
CACHE_BYTES, PACK_CHARS, BLOCK_ENTRIES, GROUP_LINKS = 64 << 20, 1 << 16, 500_000, 1 << 12
#: Spans that are written together.
WRITTEN_SPANS = 1 << 16
#: A pair of ids is one number: the id of A above the 20 bits of that of B.
PAIR_BITS = 20
#: What an entry of the cache takes beside its arrays.
ENTRY_BYTES = 150

#: Letters and marks of spans that are cut finer, and white space as Unicode has it.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
_JOINABLE = re.compile(f" ?[^{_WHITE}](?:.*[^{_WHITE}])?", re.DOTALL).fullmatch


class Spans:
    """Cuts a space and a text where neither tokenizer can join: see ``Aligner``.

    A byte-level pre-token never holds white space behind other characters, nor letters next to marks (but for the
    apostrophe). A model of pieces joins two characters only if some piece holds them side by side, which is looked up.
    """

    def __init__(self, pieces: list[str]):
        beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        white, letter = re.compile(f"[{_WHITE}]").match, re.compile(f"[{_LETTER}]").match
        #: White space that pieces hold behind other characters, or a line feed that they hold before any.
        odd = {x[1] for x in beside if white(x[1]) and not white(x[0])} | {"\n" for x in beside if x[0] == "\n"}
        self.whole = " " in odd or "\n" in odd
        self.odd = re.compile("[" + "".join(map(re.escape, odd)) + "]").search if odd else lambda text: None
        mixed = {c for x in beside if letter(x[0]) or letter(x[1]) for c in x}
        marks = "".join(re.escape(m) for m in _MARKS if m not in mixed) or r"\n"
        self.fine = re.compile(
            f" ?[{_LETTER}]++(?=[ \n{marks}]|\\Z)| ?[{marks}]++(?=[ \n{_LETTER}]|\\Z)|\n(?=[{_LETTER}{marks}])|[{_WHITE}]*+[^{_WHITE}]++|[{_WHITE}]+\\Z"
        ).findall
        self.coarse = re.compile(f"(?<=[^{_WHITE}])(?= )").split

    def cut(self, text: str) -> list[str]:
        """Parts that make up a space and the text."""
        if self.whole:
            return [" " + text]
        return self.coarse(" " + text) if self.odd(text) else self.fine(" " + text)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.zeros(self.size + len(values) + 1024, self.held.dtype)])
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.size]


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where parts of these sizes begin, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one after the other."""
    return np.repeat(first - _starts(sizes)[:-1], sizes) + np.arange(sizes.sum())


def _bitset(ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits at the ends, and for each byte the bits set before it."""
    bits = np.zeros(size, bool)
    bits[ends] = True
    packed = np.packbits(bits, bitorder="little")
    return packed, _starts(np.bitwise_count(packed))[:-1]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte offsets at which tokens of both sides end, and how many tokens of A and of B end up to each.

    Ends are bits of packed bitsets: AND gives the shared ones, and the rank of a cut is the popcount up to it.
    """
    size = int(max(ends_a[-1], ends_b[-1])) + 1
    (a, before_a), (b, before_b) = _bitset(ends_a, size), _bitset(ends_b, size)
    cuts = np.flatnonzero(np.unpackbits(a & b, bitorder="little"))
    at, mask = cuts >> 3, ((2 << (cuts & 7)) - 1).astype(np.uint8)
    return cuts, before_a[at] + np.bitwise_count(a[at] & mask), before_b[at] + np.bitwise_count(b[at] & mask)


class Aligner:
    """Aligns texts span by span, each distinct span once while it stays cached."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary = self.a.get_vocab()
        self.a_width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, number in vocabulary.items():
            self.a_width[number] = len(piece)  # the byte-level alphabet has a character for each byte
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE(p)) else p.replace("▁", " ").encode("utf-8") for p in pieces]
        self.b_width = np.array([len(x) for x in self.b_bytes], np.int64)
        self.spans = Spans([p.replace("▁", " ") for p in pieces if not _BYTE(p)])
        # Decimal digits of every id, right-aligned, and how many.
        ids = np.arange(max(len(self.a_width), len(pieces)))
        self.digits = np.stack([ids // 10**k % 10 + 48 for k in range(6, -1, -1)], axis=1).astype(np.uint8)
        self.n_digits = np.array([len(str(i)) for i in ids.tolist()], np.int64)
        self.base = 1 << PAIR_BITS
        if len(pieces) > self.base or len(self.a_width) > self.base:
            raise ValueError(f"ids above {self.base} cannot be paired")
        self.clear()

    def clear(self) -> None:
        """Forget all spans. Per span: tokens of A (-1: bytes differ) and of B, groups, links, and the ends of its items
        (ids as they are written, with the sign behind each) and of its pairs."""
        self.number: dict[str, int] = {}
        self.n_a, self.n_b, self.groups, self.links, self.item_end, self.pair_end = (Grown(np.int64) for _ in range(6))
        self.items, self.signs, self.pairs, self.times = Grown(np.int32), Grown(np.uint8), Grown(np.int64), Grown(np.int64)

    def _held(self) -> int:
        return ENTRY_BYTES * len(self.number) + 5 * self.items.size + 16 * self.pairs.size

    def learn(self, parts: list[str]) -> None:
        """Align the parts that are not cached, some at a time."""
        if self._held() > CACHE_BYTES:
            self.clear()
        joined: list[str] = []
        size = 0
        for part in set(parts).difference(self.number):
            if self.spans.whole or not _JOINABLE(part) or self.spans.odd(part):
                self._learn_alone(part)
                continue
            joined.append(part)
            size += len(part) + 1
            if size >= PACK_CHARS:
                self._learn_joined(joined)
                joined, size = [], 0
        if joined:
            self._learn_joined(joined)

    def _learn_joined(self, parts: list[str]) -> None:
        """Spans one behind the other are encoded as one text: those that begin with a space as they are, the others each
        behind a line feed, which is a span of its own."""
        laid: list[str] = [" x"]
        wanted = [False]
        for part in parts:
            if part[0] != " ":
                laid.append("\n")
                wanted.append(False)
            laid.append(part)
            wanted.append(True)
        text = "".join(laid)
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        ends = np.cumsum([len(x.encode()) for x in laid])
        found = [self._cut(ids, width, ends) for ids, width in ((a, self.a_width), (b, self.b_width))]
        if any(f is None for f in found) or b"".join([self.b_bytes[i] for i in b.tolist()]) != text.encode():
            for part in parts:
                self._learn_alone(part)
            return
        keep = np.array(wanted)
        sides = [(ids[np.repeat(keep, sizes)], sizes[keep]) for ids, sizes in zip((a, b), found, strict=True)]
        self._add(parts, *sides[0], *sides[1])

    @staticmethod
    def _cut(ids: np.ndarray, width: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Tokens of each span; none if a token lies across an end."""
        own = np.cumsum(width[ids])
        at = np.searchsorted(own, ends)
        if own[-1] != ends[-1] or (own[at] != ends).any():
            return None
        return np.diff(at, prepend=-1)

    def _learn_alone(self, part: str) -> None:
        a = self.a.encode(part, add_special_tokens=False).ids
        # Behind a line feed, which no piece joins to anything, there is no space that the model adds.
        b = self.b.encode(part[1:]) if self.spans.whole else self.b.encode("\n" + part)[2:]
        if b"".join([self.b_bytes[i] for i in b]) == part.encode():
            self._add([part], np.array(a, np.int64), np.array([len(a)]), np.array(b, np.int64), np.array([len(b)]))
        else:
            none = np.zeros(0, np.int64)
            self._add([part], none, np.array([0]), none, np.array([0]))
            self.n_a.all[-1] = -1

    def _add(self, parts: list[str], a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> None:
        """Groups, links and pairs of spans that lie one behind the other; all ends of spans are shared cuts."""
        first = len(self.number)
        self.number.update(zip(parts, range(first, first + len(parts)), strict=True))
        n = len(parts)
        if len(a):
            cuts, to_a, to_b = shared_cuts(np.cumsum(self.a_width[a]), np.cumsum(self.b_width[b]))
        else:
            cuts = to_a = to_b = np.zeros(0, np.int64)
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        span = np.searchsorted(_starts(size_a)[1:], to_a)  # of each group
        group_a, group_b = np.repeat(np.arange(len(cuts)), n_a), np.repeat(np.arange(len(cuts)), n_b)
        items, signs = np.zeros(len(a) + len(b), np.int32), np.full(len(a) + len(b), 44, np.uint8)  # a comma
        items[np.arange(len(a)) + (to_b - n_b)[group_a]] = a
        items[np.arange(len(b)) + to_a[group_b]] = b
        signs[to_a + to_b - n_b - 1] = 124  # a bar
        signs[to_a + to_b - 1] = 59  # a semicolon
        links = n_a * n_b
        small = links <= GROUP_LINKS
        # Every link of the smaller groups: the k-th joins token k // n_b of A with token k % n_b of B.
        at, m = np.flatnonzero(small), links[small]
        k = np.arange(m.sum()) - np.repeat(_starts(m)[:-1], m)
        g = np.repeat(at, m)
        keys = [a[(to_a - n_a)[g] + k // n_b[g]] * self.base + b[(to_b - n_b)[g] + k % n_b[g]]]
        owners, weights = [span[g]], [np.ones(len(g), np.int64)]
        for x in np.flatnonzero(~small).tolist():
            (own, p), (other, q) = (np.unique(ids[to - c : to], return_counts=True) for ids, to, c in ((a, to_a[x], n_a[x]), (b, to_b[x], n_b[x])))
            keys.append((own[:, None] * self.base + other).ravel())
            weights.append((p[:, None] * q).ravel())
            owners.append(np.full(len(keys[-1]), span[x]))
        pairs = self.base * len(self.a_width)
        owner, pair, times = _tallied(np.concatenate(owners), np.concatenate(keys), np.concatenate(weights), pairs)
        for column, values in (
            (self.n_a, size_a),
            (self.n_b, size_b),
            (self.groups, np.bincount(span, minlength=n)),
            (self.links, np.diff(_starts(links)[np.searchsorted(span, np.arange(n + 1))])),
            (self.item_end, self.items.size + np.cumsum(size_a + size_b)),
            (self.pair_end, self.pairs.size + np.cumsum(np.bincount(owner, minlength=n))),
            (self.items, items),
            (self.signs, signs),
            (self.pairs, pair),
            (self.times, times),
        ):
            column.add(values)

    def _digests(self, ids: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> list[str]:
        """SHA-256 of each text's groups, which are written a bounded number of spans at a time."""
        last = self.item_end.all
        first = np.concatenate([[0], last[:-1]]) if len(last) else last
        digests = [sha256() if ok and x < y else None for x, y, ok in zip(ends.tolist(), ends[1:].tolist(), whole.tolist(), strict=False)]
        begun = 0
        for lo in range(0, len(ids), WRITTEN_SPANS):
            part = ids[lo : lo + WRITTEN_SPANS]
            text, at = self._written(first[part], last[part] - first[part])
            while begun < len(digests):
                x, y = max(int(ends[begun]), lo), min(int(ends[begun + 1]), lo + len(part))
                if digests[begun] is not None and x < y:
                    # The last group of a text has no sign behind it.
                    digests[begun].update(text[at[x - lo] : at[y - lo] - (y == ends[begun + 1])])
                if y < ends[begun + 1]:
                    break
                begun += 1
        return [d.digest() if d else b"" for d in digests]

    def _written(self, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of spans as ASCII, and where each span begins in it."""
        at = _ranges(first, sizes)
        ids, signs = self.items.all[at], self.signs.all[at]
        width = self.n_digits[ids]
        ends = np.cumsum(width + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = signs
        for k in range(int(width.max()) if len(width) else 0):
            has = width > k
            out[ends[has] - 2 - k] = self.digits[ids[has], 6 - k]
        return out, _starts(width + 1)[_starts(sizes)]

    def align(self, texts: list[str]) -> dict[str, object]:
        """Per text: n_a, n_b, n_groups, n_links, sha (bytes); and (doc, key, times) of each text's distinct pairs, by text."""
        parts = [self.spans.cut(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        self.learn(flat)
        ids = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        ends = _starts(np.fromiter(map(len, parts), np.int64, len(parts)))
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        whole = np.bincount(doc[self.n_a.all[ids] < 0], minlength=len(texts)) == 0
        totals = []
        for column in (self.n_a, self.n_b, self.groups, self.links):
            sums = _starts(column.all[ids])
            totals.append(np.where(whole, sums[ends[1:]] - sums[ends[:-1]], 0))
        sha = self._digests(ids, ends, whole)
        keep = whole[doc]
        spans = max(1, len(self.number))
        seen, often = np.unique(doc[keep] * spans + ids[keep], return_counts=True)
        owner, span = seen // spans, seen % spans
        last = self.pair_end.all[span]
        n = last - np.where(span > 0, self.pair_end.all[span - 1], 0) if len(span) else span
        at = _ranges(last - n, n)
        owner, key, times = _tallied(np.repeat(owner, n), self.pairs.all[at], self.times.all[at] * np.repeat(often, n), self.base * len(self.a_width))
        return {**dict(zip(_COUNTS, totals, strict=True)), "sha": sha, "doc": owner, "key": key, "times": times}


def _tallied(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key) in order, with the sum of their weights; keys lie below ``keys``."""
    both = owner * keys + key
    order = np.argsort(both)
    both, weight = both[order], weight[order]
    first = np.flatnonzero(np.diff(both, prepend=-1))
    both = both[first]
    return both // keys, both % keys, np.add.reduceat(weight, first) if len(first) else weight


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker, so that its files are read once."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("sha", T.ArrayType(T.BinaryType()))]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in _COUNTS]
    # Little-endian arrays: pairs of each document, their places in the dictionary, occurrences; the dictionary and the documents of each pair.
    + [T.StructField(c, T.BinaryType()) for c in ("sizes", "places", "times", "keys", "holders")]
)
_DICTIONARY = "block long, place int, pair long, holders long"
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _packed(held: dict[str, list], block: int) -> pa.RecordBatch:
    joined = {c: np.concatenate(held[c]) for c in (*_COUNTS, "sizes", "key", "times")}
    keys, places = np.unique(joined["key"], return_inverse=True)
    arrays = {
        "block": pa.array([block], pa.int64()),
        "doc_ids": pa.array([held["doc_ids"]], pa.list_(pa.int64())),
        "sha": pa.array([held["sha"]], pa.list_(pa.binary())),
        **{c: pa.array([joined[c]], pa.list_(pa.int64())) for c in _COUNTS},
        "sizes": joined["sizes"].astype("<i8"),
        "places": places.astype("<u4"),
        "times": joined["times"].astype(next(k for k in ("<u1", "<u4", "<i8") if joined["times"].max(initial=0) <= np.iinfo(k).max)),
        "keys": keys.astype("<i8"),
        "holders": np.bincount(places, minlength=len(keys)).astype("<i8"),
    }
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array([x.tobytes()], pa.binary()) for x in arrays.values()], names=list(arrays))


def _blocks(a_path: str, b_path: str, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        block = storage.task_number() << 32
        empty = lambda: {c: [] for c in ("doc_ids", "sha", *_COUNTS, "sizes", "key", "times")}
        held, size = empty(), 0
        for batch in batches:
            found = own.align(strings(batch.column(1)))
            held["doc_ids"] += batch.column(0).to_pylist()
            held["sha"] += found["sha"]
            for c in (*_COUNTS, "key", "times"):
                held[c].append(found[c])
            held["sizes"].append(np.bincount(found["doc"], minlength=batch.num_rows))
            size += len(found["key"]) + batch.num_rows
            if size >= entries:
                yield _packed(held, block)
                held, size, block = empty(), 0, block + 1
        if held["doc_ids"]:
            yield _packed(held, block)
        held = None
        own.clear()  # the tokenizers stay with the worker, the spans do not
        release()

    return run


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            keys, holders = (np.frombuffer(row[c], "<i8") for c in ("keys", "holders"))
            for x in range(0, len(keys), 1 << 16):
                part = keys[x : x + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), row["block"])), pa.array(np.arange(x, x + len(part), dtype=np.int32)), pa.array(part), pa.array(holders[x : x + (1 << 16)])],
                    names=["block", "place", "pair", "holders"],
                )


def _summed(blocks: pa.Table, stats: pa.Table) -> pa.Table:
    """The documents of one block, with sums over their pairs of what the corpus says of these."""
    place = stats.column("place").to_numpy()
    counts, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    counts[place], best[place] = stats.column("count").to_numpy(), stats.column("best").to_numpy()
    out = []
    for row in blocks.to_pylist():
        sizes, places = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["places"], "<u4")
        # As wide as the largest number needs.
        times = np.frombuffer(row["times"], f"<{'ui'[len(row['times']) == 8 * len(places)]}{len(row['times']) // max(1, len(places)) or 1}").astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        totals = []
        for value in (times * best[places], times * counts[places]):
            sums = np.concatenate([[0], np.cumsum(value)])
            totals.append(sums[ends[1:]] - sums[ends[:-1]])
        arrays = [pa.array(row["doc_ids"], pa.int64()), *[pa.array(row[c], pa.int64()) for c in _COUNTS], *[pa.array(t, pa.int64()) for t in totals], pa.array([x.hex() for x in row["sha"]], pa.string())]
        out.append(pa.table(arrays, names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]))
    return pa.concat_tables(out)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair of ids linked, and whether no pair of its A id has more.

    An A id has at most as many rows here as B has ids, so the maximum is one partial aggregation of bounded groups.
    """
    counts = blocks.select("block", "keys", "holders").mapInArrow(_dictionary, _DICTIONARY).groupBy("pair").agg(F.sum("holders").alias("count"))
    counts = materialize(counts.withColumn("a", F.shiftright("pair", PAIR_BITS)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("_most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level tokenizers file, B a sentencepiece model; A encodes a space and the text, B the text, both without
    special tokens. A pair of ids counts once for each row that links it, rows that repeat an id or a text each for
    themselves. Null and empty texts, and those whose tokens of A or B do not spell them (B reads U+2581 as a space), have
    no tokens: zeros and an empty string. Null ids stay. Very long texts are taken span by span; a span without a space
    goes to both tokenizers whole. Other columns are ignored. An empty table gives none.

    The blocks lie in the folder that all executors share; what is shuffled are the dictionaries of their pairs, and the
    blocks once.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks(a_path, b_path, entries), _BLOCK), "aligned-blocks")
    counts = pair_counts(blocks)
    own = blocks.select("block", "keys", "holders").mapInArrow(_dictionary, _DICTIONARY).select("block", "place", "pair")
    stats = own.join(counts, "pair").select("block", "place", "count", "best")
    return blocks.drop("keys", "holders").groupBy("block").cogroup(stats.groupBy("block")).applyInArrow(_summed, _ALIGNED)
