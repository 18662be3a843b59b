"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the split pattern is merged on its own: every adjacent pair whose joined bytes have a rank waits in the
bucket of that rank as a position in a linked list; a three-level bitmap of non-empty buckets gives the lowest rank by
find-first-set; an entry whose pair has changed since is stale and skipped. A pre-token of n bytes costs O(n log n),
however long. The short pre-tokens of a batch share one queue: their lists are joined by barriers that no pair crosses,
and a bucket is served for all of them at once. Repeated pre-tokens come from a bounded cache.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts, strings

#: Bytes of a worker's cache (about), and what an entry takes beside its text and ids; bytes of the longest pre-token that
#: shares a queue with others, how many share one, and how many of a long text are split off at a time.
CACHE_BYTES, ENTRY_BYTES, SHORT, TOGETHER, SPLIT_TOKENS = 32 << 20, 220, 64, 50_000, 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class RankQueue:
    """Buckets by rank, each with whatever ``add`` puts in; the lowest non-empty rank by find-first-set."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, marked as non-empty."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.top |= 1 << (rank >> 12)
        return found

    def lowest(self) -> int:
        """The lowest rank with a bucket, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) | ((word & -word).bit_length() - 1)
        word = self.low[b]
        return (b << 6) | ((word & -word).bit_length() - 1)

    def drop(self, rank: int) -> list:
        """Take the bucket of the lowest rank out."""
        b, a = rank >> 6, rank >> 12
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return self.buckets.pop(rank)


class PairRanks:
    """Rank of the joined bytes of two tokens, for arrays of token pairs; -1 where the joined bytes are no token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values(), default=0) + 2  # one more id, for barriers
        pairs = [(x * self.base + y, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (x := ranks.get(token[:i])) is not None and (y := ranks.get(token[i:])) is not None]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.values = np.array([v for _, v in pairs] or [-1], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


class Numbers(dict):
    """Numbers of pre-tokens in order of arrival; ``fresh`` lists those that came since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        self.fresh.append(token)
        return number


class Tables:
    """What a rank file and a split pattern fix."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.pair_ranks = PairRanks(ranks)
        self.barrier = self.pair_ranks.base - 1
        self.of_byte = np.array([ranks.get(bytes([b]), self.barrier) for b in range(256)], np.int32)
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class ByteBpe:
    """Encoder of one rank file, with a cache of pre-tokens that is bounded by its bytes."""

    def __init__(self, tables: Tables):
        self.ranks, self.split, self.pair_ranks, self.barrier, self.of_byte = tables.ranks, tables.split, tables.pair_ranks, tables.barrier, tables.of_byte
        self.decode = tables.decode
        self.queue = RankQueue(max(self.ranks.values(), default=0))
        self.numbers = Numbers()
        self.packed: list[bytes] = []
        self.cached = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, np.ndarray]] = []
        for at, text in enumerate(texts):
            for tokens in self._pre_tokens(text):
                waiting.append((at, np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))))
                if len(self.numbers.fresh) >= TOGETHER:
                    self._settle(waiting, out)
        self._settle(waiting, out)
        return [b"".join(parts) for parts in out]

    def _pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, a long one's some at a time."""
        if len(text) <= SPLIT_TOKENS:
            yield self.split.findall(text)
            return
        found = (match[0] for match in self.split.finditer(text))
        while tokens := list(islice(found, SPLIT_TOKENS)):
            yield tokens

    def _settle(self, waiting: list[tuple[int, np.ndarray]], out: list[list[bytes]]) -> None:
        """Encode the pre-tokens that are new, and add what waits to the texts it comes from."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        new: list[bytes] = [b""] * len(fresh)
        short: list[tuple[int, bytes]] = []
        for at, token in enumerate(fresh):
            piece = token.encode("utf-8")
            whole = self.ranks.get(piece)
            if whole is not None:
                new[at] = pack("<I", whole)
            elif len(piece) > SHORT:
                new[at] = array("I", self.merge(piece)).tobytes()
            else:
                short.append((at, piece))
        self._fill(new, short)
        self.packed += new
        for at, own in waiting:
            out[at].append(b"".join(map(self.packed.__getitem__, own.tolist())))
        waiting.clear()
        self.cached += sum(map(len, fresh)) + sum(map(len, new)) + ENTRY_BYTES * len(fresh)
        if self.cached > CACHE_BYTES:
            self.numbers.clear()
            self.packed.clear()
            self.cached = 0

    def _fill(self, new: list[bytes], short: list[tuple[int, bytes]]) -> None:
        for first in range(0, len(short), TOGETHER):
            some = short[first : first + TOGETHER]
            for (at, _), packed in zip(some, self.merge_many([piece for _, piece in some]), strict=True):
                new[at] = packed

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Merge short pre-tokens together: of each, the leftmost pair of the lowest rank is merged at a time."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes + 1) - sizes  # a barrier before each
        total = int(starts[-1] + sizes[-1]) + 1
        token = np.full(total, self.barrier, np.int32)
        inside = np.ones(total, bool)
        inside[starts - 1] = inside[-1] = False
        token[inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.cumsum(~inside, dtype=np.int32)
        after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        alive = inside.copy()
        waiting = np.full(total, -1, np.int32)
        waiting[:-1] = self.pair_ranks(token[:-1], token[1:])
        queue = self.queue
        first = np.flatnonzero(waiting >= 0)
        self._push(waiting[first], first)
        while (rank := queue.lowest()) >= 0:
            at = queue.drop(rank)
            at = np.sort(at[0] if len(at) == 1 else np.concatenate(at))
            at = at[waiting[at] == rank]
            if not len(at):
                continue
            own = word[at]
            leftmost = np.ones(len(at), bool)
            np.not_equal(own[1:], own[:-1], out=leftmost[1:])
            if not leftmost.all():
                queue.bucket(rank).append(at[~leftmost])
                at = at[leftmost]
            gone = after[at]
            end = after[gone]
            left = before[at]
            token[at] = rank
            after[at] = end
            before[end] = at
            waiting[gone] = -1
            alive[gone] = False
            place = np.concatenate((at, left))
            found = self.pair_ranks(token[place], token[np.concatenate((end, at))])
            waiting[place] = found
            some = found >= 0
            if some.any():
                self._push(found[some], place[some])
        ids = token[alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive)[starts + sizes - 1] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        bucket = self.queue.bucket
        if len(ranks) < 2:
            for rank in ranks.tolist():
                bucket(rank).append(places)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cuts.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[edges[:-1]].tolist(), edges, edges[1:], strict=False):
            bucket(rank).append(places[a:b])

    def merge(self, piece: bytes) -> list[int]:
        """Merge one pre-token of any length; buckets are heaps of positions."""
        size, rank_of, queue = len(piece), self.ranks.get, self.queue
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        waiting = [-1] * size

        def look(i: int) -> None:
            """Let the pair that starts at i wait in its bucket, if it has a rank."""
            rank = rank_of(piece[i : after[after[i]]]) if after[i] < size else None
            if rank is None:
                waiting[i] = -1
            elif waiting[i] != rank:
                waiting[i] = rank
                heappush(queue.bucket(rank), i)

        for i in range(size):
            look(i)
        while (rank := queue.lowest()) >= 0:
            bucket = queue.buckets[rank]
            i = heappop(bucket)
            if not bucket:
                queue.drop(rank)
            if waiting[i] != rank:
                continue
            gone = after[i]
            waiting[i] = waiting[gone] = -1
            after[i] = after[gone]
            if after[i] < size:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        ids, i = [], 0
        while i < size:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids


_ENCODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str = "") -> ByteBpe:
    """One encoder per Python worker: its tables are read once, and its bounded cache lasts from task to task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ByteBpe(Tables(load_ranks(path), pattern))
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, with_decoded: bool = False) -> DataFrame:
    """Add ``ids`` (binary: unsigned 32-bit little-endian ids of the whole text) to the columns ``keep``, and with
    ``with_decoded`` also ``decoded`` (binary: the bytes that the ids decode to).

    Null texts count as empty and give no ids; special-token strings are ordinary text. Very long texts are split and
    merged some pre-tokens at a time, whole, and a pre-token of any length is merged by the queue. Rows are independent,
    so repeated rows, ties and empty tables need no care; ``ids`` and ``decoded`` take the place of kept columns of those
    names.
    """

    def make():
        bpe = coder(path, pattern)

        def run(batch: pa.RecordBatch) -> dict[str, object]:
            ids = bpe.encode(strings(batch.column(0)))
            out = {"ids": pa.array(ids, pa.binary())}
            return out | {"decoded": pa.array(map(bpe.decode, ids), pa.binary())} if with_decoded else out

        return run

    added = [T.StructField("ids", T.BinaryType())] + ([T.StructField("decoded", T.BinaryType())] if with_decoded else [])
    return map_texts(docs, {"text": text_col}, make, T.StructType(added), docs.columns if keep is None else keep)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded`` (binary: the bytes of the ids) to the columns ``keep``; null ids count as none."""

    def make():
        bpe = coder(path)
        return lambda batch: {"decoded": pa.array([bpe.decode(x or b"") for x in batch.column(0).to_pylist()], pa.binary())}

    return map_texts(encoded, {"ids": ids_col}, make, T.StructType([T.StructField("decoded", T.BinaryType())]), encoded.columns if keep is None else keep)
