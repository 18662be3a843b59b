"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are collapsed to distinct values. Two that differ in at most d of 64 bits agree on all but d of any B bit
blocks, so each value goes to one bucket for every choice of B - d blocks; B follows from the number of values, so that a
bucket of random values stays small however many there are. Within a bucket the values are sorted by Gray rank and every
eight neighbours share an upper node that holds the bits on which all below agree; pairs of nodes are compared from the
roots down, adding the differences on the bits that become common, and a pair of groups is dropped as soon as the sum
exceeds d, or when both already lie in one component. A bucket returns a spanning forest of its links, never all pairs.
Buckets above a size are cut into chunks whose pairs go to separate tasks, which keeps the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.components import connected_components
from gridloom.session import materialize

from .batches import map_texts, named

#: Differing bits of a link, words of a shingle, seed of its hash.
DISTANCE, SHINGLE, SEED = 4, 4, 42
#: Children of an index node; distinct values of a bucket above which it is cut into chunks; values that a task indexes
#: at a time; node pairs compared at a time; random values that a bucket should hold at most.
FANOUT, BUCKET_ROWS, INDEX_ROWS, FRONTIER, BUCKET_VALUES = 8, 50_000, 200_000, 1 << 17, 256
#: Shingles whose bits are counted at a time; columns of a bucket's key.
COUNT_ROWS, KEY = 1 << 16, 4


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit integer; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    count = max(1, len(words) - size + 1)
    stop = ends[-count:].tolist()
    start = [0, *(ends[: count - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, COUNT_ROWS):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start[at : at + COUNT_ROWS], stop[at : at + COUNT_ROWS], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fp`` (signed 64-bit) to the columns ``keep``; null texts count as empty."""

    def make():
        return lambda batch: {"fp": pa.array([fingerprint(x or b"") for x in batch.column(0).cast(pa.binary()).to_pylist()], pa.int64())}

    return map_texts(docs, {"text": text_col}, make, T.StructType([T.StructField("fp", T.LongType())]), docs.columns if keep is None else keep)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Per input row: doc_id, fp, component_id (the smallest id reachable over links, itself included).

    Rows with equal fingerprints are linked, texts without words (fingerprint 0) among them. Null texts count as empty;
    null ids never become a component_id unless the component has no other. Ids may be of any type that has an order;
    rows that repeat an id keep their own fingerprints. Whole texts are read, however long, some shingles at a time. An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    marked = materialize(fingerprints(docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")), keep=["doc_id"]), "fingerprints")
    values = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "values")
    edges = materialize(linked(values.select("fp"), distance, values.count()), "links")
    roots = connected_components(edges)
    # Both sides of each join are plain tables: Spark splits the side on which a component or a fingerprint is hot.
    placed = materialize(values.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp"), "placed")
    least = materialize(placed.groupBy("root").agg(F.min("first").alias("least")), "least")
    classes = materialize(placed.select("fp", "root").join(least, "root").select("fp", "least"), "classes")
    classes = values.join(classes, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(materialize(classes, "classes").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def blocks_for(count: int, distance: int = DISTANCE) -> int:
    """Blocks that fingerprints are cut into: the fewest with BUCKET_VALUES random values to a bucket, of ``count``."""
    blocks = distance + 1
    while blocks < 3 * distance and count / 2 ** ((blocks - distance) * 64 / blocks) > BUCKET_VALUES:
        blocks += 1
    return blocks


def linked(values: DataFrame, distance: int = DISTANCE, count: int = 0, blocks: int | None = None) -> DataFrame:
    """(src, dst): a spanning forest, bucket by bucket, of the links between the distinct fingerprints ``fp``, about
    ``count`` of them."""
    blocks = blocks or blocks_for(count, distance)
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    choices = [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in choices]
    keys = [F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)]
    rows = values.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS).select("bucket", F.ceil(F.col("n") / (BUCKET_ROWS // 2)).cast("int").alias("chunks"))
    rows = rows.join(large, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    rows = rows.select("bucket.table", "bucket.bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    key = ("table", "bits", "a", "b")
    ready = rows.repartition(*key).sortWithinPartitions(*key)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _whole_buckets(batches):
            src, dst = forest(keys, fps, distance)
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    return ready.mapInArrow(search, "src long, dst long")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers (ascending, counted anew) and values of about INDEX_ROWS rows, no bucket cut in two."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        size += batch.num_rows
        if size < INDEX_ROWS:
            continue
        rows = np.concatenate(held, axis=1)
        new = np.flatnonzero((rows[:KEY, 1:] != rows[:KEY, :-1]).any(axis=0)) + 1
        if len(new):
            yield _numbered(rows[:, : new[-1]])
            rows = rows[:, new[-1] :]
        held, size = [rows], rows.shape[1]
    if size:
        yield _numbered(np.concatenate(held, axis=1))


def _numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = (rows[:KEY, 1:] != rows[:KEY, :-1]).any(axis=0)
    return np.concatenate([[0], np.cumsum(new)]), rows[KEY].view(np.uint64)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Level:
    """Nodes of one height: the bits shared below each (mask, value), its bucket and its range of nodes below."""

    def __init__(self, bucket: np.ndarray, mask: np.ndarray, value: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.bucket, self.mask, self.value, self.first, self.last = bucket, mask, value, first, last

    def above(self) -> Level:
        size = len(self.bucket)
        opens = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]]))
        place = np.arange(size) - np.repeat(opens, np.diff(np.append(opens, size)))
        first = np.flatnonzero(place % FANOUT == 0)
        last = np.append(first[1:], size)
        lead = np.repeat(self.value[first], last - first)
        differs = np.bitwise_or.reduceat((self.value ^ lead) | ~self.mask, first)
        return Level(self.bucket[first], ~differs, self.value[first] & ~differs, first, last)


def forest(bucket: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (value, root value) of the links within buckets; ``bucket`` ascends."""
    order = np.lexsort((gray_rank(values), bucket))
    bucket, values = bucket[order], values[order]
    count = len(values)
    full = np.full(count, ~np.uint64(0))
    levels = [Level(bucket, full, values, np.arange(count), np.arange(1, count + 1))]
    while True:
        top = levels[-1].above()
        levels.append(top)
        if len(top.bucket) == top.bucket[-1] + 1:
            break
    label = np.arange(count)
    roots = np.arange(len(levels[-1].bucket))
    nothing = np.zeros(len(roots), np.uint64)
    stack = [(len(levels) - 1, roots, roots, nothing, np.zeros(len(roots), np.int64))]
    first_leaves = _first_leaves(levels)
    while stack:
        height, a, b, common, sums = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(height, a[half:], b[half:], common[half:], sums[half:]), (height, a[:half], b[:half], common[:half], sums[:half])]
            continue
        if height:
            open_pairs = ~_settled(label, first_leaves[height], a, b)
            a, b, common, sums = a[open_pairs], b[open_pairs], common[open_pairs], sums[open_pairs]
            if len(a) * FANOUT * FANOUT > 4 * FRONTIER and len(a) > 1:
                half = len(a) // 2
                stack += [(height, a[half:], b[half:], common[half:], sums[half:]), (height, a[:half], b[:half], common[:half], sums[:half])]
                continue
        if not len(a):
            continue
        if not height:
            apart = a != b
            _unite(label, a[apart], b[apart])
            continue
        upper, lower = levels[height], levels[height - 1]
        pair, x, y = _children(upper, a, b)
        mask = lower.mask[x] & lower.mask[y]
        total = sums[pair] + np.bitwise_count((lower.value[x] ^ lower.value[y]) & mask & ~common[pair])
        near = total <= distance
        stack.append((height - 1, x[near], y[near], mask[near], total[near]))
    hung = np.flatnonzero(label != np.arange(count))
    return values[hung], values[label[hung]]


def _first_leaves(levels: list[Level]) -> list[np.ndarray]:
    """First leaf below each node, by height."""
    firsts = [levels[0].first]
    for level in levels[1:]:
        firsts.append(firsts[-1][level.first])
    return firsts


def _settled(label: np.ndarray, first_leaf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether all leaves below both nodes of a pair lie in one component already; only leaves below them are looked at."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    sizes = np.append(first_leaf, len(label))[nodes + 1] - first_leaf[nodes]
    starts = np.cumsum(sizes) - sizes
    leaves = label[np.arange(sizes.sum()) + np.repeat(first_leaf[nodes] - starts, sizes)]
    least, most = np.minimum.reduceat(leaves, starts), np.maximum.reduceat(leaves, starts)
    x, y = place[: len(a)], place[len(a) :]
    return (least[x] == most[x]) & (least[y] == most[y]) & (least[x] == least[y])


def _children(level: Level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes below the pairs (a, b): index of the pair, and the two nodes, each pair once."""
    wide, high = level.last[a] - level.first[a], level.last[b] - level.first[b]
    cells = wide * high
    pair = np.repeat(np.arange(len(a)), cells)
    cell = np.arange(len(pair)) - np.repeat(np.cumsum(cells) - cells, cells)
    x = level.first[a][pair] + cell // high[pair]
    y = level.first[b][pair] + cell % high[pair]
    once = x <= y
    return pair[once], x[once], y[once]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of linked leaves; ``label`` holds each leaf's smallest one so far."""
    if not len(a):
        return
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label[:] = shorter
