"""Phase unwrapping of volumes along the most reliable edges.

A cell is the less reliable the larger the wrapped second differences across it; edges between face neighbours are sorted
by the sum of both, and each edge that joins two groups shifts one of them by whole periods so that both sides meet. The
groups' tree is the minimum spanning forest of the edges, whatever the order in which it is found: bricks merge what they
can decide alone, and the few components that are left are joined by ``spanning.minimum_forest``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import discard, materialize

from .graph import check_packed
from .spanning import minimum_forest
from .stencil import BRICK, brick_blocks, shifted

#: Half of the directions to the 26 neighbours; each has an opposite.
LINES = [o for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
#: Cost of a cell without all 26 neighbours, in squares of a period: above that of any other.
BORDER = 16.0
_PART = "kind int, node long, other long, turn long, cost double, a long, b long"


def unreliability(phase: np.ndarray, period: float) -> np.ndarray:
    """Sum of squared second differences, in periods, of the cells but the outermost layer; BORDER where one is missing."""
    h = (1, 1, 1)
    here = shifted(phase, h, (0, 0, 0))
    total = np.zeros_like(here)
    for o in LINES:
        ahead, behind = (shifted(phase, h, o) - here) / period, (here - shifted(phase, h, tuple(-i for i in o))) / period
        total += ((ahead - np.rint(ahead)) - (behind - np.rint(behind))) ** 2
    return np.where(np.isnan(total), BORDER, total)


def contract(n: int, edges: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Merge nodes along sorted edges (from, to, turn) as far as they are decided here; ``to`` is -1 beyond the brick.

    An edge is in the forest if it is the first that leaves one of its groups. A group is settled once an edge has left
    the brick from it, or was passed over between two settled groups. Returns each node's group and its turns from that
    group's first node, and the places of the edges that were passed over.
    """
    up, turns, settled = list(range(n)), [0] * n, [False] * n
    passed: list[int] = []

    def find(x: int) -> tuple[int, int]:
        path, total = [], 0
        while up[x] != x:
            path.append(x)
            x = up[x]
        for y in reversed(path):
            total += turns[y]
            up[y], turns[y] = x, total
        return x, total

    for place, (a, b, turn) in enumerate(edges):
        root, own = find(a)
        if b < 0:
            settled[root] = True
            continue
        other, theirs = find(b)
        if root == other:
            continue
        if settled[root] and settled[other]:
            passed.append(place)
            continue
        # The number of b is that of a and the turn: so is other's, less its own turns to b.
        low, high, shift = (root, other, turn + own - theirs) if root < other else (other, root, theirs - own - turn)
        up[high], turns[high] = low, shift
        settled[low] = settled[low] or settled[high]
    found = [find(x) for x in range(n)]
    return [r for r, _ in found], [t for _, t in found], passed


def unwrap(field: DataFrame, value: str, mask: str, period: float = 2 * np.pi, out: str = "unwrapped", brick: int = BRICK) -> DataFrame:
    """(x, y, z, out): the value plus whole periods, connected cells of ``mask`` = 1 unwrapped together.

    The smallest cell (by x, y, z) of each connected part keeps its value; cells with another mask keep theirs and are
    passed over, as are missing values. Edges of equal cost go by the order of their cells. A task holds one brick and a
    halo of two cells; raises where x lies outside [0, 2^23) or y or z outside [0, 2^20).
    """
    check_packed(field, 23, 20)
    valid = F.col(mask) == 1
    cells = field.select("x", "y", "z", F.when(valid & ~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("_phase"))

    def run(origin: list[int], place: tuple, padded: list[np.ndarray]) -> pd.DataFrame:
        phase = padded[0]
        near = phase[1:-1, 1:-1, 1:-1]  # the brick and one layer
        cost = unreliability(phase, period)
        axes = [np.arange(brick + 2, dtype=np.int64) + origin[i] + 1 for i in range(3)]
        packed = (axes[0][:, None, None] << 40) + (axes[1][None, :, None] << 20) + axes[2][None, None, :]
        inner = np.zeros(near.shape, bool)
        inner[1:-1, 1:-1, 1:-1] = True
        there = ~np.isnan(near)
        own = np.flatnonzero((inner & there).ravel())
        if not len(own):
            return pd.DataFrame({c.split()[0]: [] for c in _PART.split(", ")})
        number = np.full(near.size, -1, np.int64)
        number[own] = np.arange(len(own))
        number = number.reshape(near.shape)
        parts = []
        for axis in range(3):
            low = tuple(slice(None, -1) if i == axis else slice(None) for i in range(3))
            high = tuple(slice(1, None) if i == axis else slice(None) for i in range(3))
            ok = there[low] & there[high] & (inner[low] | inner[high])
            turn = np.rint((near[low][ok] - near[high][ok]) / period).astype(np.int64)
            parts.append((cost[low][ok] + cost[high][ok], packed[low][ok], packed[high][ok], number[low][ok], number[high][ok], turn))
        costs, a, b, first, second, turn = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((b, a, costs))
        costs, a, b, first, second, turn = (c[order] for c in (costs, a, b, first, second, turn))
        outward = first < 0  # from a cell beyond the brick: seen from here the other way round
        edges = list(zip(np.where(outward, second, first).tolist(), np.where(outward, -1, second).tolist(), turn.tolist(), strict=True))
        group, turns, passed = contract(len(own), edges)
        ids, group, turns = packed.ravel()[own], np.array(group), np.array(turns)
        # Cells are numbered in the order of their coordinates, so a group's first node is its smallest cell.
        at = np.unravel_index(own, near.shape)
        face = np.logical_or.reduce([i == 1 for i in at])
        rows = [pd.DataFrame({"kind": 0, "node": ids, "other": ids[group], "turn": turns, "cost": near.ravel()[own], "a": face.astype(np.int64), "b": 0})]
        keep = np.zeros(len(edges), bool)
        keep[passed] = True
        i, j = first[keep], second[keep]
        rows.append(pd.DataFrame({"kind": 1, "node": ids[group[i]], "other": ids[group[j]], "turn": turn[keep] + turns[i] - turns[j], "cost": costs[keep], "a": a[keep], "b": b[keep]}))
        beyond = (second < 0) & ~outward
        i = first[beyond]
        rows.append(pd.DataFrame({"kind": 2, "node": ids[group[i]], "other": b[beyond], "turn": turn[beyond] + turns[i], "cost": costs[beyond], "a": a[beyond], "b": b[beyond]}))
        return pd.concat(rows)

    parts = materialize(brick_blocks(cells, ["_phase"], (2, 2, 2), run, _PART, brick), "unwrap-parts")
    own = parts.where("kind = 0")
    # Edges to another brick end at a cell on its lower faces, whose group that brick knows.
    faces = own.where("a = 1").select(F.col("node").alias("_cell"), F.col("other").alias("_group"), F.col("turn").alias("_turn"))
    between = parts.where("kind = 2").join(faces, F.col("other") == F.col("_cell")).select(F.col("node").alias("u"), F.col("_group").alias("v"), "cost", "a", "b", (F.col("turn") - F.col("_turn")).alias("turn"))
    edges = parts.where("kind = 1").select(F.col("node").alias("u"), F.col("other").alias("v"), "cost", "a", "b", "turn").unionByName(between)
    labels = minimum_forest(edges)
    # Groups are named by their smallest cells: the smallest name is the cell that keeps its value.
    base = labels.groupBy("root").agg(F.min_by("turn", "node").alias("_base"))
    shift = labels.join(base, "root").select(F.col("node").alias("other"), (F.col("turn") - F.col("_base")).alias("_shift"))
    turned = own.join(shift, "other", "left").withColumn("turn", F.col("turn") + F.coalesce("_shift", F.lit(0)))
    low = (1 << 20) - 1
    place = [F.shiftright("node", 40), F.shiftright("node", 20).bitwiseAND(low), F.col("node").bitwiseAND(low)]
    unwrapped = turned.select(*[p.cast("int").alias(c) for p, c in zip(place, ("x", "y", "z"), strict=True)], (F.col("cost") + F.col("turn") * F.lit(float(period))).alias(out))
    passed = field.where(~F.coalesce(valid, F.lit(False)) | F.isnan(F.col(value).cast("double")) | F.col(value).isNull())
    result = materialize(unwrapped.unionByName(passed.select(*[F.col(c).cast("int").alias(c) for c in ("x", "y", "z")], F.col(value).cast("double").alias(out))), "unwrapped")
    discard(parts)
    discard(labels)
    return result
