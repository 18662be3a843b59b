"""Spanning forests of weighted graphs in rounds of hooking, with numbers carried along their edges.

Edges are (u, v, cost, a, b, turn): (cost, a, b) is unique and orders them, and ``turn`` is what the number of v exceeds
that of u by. In each round every component hooks on another along its best edge, pointer jumping finds the roots and sums
the turns on the way, and the edges between components that are left are relabelled, the best of each pair kept. Rounds
are logarithmic in the number of nodes; each is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import discard, materialize

EDGE = ("cost", "a", "b", "turn")


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost", "a", "b", (-F.col("turn")).alias("turn"))
    return edges.select("u", "v", *EDGE).unionByName(back)


def best_edges(edges: DataFrame) -> DataFrame:
    """(u, v, cost, a, b, turn): the first edge of every node, by partial aggregates, so that a hub costs a row per task."""
    return _both_ways(edges).groupBy("u").agg(F.min(F.struct("cost", "a", "b", "v", "turn")).alias("e")).select("u", "e.*")


def one_per_pair(edges: DataFrame) -> DataFrame:
    """The best edge of each pair of nodes, from the smaller to the greater; loops go."""
    turned = F.col("u") > F.col("v")
    ordered = edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cost", "a", "b", F.when(turned, -F.col("turn")).otherwise(F.col("turn")).alias("turn"))
    return ordered.groupBy("u", "v").agg(F.min(F.struct(*EDGE)).alias("e")).select("u", "v", "e.*")


def lifted(pointers: DataFrame, rounds: int = 62) -> DataFrame:
    """(node, root, turn) of a forest of pointers (node, up, turn), whose roots point at themselves, by pointer jumping."""
    state = materialize(pointers.select("node", "up", "turn"), "pointers")
    for _ in range(rounds):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("turn").alias("_turn"))
        moved = state.join(above, "up").select("node", F.col("_up").alias("up"), (F.col("turn") + F.col("_turn")).alias("turn"), (F.col("_up") != F.col("up")).alias("moved"))
        done, state = state, materialize(moved, "pointers")
        discard(done)
        if state.where("moved").isEmpty():
            return state.select("node", F.col("up").alias("root"), "turn")
    raise RuntimeError("the pointers have a cycle")


def relabelled(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between the roots of their ends."""
    left = roots.select(F.col("node").alias("u"), F.col("root").alias("_ru"), F.col("turn").alias("_tu"))
    right = roots.select(F.col("node").alias("v"), F.col("root").alias("_rv"), F.col("turn").alias("_tv"))
    moved = edges.join(left, "u").join(right, "v").select(F.col("_ru").alias("u"), F.col("_rv").alias("v"), "cost", "a", "b", (F.col("turn") + F.col("_tu") - F.col("_tv")).alias("turn"))
    return one_per_pair(moved)


def minimum_forest(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root, turn) for every node that has an edge: its component in the minimum spanning forest, and by how much
    its number exceeds the root's along that forest's edges."""
    left = materialize(one_per_pair(edges), "forest-edges")
    labels = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        best = materialize(best_edges(left), "best-edges")
        # Costs differ, so pointers only meet where two nodes choose one edge; the smaller of them becomes a root.
        other = best.select(F.col("u").alias("v"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        root = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("u") < F.col("v"))
        # The number of u is that of v less the turn from u to v.
        pointers = best.join(other, "v").select(F.col("u").alias("node"), F.when(root, F.col("u")).otherwise(F.col("v")).alias("up"), F.when(root, 0).otherwise(-F.col("turn")).cast("long").alias("turn"))
        found = materialize(lifted(pointers), "forest-roots")
        done, left = left, materialize(relabelled(left, found), "forest-edges")
        discard(done)
        discard(best)
        if labels is None:
            labels = found
            continue
        above = found.select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("turn").alias("_turn"))
        joined = labels.join(above, "root", "left").select("node", F.coalesce("_root", "root").alias("root"), (F.col("turn") + F.coalesce("_turn", F.lit(0))).alias("turn"))
        done, labels = labels, materialize(joined, "forest-labels")
        discard(done)
        discard(found)
    else:
        raise RuntimeError(f"a spanning forest was not complete after {rounds} rounds")
    if labels is None:
        return edges.select(F.col("u").cast("long").alias("node"), F.col("u").cast("long").alias("root"), F.lit(0).cast("long").alias("turn")).limit(0)
    return labels


def merge_tree(passes: DataFrame, lows: DataFrame, rounds: int = 200) -> DataFrame:
    """(a, b, height, saliency): the merges of basins as water rises, one fewer than the basins of a component.

    ``passes`` (u, v, height) has the lowest pass between basins u < v, ``lows`` (node, low) each basin's minimum. Where
    two components meet at a pass, the one of the higher minimum ends there, and the merge's saliency is the height of
    the pass above that minimum. A component ends at its lowest pass as soon as the one beyond has a lower minimum; that
    holds for one side of every pass that is the lowest for both, so each round gets on. Ties go to the smaller numbers.
    """
    left = materialize(one_per_pair(passes.select("u", "v", F.col("height").cast("double").alias("cost"), F.col("u").alias("a"), F.col("v").alias("b"), F.lit(0).cast("long").alias("turn"))), "passes")
    merges = []
    lows = lows.select("node", F.col("low").cast("double").alias("low"))
    for _ in range(rounds):
        if left.isEmpty():
            break
        own = lows.select(F.col("node").alias("u"), F.col("low").alias("_low"))
        beyond = lows.select(F.col("node").alias("v"), F.col("low").alias("_beyond"))
        best = materialize(best_edges(left).join(own, "u").join(beyond, "v"), "lowest-passes")
        ends = F.struct("_beyond", "v") < F.struct("_low", "u")
        merges.append(materialize(best.where(ends).select("a", "b", F.col("cost").alias("height"), (F.col("cost") - F.col("_low")).alias("saliency")), "merges"))
        pointers = best.select(F.col("u").alias("node"), F.when(ends, F.col("v")).otherwise(F.col("u")).alias("up"), F.lit(0).cast("long").alias("turn"))
        roots = materialize(lifted(pointers), "basin-roots")
        done, left = left, materialize(relabelled(left, roots), "passes")
        for table in (done, best, roots):
            discard(table)
    else:
        raise RuntimeError(f"basins were left after {rounds} rounds")
    if not merges:
        return passes.select(F.col("u").alias("a"), F.col("v").alias("b"), "height", F.col("height").alias("saliency")).limit(0)
    return reduce(DataFrame.unionByName, merges)
