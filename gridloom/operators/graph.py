"""Graph, component and trajectory operators over node, edge and cell tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.session import discard, materialize

from .combine import CELL
from .components import connected_components


#: Most classes of a classifier.
CLASSES = 10_000


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def _ends(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("degree = 1").select("node")


def end_edges(edges: DataFrame) -> DataFrame:
    """Edges with a node of degree 1."""
    ends = _ends(edges)
    marked = edges.join(ends.select(F.col("node").alias("src"), F.lit(1).alias("_s")), "src", "left").join(ends.select(F.col("node").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    return marked.where("_s = 1 or _d = 1").select(edges.columns)


def remove_end_edges(edges: DataFrame, deletable: Column | None = None) -> DataFrame:
    """The edges without those at a node of degree 1 that may go."""
    ends = _ends(edges)
    marked = edges.join(ends.select(F.col("node").alias("src"), F.lit(1).alias("_s")), "src", "left").join(ends.select(F.col("node").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    gone = F.col("_s").isNotNull() | F.col("_d").isNotNull()
    return marked.where(~(gone & (deletable if deletable is not None else F.lit(True)))).select(edges.columns)


def prune(edges: DataFrame, deletable: Column | None = None, rounds: int | None = None, most: int = 10_000) -> DataFrame:
    """Remove end edges again and again until none goes, or as often as ``rounds`` says; raises after ``most`` rounds."""
    edges = materialize(edges, "edges")
    count = edges.count()
    for _ in range(most if rounds is None else rounds):
        before, edges = edges, materialize(remove_end_edges(edges, deletable), "edges")
        discard(before)
        left = edges.count()
        if left == count:
            return edges
        count = left
    if rounds is None:
        raise RuntimeError(f"end edges were left after {most} rounds")
    return edges


def remove_deletable(edges: DataFrame, deletable: Column) -> DataFrame:
    return edges.where(~deletable)


def contract_paths(edges: DataFrame, key: str = "edge_id", length: str = "length") -> DataFrame:
    """Chains through nodes of degree 2 become one edge: src, dst (its ends, ordered), length, edges.

    Edges that share such a node are linked, the components of those links are the chains, and a chain's ends are the
    nodes that occur once in it. Closed chains have no end and keep null ends.
    """
    edges = materialize(edges.select(key, "src", "dst", length), "edges")
    # A node of degree 2 and its edges come from one aggregate, without a join of all ends.
    sides = edges.select(key, F.explode(F.array("src", "dst")).alias("node"))
    links = sides.groupBy("node").agg(F.count("*").alias("degree"), F.min(key).alias("src"), F.max(key).alias("dst")).where("degree = 2 and node is not null")
    chains = materialize(connected_components(links).withColumnRenamed("node", key).withColumnRenamed("root", "chain"), "chains")
    marked = edges.join(chains, key, "left")
    # An edge without a neighbour to join is a chain of its own: nothing is grouped for it. A loop has no end.
    src, dst = (F.when(~F.col("src").eqNullSafe(F.col("dst")), f("src", "dst")) for f in (F.least, F.greatest))
    alone = marked.where("chain is null").select(src.alias("src"), dst.alias("dst"), F.col(length), F.lit(1).cast("long").alias("edges"))
    chained = materialize(edges.join(chains, key), "chained")
    inner = chained.select("chain", F.explode(F.array("src", "dst")).alias("node")).groupBy("chain", "node").agg(F.count("*").alias("n"))
    ends = inner.where("n = 1").groupBy("chain").agg(F.min("node").alias("src"), F.max("node").alias("dst"))
    totals = chained.groupBy("chain").agg(F.sum(length).alias("length"), F.count("*").alias("edges"))
    return alone.select("src", "dst", F.col(length).alias("length"), "edges").unionByName(totals.join(ends, "chain", "left").select("src", "dst", "length", "edges"))


def centerlines(points: DataFrame, edge: str = "edge_id", order: str = "i") -> DataFrame:
    """One ordered polyline per edge; an edge's points are its own geometry, so the arrays are short."""
    return points.groupBy(edge).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *CELL))), lambda p: F.struct(*[p[c].alias(c) for c in CELL])).alias("line"))


def match_rates(found: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """False-negative and false-positive rates of points matched within a distance, by buckets of that size."""

    def bucketed(df: DataFrame, name: str) -> DataFrame:
        own = df.withColumn("_id", F.monotonically_increasing_id())
        return own.select(F.col("_id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in CELL], *[F.floor(F.col(c) / tolerance).alias(f"b{c}") for c in CELL])

    f, t = bucketed(found, "f"), bucketed(truth, "t")
    for c in CELL:
        t = t.withColumn(f"b{c}", F.explode(F.array(F.col(f"b{c}") - 1, F.col(f"b{c}"), F.col(f"b{c}") + 1)))
    near = sum(((F.col(f"f_{c}") - F.col(f"t_{c}")) * (F.col(f"f_{c}") - F.col(f"t_{c}")) for c in CELL), F.lit(0.0)) <= tolerance * tolerance
    hits = f.join(t, [f"b{c}" for c in CELL]).where(near)
    matched = hits.select(F.countDistinct("f_id").alias("mf"), F.countDistinct("t_id").alias("mt"))
    sizes = found.agg(F.count("*").alias("nf")).crossJoin(truth.agg(F.count("*").alias("nt")))
    both = matched.crossJoin(sizes)
    return both.select((1 - F.try_divide("mt", "nt")).alias("false_negative"), (1 - F.try_divide("mf", "nf")).alias("false_positive"))


def nearest(points: DataFrame, lines: DataFrame, cell: float, point_id: str, line_id: str) -> DataFrame:
    """For each point the nearest line point within ``cell``: point, line, distance; points without one are left out."""
    p = points.select(point_id, *[F.col(c).alias(f"p{c}") for c in CELL], *[F.floor(F.col(c) / cell).alias(f"b{c}") for c in CELL])
    q = lines.select(line_id, *[F.col(c).alias(f"q{c}") for c in CELL], *[F.floor(F.col(c) / cell).alias(f"b{c}") for c in CELL])
    for c in CELL:
        q = q.withColumn(f"b{c}", F.explode(F.array(F.col(f"b{c}") - 1, F.col(f"b{c}"), F.col(f"b{c}") + 1)))
    d2 = sum(((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in CELL), F.lit(0.0))
    pairs = p.join(q, [f"b{c}" for c in CELL]).withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= cell)
    return pairs.groupBy(point_id).agg(F.min_by(line_id, F.struct("distance", line_id)).alias(line_id), F.min("distance").alias("distance"))


def cell_components(cells: DataFrame, diagonal: bool = False, same: str | None = None) -> DataFrame:
    """Label connected cells: (x, y, z, label) with the smallest packed coordinate of the component as label.

    Neighbours meet by equi-join on shifted coordinates, with ``same`` only where that column is equal too. Raises where x lies outside [0, 2^23) or y or z outside [0, 2^20).
    """
    check_packed(cells, 23, 20)
    packed = (F.col("x").cast("long") * (1 << 40)) + (F.col("y").cast("long") * (1 << 20)) + F.col("z")
    alike = [same] if same else []
    nodes = cells.select(*CELL, *alike, packed.alias("node"))
    steps = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)] if diagonal else [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    ahead = nodes.select(F.col("node").alias("src"), F.explode(F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"), (F.col("z") + c).alias("z")) for a, b, c in steps])).alias("_to"), *alike).select("src", "_to.*", *alike)
    edges = ahead.join(nodes, [*CELL, *alike]).select("src", F.col("node").alias("dst"))
    roots = connected_components(edges)
    return nodes.join(roots, "node", "left").select(*CELL, F.coalesce("root", "node").alias("label"))


def check_packed(cells: DataFrame, x_bits: int, bits: int) -> None:
    """Raise where coordinates do not fit into their bits of a packed number."""
    ends = cells.agg(*[f(c).alias(f"{n}{c}") for c in CELL for n, f in (("low", F.min), ("high", F.max))]).first()
    for c in CELL:
        low, high = ends[f"low{c}"], ends[f"high{c}"]
        if low is not None and (low < 0 or high >= 1 << (x_bits if c == "x" else bits)):
            raise ValueError(f"{c} from {low} to {high} cannot be packed: move the cells to [0, 2^{x_bits if c == 'x' else bits})")


def flood_fill(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """Cells that are connected to a seed: components joined with the seeds they hold, so no frontier loop."""
    labelled = materialize(cell_components(cells), "components")
    reached = labelled.join(seeds.select(*CELL), list(CELL)).select("label").distinct()
    return labelled.join(reached, "label", "left_semi").select(*CELL)


def hysteresis(field: DataFrame, value: str, outer: tuple[float, float], inner: tuple[float, float]) -> DataFrame:
    """Cells in the outer band that connect to a cell in the inner band."""
    band = field.where(F.col(value).between(*outer)).select(*CELL, value)
    return flood_fill(band, band.where(F.col(value).between(*inner)))


def chase(parents: DataFrame, node: str, parent: str, rounds: int = 62) -> DataFrame:
    """(node, root, depth) of a forest of parent pointers, by pointer jumping: logarithmic in its height.

    Raises where pointers still move after ``rounds``, which only a cycle can do. A parent that is no node is a root.
    """
    state = parents.select(F.col(node).alias("node"), F.coalesce(parent, node).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"))
    state = materialize(state, "pointers")
    for _ in range(rounds):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        new = state.join(above, "up", "left").select("node", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        new = materialize(new, "pointers")
        totals = [t.agg(F.sum(F.col("depth").cast("decimal(38, 0)"))).first()[0] for t in (state, new)]
        before, state = state, new
        discard(before)
        if totals[0] == totals[1]:
            return state.select("node", F.col("up").alias("root"), "depth")
        if any(t is None or t > 1 << 62 for t in totals):
            break
    raise RuntimeError("the parent pointers have a cycle")


def swap_labels(label: Column, a: str, b: str) -> Column:
    return F.when(label == a, F.lit(b)).when(label == b, F.lit(a)).otherwise(label)


def compact(particles: DataFrame, key: str, out: str = "index", buckets: int = 256) -> DataFrame:
    """Dense numbers from 0 in key order: counts per range bucket give bases, so no single task sorts all rows."""
    ranged = materialize(particles.repartitionByRange(buckets, key).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.withColumn(out, own).join(base, "_part").withColumn(out, (F.col(out) + F.col("_base")).cast("long")).drop("_part", "_base")


def integrate(seeds: DataFrame, velocity: Callable[[Column, Column, Column], tuple[Column, Column, Column]], step: float, steps: int, line: str = "line_id") -> DataFrame:
    """Streamlines of an analytic velocity from seeds by the midpoint rule: (line, i, x, y, z), one row per point.

    The whole trajectory is one fold over an array, so seeds are independent and nothing is shuffled.
    """

    def advance(acc: Column, i: Column) -> Column:
        last = F.element_at(acc, -1)
        u = velocity(last["x"], last["y"], last["z"])
        mid = [last[c] + u[k] * (step / 2) for k, c in enumerate(CELL)]
        w = velocity(*mid)
        return F.concat(acc, F.array(F.struct(*[(last[c] + w[k] * step).alias(c) for k, c in enumerate(CELL)])))

    start = F.array(F.struct(*[F.col(c).cast("double").alias(c) for c in CELL]))
    lines = seeds.select(line, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance).alias("points"))
    return lines.select(line, F.posexplode("points").alias("i", "p")).select(line, "i", "p.*")


def sample_vectors(points: DataFrame, field: DataFrame, key: str, components: Sequence[str]) -> DataFrame:
    """The points (key, x, y, z, ...) with the field's vector there (d0, d1, d2), by trilinear weights of the cells around.

    A point with a cell of positive weight that the field does not have lies outside and is left out.
    """
    low = {c: F.floor(c) for c in CELL}
    corners = []
    for n in range(8):
        at, weight = {}, F.lit(1.0)
        for k, c in enumerate(CELL):
            part = F.col(c) - low[c]
            bit = n >> k & 1
            at[c] = low[c] + bit
            weight = weight * (part if bit else 1 - part)
        corners.append(F.struct(weight.alias("w"), *[at[c].cast("int").alias(f"_{c}") for c in CELL]))
    asked = points.select(key, F.explode(F.array(*corners)).alias("_c")).select(key, "_c.*").where("w > 0")
    cells = field.select(*[F.col(c).cast("int").alias(f"_{c}") for c in CELL], *[F.col(u).cast("double").alias(f"u{k}") for k, u in enumerate(components)])
    joined = asked.join(cells, [f"_{c}" for c in CELL], "left")
    found = joined.groupBy(key).agg(*[F.sum(F.col("w") * F.col(f"u{k}")).alias(f"d{k}") for k in range(3)], F.count(F.col("u0") + F.col("u1") + F.col("u2")).alias("_n"), F.count("*").alias("_all"))
    return points.join(found.where("_n = _all").drop("_n", "_all"), key)


def streamlines(seeds: DataFrame, field: DataFrame, components: Sequence[str], step: float, steps: int, line: str = "line_id") -> DataFrame:
    """Streamlines of a stored vector field from seeds by the midpoint rule: (line, i, x, y, z), one row per point.

    Lines advance by ``step`` along the direction of the field, all at once, one stage per join with the cells around
    them; each step is written to the shared folder. A line ends at the border of the field, where the field is zero, or
    after ``steps``. Seeds outside are kept as lines of one point. ``line`` is unique.
    """
    norm = F.sqrt(F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2"))
    field = materialize(field.select(*CELL, *components), "vectors")
    here = materialize(seeds.select(line, F.lit(0).alias("i"), *[F.col(c).cast("double").alias(c) for c in CELL]), "streamlines")
    points = [here]
    for n in range(1, steps + 1):
        first = sample_vectors(here, field, line, components).withColumn("_n", norm).where("_n > 0")
        middle = first.select(line, *[F.col(c).alias(f"_{c}0") for c in CELL], *[(F.col(c) + F.col(f"d{k}") / F.col("_n") * (step / 2)).alias(c) for k, c in enumerate(CELL)])
        second = sample_vectors(middle, field, line, components).withColumn("_n", norm).where("_n > 0")
        moved = second.select(line, F.lit(n).alias("i"), *[(F.col(f"_{c}0") + F.col(f"d{k}") / F.col("_n") * step).alias(c) for k, c in enumerate(CELL)])
        here = materialize(sample_vectors(moved, field, line, components).select(line, "i", *CELL), "streamlines")
        if here.isEmpty():
            break
        points.append(here)
    return reduce(DataFrame.unionByName, points)


def bounding_box(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(*[F.min(c).alias(f"lo_{c}") for c in CELL], *[F.max(c).alias(f"hi_{c}") for c in CELL])


def parallel_vectors(df: DataFrame, a: Sequence[str], b: Sequence[str], epsilon: float) -> DataFrame:
    """Cells where two vectors are parallel up to epsilon: the norm of their cross product."""
    u, w = [F.col(c) for c in a], [F.col(c) for c in b]
    cross = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    return df.withColumn("cross", F.sqrt(sum((c * c for c in cross), F.lit(0.0)))).where(F.col("cross") <= epsilon)


def classify_gaussian(samples: DataFrame, model: DataFrame, label: str, value: str, out: str = "predicted") -> DataFrame:
    """Most probable class of each sample under one Gaussian per class.

    The classes are a small table that is broadcast: above CLASSES of them it raises.
    """
    if model.count() > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    model = model.select(F.col(label).alias("_class"), "mean", "sd", "prior")
    classes = model.agg(F.collect_list(F.struct("_class", "mean", "sd", "prior")).alias("_classes"))
    best = F.array_max(F.transform("_classes", lambda m: F.struct((F.ln(m["prior"]) - F.ln(m["sd"]) - (F.col(value) - m["mean"]) * (F.col(value) - m["mean"]) / (2 * m["sd"] * m["sd"])).alias("s"), m["_class"].alias("c"))))
    return samples.crossJoin(F.broadcast(classes)).withColumn(out, best["c"]).drop("_classes")


def basins(field: DataFrame, value: str) -> DataFrame:
    """Watershed by steepest descent: (x, y, z, basin) with the packed coordinate of the minimum that a cell drains to.

    One stencil pass finds each cell's lowest neighbour, pointer jumping follows them in logarithmically many rounds.
    Ties and plateaus drain to the smallest packed coordinate, so there are no cycles. Raises where x lies outside
    [0, 2^23) or y or z outside [0, 2^15).
    """
    check_packed(field, 23, 15)
    import numpy as np

    from .stencil import brick_apply, offsets, shifted

    h = (1, 1, 1)

    def kernel(p):
        packed = p[1]
        best, target = shifted(p[0], h, (0, 0, 0)).copy(), shifted(packed, h, (0, 0, 0)).copy()
        for o in offsets(h):
            v, at = shifted(p[0], h, o), shifted(packed, h, o)
            lower = (v < best) | ((v == best) & (at < target))
            best, target = np.where(lower, v, best), np.where(lower, at, target)
        return [shifted(packed, h, (0, 0, 0)), target]

    packed = F.col("x").cast("double") * (1 << 30) + F.col("y") * (1 << 15) + F.col("z")
    down = materialize(brick_apply(field.withColumn("_at", packed), [value, "_at"], h, kernel, ["node", "down"]), "descents")
    parents = down.select(F.col("node").cast("long").alias("node"), F.when(F.col("down") != F.col("node"), F.col("down").cast("long")).alias("parent"))
    roots = chase(parents, "node", "parent")
    return down.select("x", "y", "z", F.col("node").cast("long").alias("node")).join(roots, "node").select("x", "y", "z", F.col("root").alias("basin"))


def passes(labelled: DataFrame, value: str, basin: str = "basin") -> DataFrame:
    """(u, v, height): the lowest pass between neighbouring basins u < v, the higher of two cells of the
    27-neighbourhood on either side. Each brick hands on one row for each pair that meets in it."""
    import numpy as np
    import pandas as pd

    from .stencil import BRICK, brick_blocks, offsets, shifted

    h = (1, 1, 1)

    def run(origin, place, padded):
        own, here = (shifted(p, h, (0, 0, 0)) for p in padded)
        found = []
        for o in offsets(h):
            other, there = (shifted(p, h, o) for p in padded)
            meet = own < other  # false where either is missing
            found.append(np.stack([own[meet], other[meet], np.maximum(here, there)[meet]], axis=1))
        rows = pd.DataFrame(np.concatenate(found), columns=["u", "v", "height"])
        return rows.groupby(["u", "v"], as_index=False)["height"].min().astype({"u": "int64", "v": "int64"})

    met = brick_blocks(labelled.select(*CELL, basin, value), [basin, value], h, run, "u long, v long, height double", BRICK)
    return met.groupBy("u", "v").agg(F.min("height").alias("height"))


def watershed(field: DataFrame, value: str, level: float = 0.0, threshold: float = 0.0) -> DataFrame:
    """(x, y, z, basin): basins by steepest descent, merged up to a flood level.

    ``threshold`` and ``level`` are shares of the range of values. Values below the threshold are raised to it. As water
    rises, two basins that meet are merged if the shallower one is at most ``level`` deep there (``spanning.merge_tree``);
    merged basins take the smallest of their labels, which are packed coordinates of minima as in ``basins``.
    """
    from .spanning import merge_tree

    ends = field.agg(F.min(F.col(value).cast("double")).alias("low"), F.max(F.col(value).cast("double")).alias("high")).first()
    low, span = ends["low"] or 0.0, (ends["high"] or 0.0) - (ends["low"] or 0.0)
    raised = field.select(*CELL, F.greatest(F.col(value).cast("double"), F.lit(low + threshold * span)).alias("_v"))
    labelled = materialize(raised.join(basins(raised, "_v"), list(CELL)), "basins")
    lows = labelled.groupBy(F.col("basin").alias("node")).agg(F.min("_v").alias("low"))
    merged = merge_tree(passes(labelled, "_v"), lows).where(F.col("saliency") <= level * span)
    roots = connected_components(merged, "a", "b").withColumnsRenamed({"node": "basin"})
    return labelled.join(roots, "basin", "left").select(*CELL, F.coalesce("root", "basin").alias("basin"))


def _absorbed(value, known, fixed, weigh):
    """Probabilities of the cells of a block, given those of its seeds and of its outermost layer.

    ``weigh(axis, step)`` is the weight of each cell's edge to the next cell along an axis, not a number where there is none.
    Cells are eliminated one by one in band order, each handing its weights to its neighbours (star-mesh). No step
    subtracts, so weights of any magnitude keep their digits. Cells without a path to a given cell keep what they had.
    """
    import numpy as np

    free = ~np.isnan(value) & ~(fixed > 0)
    free[[0, -1]] = free[:, [0, -1]] = free[:, :, [0, -1]] = False
    out = known.copy()
    if not free.any():
        return out
    box = tuple(slice(np.flatnonzero(free.any(axis=tuple(b for b in range(3) if b != a)))[0], np.flatnonzero(free.any(axis=tuple(b for b in range(3) if b != a)))[-1] + 1) for a in range(3))
    order = sorted(range(3), key=lambda a: box[a].start - box[a].stop)
    shape = tuple(box[a].stop - box[a].start for a in order)
    strides = (shape[1] * shape[2], shape[2], 1)
    n, band = shape[0] * strides[0], strides[0]
    links = np.zeros((n + band, 2 * band + 1))
    weight = np.zeros(n + band)
    total = np.zeros((n + band, len(known)))
    at = np.arange(n)

    def taken(array):
        return array[box].transpose(order).ravel()

    own = taken(free)
    for axis in range(3):
        for step in (1, -1):
            w = taken(weigh(order[axis], step))
            w = np.where(own & ~np.isnan(w), w, 0.0)
            inner = taken(np.roll(free, -step, order[axis]))
            links[at[inner], band + step * strides[axis]] += w[inner]
            for k in range(len(known)):
                q = taken(np.roll(known[k], -step, order[axis]))
                ok = ~inner & ~np.isnan(q)
                total[:n, k] += np.where(ok, w * q, 0.0)
            weight[:n] += np.where(ok, w, 0.0)
    size, item = 2 * band + 1, links.itemsize
    pivots = np.zeros(n)
    for k in range(n):
        row = links[k, band + 1 :]
        pivots[k] = row.sum() + weight[k]
        if pivots[k] > 0:
            part = row / pivots[k]
            ahead = np.lib.stride_tricks.as_strided(links[k + 1 :, band:], (band, band), ((size - 1) * item, item))
            ahead += part[:, None] * row
            weight[k + 1 : k + band + 1] += part * weight[k]
            total[k + 1 : k + band + 1] += part[:, None] * total[k]
    result = np.zeros((n + band, len(known)))
    result[:n] = np.stack([taken(q) for q in known], axis=1)
    for k in range(n - 1, -1, -1):
        if pivots[k] > 0:
            result[k] = (total[k] + links[k, band + 1 :] @ result[k + 1 : k + band + 1]) / pivots[k]
    for k in range(len(known)):
        whole = out[k][box].transpose(order)
        whole[...] = np.where(own, result[:n, k], whole.ravel()).reshape(shape)
    return out


def _contrast(value, beta: float):
    """Edge weights exp(-beta * difference^2) of a block."""
    import numpy as np

    return lambda axis, step: np.exp(-beta * (np.roll(value, -step, axis) - value) ** 2)


def _stored(value, forward):
    """Edge weights of a block from those of the edges to the next cell along each axis."""
    import numpy as np

    return lambda axis, step: np.where(np.isnan(np.roll(value, -step, axis)), np.nan, forward[axis] if step == 1 else np.roll(forward[axis], 1, axis))


def _walk(field: DataFrame, value: str, seeds: DataFrame, targets: dict[str, Column], beta: float, rounds: int, tolerance: float, brick: int, weights: DataFrame | None = None) -> DataFrame:
    """(x, y, z, *targets): harmonic functions that equal ``targets`` (columns of ``seeds``) on the seeds."""
    names = list(targets)
    marks = seeds.select(*CELL, *[c.cast("double").alias(f"_{name}") for name, c in targets.items()], F.lit(1).alias("_seed"))
    state = field.select(*CELL, F.col(value).alias("_v")).join(marks, list(CELL), "left")
    state = state.select(*CELL, "_v", *[F.coalesce(f"_{name}", F.lit(0.5)).alias(name) for name in names], F.col("_seed").isNotNull().cast("int").alias("_fixed"))
    if weights is not None:
        state = state.join(weights.select(*CELL, *EDGES), list(CELL), "left")
    return _settle(state, names, beta, rounds, tolerance, brick, weights is not None).select(*CELL, *names)


#: Columns of an edge-weight table: the weights of a cell's edges to the next cell along x, y and z.
EDGES = ("w0", "w1", "w2")


def _settle(state: DataFrame, names: Sequence[str], beta: float, rounds: int, tolerance: float, brick: int, stored: bool) -> DataFrame:
    """Harmonic values ``names`` of the cells (x, y, z, _v, *names, _fixed) that are not fixed, from those that are.

    Each round solves every brick and two layers around it exactly, given the last values beyond, and is written to the
    shared folder. From the largest change and the rate at which changes shrink follows the error that is left; rounds go
    on until it is below the tolerance. It is an estimate: a region across bricks whose links to the rest are weaker than
    about 1e-9 of those inside it can escape it. Bricks of fixed cells only are handed on as they are.
    """
    import numpy as np

    from .stencil import brick_apply

    h = (2, 2, 2)
    inside = tuple(slice(n, -n) for n in h)
    held = [*EDGES] if stored else []
    n = len(names)

    def kernel(p):
        known, fixed = np.stack(p[1 : n + 1]), p[n + 1]
        old = known[(slice(None), *inside)]
        weight = _stored(p[0], p[n + 2 :]) if stored else _contrast(p[0], beta)
        # Bricks of nothing but neighbours' cells return no row.
        new = old if np.isnan(old[0]).all() else _absorbed(p[0], known, fixed, weight)[(slice(None), *inside)]
        return [p[0][inside], *new, fixed[inside], *[w[inside] for w in p[n + 2 :]], np.abs(new - old).max(axis=0)]

    columns = ["_v", *names, "_fixed", *held]
    changes: list[float] = []
    before = None
    for _ in range(rounds):
        state = materialize(brick_apply(state, columns, h, kernel, [*columns, "_change"], brick), "walker")
        if before is not None:
            discard(before)
        before = state
        changes.append(state.agg(F.max("_change")).first()[0] or 0.0)
        rate = max((b / a for a, b in zip(changes[-4:], changes[-3:], strict=False) if a > 0), default=1.0)
        if changes[-1] == 0 or (rate < 1 and changes[-1] * rate / (1 - rate) <= tolerance):
            return state.select(*CELL, *names)
    raise RuntimeError(f"random walker: changes of {changes[-1]:.3g} after {rounds} rounds")


def random_walker(field: DataFrame, value: str, seeds: DataFrame, beta: float = 0.01, rounds: int = 1000, tolerance: float = 1e-6, brick: int = 16, weights: DataFrame | None = None) -> DataFrame:
    """(x, y, z, probability) that a walker from a cell meets a seed of label 1 before one of label 0.

    ``seeds`` has (x, y, z, label). Edge weights are exp(-beta * difference^2), or those of a table (x, y, z, w0, w1, w2) as
    ``walker_weights.edge_weights`` makes it. Seeds keep their label, cells without a path to a seed get 0.5. Raises if the
    tolerance is not met within ``rounds``.
    """
    return _walk(field, value, seeds, {"probability": F.col("label")}, beta, rounds, tolerance, brick, weights)


def pyramid_walker(field: DataFrame, value: str, seeds: DataFrame, beta: float = 0.01, levels: int = 2, sure: float = 0.02, rounds: int = 1000, tolerance: float = 1e-6, brick: int = 8) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The random walker from coarse to fine: (x, y, z, probability), and per level the bricks solved and all bricks.

    Level n holds means of 2^n cells along each axis. The coarsest level is walked as a whole; on each finer one only
    bricks are solved that are not settled: a brick is settled if the coarse probabilities of it and of one coarse cell
    around it lie all within ``sure`` of 0 or all within ``sure`` of 1, and none of its seeds says otherwise. Cells of
    settled bricks take the coarse probability and bound the others. A coarse cell is a seed if it holds seeds, with the
    label of most of them; ties give none.
    """
    from .stencil import half_sample

    fields, marks = [field.select(*CELL, F.col(value).cast("double").alias("_v"))], [seeds.select(*CELL, F.col("label").cast("double").alias("label"))]
    half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in CELL]
    for _ in range(levels):
        fields.append(materialize(half_sample(fields[-1], "_v", "_v"), "pyramid"))
        marks.append(materialize(marks[-1].groupBy(*half).agg(F.avg("label").alias("label")).where("label != 0.5").select(*CELL, F.round("label").alias("label")), "pyramid-seeds"))
    walked = materialize(_walk(fields[levels], "_v", marks[levels], {"probability": F.col("label")}, beta, rounds, tolerance, brick), "pyramid-walk")
    corner = [F.floor(F.col(c) / brick).cast("int").alias(f"b{c}") for c in CELL]
    solved: dict[int, tuple[int, int]] = {}
    every = walked.select(*corner).distinct().count()
    solved[levels] = (every, every)
    for level in range(levels - 1, -1, -1):
        own = fields[level].select(*CELL, "_v", *corner)
        # The coarse cells that a brick's cells and those next to them lie in say whether it is settled.
        spread = walked.select("probability", *[F.explode(F.sequence(F.floor((2 * F.col(c) - 2) / brick).cast("int"), F.floor((2 * F.col(c) + 3) / brick).cast("int"))).alias(f"b{c}") if i == 0 else F.col(c) for i, c in enumerate(CELL)])
        for c in CELL[1:]:
            spread = spread.withColumn(f"b{c}", F.explode(F.sequence(F.floor((2 * F.col(c) - 2) / brick).cast("int"), F.floor((2 * F.col(c) + 3) / brick).cast("int"))))
        asked = marks[level].select(*corner, F.col("label").alias("probability"))
        bounds = spread.select("bx", "by", "bz", "probability").unionByName(asked).groupBy("bx", "by", "bz").agg(F.min("probability").alias("low"), F.max("probability").alias("high"))
        open_bricks = materialize(bounds.where((F.col("low") < 1 - sure) & (F.col("high") > sure)).select("bx", "by", "bz").join(own.select("bx", "by", "bz").distinct(), ["bx", "by", "bz"]), "pyramid-open")
        total = own.select("bx", "by", "bz").distinct().count()
        solved[level] = (open_bricks.count(), total)
        coarse = walked.select(*[F.col(c).alias(f"_{c}") for c in CELL], "probability")
        cells = own.withColumns({f"_{c}": F.floor(F.col(c) / 2).cast("int") for c in CELL}).join(coarse, [f"_{c}" for c in CELL])
        cells = cells.join(marks[level], list(CELL), "left").join(open_bricks.withColumn("_open", F.lit(1)), ["bx", "by", "bz"], "left")
        fixed = F.col("label").isNotNull() | F.col("_open").isNull()
        state = materialize(cells.select(*CELL, "_v", F.coalesce("label", "probability").alias("probability"), fixed.cast("int").alias("_fixed"), "_open", "bx", "by", "bz"), "pyramid-state")
        # Only open bricks and the cells next to them take part in the rounds.
        reach = open_bricks
        for c in CELL:
            reach = reach.withColumn(f"b{c}", F.explode(F.array(F.col(f"b{c}") - 1, F.col(f"b{c}"), F.col(f"b{c}") + 1)))
        part = state.join(reach.distinct(), ["bx", "by", "bz"], "left_semi").select(*CELL, "_v", "probability", "_fixed")
        rest = state.join(reach.distinct(), ["bx", "by", "bz"], "left_anti").select(*CELL, "probability")
        new = _settle(part, ["probability"], beta, rounds, tolerance, brick, False) if solved[level][0] else part
        done, walked = walked, materialize(new.select(*CELL, "probability").unionByName(rest), "pyramid-walk")
        discard(done)
        discard(state)
    return walked, solved


def multilabel_walker(field: DataFrame, value: str, seeds: DataFrame, labels: Sequence[int], beta: float = 0.01, rounds: int = 1000, tolerance: float = 1e-6, brick: int = 16) -> DataFrame:
    """(x, y, z, label) with the most probable of several labels, each walked against all others; ties to the smaller."""
    walked = _walk(field, value, seeds, {f"p{i}": F.col("label") == label for i, label in enumerate(labels)}, beta, rounds, tolerance, brick)
    best = F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(-label).alias("order"), F.lit(label).alias("label")) for i, label in enumerate(labels)]))
    return walked.select(*CELL, best["label"].alias("label"))


def seeds_from_geometry(points: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Seed cells of a point table; points that are incomplete or outside are left out."""
    cells = [F.rint(c).cast("int").alias(c) for c in CELL]
    inside = [F.col(c).between(0, n - 1) for c, n in zip(CELL, shape, strict=True)]
    return points.select(*cells).where(inside[0] & inside[1] & inside[2]).distinct()


def bundle_centroid(lines: DataFrame, bundle: str, order: str) -> DataFrame:
    """Mean curve of the lines of a bundle that were resampled to equal numbers of points."""
    return lines.groupBy(bundle, order).agg(F.count("*").alias("lines"), *[F.avg(c).alias(c) for c in CELL])


def track_statistics(tracks: DataFrame, track: str, time: str, coordinates: Sequence[str] = CELL) -> DataFrame:
    """Duration, path length and net displacement of each track."""
    w = Window.partitionBy(track).orderBy(time)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in coordinates), F.lit(0.0)))
    net = F.sqrt(sum(((F.max_by(c, time) - F.min_by(c, time)) * (F.max_by(c, time) - F.min_by(c, time)) for c in coordinates), F.lit(0.0)))
    return tracks.withColumn("_step", step).groupBy(track).agg((F.max(time) - F.min(time)).alias("duration"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"), net.alias("displacement"))


def regrid(points: DataFrame, matrix: Sequence[Sequence[float]], value: str) -> DataFrame:
    """Mean value per cell of a grid that a 4 x 4 matrix maps the points to."""
    from .cellwise import affine

    to = affine(matrix, F.col("x"), F.col("y"), F.col("z"))
    return points.groupBy(*[F.floor(c).cast("int").alias(a) for c, a in zip(to, CELL, strict=True)]).agg(F.avg(value).alias(value))
