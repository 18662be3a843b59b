"""Parallel vectors on a grid, and the lines that they form.

Each cube of eight cells is cut into six tetrahedra along its main diagonal, the same way everywhere, so that neighbouring
cubes share their triangles. On a triangle both vector fields are linear; they are parallel where V b = l W b for
barycentric coordinates b, an eigenproblem of 3 x 3 whose real eigenvectors with no negative entry are the solutions.
Solutions of one tetrahedron are linked, so every solution has two links at most, and the links form paths and rings that
pointer jumping puts in order.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.session import discard, materialize

from .components import connected_components
from .graph import check_packed
from .spanning import lifted
from .stencil import BRICK, brick_blocks

_CORNERS = [np.array(c) for c in itertools.product((0, 1), repeat=3)]


def _steps() -> tuple[list[tuple], list[list[int]]]:
    """The triangles of a cube as corners (first, second, third), each beyond the one before along some axes, and for each
    tetrahedron its four triangles."""
    triangles: dict[tuple, int] = {}
    solids = []
    for order in itertools.permutations(range(3)):
        corners = [np.zeros(3, int)]
        for axis in order:
            corners.append(corners[-1] + (np.arange(3) == axis))
        faces = [tuple(tuple(map(int, corners[i])) for i in f) for f in itertools.combinations(range(4), 3)]
        solids.append([triangles.setdefault(f, len(triangles)) for f in faces])
    return list(triangles), solids


TRIANGLES, SOLIDS = _steps()
def _beyond(corners: Sequence[tuple]) -> tuple:
    """The corners after the first as steps from it: the same for a triangle or an edge in every cube that it is part of."""
    return tuple(tuple(b - a for a, b in zip(corners[0], c, strict=True)) for c in corners[1:])


#: Numbers of the kinds of triangles, edges and single cells.
KINDS = {k: i for i, k in enumerate(sorted({_beyond([c for c, used in zip(t, use, strict=True) if used]) for t in TRIANGLES for use in itertools.product((0, 1), repeat=3) if any(use)}))}
#: Bits of a coordinate in a point's number; five more tell the kind and two its solutions apart.
BITS = 18
#: Barycentric coordinates up to this count as 0: the point lies on an edge or a cell, and has the same number in every
#: triangle that shares it.
EDGE = 1e-9


def parallel_points(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solutions on triangles whose corners have the vectors v and w (rows x 3 corners x 3): numbers of rows, places among a
    row's solutions on the same corners (by the weight of the first), and barycentric coordinates. Where both matrices are
    singular there is none."""
    v, w = v.transpose(0, 2, 1), w.transpose(0, 2, 1)  # columns are corners
    size_v, size_w = np.abs(np.linalg.det(v)), np.abs(np.linalg.det(w))
    use_w = size_w >= size_v
    lower, upper = np.where(use_w[:, None, None], w, v), np.where(use_w[:, None, None], v, w)
    fine = np.flatnonzero(np.isfinite(lower).all(axis=(1, 2)) & np.isfinite(upper).all(axis=(1, 2)) & (np.maximum(size_v, size_w) > 0))
    values, vectors = np.linalg.eig(np.linalg.solve(lower[fine], upper[fine]))
    real = (values.imag == 0) if np.iscomplexobj(values) else np.ones(values.shape, bool)
    b = vectors.real.transpose(0, 2, 1)
    total = b.sum(axis=2, keepdims=True)
    with np.errstate(all="ignore"):
        b = b / total
    good = real & np.isfinite(b).all(axis=2) & (b >= -EDGE).all(axis=2)
    row, which = np.nonzero(good)
    b = b[row, which]
    b = np.where(b <= EDGE, 0.0, b)
    b /= b.sum(axis=1, keepdims=True)
    use = (b > 0) @ np.array([1, 2, 4])
    order = np.lexsort((b[:, 1], b[:, 0], use, row))
    row, b, group = row[order], b[order], (row * 8 + use)[order]
    return fine[row], np.arange(len(row)) - np.searchsorted(group, group), b


def parallel_vectors(field: DataFrame, u: Sequence[str], w: Sequence[str], brick: int = BRICK) -> tuple[DataFrame, DataFrame]:
    """Points (point, x, y, z) where two vector fields are parallel on a triangle, and links (src, dst) between them.

    Fields are given on cells, linear between them; triangles with a missing cell have no points. Where a tetrahedron has
    more than two points, the nearest ones are linked first; a point without partner stays alone. Raises where a
    coordinate lies outside [0, 2^18).
    """
    check_packed(field, BITS, BITS)
    halo = (1, 1, 1)

    def run(origin: list[int], place: tuple, padded: list[np.ndarray]) -> pd.DataFrame:
        corner = {tuple(map(int, c)): np.stack([p[tuple(slice(1 + i, 1 + i + brick) for i in c)].ravel() for p in padded], axis=-1) for c in _CORNERS}
        there = {c: ~np.isnan(p).any(axis=-1) for c, p in corner.items()}
        first = np.argwhere(np.ones((brick,) * 3, bool)) + np.array(origin) + 1
        found = []
        for n, triangle in enumerate(TRIANGLES):
            known = np.flatnonzero(np.logical_and.reduce([there[c] for c in triangle]))
            values = np.stack([corner[c][known] for c in triangle], axis=1)
            own, nth, b = parallel_points(values[..., :3], values[..., 3:])
            cube = known[own]
            number = np.empty(len(cube), np.int64)
            use = (b > 0) @ np.array([1, 2, 4])
            for code in np.unique(use).tolist():
                corners, here = [c for i, c in enumerate(triangle) if code >> i & 1], use == code
                base = first[cube[here]] + np.array(corners[0])
                number[here] = (((base[:, 0] << 2 * BITS) + (base[:, 1] << BITS) + base[:, 2]) * 32 + KINDS[_beyond(corners)]) * 4 + nth[here]
            where = first[cube] + b @ np.array(triangle, float)
            found.append(pd.DataFrame({"cube": cube, "triangle": n, "src": number, "x": where[:, 0], "y": where[:, 1], "z": where[:, 2]}))
        points = pd.concat(found)
        rows = [points.drop_duplicates("src")[["src", "x", "y", "z"]].assign(dst=-1)]
        for solid in SOLIDS:
            own = points[points["triangle"].isin(solid)].drop_duplicates(["cube", "src"]).sort_values(["cube", "src"])
            size = own.groupby("cube")["src"].transform("size")
            two = own[size == 2]
            pairs = [two.iloc[::2]["src"].to_numpy(), two.iloc[1::2]["src"].to_numpy()]
            for _, group in own[size > 2].groupby("cube"):
                a, b = _nearest(group["src"].to_numpy(), group[["x", "y", "z"]].to_numpy())
                pairs = [np.concatenate([pairs[0], a]), np.concatenate([pairs[1], b])]
            rows.append(pd.DataFrame({"src": pairs[0], "dst": pairs[1], "x": 0.0, "y": 0.0, "z": 0.0}))
        return pd.concat(rows)[["src", "dst", "x", "y", "z"]].astype({"src": "int64", "dst": "int64"})

    names = [f"_{k}{i}" for k in "uw" for i in range(3)]
    given = field.select("x", "y", "z", *[F.col(c).alias(n) for c, n in zip((*u, *w), names, strict=True)])
    parts = materialize(brick_blocks(given, names, halo, run, "src long, dst long, x double, y double, z double", brick), "parallel")
    # Triangles on the faces of bricks are found from both sides, with the same numbers and points.
    points = parts.where("dst = -1").groupBy(F.col("src").alias("point")).agg(*[F.min(c).alias(c) for c in ("x", "y", "z")])
    return points, parts.where("dst != -1").select("src", "dst").distinct()


def _nearest(ids: np.ndarray, where: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs of points, the nearest two first."""
    a, b = np.triu_indices(len(ids), 1)
    order = np.lexsort((ids[b], ids[a], ((where[a] - where[b]) ** 2).sum(axis=1)))
    used: set[int] = set()
    out: tuple[list[int], list[int]] = ([], [])
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        if not {i, j} & used:
            used |= {i, j}
            out[0].append(int(ids[i]))
            out[1].append(int(ids[j]))
    return out


def polylines(links: DataFrame) -> DataFrame:
    """(line, i, point, closed): the paths and rings of links (src, dst) in which no point has more than two.

    A line is named by its smallest point. A path begins at the smaller of its ends; a ring begins at its smallest point
    and goes on to the smaller of that one's neighbours. Points get their places by pointer jumping along the links, in
    logarithmically many rounds. Raises where a point has three links.
    """
    ends = links.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    both = materialize(ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "line-links")
    degree = both.groupBy("src").agg(F.count("*").alias("n"))
    if not degree.where("n > 2").isEmpty():
        raise ValueError("a point has more than two links")
    lines = materialize(connected_components(both).join(degree, F.col("node") == F.col("src")).select("node", "root", "n"), "line-parts")
    closed = lines.groupBy("root").agg(F.min("n").alias("least")).where("least = 2").select(F.col("root").alias("ring"))
    # A ring is opened between its smallest point and the greater of that one's neighbours.
    opened = both.join(closed, F.col("src") == F.col("ring")).groupBy("ring").agg(F.max("dst").alias("last"))
    cut = opened.select(F.col("ring").alias("src"), F.col("last").alias("dst")).unionByName(opened.select(F.col("last").alias("src"), F.col("ring").alias("dst")))
    steps = both.join(cut, ["src", "dst"], "left_anti")
    # A step (src, dst) is followed by the one that leaves dst elsewhere; the last step of a direction follows itself.
    step = F.struct("src", "dst")
    following = steps.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
    onward = steps.join(following, "dst").where("_next != src").select("src", "dst", F.struct(F.col("dst").alias("src"), F.col("_next").alias("dst")).alias("up"))
    pointers = steps.join(onward, ["src", "dst"], "left").select(step.alias("node"), F.coalesce("up", step).alias("up"), F.col("up").isNotNull().cast("long").alias("turn"))
    ranked = lifted(pointers)
    # From each point on, how far it is to either end; an end has one direction only, and lies at 0 from itself.
    reached = ranked.select(F.col("node.src").alias("point"), F.col("root.dst").alias("end"), (F.col("turn") + 1).alias("i"))
    own = reached.groupBy("point").agg(F.count("*").alias("n"), F.min(F.struct("end", "i")).alias("first"), F.max("end").alias("other"))
    start = F.when((F.col("n") == 1) & (F.col("point") < F.col("other")), 0).otherwise(F.col("first.i"))
    placed = own.select("point", start.cast("int").alias("i"))
    named = lines.join(closed, F.col("root") == F.col("ring"), "left").select(F.col("node").alias("point"), F.col("root").alias("line"), F.col("ring").isNotNull().alias("closed"))
    return placed.join(named, "point").select("line", "i", "point", "closed")


def two_links(points: DataFrame, links: DataFrame) -> DataFrame:
    """The links that are among the two shortest of both their points: a line passes a junction along these. Only points
    on edges or cells, where a field vanishes or is degenerate, have more than two."""
    where = points.select("point", F.struct("x", "y", "z").alias("p"))
    placed = links.join(where.withColumnsRenamed({"point": "src", "p": "_a"}), "src").join(where.withColumnsRenamed({"point": "dst", "p": "_b"}), "dst")
    long = sum(((F.col(f"_a.{c}") - F.col(f"_b.{c}")) * (F.col(f"_a.{c}") - F.col(f"_b.{c}")) for c in ("x", "y", "z")), F.lit(0.0))
    sides = placed.select("src", "dst", long.alias("_long"), F.explode(F.array("src", "dst")).alias("_p"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_long", "src", "dst"))
    kept = sides.withColumn("_rank", rank).where("_rank <= 2").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return kept.where("n = 2").select("src", "dst")


def corelines(field: DataFrame, u: Sequence[str], w: Sequence[str], least: float = 0.0, brick: int = BRICK) -> DataFrame:
    """(line, i, x, y, z, length, closed): the lines along which two vector fields are parallel, with the distance along
    the line up to each point; lines shorter than ``least`` are left out."""
    from .tables import arc_length

    points, links = parallel_vectors(field, u, w, brick)
    points = materialize(points, "coreline-points")
    links = materialize(two_links(points, links), "coreline-links")
    placed = polylines(links).join(points, "point").select("line", "i", "x", "y", "z", "closed")
    along = materialize(arc_length(placed, "line", "i", ("x", "y", "z")), "corelines")
    discard(links)
    long = along.groupBy("line").agg(F.max("length").alias("_whole")).where(F.col("_whole") >= least).select("line")
    return along.join(long, "line").select("line", "i", "x", "y", "z", "length", "closed")
