"""Neighbourhood operators over bricks with halos.

A field is a table of cells (x, y, z, values). ``brick_apply`` sends every cell to its brick and to the few neighbouring
bricks whose halo it lies in, one shuffle whatever the stencil, and runs a numpy function on the padded block; missing
cells are not-a-number. Bricks have a fixed size, so a task holds a bounded block, and consecutive stencils can be fused
by one function with a wider halo. Reductions to coarser grids need no halo and stay plain aggregations.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialize

#: Cells of a brick along each axis.
BRICK = 32

Kernel = Callable[[Sequence[np.ndarray]], Sequence[np.ndarray]]


def brick_blocks(field: DataFrame, values: Sequence[str], halo: tuple[int, int, int], run: Callable[[list[int], tuple, list[np.ndarray]], pd.DataFrame], schema: str, brick: int = BRICK) -> DataFrame:
    """What ``run`` makes of each brick: it gets the coordinates of the padded block's first cell, the places of the cells
    that exist in it, and one padded array per value, indexed [x, y, z]."""
    axes = ("x", "y", "z")
    cells = field.select(*axes, *[F.col(v).cast("double").alias(v) for v in values])
    for axis, reach in zip(axes, halo, strict=True):
        own = F.floor(F.col(axis) / brick).cast("int")
        low, high = F.floor((F.col(axis) - reach) / brick).cast("int"), F.floor((F.col(axis) + reach) / brick).cast("int")
        cells = cells.withColumn(f"b{axis}", F.explode(F.sequence(low, high)) if reach else own)

    def padded(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        origin = [int(k) * brick - h for k, h in zip(key, halo, strict=True)]
        shape = [brick + 2 * h for h in halo]
        place = tuple(block[a].to_numpy() - o for a, o in zip(axes, origin, strict=True))
        arrays = []
        for name in values:
            array = np.full(shape, np.nan)
            array[place] = block[name].to_numpy()
            arrays.append(array)
        with warnings.catch_warnings(), np.errstate(all="ignore"):
            warnings.simplefilter("ignore")
            return run(origin, place, arrays)

    return cells.groupBy("bx", "by", "bz").applyInPandas(padded, schema)


def brick_apply(field: DataFrame, values: Sequence[str], halo: tuple[int, int, int], kernel: Kernel, out: Sequence[str], brick: int = BRICK) -> DataFrame:
    """(x, y, z, *out): the kernel gets padded arrays indexed [x, y, z] and returns arrays of the unpadded shape."""

    def run(origin: list[int], place: tuple, padded: list[np.ndarray]) -> pd.DataFrame:
        results = kernel(padded)
        inner = np.logical_and.reduce([(p >= h) & (p < brick + h) for p, h in zip(place, halo, strict=True)])
        at = tuple(p[inner] - h for p, h in zip(place, halo, strict=True))
        data = {a: p[inner] + o for a, p, o in zip(("x", "y", "z"), place, origin, strict=True)}
        return pd.DataFrame(data | {name: r[at] for name, r in zip(out, results, strict=True)})

    schema = "x int, y int, z int, " + ", ".join(f"{name} double" for name in out)
    return brick_blocks(field, values, halo, run, schema, brick)


def shifted(padded: np.ndarray, halo: tuple[int, int, int], offset: tuple[int, int, int]) -> np.ndarray:
    """The block of unpadded shape that lies ``offset`` cells further."""
    return padded[tuple(slice(h + o, n - h + o) for h, o, n in zip(halo, offset, padded.shape, strict=True))]


def offsets(halo: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    return [(a, b, c) for a in range(-halo[0], halo[0] + 1) for b in range(-halo[1], halo[1] + 1) for c in range(-halo[2], halo[2] + 1)]


def neighbours(padded: np.ndarray, halo, within=lambda o: True) -> np.ndarray:
    """The neighbourhood of every cell, stacked along a new first axis."""
    return np.stack([shifted(padded, halo, o) for o in offsets(halo) if within(o)])


def _filled(padded: np.ndarray, outside: float | None) -> np.ndarray:
    return padded if outside is None else np.where(np.isnan(padded), outside, padded)


def box_reduce(field: DataFrame, value: str, halo, reducer, out: str, outside: float | None = None, shape: str = "box") -> DataFrame:
    """A reduction over each cell's neighbourhood, a box or the ball in it; missing cells are skipped or ``outside``."""
    radius = max(halo)
    within = (lambda o: True) if shape == "box" else (lambda o: sum(i * i for i in o) <= radius * radius)
    return brick_apply(field, [value], halo, lambda p: [reducer(neighbours(_filled(p[0], outside), halo, within), axis=0)], [out])


def mean(field: DataFrame, value: str, halo=(1, 1, 1), out: str = "mean", outside: float | None = None) -> DataFrame:
    return box_reduce(field, value, halo, np.nanmean, out, outside)


def median(field: DataFrame, value: str, halo=(1, 1, 1), out: str = "median", outside: float | None = None) -> DataFrame:
    return box_reduce(field, value, halo, np.nanmedian, out, outside)


def binary_median(field: DataFrame, value: str, level: float, halo=(1, 1, 1), least: int | None = None, out: str = "vote") -> DataFrame:
    """1 where at least ``least`` cells (default: more than half) of the neighbourhood reach the level."""

    def kernel(p):
        near = neighbours(p[0], halo)
        votes = (near >= level).sum(axis=0)
        return [(votes >= least if least is not None else 2 * votes > (~np.isnan(near)).sum(axis=0)).astype(float)]

    return brick_apply(field, [value], halo, kernel, [out])


def morphology(field: DataFrame, value: str, operator: str, halo=(1, 1, 1), shape: str = "box", out: str = "morph") -> DataFrame:
    """dilate or erode over a box or ball; open and close are two of them."""
    if operator in ("open", "close"):
        first, second = ("erode", "dilate") if operator == "open" else ("dilate", "erode")
        return morphology(morphology(field, value, first, halo, shape, out), out, second, halo, shape, out)
    return box_reduce(field, value, halo, np.nanmax if operator == "dilate" else np.nanmin, out, shape=shape)


def gaussian(field: DataFrame, value: str, extent: int = 1, sigma: float | None = None, out: str = "smooth", outside: float | None = None) -> DataFrame:
    """Separable Gaussian with sigma = extent / 2.5 unless given, normalised over the cells that exist."""
    sigma = sigma or extent / 2.5
    one = np.exp(-(np.arange(-extent, extent + 1) ** 2) / (2 * sigma**2))

    def kernel(p):
        array = _filled(p[0], outside)
        mass = (~np.isnan(array)).astype(float)
        array = np.nan_to_num(array)
        for axis in range(3):
            n = array.shape[axis] - 2 * extent
            array, mass = (sum(w * np.take(a, range(i, i + n), axis) for i, w in enumerate(one)) for a in (array, mass))
        return [array / mass]

    return brick_apply(field, [value], (extent,) * 3, kernel, [out])


def convolve(field: DataFrame, value: str, mask: np.ndarray, out: str = "conv") -> DataFrame:
    """Unnormalised sum with weights 2 m - 1 of a mask in [0, 1]; missing cells count 0."""
    halo = tuple(n // 2 for n in mask.shape)

    def kernel(p):
        array = np.nan_to_num(p[0])
        return [sum((2 * float(mask[tuple(o + h for o, h in zip(off, halo, strict=True))]) - 1) * shifted(array, halo, off) for off in offsets(halo))]

    return brick_apply(field, [value], halo, kernel, [out])


def scatter(field: DataFrame, value: str, weights: dict[tuple[int, int, int], float], out: str = "sum") -> DataFrame:
    """A linear stencil in long form: every cell adds its weighted value to its neighbours, summed map-side first.

    Plain DataFrame operations, for small stencils and for checks; bricks move far fewer rows for large ones.
    """
    parts = F.array(*[F.struct((F.col("x") - o[0]).alias("x"), (F.col("y") - o[1]).alias("y"), (F.col("z") - o[2]).alias("z"), (F.col(value) * w).alias("w")) for o, w in weights.items()])
    sums = field.select(F.explode(parts).alias("p")).groupBy("p.x", "p.y", "p.z").agg(F.sum("p.w").alias(out))
    return field.select("x", "y", "z").join(sums, ["x", "y", "z"])


def _along(axis: int, step: int) -> tuple[int, int, int]:
    return tuple(step if i == axis else 0 for i in range(3))


def _central(p: np.ndarray, halo, axis: int, spacing) -> np.ndarray:
    """Central difference; 0 where a neighbour is missing."""
    d = (shifted(p, halo, _along(axis, 1)) - shifted(p, halo, _along(axis, -1))) / (2 * spacing[axis])
    return np.where(np.isnan(d), 0.0, d)


def _weighted(p: np.ndarray, axis: int, spacing, side: np.ndarray, total: float) -> np.ndarray:
    """Difference smoothed across the axis by the outer product of ``side``; 0 where a neighbour is missing."""
    halo = (1, 1, 1)
    d = 0.0
    for off in offsets(halo):
        across = [side[o + 1] for i, o in enumerate(off) if i != axis]
        d = d + off[axis] * across[0] * across[1] * shifted(p, halo, off)
    d = d / (total * spacing[axis])
    return np.where(np.isnan(d), 0.0, d)


def gradient(field: DataFrame, value: str, method: str = "central", spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """gx, gy, gz by central differences, Sobel weights, or linear regression over the 27 cells; 0 at the border."""
    if method == "central":
        return brick_apply(field, [value], (1, 1, 1), lambda p: [_central(p[0], (1, 1, 1), a, spacing) for a in range(3)], ["gx", "gy", "gz"])
    side = np.array([1.0, 2.0, 1.0]) if method == "sobel" else np.ones(3)
    total = 2 * side.sum() ** 2
    return brick_apply(field, [value], (1, 1, 1), lambda p: [_weighted(p[0], a, spacing, side, total) for a in range(3)], ["gx", "gy", "gz"])


def laplacian(field: DataFrame, value: str, spacing=(1.0, 1.0, 1.0), out: str = "laplacian") -> DataFrame:
    """Sum of second differences; 0 at the border."""
    h = (1, 1, 1)

    def kernel(p):
        d = sum((shifted(p[0], h, _along(a, 1)) - 2 * shifted(p[0], h, (0, 0, 0)) + shifted(p[0], h, _along(a, -1))) / spacing[a] ** 2 for a in range(3))
        return [np.where(np.isnan(d), 0.0, d)]

    return brick_apply(field, [value], h, kernel, [out])


def jacobian(field: DataFrame, u: Sequence[str], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """j00 .. j22: derivative of component i along axis j, in one pass."""
    names = [f"j{i}{j}" for i in range(3) for j in range(3)]
    return brick_apply(field, u, (1, 1, 1), lambda p: [_central(p[i], (1, 1, 1), j, spacing) for i in range(3) for j in range(3)], names)


def divergence(jacobians: DataFrame) -> DataFrame:
    return jacobians.select("x", "y", "z", (F.col("j00") + F.col("j11") + F.col("j22")).alias("divergence"))


def vorticity(jacobians: DataFrame) -> DataFrame:
    j = F.col
    return jacobians.select("x", "y", "z", (j("j21") - j("j12")).alias("w0"), (j("j02") - j("j20")).alias("w1"), (j("j10") - j("j01")).alias("w2"))


def acceleration(field: DataFrame, u: Sequence[str], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Jacobian times velocity, computed where both lie together, so without a join."""
    h = (1, 1, 1)

    def kernel(p):
        here = [shifted(a, h, (0, 0, 0)) for a in p]
        return [sum(_central(p[i], h, j, spacing) * here[j] for j in range(3)) for i in range(3)]

    return brick_apply(field, u, h, kernel, ["a0", "a1", "a2"])


def _hessian(p: np.ndarray, h, spacing) -> np.ndarray:
    parts = np.empty((*shifted(p, h, (0, 0, 0)).shape, 3, 3))
    here = shifted(p, h, (0, 0, 0))
    for a in range(3):
        for b in range(3):
            if a == b:
                d = (shifted(p, h, _along(a, 1)) - 2 * here + shifted(p, h, _along(a, -1))) / spacing[a] ** 2
            else:
                corner = lambda s, t, a=a, b=b: shifted(p, h, tuple(s if i == a else t if i == b else 0 for i in range(3)))
                d = (corner(1, 1) - corner(1, -1) - corner(-1, 1) + corner(-1, -1)) / (4 * spacing[a] * spacing[b])
            parts[..., a, b] = np.where(np.isnan(d), 0.0, d)
    return parts


def curvature(field: DataFrame, value: str, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Mean and Gaussian curvature of the level sets, from gradient and Hessian; 0 where the gradient vanishes."""
    h = (1, 1, 1)

    def kernel(p):
        g = np.stack([_central(p[0], h, a, spacing) for a in range(3)], axis=-1)
        m = _hessian(p[0], h, spacing)
        size = (g * g).sum(axis=-1)
        trace = np.trace(m, axis1=-2, axis2=-1)
        mean = (np.einsum("...i,...ij,...j->...", g, m, g) - size * trace) / (2 * np.maximum(size, 1e-300) ** 1.5)
        adjoint = np.empty_like(m)
        for i in range(3):
            for j in range(3):
                a, b, c, d = (i + 1) % 3, (i + 2) % 3, (j + 1) % 3, (j + 2) % 3
                adjoint[..., j, i] = m[..., a, c] * m[..., b, d] - m[..., a, d] * m[..., b, c]
        gauss = np.einsum("...i,...ij,...j->...", g, adjoint, g) / np.maximum(size, 1e-300) ** 2
        return [np.where(size > 0, mean, 0.0), np.where(size > 0, gauss, 0.0)]

    return brick_apply(field, [value], h, kernel, ["mean_curvature", "gauss_curvature"])


def vesselness(field: DataFrame, value: str, sigmas: Sequence[int] = (1, 2), alpha1: float = 0.5, alpha2: float = 2.0) -> DataFrame:
    """Bright-line measure of the sorted Hessian eigenvalues over scales, and the scale of its maximum."""
    reach = max(sigmas) * 2 + 1
    halo = (reach,) * 3

    def kernel(p):
        best = scale = None
        for sigma in sigmas:
            one = np.exp(-(np.arange(-2 * sigma, 2 * sigma + 1) ** 2) / (2.0 * sigma**2))
            array, mass = np.nan_to_num(p[0]), (~np.isnan(p[0])).astype(float)
            for axis in range(3):
                n = array.shape[axis] - 4 * sigma
                array, mass = (sum(w * np.take(a, range(i, i + n), axis) for i, w in enumerate(one)) for a in (array, mass))
            smooth = np.where(mass > 0, array / np.maximum(mass, 1e-300), np.nan)
            trim = reach - 2 * sigma - 1
            smooth = smooth[tuple(slice(trim, n - trim) for n in smooth.shape)] if trim else smooth
            e = np.linalg.eigvalsh(_hessian(smooth, (1, 1, 1), (1.0, 1.0, 1.0)) * sigma**2)
            weak, side, strong = e[..., 2], e[..., 1], e[..., 0]
            across = np.maximum(-side, 0.0)
            width = np.where(weak <= 0, alpha1, alpha2) * across
            line = np.where(across > 0, across * np.exp(-(weak**2) / np.maximum(2 * width**2, 1e-300)), 0.0)
            line = np.where(strong < 0, line, 0.0)
            better = line > best if best is not None else np.ones(line.shape, bool)
            scale = np.where(better, float(sigma), scale if scale is not None else 0.0)
            best = np.where(better, line, best if best is not None else 0.0)
        return [best, scale]

    return brick_apply(field, [value], halo, kernel, ["vesselness", "scale"])


def half_sample(field: DataFrame, value: str, out: str = "half") -> DataFrame:
    """Mean of each block of 2 x 2 x 2 cells: a plain aggregation with map-side combination."""
    half = [F.floor(F.col(a) / 2).cast("int").alias(a) for a in ("x", "y", "z")]
    return field.groupBy(*half).agg(F.avg(value).alias(out))


def local_ball_mean(field: DataFrame, value: str, inside: str, radius: int, out: str = "local") -> DataFrame:
    """Mean over the ball where ``inside`` holds; 0 where the centre is not inside. Bricks share halos, so no edges show."""
    halo = (radius,) * 3

    def kernel(p):
        ball = lambda o: sum(i * i for i in o) <= radius * radius
        held = np.where(p[1] > 0, p[0], np.nan)
        mean = np.nanmean(neighbours(held, halo, ball), axis=0)
        return [np.where(shifted(p[1], halo, (0, 0, 0)) > 0, mean, 0.0)]

    return brick_apply(field.withColumn("_in", F.col(inside).cast("int")), [value, "_in"], halo, kernel, [out])


def one_sided(field: DataFrame, value: str, axis: str = "x", out: str = "d") -> DataFrame:
    """Second-order forward difference (-3 u0 + 4 u1 - u2) / 2 along an axis; null where cells are missing."""
    a = "xyz".index(axis)
    halo = tuple(2 if i == a else 0 for i in range(3))
    return brick_apply(field, [value], halo, lambda p: [(-3 * shifted(p[0], halo, (0, 0, 0)) + 4 * shifted(p[0], halo, _along(a, 1)) - shifted(p[0], halo, _along(a, 2))) / 2], [out]).withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def diffuse(field: DataFrame, value: str, steps: int = 2, dt: float = 0.1, conductance: float = 10.0, out: str = "diffused") -> DataFrame:
    """Edge-preserving diffusion; all steps run on one block with a halo as wide as the number of steps."""
    halo = (steps,) * 3

    def kernel(p):
        u = p[0]
        for _ in range(steps):
            flow = np.zeros_like(u)
            for a in range(3):
                for s in (1, -1):
                    d = np.roll(u, -s, axis=a) - u
                    edge = [slice(None)] * 3
                    edge[a] = slice(-1, None) if s == 1 else slice(0, 1)
                    d[tuple(edge)] = 0
                    d = np.where(np.isnan(d), 0.0, d)
                    flow += d * np.exp(-((d / conductance) ** 2))
            u = u + dt * flow
        return [shifted(u, halo, (0, 0, 0))]

    return brick_apply(field, [value], halo, kernel, [out])


def regional_maxima(field: DataFrame, value: str, out: str = "is_max") -> DataFrame:
    """1 for cells of a plateau (connected cells of one value, of the 27-neighbourhood) that no neighbour is higher than.

    A cell without an equal neighbour is decided in its brick; the others are linked to plateaus, whose cells are
    maxima if none of them has a higher neighbour.
    """
    from .graph import cell_components

    h = (1, 1, 1)

    def kernel(p):
        here, near = shifted(p[0], h, (0, 0, 0)), neighbours(p[0], h, any)
        return [here, (near > here).any(axis=0).astype(float), (near == here).any(axis=0).astype(float)]

    cells = materialize(brick_apply(field, [value], h, kernel, ["_value", "_below", "_flat"]), "maxima")
    flat = cells.where("_flat = 1")
    plateaus = flat.join(cell_components(flat, diagonal=True, same="_value"), ["x", "y", "z"])
    below = plateaus.groupBy("label").agg(F.max("_below").alias("_any"))
    decided = plateaus.join(below, "label").select("x", "y", "z", (1 - F.col("_any")).alias(out))
    return cells.where("_flat = 0").select("x", "y", "z", (1 - F.col("_below")).alias(out)).unionByName(decided)


def gradient_vector_flow(field: DataFrame, value: str, steps: int = 3, mu: float = 0.1, dt: float = 0.5, out: Sequence[str] = ("fx", "fy", "fz")) -> DataFrame:
    """Gradient g diffused where it is weak and kept where it is strong, for a few steps on one block.

    u starts as g and changes by dt * (mu * sum(neighbour - u) - s * (u - g)) with s = |g|^2 / (1 + |g|^2). g is the
    central difference, 0 along an axis where a neighbour is missing; missing neighbours add nothing to the sum.
    """
    h = (steps + 1,) * 3

    def kernel(p):
        there = ~np.isnan(p[0][1:-1, 1:-1, 1:-1])
        start = np.stack([_central(p[0], (1, 1, 1), a, (1.0, 1.0, 1.0)) for a in range(3)])
        size = (start * start).sum(axis=0)
        keep, u = size / (1 + size), np.where(there, start, np.nan)
        for _ in range(steps):
            around = np.zeros_like(u)
            wide = np.pad(u, ((0, 0), (1, 1), (1, 1), (1, 1)), constant_values=np.nan)
            for o in offsets((1, 1, 1)):
                if sum(map(abs, o)) == 1:
                    around += np.nan_to_num(np.stack([shifted(c, (1, 1, 1), o) for c in wide]) - u)
            u = u + dt * (mu * around - keep * (u - start))
        return [shifted(c, (steps,) * 3, (0, 0, 0)) for c in u]

    return brick_apply(field, [value], h, kernel, list(out))


def advect_diffuse(field: DataFrame, value: str, velocity: Sequence[str], steps: int = 2, dt: float = 0.1, diffusivity: float = 0.1, out: str = "transported") -> DataFrame:
    """Explicit upwind steps of advection and diffusion; missing neighbours take the cell's own value."""
    h = (steps,) * 3

    def kernel(p):
        u, speed = p[0], [np.nan_to_num(v) for v in p[1:]]
        for _ in range(steps):
            change = np.zeros_like(u)
            for a in range(3):
                pad = [(1, 1) if i == a else (0, 0) for i in range(3)]
                wide = np.pad(u, pad, constant_values=np.nan)
                n = u.shape[a]
                ahead = np.take(wide, range(2, n + 2), a)
                behind = np.take(wide, range(0, n), a)
                ahead, behind = np.where(np.isnan(ahead), u, ahead), np.where(np.isnan(behind), u, behind)
                change += diffusivity * (ahead - 2 * u + behind) - np.maximum(speed[a], 0) * (u - behind) - np.minimum(speed[a], 0) * (ahead - u)
            u = u + dt * change
        return [shifted(u, h, (0, 0, 0))]

    return brick_apply(field, [value, *velocity], h, kernel, [out])


def kernel_mean(field: DataFrame, value: str, weights: np.ndarray, out: str = "smooth") -> DataFrame:
    """Weighted mean with a kernel of any odd shape, normalised over the cells that exist."""
    halo = tuple(n // 2 for n in weights.shape)
    parts = [(o, float(weights[tuple(i + h for i, h in zip(o, halo, strict=True))])) for o in offsets(halo)]

    def kernel(p):
        there = (~np.isnan(p[0])).astype(float)
        known = np.nan_to_num(p[0])
        return [sum(w * shifted(known, halo, o) for o, w in parts) / sum(w * shifted(there, halo, o) for o, w in parts)]

    return brick_apply(field, [value], halo, kernel, [out])


def crossings(field: DataFrame, value: str, level: float) -> DataFrame:
    """Cells at or above a level with a face neighbour below it, and how many: where an isosurface passes."""
    halo = (1, 1, 1)
    faces = [_along(axis, step) for axis in range(3) for step in (-1, 1)]

    def kernel(p):
        below = sum((shifted(p[0], halo, o) < level).astype(float) for o in faces)
        return [np.where(shifted(p[0], halo, (0, 0, 0)) >= level, below, 0.0)]

    return brick_apply(field, [value], halo, kernel, ["faces"]).where("faces > 0").withColumn("faces", F.col("faces").cast("int"))
