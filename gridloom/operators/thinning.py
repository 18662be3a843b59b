"""Medial lines and points: thinning that keeps the topology of a mask.

A cell is simple if taking it away changes no component, tunnel or cavity: its foreground neighbours (of 26) form one
component, and its background face neighbours are connected within the 18-neighbourhood. Rounds take away simple border
cells in eight subfields by the parity of x, y and z; cells of one subfield never touch, so they go together. One round of
all eight is one pass over the bricks, with a halo as wide as the subfields reach.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import discard, materialize

from .stencil import BRICK, brick_blocks

OFFSETS = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
_NEAR = np.array(OFFSETS)
#: Foreground cells touch by a corner; background cells by a face, and only those of the 18-neighbourhood count.
_TOUCH = np.abs(_NEAR[:, None] - _NEAR[None]).max(axis=2) <= 1
_FACES = np.abs(_NEAR).sum(axis=1) == 1
_EIGHTEEN = np.abs(_NEAR).sum(axis=1) <= 2
_BESIDE = (np.abs(_NEAR[:, None] - _NEAR[None]).sum(axis=2) <= 1) & _EIGHTEEN[:, None] & _EIGHTEEN[None]
#: Layers that a round of eight subfields looks at.
REACH = 9


def _connected(members: np.ndarray, needed: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Whether all ``needed`` of each row lie in one component of its ``members``; not where none is needed."""
    reached = np.zeros_like(members)
    some = needed.any(axis=1)
    reached[np.flatnonzero(some), needed[some].argmax(axis=1)] = True
    step = links.astype(np.float32)
    while True:
        more = (reached.astype(np.float32) @ step > 0) & members
        if (more == reached).all():
            return some & ~(needed & ~reached).any(axis=1)
        reached = more


def simple(near: np.ndarray) -> np.ndarray:
    """Whether the middle of each 26-neighbourhood (rows of flags, in the order of OFFSETS) is a simple cell."""
    empty = ~near
    return _connected(near, near, _TOUCH) & _connected(empty & _EIGHTEEN, empty & _FACES, _BESIDE)


def thin_once(there: np.ndarray, origin: list[int], keep_ends: bool) -> np.ndarray:
    """One round over a block of flags whose first cell has the coordinates ``origin``; beyond the block all is empty."""
    flags = np.pad(there, 1)
    border = np.zeros_like(flags)
    inner = (slice(1, -1),) * 3
    for axis in range(3):
        for step in (1, -1):
            border[inner] |= ~np.roll(flags, step, axis)[inner]
    border &= flags
    place = np.argwhere(border)
    parity = (place - 1 + np.array(origin)) % 2
    for sub in itertools.product((0, 1), repeat=3):
        own = place[(parity == sub).all(axis=1)]
        near = flags[tuple((own[:, None] + _NEAR[None])[..., k] for k in range(3))]
        gone = simple(near)
        if keep_ends:
            gone &= near.sum(axis=1) > 1
        flags[tuple(own[gone].T)] = False
    return flags[inner]


def thin(mask: DataFrame, ends: bool = True, rounds: int = 10_000, brick: int = BRICK) -> DataFrame:
    """The cells (x, y, z) of a mask that are left when no simple border cell can go.

    With ``ends`` cells with a single neighbour stay, which leaves lines; without, a part without holes becomes a point.
    Components (by corners), tunnels and cavities are those of the mask. Each round is written to the shared folder;
    raises where cells still go after ``rounds``.
    """
    halo = (REACH,) * 3

    def run(origin: list[int], place: tuple, padded: list[np.ndarray]) -> pd.DataFrame:
        left = thin_once(padded[0] > 0, origin, ends)
        kept = np.logical_and.reduce([(p >= REACH) & (p < brick + REACH) for p in place]) & left[place]
        return pd.DataFrame({c: p[kept] + o for c, p, o in zip(("x", "y", "z"), place, origin, strict=True)})

    cells = materialize(mask.select("x", "y", "z").distinct(), "thinned")
    count = cells.count()
    for _ in range(rounds):
        thinner = materialize(brick_blocks(cells.withColumn("_there", F.lit(1.0)), ["_there"], halo, run, "x int, y int, z int", brick), "thinned")
        discard(cells)
        cells, before, count = thinner, count, thinner.count()
        if count == before:
            return cells
    raise RuntimeError(f"cells were left to thin after {rounds} rounds")
