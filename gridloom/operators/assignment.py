"""Assignment, phase unwrapping and quantisation within small groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def munkres(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost matching of rows to columns by shortest augmenting paths with potentials."""
    n, m = cost.shape
    if n > m:
        return sorted((a, b) for b, a in munkres(cost.T))
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        column = 0
        best = np.full(m + 1, np.inf)
        came = np.zeros(m + 1, int)
        done = np.zeros(m + 1, bool)
        while owner[column]:
            done[column] = True
            row = owner[column]
            free = ~done
            free[0] = False
            reduced = cost[row - 1] - u[row] - v[1:]
            better = free[1:] & (reduced < best[1:])
            best[1:][better] = reduced[better]
            came[1:][better] = column
            target = int(np.flatnonzero(free)[best[free].argmin()])
            step = best[target]
            u[owner[done]] += step
            v[done] -= step
            best[free] -= step
            column = target
        while column:
            owner[column] = owner[came[column]]
            column = came[column]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def assign(pairs: DataFrame, group: str, left: str, right: str, cost: str) -> DataFrame:
    """(group, left, right, cost) of a minimum-cost matching per group; missing pairs may not be matched.

    A group is one small matrix; groups run in parallel.
    """
    types = dict(pairs.dtypes)

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        table = block.pivot_table(index=left, columns=right, values=cost, aggfunc="min")
        wall = float(np.nansum(np.abs(table.to_numpy()))) + 1.0
        matched = [(a, b) for a, b in munkres(np.where(table.isna(), wall, table)) if not np.isnan(table.iat[a, b])]
        return pd.DataFrame({group: block[group].iloc[0], left: [table.index[a] for a, _ in matched], right: [table.columns[b] for _, b in matched], cost: [table.iat[a, b] for a, b in matched]})

    return pairs.select(group, left, right, cost).groupBy(group).applyInPandas(solve, f"{group} {types[group]}, {left} {types[left]}, {right} {types[right]}, {cost} {types[cost]}")


def unwrap_lines(field: DataFrame, value: str, mask: str, axis: str = "x", period: float = 2 * np.pi, out: str = "unwrapped") -> DataFrame:
    """Unwrap a periodic value along each line of an axis; masked cells are passed over and keep their value."""
    others = [a for a in ("x", "y", "z") if a != axis]

    def line(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(axis)
        valid = block[mask].to_numpy() == 1
        values = block[value].to_numpy(float).copy()
        values[valid] = np.unwrap(values[valid], period=period)
        return pd.DataFrame({"x": block["x"], "y": block["y"], "z": block["z"], out: values})

    return field.select("x", "y", "z", value, mask).groupBy(*others).applyInPandas(line, f"x int, y int, z int, {out} double")
