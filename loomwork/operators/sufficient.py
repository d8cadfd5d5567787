"""Sufficient statistics of a whole table in one pass: pairs, groups, crosstabs, regression forms and cross-products at once.

The columns that mining takes (numbers as doubles, categories as the number of
their level) are written once; each task sums its own blocks of them, and the
driver gets a table whose size depends on columns and levels only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.moments import FOLDS, Gram, Pairwise, summed
from loomwork.operators.nodes import quoted
from loomwork.operators.pairs import number
from loomwork.scratch import materialize

#: Rows and columns of the ladder's table for each predictor: powers of the standardised predictor, its logarithm; powers of the target, its logarithm.
PREDICTOR = ("there", "z", "z2", "z3", "z4", "log", "log2", "positive")
TARGET = ("there", "v", "v2", "log", "log2", "positive")


@dataclass
class Columns:
    """The written columns: row, x0, ... of ``numeric``, c0, ... (places in ``levels``) of the categories, fold."""

    df: DataFrame
    numeric: list[str]
    levels: dict[str, list[str]]
    center: np.ndarray
    scale: np.ndarray

    @property
    def names(self) -> list[str]:
        return [f"x{k}" for k in range(len(self.numeric))]

    @property
    def inputs(self) -> list[str]:
        return [*self.names, *[f"c{k}" for k in range(len(self.levels))], "fold"]


def columns_of(df: DataFrame, numeric: Sequence[str], levels: dict[str, list[str]], center: Sequence[float], scale: Sequence[float]) -> Columns:
    """``center`` and ``scale`` are near each number's mean and deviation; ``levels`` has every level of each category."""
    made = [F.monotonically_increasing_id().alias("row"), *[number(c).alias(f"x{k}") for k, c in enumerate(numeric)]]
    for k, (c, of) in enumerate(levels.items()):
        place = F.try_element_at(F.create_map(*[F.lit(v) for i, level in enumerate(of) for v in (level, float(i))]), quoted(c).cast("string")) if of else F.lit(None).cast("double")
        made.append(place.alias(f"c{k}"))
    held = df.select(*made)
    held = held.withColumn("fold", F.pmod(F.xxhash64(*[c for c in held.columns if c != "row"]), F.lit(FOLDS)).cast("double"))
    safe = np.array([s if s and math.isfinite(s) else 1.0 for s in scale], dtype=float)
    return Columns(materialize(held, "mined-columns"), list(numeric), levels, np.array([m or 0.0 for m in center], dtype=float), safe)


@dataclass
class Statistics:
    """Of each pair of numbers ``pairs``; of levels (rows, all categories' one after the other) and numbers ``n``, ``sums``, ``squares`` (less center);

    ``cells`` of levels and levels; ``ladder`` (``PREDICTOR`` x numbers, ``TARGET``); ``gram`` of numbers and levels over rows complete in all,
    by fold; ``complete`` of numbers over rows complete in them.
    """

    of: Columns
    pairs: Pairwise
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    cells: np.ndarray
    ladder: np.ndarray
    gram: Gram
    complete: Gram

    @property
    def places(self) -> dict[str, range]:
        """Where each category's levels are."""
        out, at = {}, 0
        for c, of in self.of.levels.items():
            out[c] = range(at, at + len(of))
            at += len(of)
        return out


def log_center(center: float) -> float:
    return math.log(center) if center > 0 else 0.0


def statistics(of: Columns, target: str | None = None) -> Statistics:
    """All of it in one pass; the ladder is of ``target`` on every other number."""
    k, sizes = len(of.numeric), [len(v) for v in of.levels.values()]
    width, center, scale = sum(sizes), of.center, of.scale
    t = of.numeric.index(target) if target in of.numeric else None
    logs = np.array([log_center(c) for c in center])
    m = k + width
    shapes = [(4, k, k), (3, width, k), (width, width), (len(PREDICTOR), k, len(TARGET)), (FOLDS, 1 + m + m * m), (1, 1 + k + k * k)]

    def task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        out = [np.zeros(s) for s in shapes]
        for block in blocks:
            raw, codes, fold = block[:, :k], block[:, k:-1], block[:, -1]
            there = ~np.isnan(raw)
            x, one = np.where(there, raw - center, 0.0), there.astype(float)
            dummies = np.concatenate([(codes[:, c : c + 1] == np.arange(size)).astype(float) for c, size in enumerate(sizes)] or [np.zeros((len(raw), 0))], axis=1)
            square = x * x
            out[0] += one.T @ one, x.T @ one, square.T @ one, x.T @ x
            out[1] += dummies.T @ one, dummies.T @ x, dummies.T @ square
            out[2] += dummies.T @ dummies
            if t is not None:
                z, positive = x / scale, there & (raw > 0)
                log = np.where(positive, np.log(np.where(positive, raw, 1.0)) - logs, 0.0)
                y = np.stack([one[:, t], x[:, t], square[:, t], log[:, t], log[:, t] ** 2, positive[:, t]], axis=1)
                out[3] += np.stack([p.T @ y for p in (one, z, z**2, z**3, z**4, log, log**2, positive.astype(float))])
            whole = there.all(axis=1)
            if k:
                part = x[whole]
                out[5][0, 0] += len(part)
                out[5][0, 1 : 1 + k] += part.sum(axis=0)
                out[5][0, 1 + k :] += (part.T @ part).ravel()
            whole &= ~np.isnan(codes).any(axis=1)
            for f in range(FOLDS):
                part = np.concatenate([x, dummies], axis=1)[whole & (fold == f)]
                out[4][f, 0] += len(part)
                out[4][f, 1 : 1 + m] += part.sum(axis=0)
                out[4][f, 1 + m :] += (part.T @ part).ravel()
        return np.concatenate([x.ravel() for x in out]).reshape(1, -1)

    length = sum(int(np.prod(s)) for s in shapes)
    found = summed(of.df.select(*of.inputs), task, length)
    flat, parts = (found if len(found) else np.zeros((1, length)))[0], []
    for s in shapes:
        size = int(np.prod(s))
        parts.append(flat[:size].reshape(s))
        flat = flat[size:]
    pair, group, cells, ladder, gram, complete = parts
    whole = Gram(gram[:, 0], gram[:, 1 : 1 + m], gram[:, 1 + m :].reshape(FOLDS, m, m), np.concatenate([center, np.zeros(width)]))
    numbers = Gram(complete[:, 0], complete[:, 1 : 1 + k], complete[:, 1 + k :].reshape(1, k, k), center)
    return Statistics(of, Pairwise(*pair), *group, cells, ladder, whole, numbers)
