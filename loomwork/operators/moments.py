"""Cross-products of many columns in one pass: each task sums its own, the driver gets columns x columns numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


@dataclass
class Gram:
    """n and the cross-products of columns shifted by ``center``, for each fold; slices of numpy arrays."""

    n: np.ndarray  # folds
    sums: np.ndarray  # folds x columns, of shifted values
    cross: np.ndarray  # folds x columns x columns
    center: np.ndarray

    def total(self) -> tuple[int, np.ndarray, np.ndarray]:
        """(n, means, centred cross-products) over all folds."""
        return centred(self.n.sum(), self.sums.sum(axis=0), self.cross.sum(axis=0), self.center)

    def only(self, columns: Sequence[int]) -> Gram:
        """Some of the columns, in this order; rows stay those complete in all."""
        at = np.asarray(columns, dtype=int)
        return Gram(self.n, self.sums[:, at], self.cross[:, at[:, None], at[None, :]], self.center[at])

    def without(self, fold: int) -> tuple[int, np.ndarray, np.ndarray]:
        rest = [k for k in range(len(self.n)) if k != fold]
        return centred(self.n[rest].sum(), self.sums[rest].sum(axis=0), self.cross[rest].sum(axis=0), self.center)


def centred(n: float, sums: np.ndarray, cross: np.ndarray, center: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = sums / max(n, 1)
    return int(n), mean + center, cross - n * np.outer(mean, mean)


def summed(df: DataFrame, task, width: int) -> np.ndarray:
    """The sum over tasks of the (rows x ``width``) table that ``task(matrices)`` returns; matrices are blocks of all columns."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) for b in batches if b.num_rows)
        found = np.atleast_2d(task(blocks))
        yield pa.record_batch({"i": pa.array(range(len(found)), pa.int32()), "x": pa.array(found.tolist(), pa.list_(pa.float64()))})

    rows = df.mapInArrow(partial, "i int, x array<double>").select("i", F.posexplode("x").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((max((r["i"] for r in rows), default=-1) + 1, width))
    for r in rows:
        out[r["i"], r["j"]] = r["x"]
    return out


def complete(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Rows where every column is there, as doubles x0, x1, ..."""
    return df.select(*[c.cast("double").alias(f"x{k}") for k, c in enumerate(columns)]).dropna()


def gram(df: DataFrame, columns: Sequence[Column], folds: int = FOLDS) -> Gram:
    """Cross-products over complete rows. Values are shifted by a first pass's means, so no digits are lost; a row's fold is its hash."""
    held, d = complete(df, columns), len(columns)
    center = np.array([x or 0.0 for x in held.agg(*[F.avg(c) for c in held.columns]).first()], dtype=float)
    held = held.withColumn("fold", F.pmod(F.xxhash64(*held.columns), F.lit(folds)))

    def task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        n, sums, cross = np.zeros(folds), np.zeros((folds, d)), np.zeros((folds, d, d))
        for block in blocks:
            x, fold = block[:, :d] - center, block[:, d]
            for f in range(folds):
                part = x[fold == f]
                n[f] += len(part)
                sums[f] += part.sum(axis=0)
                cross[f] += part.T @ part
        return np.hstack([n[:, None], sums, cross.reshape(folds, -1)])

    found = summed(held, task, 1 + d + d * d)
    found = found if len(found) else np.zeros((folds, 1 + d + d * d))
    return Gram(found[:, 0], found[:, 1 : 1 + d], found[:, 1 + d :].reshape(folds, d, d), center)


@dataclass
class Pairwise:
    """Of each pair of columns (a, b), over the rows where both are there: n, the sum of a, of a^2 and of a * b, values less ``center``."""

    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    cross: np.ndarray

    def correlation(self, a: int, b: int) -> tuple[int, float | None]:
        """(n, Pearson's r or None without spread in both); spread below 1e-14 of the squares is rounding."""
        n = int(self.n[a, b])
        if not n:
            return 0, None
        va, vb = (self.squares[i, j] - self.sums[i, j] ** 2 / n for i, j in ((a, b), (b, a)))
        if not (va > 1e-14 * self.squares[a, b] and vb > 1e-14 * self.squares[b, a]):
            return n, None
        r = (self.cross[a, b] - self.sums[a, b] * self.sums[b, a] / n) / np.sqrt(va) / np.sqrt(vb)
        return n, max(-1.0, min(1.0, float(r)))


def pairwise(df: DataFrame, columns: Sequence[str], center: Sequence[float] | None = None) -> Pairwise:
    """One pass over double columns, null where missing; without ``center`` (near each column's mean) another pass finds the means."""
    held, d = df.select(*[F.col(c) for c in columns]), len(columns)
    if center is None:
        center = [x or 0.0 for x in held.agg(*[F.avg(c) for c in columns]).first()]
    shift = np.asarray(center, dtype=float)

    def task(blocks: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((4, d, d))
        for block in blocks:
            there = ~np.isnan(block)
            x, m = np.where(there, block - shift, 0.0), there.astype(float)
            out += m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
        return out.reshape(1, -1)

    found = summed(held, task, 4 * d * d)
    return Pairwise(*(found if len(found) else np.zeros((1, 4 * d * d))).reshape(4, d, d))
