"""Relational preparation steps: each is a function from DataFrames to a DataFrame, lazily planned as a whole."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.ranks import cumulated, quantiles
from loomwork.scratch import materialize

JOIN_KINDS = ("inner", "left", "right", "full")
NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")


def column(df: DataFrame, name: str) -> str:
    """The column's own spelling; ValueError that names what there is when it is missing."""
    found = {c.lower(): c for c in df.columns}.get(name.lower())
    if found is None:
        raise ValueError(f"no column {name!r}; there are: {', '.join(df.columns)}")
    return found


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def select(df: DataFrame, keep: Sequence[str] = (), drop: Sequence[str] = (), rename: Mapping[str, str] | None = None, cast: Mapping[str, str] | None = None) -> DataFrame:
    """Keep columns in the given order, or drop some; casts name the old columns, renames come after them."""
    if keep and drop:
        raise ValueError("give keep or drop, not both")
    gone = {column(df, c) for c in drop}
    names = [column(df, c) for c in keep] if keep else [c for c in df.columns if c not in gone]
    kinds = {column(df, c): t for c, t in (cast or {}).items()}
    new = {column(df, c): n for c, n in (rename or {}).items()}
    return df.select(*[(quoted(c).cast(kinds[c]) if c in kinds else quoted(c)).alias(new.get(c, c)) for c in names])


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which the expression is true; null is not."""
    return df.filter(F.expr(expression))


def calculated(df: DataFrame, name: str, expression: str) -> DataFrame:
    """One more column, from a Spark SQL expression; an existing name is refused."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name!r} already")
    return df.withColumn(name, F.expr(expression))


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with no null in the listed columns. NaN is a value here."""
    return df.filter(reduce(lambda a, b: a & b, [quoted(column(df, c)).isNotNull() for c in columns]))


def fill_nulls(df: DataFrame, columns: Sequence[str], value: str | float | int) -> DataFrame:
    """Nulls of the listed columns become a constant; text that looks like a number is one where the column is a number."""
    if isinstance(value, str) and NUMBER.match(value.strip()):
        value = float(value) if re.search(r"[.eE]", value) else int(value)

    def fill(name: str) -> Column:
        kind = df.schema[name].dataType
        fits = F.lit(str(value)) if isinstance(kind, T.StringType) else F.lit(value)
        return F.coalesce(quoted(name), fits)

    return df.withColumns({c: fill(c) for c in (column(df, c) for c in columns)})


def clean_nulls(df: DataFrame, mode: str, columns: Sequence[str], fill_value: str | float | int | None = None) -> DataFrame:
    if mode == "drop":
        return drop_nulls(df, columns)
    if mode == "fill" and fill_value is not None:
        return fill_nulls(df, columns, fill_value)
    raise ValueError("mode is 'drop', or 'fill' with a fill_value")


def aggregate(df: DataFrame, group_by: Sequence[str] = (), aggregations: Sequence[str] = ()) -> DataFrame:
    """Keys, then aggregate expressions (``sum(x) AS total``); null is a group, no key means the whole table."""
    if not aggregations:
        return df.select(*[quoted(column(df, k)) for k in group_by]).distinct()
    return df.groupBy(*[quoted(column(df, k)) for k in group_by]).agg(*[F.expr(a) for a in aggregations])


def join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Equality join. Keys of the same names appear once, coalesced in right and full joins; others both stay.

    Null keys match nothing. Other columns of the right that the left has too
    come out as ``name_1`` (the next free number). ``hint`` is a Spark join
    hint; without one adaptive execution chooses.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"unknown join {how!r}: {', '.join(JOIN_KINDS)}")
    lk, same = [column(left, c) for c in left_on], right_on is None
    rk = [column(right, c) for c in (left_on if same else right_on)]
    if not lk or len(lk) != len(rk):
        raise ValueError("a join needs as many keys on the left as on the right, and one at least")
    taken = {c.lower() for c in left.columns} | ({c.lower() for c in right.columns} - {c.lower() for c in left.columns})
    new = {}
    for c in right.columns:
        if c.lower() in {x.lower() for x in left.columns} and not (same and c in rk):
            k = 1
            while f"{c}_{k}".lower() in taken:
                k += 1
            new[c] = f"{c}_{k}"
            taken.add(new[c].lower())
    if same:
        new |= {r: x for r, x in zip(rk, lk, strict=True) if r != x}
    right = right.withColumnsRenamed(new)
    right = right.hint(hint) if hint else right
    if same:
        return left.join(right, lk, how)
    return left.join(right, reduce(lambda a, b: a & b, [left[quoted_name(x)] == right[quoted_name(new.get(y, y))] for x, y in zip(lk, rk, strict=True)]), how)


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def union(*frames: DataFrame) -> DataFrame:
    """All rows, columns matched by name; missing ones are null. Text beside another type makes the column text."""
    if len(frames) < 2:
        raise ValueError("a union needs two inputs at least")
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name.lower(), set()).add(f.dataType.typeName())
    text = {n for n, k in kinds.items() if len(k) > 1 and "string" in k}
    widened = [df.select(*[quoted(c).cast("string").alias(c) if c.lower() in text else quoted(c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), widened)


#: Columns of a pivot that one aggregate makes; wider pivots are made in slices of so many.
PIVOT_WIDTH = 10_000


def pivot_keys(df: DataFrame, key: str, using: Sequence[str], group_by: Sequence[str] | None) -> list[str]:
    """Columns a pivot groups by: those given, else every one that ``key`` and ``using`` do not mention."""
    if group_by is not None:
        return [column(df, g) for g in group_by]
    mentioned = " ".join(using).lower()
    return [c for c in df.columns if c != key and not re.search(rf"\b{re.escape(c.lower())}\b", mentioned)]


def pivot(df: DataFrame, on: str, using: Sequence[str], group_by: Sequence[str] | None = None, values: Sequence[object] | None = None) -> DataFrame:
    """Values of ``on`` become columns. Without ``group_by``, by every column that ``on`` and ``using`` do not mention.

    Null makes no column, but its group stays. Without ``values`` they are
    read in a first job; give them on large tables. There is a name on the
    driver for each column, so a result of very many values is better had
    long (``pivot_cells``) or by slices (``pivot_slice``).
    """
    key = column(df, on)
    if values is None:
        values = [r[0] for r in df.select(quoted(key)).filter(quoted(key).isNotNull()).distinct().orderBy(quoted(key)).collect()]
    return df.groupBy(*[quoted(g) for g in pivot_keys(df, key, using, group_by)]).pivot(key, list(values)).agg(*[F.expr(u) for u in using])


def pivot_cells(df: DataFrame, on: str, using: Sequence[str], group_by: Sequence[str] | None = None) -> DataFrame:
    """A pivot in long form: groups, the value of ``on``, ``position`` of its column (from 0, by value), the aggregates; any number of values.

    ``using`` are aliased aggregates. Positions are ranks by ranges, so
    nothing of the values reaches the driver. A group whose values are all
    null has one row of null value, position and aggregates; an empty table
    gives no row. Rows are of groups that have the value.
    """
    key = column(df, on)
    keys = pivot_keys(df, key, using, group_by)
    if "position" in {c.lower() for c in [*keys, key]}:
        raise ValueError("there is a column 'position' already")
    cells = materialize(df.groupBy(*[quoted(k) for k in keys], quoted(key)).agg(*[F.expr(u) for u in using]), "cells")
    made = [c for c in cells.columns if c not in (*keys, key)]
    ranks = cumulated(cells.select(quoted(key)).distinct(), quoted(key)).select(F.col("value").alias("__value"), F.col("before").alias("position"))
    there = cells.filter(quoted(key).isNotNull()).join(ranks, quoted(key) == F.col("__value"))
    named = there.select(*[quoted(k) for k in keys], quoted(key), "position", *[quoted(m) for m in made])
    groups = lambda d: d.select(*[quoted(k) for k in keys])
    only_null = groups(cells.filter(quoted(key).isNull()))
    if keys:
        has = groups(cells.filter(quoted(key).isNotNull())).distinct().toDF(*[f"__g{i}" for i in range(len(keys))])
        only_null = only_null.join(has, reduce(lambda x, y: x & y, [quoted(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]), "left_anti")
    else:
        only_null = only_null.limit(0) if not cells.filter(quoted(key).isNotNull()).isEmpty() else only_null
    return named.unionByName(only_null, allowMissingColumns=True)


def pivot_slice(cells: DataFrame, on: str, keys: Sequence[str], first: int, width: int = PIVOT_WIDTH) -> DataFrame:
    """Columns ``first`` to ``first + width`` - 1 of the pivot of which ``cells`` is the long form: every group, a column for each value and aggregate.

    Only the slice's names reach the driver, and a group's row is ``width``
    wide at most in any task. ``cells`` should be written: each slice reads it.
    """
    key = column(cells, on)
    held = F.col("position").between(first, first + width - 1)
    values = [r[0] for r in cells.filter(held).select("position", quoted(key)).distinct().orderBy("position").select(quoted(key)).collect()]
    names = [column(cells, k) for k in keys]
    made = [c for c in cells.columns if c not in (*names, key, "position")]
    return cells.groupBy(*[quoted(k) for k in names]).pivot(key, values).agg(*[F.first(quoted(m), True).alias(m) for m in made])


def unpivot(df: DataFrame, columns: Sequence[str], name_to: str = "name", value_to: str = "value") -> DataFrame:
    """Fold columns into name and value; null values give no row."""
    folded = [column(df, c) for c in columns]
    rest = [quoted(c) for c in df.columns if c not in folded]
    return df.unpivot(rest, [quoted(c) for c in folded], name_to, value_to).filter(quoted(value_to).isNotNull())


def outliers(df: DataFrame, column_name: str, method: str = "iqr", factor: float = 1.5, action: str = "flag", accuracy: int | None = None) -> DataFrame:
    """Flag (``is_outlier``) or remove values far from the rest; null is never an outlier.

    iqr: beyond ``factor`` interquartile ranges from the interpolated
    quartiles, exact by ranges of values; ``accuracy`` takes approximate ones.
    zscore: over ``factor`` sample deviations from the mean; no spread, no outlier.
    The one row of statistics is broadcast.
    """
    c = quoted(column(df, column_name))
    if method == "iqr":
        if accuracy:
            stats = df.agg(*[F.percentile_approx(c, p, accuracy).alias(n) for n, p in (("__a", 0.25), ("__b", 0.75))])
        else:
            stats = quantiles(df, c, (0.25, 0.75)).select(F.col("q0").alias("__a"), F.col("q1").alias("__b"))
        reach = F.lit(float(factor)) * (F.col("__b") - F.col("__a"))
        far = (c < F.col("__a") - reach) | (c > F.col("__b") + reach)
    elif method == "zscore":
        stats = df.agg(F.avg(c).alias("__a"), F.stddev_samp(c).alias("__b"))
        far = (F.col("__b") > 0) & (F.abs(c - F.col("__a")) > F.lit(float(factor)) * F.col("__b"))
    else:
        raise ValueError(f"unknown method {method!r}: iqr or zscore")
    if action not in ("flag", "remove"):
        raise ValueError(f"unknown action {action!r}: flag or remove")
    if action == "flag" and "is_outlier" in {x.lower() for x in df.columns}:
        raise ValueError("there is a column 'is_outlier' already")
    found = df.crossJoin(F.broadcast(stats)).withColumn("is_outlier", F.coalesce(far, F.lit(False))).drop("__a", "__b")
    return found if action == "flag" else found.filter(~F.col("is_outlier")).drop("is_outlier")


#: Samples of so many rows or fewer are the best of each task, merged; larger ones are cut at a hash found from counts.
SMALL_SAMPLE = 10_000
#: Bits of the hash that a histogram tells apart, and rows of a bin whose hashes are looked at one by one.
SAMPLE_BITS, SAMPLE_BIN = 12, 100_000


def sample(df: DataFrame, rows: int = 10_000, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``rows`` rows, or all: those of the least seeded hash, the same ones however the input is partitioned.

    The hash is of all columns, or with ``keys`` the first 60 bits of the MD5
    of ``seed:key:key...`` as text, which other engines can make too. A large
    sample is a filter: histograms of the hash find the one at which to cut,
    so nothing is sorted and no task gets the sample.
    """
    if rows < 1:
        raise ValueError("a sample has one row at least")
    if keys:
        text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(quoted(column(df, k)).cast("string"), F.lit("")) for k in keys])
        h = F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long")
    else:
        h = F.xxhash64(F.lit(seed), *[F.to_json(F.struct(quoted(f.name))) if _has_map(f.dataType) else quoted(f.name) for f in df.schema.fields])
    if rows <= SMALL_SAMPLE:
        return df.withColumn("__h", h).orderBy("__h").limit(rows).drop("__h")
    cut, more = cut_off(df.select(h.alias("h")), rows)
    if cut is None:
        return df
    held = df.withColumn("__h", h)
    below, ties = held.filter(F.col("__h") < cut), held.filter(F.col("__h") == cut)
    return (below.unionByName(ties.limit(more)) if more else below).drop("__h")


def cut_off(hashes: DataFrame, rows: int) -> tuple[int | None, int]:
    """(hash, n) such that ``rows`` rows of ``hashes`` (h) are below the hash or among n that have it; (None, 0) if there are no more rows than that.

    A histogram of the hash's leading bits finds the bin in which the cut
    falls, one of the next bits looks into it, until few rows are left.
    """
    low, bits, need = -(1 << 63), 64, rows
    while True:
        bits = max(bits - SAMPLE_BITS, 0)
        bin_ = F.shiftright(F.col("h") - F.lit(low) if bits < 52 else F.col("h"), bits)
        top = low if bits < 52 else 0
        span = hashes if bits == 52 else hashes.filter((F.col("h") >= low) & (F.col("h") <= low + (1 << (bits + SAMPLE_BITS)) - 1))
        counts = sorted((r["b"], r["n"]) for r in span.groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect())
        if bits == 52 and sum(n for _, n in counts) <= rows:
            return None, 0
        for b, n in counts:
            if n >= need:
                break
            need -= n
        low = top + (b << bits)
        if n <= SAMPLE_BIN or not bits:
            exact = hashes.filter((F.col("h") >= low) & (F.col("h") <= low + (1 << bits) - 1)).groupBy("h").agg(F.count("*").alias("n")).collect() if bits else [(low, n)]
            for h, n in sorted(map(tuple, exact)):
                if n >= need:
                    return h, need
                need -= n


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)
