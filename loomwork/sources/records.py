"""JSON documents to tables: paths compiled to column expressions over nested types, records exploded, leaves flattened."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.nodes import quoted

#: Keys that commonly hold the records of a response, in order (fixed values).
RECORD_KEYS = ("data", "items", "results", "records", "values", "issues", "rows", "elements")
MAX_COLUMNS, DEPTH = 60, 3
STEP = re.compile(r"\.?([^.\[\]]+)|\[(\*|-?\d+)\]")


def parse_path(path: str) -> list[str | int]:
    """``a.b[0].c[*]`` as steps: keys, indexes (negative from the end) and ``*``, which is -- like a key named so -- the text."""
    steps: list[str | int] = []
    at = 0
    while at < len(path.strip()):
        m = STEP.match(path.strip(), at)
        if not m:
            raise ValueError(f"cannot read the path {path!r} at {path.strip()[at:]!r}")
        steps.append(m[1] if m[1] is not None else "*" if m[2] == "*" else int(m[2]))
        at = m.end()
    return steps


def _missing() -> tuple[Column, T.DataType]:
    return F.lit(None).cast("string"), T.StringType()


def resolve(c: Column, kind: T.DataType, steps: list[str | int]) -> tuple[Column, T.DataType]:
    """(column, type) at the end of a path: null where a key or index is not there; a key after a list maps over it."""
    if not steps:
        return c, kind
    step, rest = steps[0], steps[1:]
    if isinstance(kind, T.ArrayType):
        if step == "*" or isinstance(step, str):
            below = rest if step == "*" else steps
            inner: list[T.DataType] = []

            def each(x: Column) -> Column:
                found, found_kind = resolve(x, kind.elementType, below)
                inner.append(found_kind)
                return found

            mapped = F.transform(c, each)
            return mapped, T.ArrayType(inner[0])
        return resolve(F.try_element_at(c, F.lit(step + 1 if step >= 0 else step)), kind.elementType, rest)
    if isinstance(step, str) and step != "*":
        if isinstance(kind, T.StructType) and step in kind.names:
            return resolve(c.getField(step), kind[step].dataType, rest)
        if isinstance(kind, T.MapType):
            return resolve(F.try_element_at(c, F.lit(step)), kind.valueType, rest)
    return _missing()


def scalar(c: Column, kind: T.DataType) -> Column:
    """A cell: lists and objects as JSON text, other values as they are."""
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c


def parse_documents(df: DataFrame, name: str, schema: str | None = None) -> DataFrame:
    """``df`` with its JSON text column parsed to nested values; without a schema it is merged from all documents, on the executors."""
    c = quoted(name)
    if schema is None:
        merged = df.select(F.schema_of_variant_agg(F.try_parse_json(c))).first()[0]
        schema = re.sub(r"\bOBJECT<", "STRUCT<", merged or "VOID").replace("VARIANT", "STRING").replace("VOID", "STRING")
        if not schema.startswith(("STRUCT", "ARRAY")):
            raise ValueError(f"column {name!r} holds no JSON objects: {schema}")
    return df.withColumn(name, F.from_json(c, schema))


def records(df: DataFrame, path: str = "", document: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``record``, one row for each record at ``path``: of a list each element, of a single object one, of nothing none.

    The document is a nested column, or without a name the whole row.
    """
    c = quoted(document) if document else F.struct(*map(quoted, df.columns))
    kind = df.schema[document].dataType if document else df.schema
    found, found_kind = resolve(c, kind, parse_path(path))
    kept = [quoted(k) for k in keep]
    if isinstance(found_kind, T.ArrayType):
        return df.select(*kept, F.explode(found).alias("record"))
    return df.select(*kept, found.alias("record")).filter("record is not null")


def project(found: DataFrame, columns: Mapping[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and one column for each name and path within ``record``."""
    kind = found.schema["record"].dataType
    return found.select(*[quoted(k) for k in keep], *[scalar(*resolve(F.col("record"), kind, parse_path(p))).alias(n) for n, p in columns.items()])


def leaves(kind: T.DataType, prefix: str = "", depth: int = 0) -> list[tuple[str, list[str]]]:
    """(dotted name, steps) of a type's leaves: objects to three levels below the root, anything deeper and lists whole."""
    if not isinstance(kind, T.StructType):
        return [(prefix or "value", [])]
    out = []
    for f in kind.fields:
        name = f"{prefix}.{f.name}" if prefix else f.name
        below = leaves(f.dataType, name, depth + 1) if isinstance(f.dataType, T.StructType) and depth < DEPTH else [(name, [])]
        out += [(n, [f.name, *steps]) for n, steps in below]
    return out


def flatten(found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and every leaf of ``record`` under its dotted name; lists and deep objects as JSON text."""
    kind = found.schema["record"].dataType
    return found.select(*[quoted(k) for k in keep], *[scalar(*resolve(F.col("record"), kind, list(steps))).alias(n) for n, steps in leaves(kind)])


def infer_mapping(df: DataFrame, document: str | None = None) -> tuple[str, dict[str, str]]:
    """(records path, {column: path}): a conventional key that holds a list, else the longest list of objects; up to 60 leaves, dots as ``_``."""
    kind = df.schema[document].dataType if document else df.schema
    c = quoted(document) if document else F.struct(*map(quoted, df.columns))
    path = ""
    if isinstance(kind, T.StructType):
        lists = [f.name for f in kind.fields if isinstance(f.dataType, T.ArrayType)]
        path = next((k for k in RECORD_KEYS if k in lists), "")
        objects = [n for n in lists if isinstance(kind[n].dataType.elementType, T.StructType)]
        if not path and objects:
            sizes = df.agg(*[F.max(F.size(c.getField(n))).alias(n) for n in objects]).first()
            path = max(objects, key=lambda n: (sizes[n] or 0, -objects.index(n)))
    found, found_kind = resolve(c, kind, parse_path(path))
    if isinstance(found_kind, T.ArrayType):
        found_kind = found_kind.elementType
    return path, {n.replace(".", "_"): n for n, _ in leaves(found_kind)[:MAX_COLUMNS]}


def to_table(df: DataFrame, path: str = "", columns: Mapping[str, str] | None = None, document: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records at ``path``, projected on declared columns, or flattened."""
    found = records(df, path, document, keep)
    return project(found, columns, keep) if columns else flatten(found, keep)
