"""Field mapping: a document that projects a source table onto a target schema and counts every value it loses.

Document: ``{"fields": [{"target", "sources": [...], "join_with", "constant", "type", "required", "steps": [{"key", "args"}]}],
"unmapped": "drop" | "null" | "passthrough", "schema": [{"name", "type", "required"}]}``.
One row in, one row out; the whole mapping is one projection, the counters one aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomwork.functions import transforms as tf
from loomwork.operators.nodes import column, quoted

POLICIES = ("drop", "null", "passthrough")
TYPE = re.compile(r"\s*([A-Za-z]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*$")
#: Declared types and what they are in Spark (fixed values).
TYPES = {
    "VARCHAR": "string", "TEXT": "string", "STRING": "string", "CHAR": "string", "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "INT": "int", "BIGINT": "bigint",
    "FLOAT": "float", "REAL": "float", "DOUBLE": "double", "DECIMAL": "decimal", "NUMERIC": "decimal", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "BOOL": "boolean",
}


def spark_type(declared: str) -> str:
    """The Spark name of a declared type such as ``DECIMAL(10,2)``; anything unknown is refused."""
    m = TYPE.match(declared)
    name = m and TYPES.get(m[1].upper())
    if not name:
        raise ValueError(f"unknown type {declared!r}")
    if name == "decimal":
        return f"decimal({m[2] or 18},{m[3] or (0 if m[2] else 4)})"
    return name


@dataclass(frozen=True)
class Step:
    key: str
    args: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class FieldMap:
    target: str
    sources: tuple[str, ...] = ()
    join_with: str = " "
    constant: str = ""
    type: str = ""
    steps: tuple[Step, ...] = ()


@dataclass(frozen=True)
class TargetColumn:
    name: str
    type: str = ""
    required: bool = False


@dataclass(frozen=True)
class MappingDoc:
    fields: tuple[FieldMap, ...]
    unmapped: str = "drop"
    schema: tuple[TargetColumn, ...] = ()

    @classmethod
    def from_dict(cls, doc: Mapping[str, Any]) -> MappingDoc:
        fields = [
            FieldMap(f["target"], tuple(f.get("sources", ())), f.get("join_with", " "), str(f.get("constant", "")), f.get("type", ""), tuple(Step(s["key"], dict(s.get("args", {}))) for s in f.get("steps", ())))
            for f in doc.get("fields", ())
        ]
        return cls(tuple(fields), doc.get("unmapped", "drop"), tuple(TargetColumn(c["name"], c.get("type", ""), bool(c.get("required"))) for c in doc.get("schema", ())))

    def to_dict(self) -> dict[str, Any]:
        fields = [{"target": f.target, "sources": list(f.sources), "join_with": f.join_with, "constant": f.constant, "type": f.type, "steps": [{"key": s.key, "args": s.args} for s in f.steps]} for f in self.fields]
        return {"fields": fields, "unmapped": self.unmapped, "schema": [{"name": c.name, "type": c.type, "required": c.required} for c in self.schema]}

    def declared(self, target: str) -> str:
        """The type a target is cast to: the field's, else the schema's; empty for none."""
        own = next((f.type for f in self.fields if f.target.lower() == target.lower() and f.type), "")
        return own or next((c.type for c in self.schema if c.name.lower() == target.lower()), "")

    def validate(self, columns: Sequence[str] | None = None) -> None:
        """ValueError for the first fault: policy, transforms and their arguments, targets, sources that ``columns`` lacks."""
        if self.unmapped not in POLICIES:
            raise ValueError(f"unknown policy {self.unmapped!r}: {', '.join(POLICIES)}")
        seen: set[str] = set()
        declared = {c.name.lower() for c in self.schema}
        for f in self.fields:
            if not f.target or f.target.lower() in seen:
                raise ValueError(f"target {f.target!r} is empty or given twice")
            seen.add(f.target.lower())
            if declared and f.target.lower() not in declared:
                raise ValueError(f"target {f.target!r} is not in the schema")
            if f.sources and f.constant:
                raise ValueError(f"{f.target}: a source and a constant are given")
            for s in f.steps:
                tf.checked_arguments(s.key, s.args)
            if self.declared(f.target):
                spark_type(self.declared(f.target))
            if columns is not None and (missing := [s for s in f.sources if s.lower() not in {c.lower() for c in columns}]):
                raise ValueError(f"{f.target}: no source column {', '.join(missing)}; there are: {', '.join(columns)}")
        if missing := [c.name for c in self.schema if c.required and c.name.lower() not in seen]:
            raise ValueError(f"required targets are not mapped: {', '.join(missing)}")


@dataclass
class _Built:
    """A target's columns at each stage, all on one frame."""

    base: Column
    final: Column
    readable: Column
    lossy: list[tuple[str, Column, Column]] = field(default_factory=list)  # name of the step, before, after
    cast: tuple[Column, Column] | None = None
    lookups: list[tuple[Column, Column]] = field(default_factory=list)  # value, hit



def _build(df: DataFrame, doc: MappingDoc, crosswalks: Mapping[str, DataFrame]) -> tuple[DataFrame, dict[str, _Built]]:
    """The frame with helper columns (steps of expressions, joined crosswalks) and each target's columns on it."""
    built, helper = {}, 0
    for f in doc.fields:
        if len(f.sources) == 1:
            name = column(df, f.sources[0])
            c, kind = quoted(name), df.schema[name].dataType.simpleString()
            readable = c.isNotNull()
        elif f.sources:
            parts = [quoted(column(df, s)) for s in f.sources]
            c, kind = F.concat_ws(f.join_with, *[p.cast("string") for p in parts]), "string"
            readable = c.isNotNull() & (c != "")
        else:
            c, kind = (F.lit(f.constant) if f.constant else F.lit(None).cast("string")), "string"
            readable = c.isNotNull()
        own = _Built(c, c, readable)
        for s in f.steps:
            args, before = tf.checked_arguments(s.key, s.args), c
            if s.key == "expression":
                helper += 1
                df = df.withColumn(f"__v{helper}", c)
                df = df.withColumn(f"__e{helper}", F.expr(args["sql"].replace("{value}", f"__v{helper}")))
                c, kind = F.col(f"__e{helper}"), df.schema[f"__e{helper}"].dataType.simpleString()
            elif s.key == "lookup":
                text = c if kind == "string" else c.cast("string")
                if args.get("file"):
                    if args["file"] not in crosswalks:
                        raise ValueError(f"{f.target}: no crosswalk {args['file']!r} was given")
                    helper += 1
                    walk = crosswalk(crosswalks[args["file"]])
                    df = df.withColumn(f"__v{helper}", text).join(walk.select(F.col("key").alias(f"__v{helper}"), F.col("value").alias(f"__x{helper}")), f"__v{helper}", "left")
                    hit = F.col(f"__x{helper}")
                else:
                    hit = tf.lookup_hit(text, tf.pairs_of(args["pairs"])[0])
                own.lookups.append((text, hit))
                c, kind = F.coalesce(hit, text), "string"
            else:
                c = tf.TRANSFORMS[s.key].build(c, args, kind)
                kind = tf.result_type(s.key, args, kind)
                if tf.TRANSFORMS[s.key].lossy:
                    own.lossy.append((s.key, before, c))
        if declared := doc.declared(f.target):
            before, c = c, tf.try_cast(c, spark_type(declared), kind)
            own.cast = (before, c)
        own.final = c
        built[f.target] = own
    return df, built


def crosswalk(table: DataFrame) -> DataFrame:
    """(key, value) of a table's first two columns as text: the least value of each key, null keys left out. Any number of rows."""
    key, value = (quoted(c).cast("string") for c in table.columns[:2])
    return table.select(key.alias("key"), value.alias("value")).filter("key is not null").groupBy("key").agg(F.min("value").alias("value"))


def crosswalk_notes(table: DataFrame) -> list[str]:
    """What crosswalk() leaves out, counted."""
    key, value = (quoted(c).cast("string") for c in table.columns[:2])
    r = table.select(key.alias("k"), value.alias("v")).agg(F.count_if(F.col("k").isNull()).alias("blank"), F.count("k").alias("n"), F.countDistinct("k").alias("keys")).first()
    return [f"{r['blank']} crosswalk row(s) have no key"] * bool(r["blank"]) + [f"{r['n'] - r['keys']} crosswalk row(s) repeat a key; the least value counts"] * (r["n"] > r["keys"])


def _output(df: DataFrame, source: DataFrame, doc: MappingDoc, built: Mapping[str, _Built]) -> list[Column]:
    out: list[Column] = []
    targets = {f.target.lower() for f in doc.fields}
    if doc.unmapped == "passthrough":
        used = {s.lower() for f in doc.fields for s in f.sources} | targets
        out += [quoted(c) for c in source.columns if c.lower() not in used]
    if doc.unmapped == "null" and doc.schema:
        by = {t.lower(): b.final.alias(t) for t, b in built.items()}
        out += [by.get(c.name.lower(), F.lit(None).cast(spark_type(c.type) if c.type else "string").alias(c.name)) for c in doc.schema]
    else:
        out += [b.final.alias(t) for t, b in built.items()]
    return out


def apply_mapping(df: DataFrame, doc: MappingDoc, crosswalks: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The mapped table. Steps fold left to right, then the declared type is cast to; a value that cannot be is null."""
    doc.validate(df.columns)
    held, built = _build(df, doc, crosswalks or {})
    return held.select(*_output(held, df, doc, built))


def _counters(built: Mapping[str, _Built]) -> list[Column]:
    out, used = [], set()

    def add(name: str, lost: Column) -> None:
        k, own = 1, name
        while own.lower() in used:
            k += 1
            own = f"{name}_{k}"
        used.add(own.lower())
        out.append(F.count_if(lost).alias(own))

    for target, b in built.items():
        for key, before, after in b.lossy:
            add(f"{target}__lost_{key}", b.readable & before.isNotNull() & after.isNull())
        if b.cast:
            add(f"{target}__lost", b.readable & b.cast[0].isNotNull() & b.cast[1].isNull())
        for value, hit in b.lookups:
            add(f"{target}__unmatched", value.isNotNull() & hit.isNull())
    return out


def loss_counters(df: DataFrame, doc: MappingDoc, crosswalks: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One row: values each lossy step and each cast could not read, and lookups that found nothing, in one pass."""
    doc.validate(df.columns)
    held, built = _build(df, doc, crosswalks or {})
    counters = _counters(built)
    return held.agg(*counters) if counters else df.sparkSession.range(1).select()


def apply_observed(df: DataFrame, doc: MappingDoc, crosswalks: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, Observation]:
    """The mapped table and an Observation with its rows and loss counters, filled by whatever action runs first: no second scan.

    A sort above it reads its input twice and so counts twice: write first, or sort what was written.
    """
    doc.validate(df.columns)
    held, built = _build(df, doc, crosswalks or {})
    seen = Observation()
    return held.observe(seen, F.count("*").alias("rows"), *_counters(built)).select(*_output(held, df, doc, built)), seen


def preview(df: DataFrame, doc: MappingDoc, target: str, rows: int = 20, crosswalks: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``before`` and ``after`` of one target on some rows."""
    held, built = _build(df, doc, crosswalks or {})
    b = next((b for t, b in built.items() if t.lower() == target.lower()), None)
    if b is None:
        raise ValueError(f"no target {target!r}; there are: {', '.join(built)}")
    return held.select(b.base.alias("before"), b.final.alias("after")).limit(rows)


def notes(doc: MappingDoc) -> list[str]:
    """What the document itself leaves out: repeated lookup pairs and those beyond the limit."""
    out = []
    for f in doc.fields:
        for s in f.steps:
            if s.key == "lookup" and s.args.get("pairs"):
                _, repeated, beyond = tf.pairs_of(s.args["pairs"])
                if repeated:
                    out.append(f"{f.target}: {repeated} lookup pair(s) repeat a key; the first counts")
                if beyond:
                    out.append(f"{f.target}: {beyond} lookup pair(s) beyond {tf.MAX_PAIRS} are not used; give a crosswalk file")
    return out
