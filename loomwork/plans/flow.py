"""Flows: a JSON document of nodes and edges folded into one chain of DataFrames, so that Catalyst sees a single plan.

``{"schema": 1, "nodes": [{"id", "type", "params"}], "edges": [{"src", "dst", "port"}]}``
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomwork.operators import mapping, nodes, profile
from loomwork.sources import files, push
from loomwork.sources.files import WriteReport

SCHEMA = 1
PREVIEW_ROWS = 500


@dataclass(frozen=True)
class NodeType:
    """``run(*inputs, **params)``; sources take the session first. A sink's run gives what it would write, ``write`` writes it."""

    name: str
    run: Callable[..., DataFrame]
    least: int = 1
    most: int | None = 1
    source: bool = False
    write: Callable[..., WriteReport] | None = None
    destructive: bool = False


NODE_TYPES: dict[str, NodeType] = {}


def register_node(name: str, run: Callable[..., DataFrame], inputs: int | tuple[int, int | None] = 1, **more: Any) -> None:
    """Add a node type; ``run(*dfs, **params)`` gives a DataFrame."""
    if name in NODE_TYPES:
        raise ValueError(f"there is a node type {name!r} already")
    least, most = inputs if isinstance(inputs, tuple) else (inputs, inputs)
    NODE_TYPES[name] = NodeType(name, run, least, most, **more)


def _map_fields(df: DataFrame, doc: Mapping[str, Any]) -> DataFrame:
    made = mapping.MappingDoc.from_dict(doc)
    paths = {s.args["file"] for f in made.fields for s in f.steps if s.key == "lookup" and s.args.get("file")}
    return mapping.apply_mapping(df, made, {p: files.read_file(df.sparkSession, p) for p in paths})


def _write_rest(df: DataFrame, dry_run: bool = True, order: list[str] | None = None, **spec: Any) -> WriteReport:
    if not dry_run:
        raise ValueError("requests are planned, not sent: run with dry_run")
    return push.push_plan(df, push.PushSpec(**spec), order or df.columns[:1])[2]


def _joined(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, how: str = "inner", hint: str | None = None) -> DataFrame:
    return nodes.join(left, right, left_on, right_on, how, hint)


register_node("input_file", files.read_file, 0, source=True)
register_node("input_database", lambda spark, url="", table="", query="", **o: files.read_database(spark, {"url": url, **o}, table, query), 0, source=True)
register_node("input_dataset", lambda spark, name: spark.table(name), 0, source=True)
register_node("select", nodes.select)
register_node("filter", nodes.filter_rows)
register_node("calculated", nodes.calculated)
register_node("clean_nulls", nodes.clean_nulls)
register_node("aggregate", nodes.aggregate)
register_node("join", _joined, 2)
register_node("union", nodes.union, (2, None))
register_node("pivot", nodes.pivot)
register_node("unpivot", nodes.unpivot)
register_node("outliers", lambda df, column, **p: nodes.outliers(df, column, **p))
register_node("sample", nodes.sample)
register_node("map_fields", _map_fields)
register_node("output", lambda df, **p: df, write=lambda df, dry_run=True, path="", format="parquet": files.write_file(df, path, format, dry_run))
register_node("output_dataset", lambda df, **p: df, write=lambda df, dry_run=True, table="": files.write_table(df, table, dry_run), destructive=True)
register_node("output_rest", lambda df, **p: df, write=_write_rest, destructive=True)


@dataclass
class Flow:
    nodes: dict[str, tuple[str, dict[str, Any]]] = field(default_factory=dict)
    edges: list[tuple[str, str, int]] = field(default_factory=list)

    @classmethod
    def from_doc(cls, doc: Mapping[str, Any]) -> Flow:
        if int(doc.get("schema", SCHEMA)) > SCHEMA:
            raise ValueError(f"the flow has schema {doc['schema']}, newer than {SCHEMA}")
        flow = cls()
        for n in doc.get("nodes", ()):
            flow.add(n["id"], n["type"], n.get("params", {}))
        for e in doc.get("edges", ()):
            flow.connect(e["src"], e["dst"], int(e.get("port", 0)))
        return flow

    def to_doc(self) -> dict[str, Any]:
        return {"schema": SCHEMA, "nodes": [{"id": i, "type": t, "params": p} for i, (t, p) in self.nodes.items()], "edges": [{"src": a, "dst": b, "port": k} for a, b, k in self.edges]}

    def add(self, ident: str, kind: str, params: Mapping[str, Any] | None = None) -> Flow:
        if kind not in NODE_TYPES:
            raise ValueError(f"node {ident!r}: unknown type {kind!r}; there are: {', '.join(NODE_TYPES)}")
        if ident in self.nodes:
            raise ValueError(f"node {ident!r} is there twice")
        self.nodes[ident] = (kind, dict(params or {}))
        return self

    def connect(self, src: str, dst: str, port: int = 0) -> Flow:
        for i in (src, dst):
            if i not in self.nodes:
                raise ValueError(f"an edge names node {i!r}, which is not there")
        kind = NODE_TYPES[self.nodes[dst][0]]
        if kind.most is not None and port >= kind.most or port < 0:
            raise ValueError(f"node {dst!r}: {kind.name} has no input {port}")
        if any(d == dst and k == port for _, d, k in self.edges):
            raise ValueError(f"node {dst!r}: input {port} is taken")
        if src == dst or dst in self.ancestors(src):
            raise ValueError(f"node {dst!r}: the edge from {src!r} closes a circle")
        self.edges.append((src, dst, port))
        return self

    def inputs(self, ident: str) -> list[str]:
        return [s for k, s in sorted((k, s) for s, d, k in self.edges if d == ident)]

    def ancestors(self, ident: str) -> set[str]:
        found: set[str] = set()
        wait = self.inputs(ident)
        while wait:
            if (i := wait.pop()) not in found:
                found.add(i)
                wait += self.inputs(i)
        return found

    def check(self, ident: str) -> None:
        """ValueError that names the node: too few inputs, or parameters its type does not take or lacks."""
        for i in [ident, *self.ancestors(ident)]:
            kind, params = NODE_TYPES[self.nodes[i][0]], self.nodes[i][1]
            if len(self.inputs(i)) < kind.least:
                raise ValueError(f"node {i!r}: {kind.name} needs {kind.least} input(s), it has {len(self.inputs(i))}")
            inputs = [None] * max(len(self.inputs(i)), int(kind.source))
            try:
                inspect.signature(kind.run).bind(*inputs, **params)
            except TypeError as e:
                raise ValueError(f"node {i!r}: {kind.name}: {e}") from None

    def sinks(self) -> list[str]:
        return [i for i, (t, _) in self.nodes.items() if NODE_TYPES[t].write]

    def frame(self, spark: SparkSession, ident: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
        """The DataFrame of a node; nodes that several others use are built once."""
        if ident not in self.nodes:
            raise ValueError(f"no node {ident!r}; there are: {', '.join(self.nodes)}")
        self.check(ident)
        made = {} if made is None else made

        def build(i: str) -> DataFrame:
            if i not in made:
                kind, params = NODE_TYPES[self.nodes[i][0]], self.nodes[i][1]
                inputs = [build(s) for s in self.inputs(i)]
                try:
                    made[i] = kind.run(*([spark] if kind.source else inputs), **params)
                except ValueError as e:
                    raise ValueError(f"node {i!r}: {e}") from e
            return made[i]

        return build(ident)


def run_flow(spark: SparkSession, doc: Mapping[str, Any], node: str) -> DataFrame:
    return Flow.from_doc(doc).frame(spark, node)


def preview(spark: SparkSession, flow: Flow, node: str, rows: int = PREVIEW_ROWS) -> tuple[list[tuple[str, str]], int, DataFrame]:
    """(schema, total rows, first rows) of a node."""
    df = flow.frame(spark, node)
    return df.dtypes, df.count(), df.limit(rows)


def profile_node(spark: SparkSession, flow: Flow, node: str, max_rows: int | None = None) -> dict[str, DataFrame]:
    return profile.profile(flow.frame(spark, node), max_rows)


def run_outputs(spark: SparkSession, flow: Flow, only: list[str] | None = None, allow_writes: bool = False, dry_run: bool = False) -> dict[str, WriteReport]:
    """Run all sinks, or ``only`` some. Before anything runs, sinks that replace or send are refused unless writes are allowed or it is a dry run.

    Nodes that feed more than one sink are persisted while the flow runs.
    """
    chosen = only if only is not None else flow.sinks()
    for i in chosen:
        if i not in flow.nodes or not NODE_TYPES[flow.nodes[i][0]].write:
            raise ValueError(f"node {i!r} is no output")
        flow.check(i)
    if refused := [i for i in chosen if NODE_TYPES[flow.nodes[i][0]].destructive and not (allow_writes or dry_run)]:
        raise PermissionError(f"outputs that replace or send data need allow_writes: {', '.join(refused)}")
    made: dict[str, DataFrame] = {}
    shared = {s for s in {i for c in chosen for i in flow.ancestors(c)} if len({d for a, d, _ in flow.edges if a == s and (d in chosen or any(d in flow.ancestors(c) for c in chosen))}) > 1}
    reports, held = {}, []
    try:
        for i in chosen:
            for s in [a for a in flow.nodes if a in shared and a in flow.ancestors(i) and a not in made]:
                flow.frame(spark, s, made)
                made[s] = made[s].persist()
                held.append(made[s])
            df = flow.frame(spark, i, made)
            kind, params = NODE_TYPES[flow.nodes[i][0]], flow.nodes[i][1]
            reports[i] = kind.write(df, dry_run=dry_run, **params)
            for a in flow.nodes:
                if a in flow.ancestors(i) and flow.nodes[a][0] == "map_fields":
                    reports[i].notes += mapping.notes(mapping.MappingDoc.from_dict(flow.nodes[a][1]["doc"]))
    finally:
        for df in held:
            df.unpersist()
    return reports


def flow_from_columns(source: str, columns: list[str], out: str) -> Flow:
    return Flow().add("in", "input_file", {"path": source}).add("select", "select", {"keep": columns}).add("out", "output", {"path": out}).connect("in", "select").connect("select", "out")


def flow_with_mapping(source: str, doc: Mapping[str, Any], out: str) -> Flow:
    return Flow().add("in", "input_file", {"path": source}).add("map", "map_fields", {"doc": dict(doc)}).add("out", "output", {"path": out}).connect("in", "map").connect("map", "out")
