"""Reading and writing tables: files, databases, a catalog of named datasets, write reports."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.operators.nodes import column, quoted
from loomwork.scratch import scratch_path  # noqa: F401

SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}
TABLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[1] if "." in name else ""


def read_file(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str | None = None, header: bool = True) -> DataFrame:
    """A file or folder by its suffix: .csv .tsv .txt .json .jsonl .ndjson .parquet. Give a schema at scale: without one Spark reads twice."""
    kind = suffix(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in SEPARATORS:
        return reader.csv(path, sep=sep or SEPARATORS[kind], header=header, inferSchema=schema is None, multiLine=False, escape='"')
    if kind in (".json", ".jsonl", ".ndjson"):
        return reader.json(path, multiLine=kind == ".json")
    if kind == ".parquet":
        return reader.parquet(path)
    raise ValueError(f"cannot read {path!r}: .csv .tsv .txt .json .jsonl .ndjson .parquet")


@dataclass(frozen=True)
class Dialect:
    """How a kind of database is reached: URL form and the fields it needs."""

    name: str
    url: str
    required: tuple[str, ...]
    port: str = ""
    driver: str = ""


#: JDBC URL forms of databases (fixed values of their drivers).
DIALECTS = {
    d.name: d
    for d in (
        Dialect("derby", "jdbc:derby:{database}", ("database",), "", "org.apache.derby.jdbc.EmbeddedDriver"),
        Dialect("sqlite", "jdbc:sqlite:{path}", ("path",), "", "org.sqlite.JDBC"),
        Dialect("postgresql", "jdbc:postgresql://{host}:{port}/{database}", ("host", "database", "user"), "5432", "org.postgresql.Driver"),
        Dialect("mysql", "jdbc:mysql://{host}:{port}/{database}", ("host", "database", "user"), "3306", "com.mysql.cj.jdbc.Driver"),
        Dialect("mssql", "jdbc:sqlserver://{host}:{port};databaseName={database}", ("host", "database", "user"), "1433", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
        Dialect("oracle", "jdbc:oracle:thin:@//{host}:{port}/{service}", ("host", "service", "user"), "1521", "oracle.jdbc.OracleDriver"),
        Dialect("snowflake", "jdbc:snowflake://{account}.snowflakecomputing.com/?db={database}&warehouse={warehouse}", ("account", "database", "user"), "", "net.snowflake.client.jdbc.SnowflakeDriver"),
        Dialect("redshift", "jdbc:redshift://{host}:{port}/{database}", ("host", "database", "user"), "5439", "com.amazon.redshift.jdbc42.Driver"),
        Dialect("trino", "jdbc:trino://{host}:{port}/{catalog}/{schema}", ("host", "catalog", "user"), "8080", "io.trino.jdbc.TrinoDriver"),
        Dialect("clickhouse", "jdbc:clickhouse://{host}:{port}/{database}", ("host", "database"), "8123", "com.clickhouse.jdbc.ClickHouseDriver"),
        Dialect("db2", "jdbc:db2://{host}:{port}/{database}", ("host", "database", "user"), "50000", "com.ibm.db2.jcc.DB2Driver"),
        Dialect("bigquery", "jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443;ProjectId={project};DefaultDataset={dataset};OAuthType=3", ("project",), "", "com.simba.googlebigquery.jdbc.Driver"),
        Dialect("athena", "jdbc:athena://Region={region};Database={database};OutputLocation={output};CredentialsProvider=DefaultChain", ("region", "output"), "", "com.amazon.athena.jdbc.AthenaDriver"),
        Dialect("databricks", "jdbc:databricks://{host}:443;httpPath={http_path}", ("host", "http_path"), "", "com.databricks.client.jdbc.Driver"),
    )
}


def jdbc_options(dialect: str, values: Mapping[str, str]) -> dict[str, str]:
    """url, driver, user and password options; values are escaped, missing required ones are named."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown database {dialect!r}: {', '.join(DIALECTS)}")
    d = DIALECTS[dialect]
    if missing := [f for f in d.required if not str(values.get(f, "")).strip()]:
        raise ValueError(f"{dialect} needs: {', '.join(missing)}")
    names = re.findall(r"{(\w+)}", d.url)
    kept = {"derby": "/:;=", "sqlite": "/:;=", "databricks": "/:;=", "athena": "/:"}.get(dialect, "")
    filled = {n: quote(str(values.get(n) or (d.port if n == "port" else "")).strip(), safe=kept) for n in names}
    out = {"url": re.sub(r"[?&;]\w+=(?=[&;]|$)", "", d.url.format(**filled)), "driver": d.driver}
    return out | {k: str(values[k]) for k in ("user", "password") if values.get(k)}


def redacted(options: Mapping[str, str]) -> dict[str, str]:
    """Options that may be shown: no password, in the URL neither."""
    hide = lambda v: re.sub(r"(?i)(password=)[^;&]*", r"\1***", re.sub(r"(//[^/:@]+:)[^@/]+@", r"\1***@", v))
    return {k: "***" if k == "password" else hide(v) for k, v in options.items()}


def read_database(
    spark: SparkSession, options: Mapping[str, str], table: str = "", query: str = "", partition: tuple[str, object, object, int] | None = None, parts: Sequence[str] = ()
) -> DataFrame:
    """A table or a query (which wins) over JDBC, in parallel with ``partition`` (column, low, high, parts of equal width) or ``parts`` (conditions, one a task: see database_parts)."""
    if not query and not table:
        raise ValueError("a table or a query is needed")
    if partition and parts:
        raise ValueError("give partition or parts, not both")
    if parts:
        return spark.read.jdbc(options["url"], f"({query}) q" if query else table, predicates=list(parts), properties={k: v for k, v in options.items() if k != "url"})
    reader = spark.read.format("jdbc").options(**options)
    if query and not partition:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", f"({query}) q" if query else table)
    if partition:
        name, low, high, parts = partition
        reader = reader.options(partitionColumn=name, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


#: Bins of each count that database_parts() asks for.
PART_BINS = 64


def database_parts(spark: SparkSession, options: Mapping[str, str], table: str, by: Sequence[str], parts: int) -> list[str]:
    """Conditions that cut a table (or a query in brackets, with an alias) into some ``parts`` of like row counts, for read_database().

    ``by`` are whole-number columns as the database spells them. The database
    counts rows in bins of the first; a bin that holds over a quarter of a part
    is counted again in finer bins, a single value that does is cut by the next
    column. Neighbouring bins are then joined up to a part's size. Each count
    returns PART_BINS rows, whatever the table's size. The conditions cover
    every row once, nulls and rows that come later too. An empty table is one part.
    """
    if parts < 1 or not by:
        raise ValueError("name a column and a part at least")
    ask = lambda sql: [tuple(r) for r in spark.read.format("jdbc").options(**options, query=sql).load().collect()]
    total = int(ask(f"SELECT count(*) AS n FROM {table}")[0][0])
    small = max(total / parts / 4, 1)

    def bins(where: str, c: str, low: int, high: int, n: int) -> list[tuple[int, int, int]]:
        """(least, largest, rows) of bins in order, none over ``small`` but single values."""
        if n <= small or low == high:
            return [(low, high, n)]
        width = (high - low) // PART_BINS + 1
        inner = f"SELECT {c} AS k, ({c} - ({low})) / {width} AS b FROM {table} WHERE {where} AND {c} BETWEEN {low} AND {high}"
        counted = sorted(tuple(map(int, r)) for r in ask(f"SELECT min(k) AS a, max(k) AS z, count(*) AS n FROM ({inner}) x GROUP BY b"))
        return [x for a, z, k in counted for x in bins(where, c, a, z, k)]

    def cells(where: str, columns: Sequence[str]) -> list[tuple[str, str, int | None, int | None, int]]:
        """(where, column, from, below, rows): ranges of the column among the rows of ``where``; None is open, no column means all of them."""
        c = columns[0]
        low, high, n, there = ask(f"SELECT min({c}) AS a, max({c}) AS b, count(*) AS n, count({c}) AS k FROM {table} WHERE {where}")[0]
        cut = lambda condition, k: cells(condition, columns[1:]) if k > small and len(columns) > 1 else [(condition, "", None, None, k)]
        out = cut(f"{where} AND {c} IS NULL", int(n - there))
        found = bins(where, c, int(low), int(high), int(there)) if there else []
        edges = [None, *[a for a, _, _ in found[1:]], None]
        for (a, z, k), start, stop in zip(found, edges, edges[1:], strict=False):
            if a == z and k > small and len(columns) > 1:
                out += [*cut(f"{where} AND {c} = {a}", k), (f"{where} AND {c} <> {a}", c, start, stop, 0)]  # the latter: rows that come later
            else:
                out.append((where, c, start, stop, k))
        return out if found else [*out, (f"{where} AND {c} IS NOT NULL", "", None, None, 0)]

    made: list[tuple[list[tuple[str, str, int | None, int | None]], int]] = []
    for where, c, start, stop, n in cells("1 = 1", list(by)):
        if made and made[-1][1] + n <= total / parts:
            held, before = made[-1]
            w, k, a, z = held[-1]
            joined = [*held[:-1], (w, k, a, stop)] if c and (w, k, z) == (where, c, start) else [*held, (where, c, start, stop)]
            made[-1] = (joined, before + n)
        else:
            made.append(([(where, c, start, stop)], n))

    def condition(where: str, c: str, start: int | None, stop: int | None) -> str:
        ends = ([f"{c} >= {start}"] if start is not None else []) + ([f"{c} < {stop}"] if stop is not None else [])
        return " AND ".join([where, *(ends or ([f"{c} IS NOT NULL"] if c else []))])

    return [" OR ".join(f"({condition(*x)})" for x in held) for held, _ in made]


@dataclass
class Dataset:
    df: DataFrame
    name: str
    origin: str
    notes: list[str] = field(default_factory=list)


class Catalog:
    """Named datasets, each a temporary view."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.datasets = spark, {}

    def register(self, name: str, df: DataFrame, origin: str = "") -> Dataset:
        if not TABLE.match(name):
            raise ValueError(f"not a dataset name: {name!r}")
        df.createOrReplaceTempView(name)
        self.datasets[name] = Dataset(df, name, origin)
        return self.datasets[name]

    def open_file(self, path: str, name: str | None = None, **reading) -> Dataset:
        stem = re.sub(r"\W+", "_", path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]).strip("_") or "table"
        own, k = name or (stem if TABLE.match(stem) else f"t_{stem}"), 1
        while name is None and own in self.datasets:
            k += 1
            own = f"{stem}_{k}"
        return self.register(own, read_file(self.spark, path, **reading), f"file {path}")

    def get(self, name: str) -> DataFrame:
        if name not in self.datasets:
            raise ValueError(f"no dataset {name!r}; there are: {', '.join(self.datasets)}")
        return self.datasets[name].df

    def describe(self, name: str) -> list[tuple[str, str]]:
        return self.get(name).dtypes

    def count_rows(self, name: str) -> int:
        return self.get(name).count()

    def page(self, name: str, key: Sequence[str], offset: int, limit: int) -> DataFrame:
        return page(self.get(name), key, offset, limit)

    def derive(self, source: str, columns: Sequence[str], name: str) -> Dataset:
        return self.register(name, derive(self.get(source), columns), f"{len(columns)} column(s) of {source}")


def page(df: DataFrame, key: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in the order of ``key``, which must tell rows apart for pages to be whole."""
    if not key:
        raise ValueError("a page needs a sort key")
    return df.orderBy(*[quoted(column(df, k)).asc_nulls_last() for k in key]).offset(offset).limit(limit)


def derive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A projection; all missing columns are named in the error."""
    if not columns:
        raise ValueError("name a column at least")
    if missing := [c for c in columns if c.lower() not in {x.lower() for x in df.columns}]:
        raise ValueError(f"no column {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return df.select(*[quoted(column(df, c)) for c in columns])


@dataclass
class WriteReport:
    """What every sink returns."""

    target: str = ""
    attempted: int = 0
    written: int = 0
    failed: int = 0
    skipped: int = 0
    dry_run: bool = False
    notes: list[str] = field(default_factory=list)
    failures: DataFrame | None = None


def _counted(df: DataFrame, target: str, dry_run: bool, write: Callable[[DataFrame], None]) -> WriteReport:
    if dry_run:
        n = df.count()
        return WriteReport(target, n, 0, 0, n, True, [f"dry run: {n:,} row(s) would be written to {target}"])
    seen = Observation()
    write(df.observe(seen, F.count("*").alias("rows")))
    return WriteReport(target, seen.get["rows"], seen.get["rows"])


def write_file(df: DataFrame, path: str, kind: str = "parquet", dry_run: bool = True) -> WriteReport:
    """CSV with a header, or Parquet; rows are counted by the write itself. A dry run counts and writes nothing."""
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unknown format {kind!r}: csv or parquet")
    return _counted(df, path, dry_run, lambda d: d.write.mode("overwrite").csv(path, header=True) if kind == "csv" else d.write.mode("overwrite").parquet(path))


def write_table(df: DataFrame, table: str, dry_run: bool = True) -> WriteReport:
    """Create or replace a named Spark table."""
    if not TABLE.match(table):
        raise ValueError(f"not a table name: {table!r}")
    return _counted(df, table, dry_run, lambda d: d.write.mode("overwrite").saveAsTable(table))


def write_chart(data, path: str) -> WriteReport:
    """Chart rows as CSV, with the notes beside them under ``path + ".notes"``."""
    report = write_file(data.df, path, "csv", dry_run=False)
    spark = data.df.sparkSession
    spark.createDataFrame([(k, n) for k, n in enumerate(data.notes)], "position int, note string").coalesce(1).write.mode("overwrite").csv(path.rstrip("/") + ".notes", header=True)
    report.notes = list(data.notes)
    return report
