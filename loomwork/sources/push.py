"""The offline half of row-wise HTTP writes: a plan of requests as a DataFrame, with each row that cannot be sent and why."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.nodes import column, quoted
from loomwork.sources.files import WriteReport

METHODS, MODES = ("POST", "PUT", "PATCH"), ("per_row", "batch")
MAX_ROWS, CHUNK = 1_000, 100


@dataclass(frozen=True)
class PushSpec:
    url_template: str
    method: str = "PUT"
    key_column: str = ""
    mode: str = "per_row"
    chunk: int = CHUNK
    max_rows: int = MAX_ROWS
    idempotency: bool = True
    post_acknowledged: bool = False

    def validate(self) -> None:
        if not re.match(r"(?i)https?://", self.url_template.strip()):
            raise ValueError("the URL template is an http(s) URL")
        if self.method.upper() not in METHODS:
            raise ValueError(f"unknown method {self.method!r}: {', '.join(METHODS)}")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}: {', '.join(MODES)}")
        if self.method.upper() in ("PUT", "PATCH") and (not self.key_column or "{" not in self.url_template):
            raise ValueError(f"{self.method} needs a key column and a URL that names the row, such as .../items/{{id}}")
        if self.method.upper() == "POST" and not self.post_acknowledged:
            raise ValueError("POST may create a row twice when a request is repeated; acknowledge it with post_acknowledged")
        if self.chunk < 1 or self.max_rows < 1:
            raise ValueError("chunk and max_rows are one at least")


def url_quoted(c: Column) -> Column:
    """Percent-encoding with no safe character but letters, digits and ``_.-~``."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def render_url(df: DataFrame, template: str) -> tuple[Column, str]:
    """(URL column, fault): every ``{column}`` filled with the row's quoted value, null where one is null; a fault names a placeholder without a column."""
    names = {c: c for c in df.columns}
    parts, at = [], 0
    for m in re.finditer(r"{([^{}]*)}", template):
        if m[1] not in names:
            return F.lit(None).cast("string"), f"the URL template names {m[1]!r}, which is no column"
        parts += [F.lit(template[at : m.start()]), url_quoted(quoted(m[1]).cast("string"))]
        at = m.end()
    if "{" in re.sub(r"{[^{}]*}", "", template) or "}" in re.sub(r"{[^{}]*}", "", template):
        return F.lit(None).cast("string"), "the URL template has a brace without its pair"
    return F.concat(*parts, F.lit(template[at:])), ""


def idempotency_key(body: Column) -> Column:
    """SHA-256 of the body: the same content has the same key in every run."""
    return F.sha2(body.cast("binary"), 256)


def push_plan(df: DataFrame, spec: PushSpec, order: Sequence[str], only_keys: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, WriteReport]:
    """(requests, failures, report) of writing ``df``; nothing is sent.

    Rows are taken in the order of ``order`` up to the cap. requests: request,
    url, body, idempotency_key, rows; failures: index, key, status, message,
    one for each row that cannot be sent.
    """
    spec.validate()
    report = WriteReport(spec.url_template, dry_run=True)
    key = column(df, spec.key_column) if spec.key_column and spec.key_column.lower() in {c.lower() for c in df.columns} else None
    rows = df
    if only_keys is not None:
        if key is None:
            raise ValueError("only_keys needs the key column")
        rows = df.filter(quoted(key).cast("string").isin(*map(str, only_keys)))
        report.notes.append(f"targeted run: rows with one of {len(set(map(str, only_keys)))} key(s)")
    total = rows.count()
    taken = rows.orderBy(*[quoted(column(df, c)) for c in order]).limit(spec.max_rows)
    if total > spec.max_rows:
        report.skipped = total - spec.max_rows
        report.notes.append(f"stopped at the cap of {spec.max_rows:,} rows: {report.skipped:,} were not attempted")
    # the cap bounds what is numbered here
    numbered = taken.withColumn("__i", F.row_number().over(Window.orderBy(*[quoted(column(df, c)) for c in order])) - 1)
    url, fault = render_url(df, spec.url_template) if spec.mode == "per_row" else (F.lit(spec.url_template), "")
    message = F.lit(fault) if fault else F.when(url.isNull(), "a value the URL needs is missing")
    if spec.key_column and key is None:
        message = F.coalesce(message, F.lit(f"no column {spec.key_column!r}"))
    held = numbered.select(F.col("__i").alias("index"), (quoted(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), url.alias("url"), F.to_json(F.struct(*map(quoted, df.columns))).alias("body"), message.alias("message"))
    failures = held.filter("message is not null").select("index", "key", F.lit(0).alias("status"), "message")
    good = held.filter("message is null")
    if spec.mode == "batch":
        chunks = good.groupBy(F.floor(F.col("index") / spec.chunk).alias("request"), "url").agg(F.array_sort(F.collect_list(F.struct("index", "body"))).alias("x"))  # ``chunk`` rows at most
        good = chunks.select("request", "url", F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["body"]), ","), F.lit("]")).alias("body"), F.size("x").alias("rows"))
    else:
        good = good.select(F.col("index").cast("long").alias("request"), "url", "body", F.lit(1).alias("rows"))
    keyed = spec.method.upper() == "POST" and spec.idempotency
    requests = good.withColumn("idempotency_key", idempotency_key(F.col("body")) if keyed else F.lit(None).cast("string"))
    report.attempted = min(total, spec.max_rows)
    report.failed = failures.count()
    report.skipped += report.attempted - report.failed
    report.failures = failures
    report.notes.append(f"dry run: {report.attempted:,} row(s) rehearsed, no request sent")
    return requests, failures, report


def write_failures(failures: DataFrame, path: str) -> None:
    """The failures table as CSV, for a targeted run of just these keys."""
    failures.write.mode("overwrite").csv(path, header=True)
