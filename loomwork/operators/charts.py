"""Chart data: what a chart shows, as a DataFrame, with notes on what it leaves out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.nodes import column, quoted, sample
from loomwork.operators.ranks import quantiles, with_medians

SCALES = ("linear", "log")
#: A median is no aggregate expression: it comes from ranks.
AGGREGATES: dict[str, Callable[[Column], Column] | None] = {"sum": F.sum, "mean": F.avg, "median": None, "count": F.count, "min": F.min, "max": F.max}
#: Default limits of groups on an axis, of points, of box groups and of series (fixed values).
GROUPS, POINTS, BOXES, SERIES = 30, 5_000, 16, 8


@dataclass(frozen=True)
class Mark:
    """What a kind of chart takes: the columns it needs, whether it aggregates y by x, and how its y and title read."""

    needs: tuple[str, ...] = ("x", "y")
    grouped: bool = False
    y_text: str = "{y}"
    title: str = "{measure} by {x}{split}"


#: Kinds of charts (fixed names).
MARKS = {
    "bar": Mark(grouped=True, y_text="{agg} of {y}"),
    "line": Mark(grouped=True, y_text="{agg} of {y}"),
    "scatter": Mark(),
    "box": Mark(),
    "histogram": Mark(needs=("x",), y_text="rows", title="Distribution of {x}"),
}


@dataclass(frozen=True)
class ChartSpec:
    """A chart as a document: its fields are what is saved."""

    mark: str = "bar"
    x: str = ""
    y: str = ""
    color: str = ""
    agg: str = "sum"
    x_scale: str = "linear"
    y_scale: str = "linear"
    limit: int = GROUPS
    title: str = ""
    dataset: str = ""

    @classmethod
    def from_dict(cls, doc: Mapping) -> ChartSpec:
        return cls(**{k: v for k, v in doc.items() if k in cls.__dataclass_fields__})


#: Fields with a closed list of values.
CHOICES = {"mark": MARKS, "agg": AGGREGATES, "x_scale": SCALES, "y_scale": SCALES}


def counts_rows(spec: ChartSpec) -> bool:
    """Whether the chart's y is a number of rows, for which no column is needed."""
    return spec.agg == "count" and MARKS[spec.mark].grouped


def checked(spec: ChartSpec) -> ChartSpec:
    """The chart itself; ValueError with all that is wrong with it."""
    wrong = [f"{name} is {getattr(spec, name)!r}, not one of {', '.join(known)}" for name, known in CHOICES.items() if getattr(spec, name) not in known]
    if not wrong:
        missing = [c for c in MARKS[spec.mark].needs if not getattr(spec, c) and not (c == "y" and counts_rows(spec))]
        wrong = [f"a {spec.mark} chart needs a column for {c}" for c in missing] + ["limit is less than one"] * (spec.limit < 1)
    if wrong:
        raise ValueError("; ".join(wrong))
    return spec


def labels(spec: ChartSpec) -> tuple[str, str]:
    """(name of what y shows, title of the chart)."""
    kind = MARKS[spec.mark]
    measure = "rows" if counts_rows(spec) else kind.y_text.format(agg=spec.agg, y=spec.y)
    split = spec.color and f", split by {spec.color}"
    return measure, spec.title or kind.title.format(measure=measure, x=spec.x, split=split)


@dataclass
class ChartData:
    """``df`` is lazy; ``notes`` runs the counts it states, once, when it is read."""

    spec: ChartSpec
    df: DataFrame
    state: Callable[[], list[str]] = field(default=list)

    @cached_property
    def notes(self) -> list[str]:
        return self.state()


def aggregated(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """x, series, y of every group whose x is there."""
    x = quoted(column(df, spec.x))
    series = quoted(column(df, spec.color)).cast("string") if spec.color else F.lit(None).cast("string")
    if spec.agg == "median":
        held = df.filter(x.isNotNull()).select(x.alias("x"), series.alias("series"), quoted(column(df, spec.y)).cast("double").alias("v"))
        return with_medians(held.select("x", "series").distinct(), held, {"x": F.col("x"), "series": F.col("series")}, {"y": F.col("v")})
    y = F.count("*") if spec.agg == "count" and not spec.y else AGGREGATES[spec.agg](quoted(column(df, spec.y)))
    return df.filter(x.isNotNull()).groupBy(x.alias("x"), series.alias("series")).agg(y.cast("double").alias("y"))


def grouped_chart(df: DataFrame, spec: ChartSpec) -> ChartData:
    """bar: the groups of largest y; line: the first by x. On a log scale groups without a positive y are left out and counted."""
    groups = aggregated(df, spec)
    shown = groups.filter("y > 0") if spec.y_scale == "log" else groups
    order = [F.col("y").desc_nulls_last(), F.col("x"), F.col("series")] if spec.mark == "bar" else [F.col("x"), F.col("series")]
    if not spec.color or spec.mark == "bar":
        out = shown.orderBy(*order).limit(spec.limit)
    else:
        firsts = shown.select("x").distinct().orderBy("x").limit(spec.limit)
        out = shown.join(F.broadcast(firsts), "x").select("x", "series", "y").orderBy(*order)

    def state() -> list[str]:
        total, gone = groups.agg(F.count("*"), F.count_if(F.coalesce(F.col("y") <= 0, F.lit(True)))).first()
        log = spec.y_scale == "log"
        left = total - gone if log else total
        notes = [f"{gone} group(s) without a positive value are not on the log scale"] * bool(log and gone)
        if left > spec.limit and (spec.mark == "bar" or not spec.color):
            notes.append(f"top {spec.limit} of {left} groups, ranked by {labels(spec)[0]}" if spec.mark == "bar" else f"first {spec.limit} of {left} values of {spec.x}")
        return notes

    return ChartData(spec, out, state)


def _positive(rows: DataFrame, spec: ChartSpec, names: list[tuple[str, str]]) -> DataFrame:
    for name, scale in names:
        rows = rows.filter(F.col(name) > 0) if scale == "log" else rows
    return rows


def scatter(df: DataFrame, spec: ChartSpec, seed: int = 42) -> ChartData:
    """x, y, series rows; a seeded sample of at most 5,000, the same however the data are partitioned."""
    rows = df.select(quoted(column(df, spec.x)).cast("double").alias("x"), quoted(column(df, spec.y)).cast("double").alias("y"), (quoted(column(df, spec.color)).cast("string") if spec.color else F.lit(None).cast("string")).alias("series"))
    present = rows.filter("x is not null and y is not null")
    shown = _positive(present, spec, [("x", spec.x_scale), ("y", spec.y_scale)])

    def state() -> list[str]:
        bad = (F.col("x") <= 0) & (spec.x_scale == "log") | (F.col("y") <= 0) & (spec.y_scale == "log")
        total, gone = present.agg(F.count("*"), F.count_if(bad)).first()
        notes = [f"{gone} row(s) without a positive value are not on the log scale"] * bool(gone)
        return notes + [f"a sample of {POINTS:,} of {total - gone:,} points"] * (total - gone > POINTS)

    return ChartData(spec, sample(shown, POINTS, seed), state)


def box(df: DataFrame, spec: ChartSpec, accuracy: int | None = None) -> ChartData:
    """x, n, q0 to q4, whiskers and outliers of each group, over all rows; the 16 largest groups.

    Whiskers are the extreme values within 1.5 interquartile ranges of the
    quartiles, which are exact, by ranges of values; ``accuracy`` takes
    approximate ones.
    """
    rows = df.select(quoted(column(df, spec.x)).alias("x"), quoted(column(df, spec.y)).cast("double").alias("y")).filter("x is not null and y is not null")
    rows, places = _positive(rows, spec, [("y", spec.y_scale)]), (0.0, 0.25, 0.5, 0.75, 1.0)
    if accuracy:
        five = rows.groupBy("x").agg(F.count("*").alias("n"), *[F.percentile_approx("y", p, accuracy).alias(f"q{k}") for k, p in enumerate(places)])
    else:
        five = quantiles(rows, F.col("y"), places, [F.col("x")]).withColumnRenamed("k0", "x").drop("levels")
    largest = five.orderBy(F.desc("n"), "x").limit(BOXES)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("y") >= F.col("q1") - reach) & (F.col("y") <= F.col("q3") + reach)
    ends = rows.join(F.broadcast(largest), "x").groupBy("x").agg(F.min(F.when(inside, F.col("y"))).alias("low"), F.max(F.when(inside, F.col("y"))).alias("high"), F.count_if(~inside).alias("outliers"))
    out = largest.join(ends, "x").select("x", "n", "q0", "q1", "q2", "q3", "q4", "low", "high", "outliers").orderBy(F.desc("n"), "x")
    return ChartData(spec, out, lambda: [f"the {BOXES} largest of {total} groups" for total in [five.count()] if total > BOXES])


def histogram(df: DataFrame, spec: ChartSpec) -> ChartData:
    """bin, lo, hi, n over all rows: sqrt(n) bins of equal width, 8 to 40, empty ones included; one bin for a constant."""
    present = df.select(quoted(column(df, spec.x)).cast("double").alias("v")).filter("v is not null")
    shown = _positive(present, spec, [("v", spec.x_scale)])
    bounds = shown.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("total")).filter("total > 0")
    bounds = bounds.withColumn("bins", F.when(F.col("a") == F.col("b"), 1).otherwise(F.greatest(F.lit(8), F.least(F.lit(40), F.floor(F.sqrt("total"))))).cast("int"))
    width = (F.col("b") - F.col("a")) / F.col("bins")
    bin_ = F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("a")) / width), F.col("bins") - 1)).cast("int")
    counts = shown.crossJoin(F.broadcast(bounds)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = bounds.select("a", "b", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    lo = F.col("a") + F.col("bin") * width
    out = every.join(counts, "bin", "left").select("bin", lo.alias("lo"), F.when(F.col("bin") == F.col("bins") - 1, F.col("b")).otherwise(lo + width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("bin")

    def state() -> list[str]:
        gone = present.filter("v <= 0").count() if spec.x_scale == "log" else 0
        return [f"{gone} row(s) without a positive value are not on the log scale"] * bool(gone)

    return ChartData(spec, out, state)


def chart(df: DataFrame, spec: ChartSpec | Mapping) -> ChartData:
    spec = checked(spec if isinstance(spec, ChartSpec) else ChartSpec.from_dict(spec))
    return {"scatter": scatter, "box": box, "histogram": histogram}.get(spec.mark, grouped_chart)(df, spec)


def fold_series(data: DataFrame, most: int = SERIES, by: str = "y") -> DataFrame:
    """Series beyond the first ``most`` by first appearance become "Other"; a missing series stays missing.

    Rows are in order of falling y, then x, or with ``by="x"`` of x. A series
    first appears at the minimum of these, a grouped aggregate, and the
    ``most`` first series are kept: there may be any number of them.
    """
    if by not in ("x", "y"):
        raise ValueError(f"series are ordered by x or y, not {by!r}")
    place = F.struct(F.col("y").isNull().alias("none"), (-F.col("y")).alias("y"), F.col("x").alias("x")) if by == "y" else F.struct(F.col("x").alias("x"))
    first = data.filter("series is not null").groupBy("series").agg(F.min(place).alias("first"))
    kept = first.orderBy("first", "series").limit(most).select(F.col("series").alias("__kept"))
    out = data.join(F.broadcast(kept), F.col("series") == F.col("__kept"), "left")
    return out.withColumn("series", F.when(F.col("series").isNotNull() & F.col("__kept").isNull(), "Other").otherwise(F.col("series"))).select(*data.columns)


@dataclass
class Dashboard:
    """Charts in a grid of two columns; each names its dataset."""

    specs: list[ChartSpec] = field(default_factory=list)

    def add(self, spec: ChartSpec) -> tuple[int, int]:
        self.specs.append(checked(spec))
        return divmod(len(self.specs) - 1, 2)

    def needs(self) -> list[str]:
        return sorted({s.dataset for s in self.specs if s.dataset})

    def evaluate(self, datasets: Mapping[str, DataFrame]) -> list[ChartData]:
        if missing := [d for d in self.needs() if d not in datasets]:
            raise ValueError(f"datasets that are not open: {', '.join(missing)}")
        return [chart(datasets[s.dataset], s) for s in self.specs]
