"""Suggestions for field mappings, by the names of columns and by the values in them."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from loomwork.operators.nodes import column, quoted
from loomwork.scratch import discard, materialize, stored

LEAST_CONFIDENCE = 0.45
#: Weights of shared words, of similar spelling and of agreeing types (fixed values).
WEIGHTS = (0.5, 0.3, 0.2)
#: Targets are first matched at these confidences, from the top: by more shared words, and above the last one's by shared words alone. Room for rounding in bounds.
LEVELS, EPSILON = (0.75, 0.65, 0.51), 1e-9
#: Tokens at most that an order names one by one, the table they are looked up in, and pairs at most that are broadcast (2 MB).
HOT, SLOTS, BROADCAST = 1024, 4096, 100_000
#: Pairs for each name that two groups of like shape may make before an index is taken.
DIRECT = 8

#: Abbreviations of column names and what they stand for (fixed values).
ABBREVIATIONS = {
    "nm": "name", "clr": "color", "col": "color", "colour": "color", "qty": "quantity", "desc": "description", "descr": "description",
    "prod": "product", "cust": "customer", "cat": "category", "num": "number", "no": "number", "nbr": "number", "amt": "amount",
    "prc": "price", "px": "price", "cd": "code", "dt": "date", "tm": "time", "addr": "address", "tel": "phone", "img": "image",
    "pic": "image", "mfr": "manufacturer", "vend": "vendor", "sz": "size", "wt": "weight", "ht": "height", "len": "length",
    "pct": "percent", "avg": "average", "min": "minimum", "max": "maximum", "uom": "unit", "curr": "currency", "ccy": "currency",
    "lang": "language", "ctry": "country", "st": "state", "id": "identifier", "ref": "reference", "sku": "sku",
}

#: Families of types by the prefix of their names.
FAMILIES = {
    "numeric": r"(?i)^u?(tiny|small|big|huge)?int(eger|[0-9]+)?\b|^(byte|short|long|float|double|decimal|numeric|real)",
    "temporal": r"(?i)^(date|timestamp|time)",
    "text": r"(?i)^(varchar|text|string|char)",
}
#: Words inside a name: capitals before a capitalised word, a word with the capitals it begins with, capitals alone.
WORD_SHAPES = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]*[a-z0-9]+|[A-Z]+"


def _words(name):
    """The name's words in lower case, camel case and punctuation split, abbreviations written out."""
    words = F.transform(F.regexp_extract_all(name, F.lit(WORD_SHAPES), F.lit(0)), lambda w: F.lower(w))
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)))


def _family(kind):
    found = F.lit("unknown")
    for family, pattern in reversed(FAMILIES.items()):
        found = F.when(kind.rlike(pattern), family).otherwise(found)
    return found


@pandas_udf(StringType())
def _flat(names: pd.Series) -> pd.Series:
    return names.map(lambda s: re.sub(r"[\W_]", "", s.lower()))


@pandas_udf(DoubleType())
def _alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """How like the spellings are; -1 where their letters in any order say that it is less than ``least``."""

    def ratio(x: str, y: str, need: float) -> float:
        m = SequenceMatcher(None, x, y)
        return m.ratio() if m.quick_ratio() >= need else -1.0

    return pd.Series([ratio(*x) for x in zip(a, b, least, strict=True)], dtype="float64")


def _numbered(parts):
    """Each element with how often it came before, so that sets of these meet in as many elements as the multisets do."""
    return F.transform(parts, lambda x, i: F.concat(x, F.lit("\0"), F.size(F.filter(F.slice(parts, 1, i), lambda y: y == x)).cast("string")))


def _letters(flat):
    """The letters of a spelling, numbered."""
    return _numbered(F.when(F.char_length(flat) > 0, F.split(flat, "")).otherwise(F.array().cast("array<string>")))


def _pairs(flat):
    """Its pairs of neighbours, numbered; a single letter is one."""
    n = F.char_length(flat)
    return _numbered(F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(flat, i, F.lit(2)))).otherwise(F.array(flat)))


def _described(columns: DataFrame) -> DataFrame:
    """id, name, family, words, flat of each distinct column; names that differ in type stay apart."""
    held = columns.filter("name is not null").select("name", _family(F.coalesce("type", F.lit(""))).alias("family")).distinct()
    return held.select(F.monotonically_increasing_id().alias("id"), "name", "family", _words(F.col("name")).alias("words"), _flat("name").alias("flat"))


def _hashed(tokens):
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _order(s: DataFrame, t: DataFrame, tokens) -> Callable:
    """Ranks of hashes: 0, but for the HOT tokens that would make most pairs of both sides meet, the worst last. A table of SLOTS is looked up; of hot tokens with one slot the worst is in it."""
    each = lambda df, n: df.select(F.explode(_hashed(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias(n))
    worst = each(s, "a").join(each(t, "b"), "token").orderBy(F.desc(F.col("a") * F.col("b")), "token").limit(HOT).collect()
    held = {r["token"] % SLOTS: (r["token"], len(worst) - k) for k, r in reversed(list(enumerate(worst)))}
    array = lambda k: F.split(F.lit(",".join(str(held.get(x, (0, 0))[k]) for x in range(SLOTS))), ",").cast("array<bigint>")
    hashes, ranks = array(0), array(1)

    def rank(x):
        slot = F.pmod(x, F.lit(SLOTS)).cast("int")
        return F.when(F.get(hashes, slot) == x, F.get(ranks, slot)).otherwise(F.lit(0).cast("bigint"))

    return rank


def _sorted(tokens, rank: Callable):
    """Hashes of a row's tokens, by an order that both sides share (any such order gives all pairs)."""
    return F.transform(F.array_sort(F.transform(_hashed(tokens), lambda x: F.struct(rank(x).alias("n"), x.alias("x")))), lambda p: p["x"])


def _sharing_words(s: DataFrame, t: DataFrame, level: float, rank: Callable) -> DataFrame:
    """(sid, tid) of all pairs with a common word whose confidence may be ``level``.

    j being the overlap needed when spelling and types agree in full, names of
    a and b words have k = ceil(j / (1 + j) * (a + b)) words in common at
    least; so one of each side's first a - k + 1 and b - k + 1 words is shared,
    and rows meet on it and on both sizes. Bounds are taken where they meet.
    """
    need = max(0.0, (level - WEIGHTS[1] - WEIGHTS[2]) / WEIGHTS[0] - EPSILON)
    common = lambda a, b: F.greatest(F.ceil(F.lit(need / (1 + need)) * (a + b) - EPSILON), F.lit(1)).cast("int")
    sizes = [[r[0] for r in x.select(F.size("words")).distinct().collect()] for x in (s, t)]
    sized = need / (1 + need) * sum(max(x, default=0) for x in sizes) > 1  # else one word will do at all sizes

    def keyed(df: DataFrame, k: str, others: list[int]) -> DataFrame:
        size = F.size("words")

        def first(other):
            n = F.when(common(size, other) <= F.least(size, other), size - common(size, other) + 1).otherwise(0)
            return F.transform(F.slice("ordered", 1, n), lambda x: F.xxhash64(x, size, other) if k == "s" else F.xxhash64(x, other, size))

        keys = F.flatten(F.transform(F.array(*[F.lit(x) for x in others]).cast("array<int>"), first)) if sized else F.col("ordered")
        rows = df.withColumn("ordered", _sorted("words", rank) if sized else _hashed("words"))
        return rows.select(F.col("id").alias(f"{k}id"), F.col("family").alias(f"{k}f"), F.col("flat").alias(f"{k}flat"), _hashed("words").alias(f"{k}w"), F.explode(keys).alias("key"))

    met = keyed(s, "s", sizes[1]).join(keyed(t, "t", sizes[0]), "key")
    shared = F.size(F.array_intersect("sw", "tw"))
    sure = WEIGHTS[0] * shared / (F.size("sw") + F.size("tw") - shared) + WEIGHTS[2] * _types("sf", "tf")
    return met.filter((sure + WEIGHTS[1] >= level - EPSILON) & (sure + WEIGHTS[1] * _by_edits("sflat", "tflat") >= level - EPSILON)).select("sid", "tid").distinct()


def _by_edits(a: str, b: str):
    """How like two spellings can be: k letters in common, in order, leave m + n - 2 * k to take out or put in, and no fewer edits will do."""
    letters = F.char_length(a) + F.char_length(b)
    return F.when(letters > 0, 1 - F.levenshtein(a, b) / letters).otherwise(1.0)


def _types(a: str, b: str):
    return F.when((F.col(a) == "unknown") | (F.col(b) == "unknown"), 0.5).when(F.col(a) == F.col(b), 1.0).otherwise(0.0)


def _meeting(a: DataFrame, b: DataFrame, ratio: float) -> DataFrame:
    """(sid, tid) of all pairs of (id, at, flat) with the same ``at`` whose spellings agree by ``ratio`` (over 2/3) at least.

    Of m and n letters such a pair has k >= ratio * (m + n) / 2 in common, in
    order, and m >= n * ratio / (2 - ratio). So k letters are shared, and at
    least 3 * k - m - n - 1 pairs of neighbours, as a letter left out takes two
    of its side's and one of the other's. One rare letter and one rare pair of
    both sides must be the same: rows meet on both at once.
    """
    length = F.char_length("flat")
    shortest = F.lit(2 / (2 - ratio)) * length  # m + n at least
    letters = F.ceil(F.lit(ratio / 2) * shortest - EPSILON)
    pairs = F.greatest(F.ceil(F.lit(1.5 * ratio - 1) * shortest - 1 - EPSILON), F.lit(1))
    by_letter, by_pair = (_order(a, b, tokens(F.col("flat"))) for tokens in (_letters, _pairs))

    def keyed(df: DataFrame, k: str) -> DataFrame:
        x, y = _sorted(_letters(F.col("flat")), by_letter), _sorted(_pairs(F.col("flat")), by_pair)
        rows = df.select("id", "at", length.alias("m"), F.when(length > 0, F.slice(x, 1, (length - letters + 1).cast("int"))).otherwise(F.array(F.lit(0))).alias("x"), F.slice(y, 1, (F.greatest(length - 1, F.lit(1)) - pairs + 1).cast("int")).alias("y"))
        return rows.select(F.col("id").alias(f"{k}id"), F.col("m").alias(f"{k}m"), "at", "y", F.explode("x").alias("x")).select(f"{k}id", f"{k}m", F.explode(F.transform("y", lambda p: F.xxhash64("at", "x", p))).alias("key"))

    near = 2 * F.least("sm", "tm") >= F.lit(ratio - EPSILON) * (F.col("sm") + F.col("tm"))
    return keyed(a, "s").join(keyed(b, "t"), "key").filter(near).select("sid", "tid").distinct()


def _sharing_spelling(s: DataFrame, t: DataFrame, ratio: float) -> DataFrame | None:
    """(sid, tid) of all pairs of one known family whose spellings may agree by ``ratio``; None if there are none.

    Names that differ in digits alone have one shape. What two names have in
    common their shapes have too, so shapes are compared first, and only names
    of shapes that may agree are looked at: catalogs of numbered names are a
    few shapes.
    """
    a, b = (x.filter("family != 'unknown'").select("id", "family", "flat", F.regexp_replace("flat", "[0-9]", "0").alias("shape")).withColumn("group", F.xxhash64("family", "shape")) for x in (s, t))
    shapes = [materialize(x.groupBy(F.col("group").alias("id"), F.xxhash64("family").alias("at"), F.col("shape").alias("flat")).agg(F.count("*").alias("n")), "shapes") for x in (a, b)]
    side = lambda df, k: df.select(F.col("id").alias(f"{k}id"), F.col("n").alias(f"{k}n"), _letters(F.col("flat")).alias(k))
    known = _meeting(*shapes, ratio).join(side(shapes[0], "s"), "sid").join(side(shapes[1], "t"), "tid")
    alike = 2 * F.size(F.array_intersect("s", "t")) >= F.lit(ratio - EPSILON) * (F.size("s") + F.size("t"))
    direct = F.col("sn") * F.col("tn") <= DIRECT * (F.col("sn") + F.col("tn"))
    held = materialize(known.filter(alike).groupBy("sid", "tid").agg(F.max(direct).alias("direct")), "shape-pairs")
    if held.isEmpty():
        return None
    names = lambda df, k: df.select(F.col("group").alias(f"{k}id"), "id", "flat")
    pairs = held.filter("direct").join(names(a, "s").withColumnRenamed("id", "x"), "sid").join(names(b, "t").withColumnRenamed("id", "y"), "tid").select(F.col("x").alias("sid"), F.col("y").alias("tid"))
    crowded = held.filter("NOT direct")
    if crowded.isEmpty():
        return pairs
    left = names(a, "s").join(crowded, "sid").select("id", F.col("tid").alias("at"), "flat")
    right = names(b, "t").join(crowded.select("tid").distinct(), "tid").select("id", F.col("tid").alias("at"), "flat")
    return pairs.unionByName(_meeting(left, right, ratio))


def suggest_by_name(sources: DataFrame, targets: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """source, target, confidence, shared for the best source of each target; inputs are (name, type) rows of a catalog.

    Weighs the Jaccard overlap of words, the similarity of spellings and the
    agreement of types (half a point where one is unknown). Of equal sources
    the first by name; null names are left out, repeated rows count once.

    Candidates come from indexes of rare words, letters and pairs of letters,
    which hold every pair that may reach ``least``; bounds from word overlap,
    types and edits leave few whose spellings are compared. Targets that have
    found a source at one of LEVELS don't look at weaker ones, so spellings
    without a common word are sought for those alone that no word has matched.
    Below a ``least`` of LEAST_CONFIDENCE there is no such index: refused.
    """
    if least < LEAST_CONFIDENCE:
        raise ValueError(f"a confidence of {LEAST_CONFIDENCE} at least")
    s, t = materialize(_described(sources), "sources"), materialize(_described(targets), "targets")
    rank = _order(s, t, F.col("words"))
    found = []
    for level in sorted({max(x, least) for x in (*LEVELS, least)}, reverse=True):
        pairs = _sharing_words(s, t, level, rank)
        if level <= WEIGHTS[1] + WEIGHTS[2]:  # spelling and types alone may do
            spelt = _sharing_spelling(s, t, (level - WEIGHTS[2]) / WEIGHTS[1])
            pairs = pairs if spelt is None else pairs.unionByName(spelt).distinct()
        found.append(_best(pairs, s, t, level))
        if level > least and not found[-1].isEmpty():
            t = materialize(t.join(found[-1].select(F.col("target").alias("name")), "name", "left_anti"), "targets")
    return reduce(DataFrame.unionByName, found).orderBy(F.desc("confidence"), "target")


def _best(pairs: DataFrame, s: DataFrame, t: DataFrame, level: float) -> DataFrame:
    """The best source of each target among candidate ``pairs``, at ``level`` or above."""
    pairs, where = stored(pairs, "pairs")
    side = lambda df, name, k: df.select(F.col("id").alias(f"{k}id"), F.col("name").alias(name), F.col("family").alias(f"{k}f"), F.col("words").alias(f"{k}w"), F.col("flat").alias(f"{k}flat"))
    known = side(s, "source", "s").join(F.broadcast(pairs) if pairs.count() <= BROADCAST else pairs, "sid").join(side(t, "target", "t"), "tid")
    union = F.size(F.array_union("sw", "tw"))
    jaccard = F.when(union > 0, F.size(F.array_intersect("sw", "tw")) / union).otherwise(0.0)
    known = known.withColumn("jaccard", jaccard).withColumn("types", _types("sf", "tf"))
    rest = WEIGHTS[0] * F.col("jaccard") + WEIGHTS[2] * F.col("types")
    bounded = known.filter(rest + WEIGHTS[1] * _by_edits("sflat", "tflat") >= level - EPSILON).withColumn("alike", _alike("sflat", "tflat", (level - EPSILON - rest) / WEIGHTS[1]))
    scored = bounded.filter("alike >= 0").withColumn("confidence", WEIGHTS[0] * F.col("jaccard") + WEIGHTS[1] * F.col("alike") + WEIGHTS[2] * F.col("types")).filter(F.col("confidence") >= level)
    shared = F.array_sort(F.array_intersect("sw", "tw"))
    order = Window.partitionBy("target").orderBy(F.desc("confidence"), "source", F.desc("types"))
    best = materialize(scored.withColumn("k", F.row_number().over(order)).filter("k = 1").select("source", "target", "confidence", shared.alias("shared")), "suggested")
    discard(s.sparkSession, where)
    return best


def _values(df: DataFrame, columns: list[str] | None) -> DataFrame:
    names = [column(df, c) for c in columns or df.columns]
    text = [F.struct(F.lit(c).alias("name"), F.lower(F.trim(quoted(c).cast("string"))).alias("value")) for c in names]
    return df.select(F.explode(F.array(*text)).alias("x")).select("x.name", "x.value").filter("value is not null and value != ''").distinct()


def suggest_by_values(source: DataFrame, target: DataFrame, source_columns: list[str] | None = None, target_columns: list[str] | None = None) -> DataFrame:
    """source, target, shared, confidence: values two columns have in common over the fewer distinct values of the two.

    All distinct values count, compared as trimmed lower-case text; pairs
    without a common value have no row. The work is one join on the value.
    """
    a, b = _values(source, source_columns), _values(target, target_columns)
    na, nb = a.groupBy(F.col("name").alias("source")).agg(F.count("*").alias("na")), b.groupBy(F.col("name").alias("target")).agg(F.count("*").alias("nb"))
    common = a.withColumnRenamed("name", "source").join(b.withColumnRenamed("name", "target"), "value").groupBy("source", "target").agg(F.count("*").alias("shared"))
    return common.join(na, "source").join(nb, "target").select("source", "target", "shared", (F.col("shared") / F.least("na", "nb")).alias("confidence"))
