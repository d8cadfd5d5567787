"""The scalar transforms of field mapping, each a closed function from a Column and checked arguments to a Column."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names a cast may take, and what they are in Spark (fixed values).
CAST_TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "DOUBLE": "double", "DECIMAL(18,4)": "decimal(18,4)", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}
#: Pairs of an inline lookup at most.
MAX_PAIRS = 50

#: strptime codes and Java patterns for reading: M and d also take one digit.
PARSE_CODES = {"Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "p": "a", "b": "MMM", "B": "MMMM", "j": "D", "f": "SSSSSS"}
#: And for writing.
FORMAT_CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "a": "E", "A": "EEEE", "b": "MMM", "B": "MMMM", "j": "DDD", "f": "SSSSSS"}


def java_pattern(form: str, codes: Mapping[str, str]) -> str:
    """A ``%``-format as a Java date pattern; text outside codes is quoted unless it is plain punctuation."""
    out, literal = [], ""

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append(literal if all(c in " -/:.," for c in literal) else "'" + literal.replace("'", "''") + "'")
        literal = ""

    for percent, code, plain in re.findall(r"(%)(.?)|([^%])", form, re.DOTALL):
        if not percent:
            literal += plain
        elif code == "%":
            literal += "%"
        elif code in codes:
            flush()
            out.append(codes[code])
        else:
            raise ValueError(f"unknown date code %{code}")
    flush()
    return "".join(out)


def try_cast(c: Column, kind: str, source: str = "string") -> Column:
    """A cast that gives null where it cannot. To a whole number text is rounded half away from zero, a double half to even."""
    if kind == "bigint" and source == "string":
        number = F.coalesce(c.try_cast("decimal(38,10)"), c.try_cast("double").try_cast("decimal(38,10)"))
        return F.round(number, 0).try_cast("bigint")
    if kind == "bigint" and source in ("double", "float"):
        return F.bround(c, 0).try_cast("bigint")
    if kind in ("date", "timestamp_ntz") and not source.startswith(("string", "date", "timestamp")):
        return c.cast("string").try_cast(kind)  # numbers and booleans are no dates
    if source.startswith(("date", "timestamp")) and not kind.startswith(("string", "date", "timestamp")):
        return c.cast("string").try_cast(kind)
    return c.try_cast(kind)


def groups_in(pattern: str) -> int:
    """Capturing groups of a regular expression."""
    return re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", pattern)).groups


@dataclass(frozen=True)
class Argument:
    name: str
    kind: type = str
    default: Any = None
    required: bool = True
    least: int | None = None
    most: int | None = None
    choices: tuple[str, ...] = ()

    def checked(self, value: Any, transform: str) -> Any:
        if value is None:
            if self.required and self.default is None:
                raise ValueError(f"{transform} needs {self.name}")
            return self.default
        if self.kind is int:
            if isinstance(value, bool) or not re.fullmatch(r"[+-]?\d+", str(value).strip()):
                raise ValueError(f"{transform}: {self.name} is a whole number, not {value!r}")
            value = int(value)
            if self.least is not None and value < self.least or self.most is not None and value > self.most:
                raise ValueError(f"{transform}: {self.name} is out of range: {value}")
            return value
        if self.kind is str and not isinstance(value, str):
            raise ValueError(f"{transform}: {self.name} is text, not {value!r}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{transform}: {self.name} is one of {', '.join(self.choices)}")
        return value


@dataclass(frozen=True)
class Transform:
    key: str
    build: Callable[[Column, dict[str, Any], str], Column]
    arguments: tuple[Argument, ...] = ()
    lossy: bool = False
    result: str | None = "string"  # type it gives; None: that of its input
    check: Callable[[dict[str, Any]], None] = field(default=lambda a: None)


def _text(c: Column, source: str) -> Column:
    return c if source == "string" else c.cast("string")


def _check_group(a: dict[str, Any]) -> None:
    if a["group"] > groups_in(a["pattern"]):
        raise ValueError(f"regex_extract: the pattern has {groups_in(a['pattern'])} group(s), not {a['group']}")


def _java_replacement(text: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", r"\$"))


def _check_replace(a: dict[str, Any]) -> None:
    groups_in(a["pattern"])


def pairs_of(raw: Any) -> tuple[list[tuple[str, str]], int, int]:
    """(pairs with the first of equal keys, how many were repeated, how many beyond the limit)."""
    pairs = list(raw.items()) if isinstance(raw, Mapping) else [tuple(p) for p in raw or []]
    held: dict[str, str] = {}
    for k, v in pairs:
        held.setdefault(str(k), str(v))
    repeated = len(pairs) - len(held)
    return list(held.items())[:MAX_PAIRS], repeated, max(0, len(held) - MAX_PAIRS)


def lookup_hit(c: Column, pairs: list[tuple[str, str]], source: str = "string") -> Column:
    """The mapped value, null where there is none."""
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), _text(c, source))


def _check_date(codes: Mapping[str, str]) -> Callable[[dict[str, Any]], None]:
    return lambda a: java_pattern(a["format"], codes) and None


def _expression(c: Column, a: dict[str, Any], source: str) -> Column:
    raise ValueError("an expression refers to a column of a frame: use it in a mapping")


def _check_pad(a: dict[str, Any]) -> None:
    if not a["char"]:
        raise ValueError("pad: char is empty")


TRANSFORMS: dict[str, Transform] = {
    t.key: t
    for t in (
        Transform("trim", lambda c, a, s: F.trim(_text(c, s))),
        Transform("upper", lambda c, a, s: F.upper(_text(c, s))),
        Transform("lower", lambda c, a, s: F.lower(_text(c, s))),
        Transform("title", lambda c, a, s: F.initcap(_text(c, s))),
        Transform("truncate", lambda c, a, s: F.substring(_text(c, s), 1, a["length"]), (Argument("length", int, least=1),)),
        Transform("prepend", lambda c, a, s: F.concat(F.lit(a["text"]), _text(c, s)), (Argument("text"),)),
        Transform("append", lambda c, a, s: F.concat(_text(c, s), F.lit(a["text"])), (Argument("text"),)),
        Transform("replace", lambda c, a, s: F.replace(_text(c, s), F.lit(a["find"]), F.lit(a["with"])), (Argument("find"), Argument("with", default="", required=False))),
        Transform("split_part", lambda c, a, s: F.split_part(_text(c, s), F.lit(a["sep"]), F.lit(a["index"])), (Argument("sep"), Argument("index", int, least=1))),
        Transform("regex_extract", lambda c, a, s: F.regexp_extract(_text(c, s), a["pattern"], a["group"]), (Argument("pattern"), Argument("group", int, default=0, required=False, least=0)), check=_check_group),
        Transform("regex_replace", lambda c, a, s: F.regexp_replace(_text(c, s), F.lit(a["pattern"]), F.lit(_java_replacement(a["with"]))), (Argument("pattern"), Argument("with", default="", required=False)), check=_check_replace),
        Transform("pad", lambda c, a, s: (F.rpad if a["side"] == "right" else F.lpad)(_text(c, s), a["length"], a["char"]), (Argument("length", int, least=1), Argument("char", default=" ", required=False), Argument("side", default="left", required=False, choices=("left", "right"))), check=_check_pad),
        Transform("default", lambda c, a, s: F.coalesce(c, F.lit(a["value"]) if s == "string" else F.lit(a["value"]).try_cast(s)), (Argument("value"),), result=None),
        Transform("round", lambda c, a, s: F.round(c.try_cast("double"), a["places"]), (Argument("places", int, default=0, required=False, least=0, most=12),), lossy=True, result="double"),
        Transform("lookup", lambda c, a, s: F.coalesce(lookup_hit(c, pairs_of(a["pairs"])[0], s), _text(c, s)), (Argument("pairs", object, required=False), Argument("file", required=False))),
        Transform("cast", lambda c, a, s: try_cast(c, CAST_TYPES[a["type"]], s), (Argument("type", choices=tuple(CAST_TYPES)),), lossy=True, result="cast"),
        Transform("parse_date", lambda c, a, s: F.try_to_timestamp(_text(c, s), F.lit(java_pattern(a["format"], PARSE_CODES))).cast("timestamp_ntz"), (Argument("format"),), lossy=True, result="timestamp_ntz", check=_check_date(PARSE_CODES)),
        Transform("date_format", lambda c, a, s: F.date_format(c.try_cast("timestamp_ntz"), java_pattern(a["format"], FORMAT_CODES)), (Argument("format"),), lossy=True, check=_check_date(FORMAT_CODES)),
        Transform("expression", _expression, (Argument("sql"),), result=None),
    )
}


def checked_arguments(key: str, given: Mapping[str, Any] | None) -> dict[str, Any]:
    """The transform's arguments, checked and completed; ValueError names what is wrong."""
    if key not in TRANSFORMS:
        raise ValueError(f"unknown transform {key!r}; there are: {', '.join(TRANSFORMS)}")
    t, given = TRANSFORMS[key], dict(given or {})
    if extra := set(given) - {a.name for a in t.arguments}:
        raise ValueError(f"{key} does not take {', '.join(sorted(extra))}")
    found = {a.name: a.checked(given.get(a.name), key) for a in t.arguments}
    t.check(found)
    return found


def result_type(key: str, arguments: dict[str, Any], source: str) -> str:
    t = TRANSFORMS[key]
    return source if t.result is None else CAST_TYPES[arguments["type"]] if t.result == "cast" else t.result


def apply(c: Column, key: str, given: Mapping[str, Any] | None = None, source: str = "string") -> Column:
    """One transform on a column of type ``source`` (not ``expression``, which needs the column's place in a frame)."""
    return TRANSFORMS[key].build(c, checked_arguments(key, given), source)
