"""Transforms, mappings with their loss counters, suggestions."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomwork.functions import transforms as tf
from loomwork.operators import mapping, suggest


@pytest.mark.parametrize(
    "key,args,value,want",
    [
        ("trim", {}, "\t", "\t"), ("trim", {}, "   kiln   ", "kiln"), ("upper", {}, "mixed Case 7", "MIXED CASE 7"), ("lower", {}, "QUARTZ", "quartz"), ("title", {}, "river OF stones", "River Of Stones"),
        ("truncate", {"length": 3}, "übergröße", "übe"), ("truncate", {"length": 9}, "short", "short"), ("prepend", {"text": "no. "}, "17", "no. 17"), ("prepend", {"text": "no. "}, None, None), ("append", {"text": " kg"}, "3.5", "3.5 kg"),
        ("replace", {"find": "--", "with": "/"}, "p--q--r", "p/q/r"), ("split_part", {"sep": ":", "index": 3}, "h:m:s", "s"), ("split_part", {"sep": ":", "index": 4}, "h:m:s", ""), ("regex_extract", {"pattern": "([0-9]+)x([0-9]+)", "group": 2}, "size 30x45 cm", "45"),
        ("regex_extract", {"pattern": "[0-9]"}, "none", ""), ("regex_replace", {"pattern": "([aeiou])", "with": r"<\1>"}, "tin", "t<i>n"), ("pad", {"length": 6, "char": "*"}, "781", "***781"),
        ("pad", {"length": 3, "char": "_", "side": "right"}, "z", "z__"), ("pad", {"length": 2, "char": "_", "side": "right"}, "zebra", "ze"), ("default", {"value": "missing"}, None, "missing"), ("default", {"value": "missing"}, " ", " "), ("round", {"places": 2}, "7.125", 7.13),
        ("round", {}, "seven", None), ("lookup", {"pairs": {"ja": "yes", "nej": "no"}}, "nej", "no"), ("lookup", {"pairs": {"ja": "yes"}}, "måske", "måske"), ("cast", {"type": "BIGINT"}, "-4.5", -5), ("cast", {"type": "BIGINT"}, "25e1", 250),
        ("cast", {"type": "BIGINT"}, "4 5", None), ("cast", {"type": "BOOLEAN"}, "false", False), ("parse_date", {"format": "%d/%m/%Y"}, "7/11/2019", dt.datetime(2019, 11, 7)),
        ("parse_date", {"format": "%H.%M on %Y-%m-%d"}, "23.59 on 1999-12-31", dt.datetime(1999, 12, 31, 23, 59)), ("parse_date", {"format": "%m"}, "May", None), ("date_format", {"format": "day %d of '%y at %M"}, "2031-02-03 14:25:36", "day 03 of '31 at 25"),
    ],
)
def test_transform(spark, key, args, value, want):
    got = spark.createDataFrame([(value,)], "v string").select(tf.apply(F.col("v"), key, args).alias("o")).first()["o"]
    assert got == want


def test_casts_from_numbers(spark):
    df = spark.createDataFrame([(2.5, 3.5)], "a double, b double")
    assert tuple(df.select(tf.apply(F.col("a"), "cast", {"type": "BIGINT"}, "double"), tf.apply(F.col("b"), "cast", {"type": "BIGINT"}, "double")).first()) == (2, 4)


@pytest.mark.parametrize(
    "key,args", [("nope", {}), ("truncate", {}), ("truncate", {"length": 0}), ("truncate", {"length": "a"}), ("trim", {"x": 1}), ("pad", {"length": 3, "char": ""}), ("regex_extract", {"pattern": "a", "group": 1}), ("cast", {"type": "BLOB"}), ("parse_date", {"format": "%Q"})]
)
def test_bad_arguments(key, args):
    with pytest.raises(ValueError):
        tf.checked_arguments(key, args)


@pytest.fixture(scope="module")
def catches(spark):
    return spark.createDataFrame([("Nordlys", "Tromsø", "f31/cod/410"), ("Havbris", None, "f7/ling/95")], "boat string, harbour string, lot string")


SCHEMA = [{"name": "vesselCode", "type": "VARCHAR", "required": True}, {"name": "landedBy", "type": "VARCHAR", "required": True}, {"name": "kilos", "type": "DECIMAL(9,2)"}]
FIELDS = [
    {"target": "landedBy", "sources": ["boat", "harbour"], "join_with": " @ "},
    {"target": "vesselCode", "sources": ["lot"], "steps": [{"key": "split_part", "args": {"sep": "/", "index": 1}}, {"key": "upper"}]},
]


def doc(**more):
    return mapping.MappingDoc.from_dict({"fields": FIELDS, "schema": SCHEMA, **more})


def test_policies(catches):
    null = mapping.apply_mapping(catches, doc(unmapped="null"))
    assert null.dtypes == [("vesselCode", "string"), ("landedBy", "string"), ("kilos", "decimal(9,2)")]
    assert sorted(map(tuple, null.collect())) == [("F31", "Nordlys @ Tromsø", None), ("F7", "Havbris", None)]
    assert mapping.apply_mapping(catches, doc()).columns == ["landedBy", "vesselCode"]
    extra = catches.withColumn("note", F.lit(1)).withColumn("VESSELCODE", F.lit(2))
    assert mapping.apply_mapping(extra, doc(unmapped="passthrough")).columns == ["note", "landedBy", "vesselCode"]
    assert mapping.MappingDoc.from_dict(doc().to_dict()) == doc()


@pytest.mark.parametrize(
    "change,text",
    [
        ({"unmapped": "keep"}, "policy"), ({"fields": FIELDS[:1]}, "required"), ({"fields": [*FIELDS, {"target": "VESSELCODE"}]}, "twice"), ({"fields": [*FIELDS, {"target": "other"}]}, "not in the schema"),
        ({"fields": [*FIELDS, {"target": "kilos", "sources": ["x"]}]}, "no source column x"), ({"fields": [*FIELDS, {"target": "kilos", "sources": ["boat"], "constant": "1"}]}, "constant"),
        ({"fields": [*FIELDS, {"target": "kilos", "type": "DECIMAL(1); drop"}]}, "unknown type"), ({"fields": [*FIELDS, {"target": "kilos", "steps": [{"key": "zap"}]}]}, "unknown transform"),
    ],
)
def test_validation(catches, change, text):
    with pytest.raises(ValueError, match=text):
        mapping.apply_mapping(catches, mapping.MappingDoc.from_dict({"fields": FIELDS, "schema": SCHEMA} | change))


def test_losses_are_counted_once_and_observed(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, None), ("2.6", "zz")], "n string, k string")
    d = mapping.MappingDoc.from_dict({"fields": [
        {"target": "n", "sources": ["n"], "type": "BIGINT"}, {"target": "k", "sources": ["k"], "steps": [{"key": "lookup", "args": {"pairs": [["a", "1"]]}}, {"key": "lookup", "args": {"pairs": [["b", "2"]]}}]},
        {"target": "twice", "sources": ["n"], "steps": [{"key": "cast", "args": {"type": "DOUBLE"}}, {"key": "cast", "args": {"type": "DATE"}}]},
        {"target": "e", "sources": ["n"], "steps": [{"key": "expression", "args": {"sql": "concat({value}, k)"}}]},
    ]})
    assert mapping.loss_counters(df, d).first().asDict() == {"n__lost": 1, "k__unmatched": 2, "k__unmatched_2": 2, "twice__lost_cast": 1, "twice__lost_cast_2": 2}
    out, seen = mapping.apply_observed(df, d)
    assert sorted(r["e"] or "" for r in out.collect()) == ["", "1a", "2.6zz", "xb"]
    assert seen.get["rows"] == 4 and seen.get["n__lost"] == 1
    assert mapping.preview(df, d, "N").filter("before = '2.6'").first()["after"] == 3


def test_crosswalks(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    walk = spark.createDataFrame([("a", "2", "x"), ("a", "1", "y"), (None, "9", "z")], "c string, v string, more string")
    d = mapping.MappingDoc.from_dict({"fields": [{"target": "k", "sources": ["k"], "steps": [{"key": "lookup", "args": {"file": "w"}}]}]})
    assert sorted(r["k"] or "" for r in mapping.apply_mapping(df, d, {"w": walk}).collect()) == ["", "1", "b"]
    assert mapping.loss_counters(df, d, {"w": walk}).first()["k__unmatched"] == 1
    assert [n.split(" ")[0] for n in mapping.crosswalk_notes(walk)] == ["1", "1"]
    with pytest.raises(ValueError, match="crosswalk"):
        mapping.apply_mapping(df, d)
    many = mapping.MappingDoc.from_dict({"fields": [{"target": "k", "sources": ["k"], "steps": [{"key": "lookup", "args": {"pairs": [[str(k), "v"] for k in range(60)] + [["1", "w"]]}}]}]})
    assert len(mapping.notes(many)) == 2


def test_suggestions_by_name(spark):
    source = spark.createDataFrame([("cust_addr", "string"), ("HTTPStatusCd", "usmallint"), ("payload", "binary")], "name string, type string")
    target = spark.createDataFrame([("customerAddress", "VARCHAR"), ("http-status", "UBIGINT"), ("w", "DATE")], "name string, type string")
    got = {r["target"]: (r["source"], round(r["confidence"], 3), r["shared"]) for r in suggest.suggest_by_name(source, target).collect()}
    assert got["customerAddress"] == ("cust_addr", round(0.5 + 0.3 * 2 * 8 / 23 + 0.2, 3), ["address", "customer"])
    assert got["http-status"][0] == "HTTPStatusCd" and got["http-status"][2] == ["http", "status"] and "w" not in got


def test_suggestions_are_those_of_all_pairs(spark):
    rnd = random.Random(11)
    words, kinds = ["cust", "customer", "id", "ship", "dt", "total", "tot", "line", "é", "a"], ["string", "int", "date", "binary", "double"]

    def made():
        if rnd.random() < 0.6:
            return rnd.choice(["_", "", "-"]).join(rnd.choices(words, k=rnd.randint(0, 4)))
        return "".join(rnd.choices("abcdeé1_", k=rnd.randint(1, 14)))

    sources = [(made(), rnd.choice(kinds)) for _ in range(150)]
    edited = [n[:k] + rnd.choice(["", "x", "7"]) + n[k + rnd.randint(0, 1) :] for n, _ in sources for k in [rnd.randint(0, len(n))]]
    targets = [(n, rnd.choice(kinds)) for n in edited + [made() for _ in range(50)]]
    frames = [spark.createDataFrame(x, "name string, type string") for x in (sources, targets)]
    plain = [df.select("name", suggest._words(F.col("name")).alias("w"), suggest._family(F.col("type")).alias("f")).collect() for df in frames]
    flat = lambda n: "".join(c for c in n.lower() if c.isalnum())
    want = {}
    for t in plain[1]:
        for s in plain[0]:
            jaccard = len(set(s.w) & set(t.w)) / len(set(s.w) | set(t.w)) if s.w or t.w else 0.0
            types = 0.5 if "unknown" in (s.f, t.f) else float(s.f == t.f)
            confidence = 0.5 * jaccard + 0.3 * SequenceMatcher(None, flat(s.name), flat(t.name)).ratio() + 0.2 * types
            if confidence >= 0.45:
                want[t.name] = min(want.get(t.name, (0.0, "")), (-confidence, s.name))
    got = {r["target"]: (-r["confidence"], r["source"]) for r in suggest.suggest_by_name(*frames).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-12 for k in want)


def test_numbered_names_do_not_all_meet(spark, monkeypatch):
    """Catalogs of numbered names: a few of the 120,000 pairs are compared, also for numbers that the other side does not have."""
    seen, best = [], suggest._best

    def spied(pairs, *rest):
        seen.append(pairs.distinct().count())
        return best(pairs, *rest)

    monkeypatch.setattr(suggest, "_best", spied)
    sources = spark.createDataFrame([(f"Customer#{k:09d}", "string") for k in range(400)], "name string, type string")
    targets = spark.createDataFrame([(f"Supplier#{k:09d}", "string") for k in range(250, 550)], "name string, type string")
    got = suggest.suggest_by_name(sources, targets).collect()
    assert sorted((r["source"], r["target"]) for r in got) == [(f"Customer#{k:09d}", f"Supplier#{k:09d}") for k in range(250, 400)]
    assert sum(seen) <= 600


@pytest.mark.parametrize("small", [False, True])
def test_numbered_names_of_like_spelling(spark, monkeypatch, small):
    """Names that share no word but most letters, in groups of one shape each, crowded or not, against all pairs; also with small tables."""
    if small:
        for name, n in {"HOT": 3, "SLOTS": 2, "BROADCAST": 0, "DIRECT": 0}.items():
            monkeypatch.setattr(suggest, name, n)
    rnd = random.Random(5)
    sources = [f"custmer{rnd.randrange(900):05d}" for _ in range(60)] + [f"shp{k}date" for k in range(4)] + ["ordertotal", "Big Red lid 7", "x", "7", ""]
    targets = [f"customr{rnd.randrange(900):05d}" for _ in range(50)] + ["shipdate1", "orderstotal", "Red lid 7", "big green lid 7", "X", "8", "__"]
    want = {}
    for t in targets:
        for x in sources:
            a, b = ("".join(c for c in n.lower() if c.isalnum()) for n in (x, t))
            v, w = (set(n.lower().replace("_", "").split()) for n in (x, t))
            confidence = 0.5 * (len(v & w) / len(v | w) if v | w else 0.0) + 0.3 * SequenceMatcher(None, a, b).ratio() + 0.2
            if confidence >= 0.45:
                want[t] = min(want.get(t, (0.0, "")), (-confidence, x))
    frames = [spark.createDataFrame([(n, "string") for n in x], "name string, type string") for x in (sources, targets)]
    got = {r["target"]: (-r["confidence"], r["source"]) for r in suggest.suggest_by_name(*frames).collect()}
    assert len(want) > 45 and got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-12 for k in want)


def test_suggestions_on_empty_catalogs_and_nulls(spark):
    some = spark.createDataFrame([("x_id", "int"), (None, "int"), ("x_id", "int"), ("y", None)], "name string, type string")
    assert suggest.suggest_by_name(some, some.limit(0)).collect() == [] == suggest.suggest_by_name(some.limit(0), some).collect()
    assert [(r["target"], r["source"], r["confidence"]) for r in suggest.suggest_by_name(some, some).collect()] == [("x_id", "x_id", 1.0), ("y", "y", 0.9)]
    with pytest.raises(ValueError):
        suggest.suggest_by_name(some, some, 0.2)


@pytest.mark.parametrize("name,words", [("HTTPStatusCd", ["http", "status", "code"]), ("a1B2", ["a1", "b2"]), ("XYZ", ["xyz"]), ("__x--y9Z", ["x", "y9", "z"]), ("qtyQTY", ["quantity"]), ("", []), ("éa", ["a"])])
def test_words_of_names(spark, name, words):
    assert spark.createDataFrame([(name,)], "n string").select(suggest._words(F.col("n"))).first()[0] == words


def test_families_of_types(spark):
    kinds = {"numeric": "TINYINT UTINYINT USMALLINT UINTEGER UBIGINT HUGEINT int bigint INT4 double DECIMAL(9,2) float real", "temporal": "DATE timestamp TIME timestamp_ntz", "text": "VARCHAR string char(3)", "unknown": "INTERVAL binary BOOLEAN struct<a:int> interesting"}
    df = spark.createDataFrame([(k, f) for f, ks in kinds.items() for k in ks.split()], "kind string, family string")
    assert df.filter(suggest._family(F.col("kind")) != F.col("family")).collect() == []


def test_suggestions_by_values(spark):
    a = spark.createDataFrame([("Cod",), ("ling ",), ("Hake",), ("tusk",), ("saithe",), (None,)], "species string")
    b = spark.createDataFrame([("cod", 1), ("LING", 2), ("perch", 3), ("", 4)], "fish string, n int")
    assert [(*tuple(r)[:3], round(r["confidence"], 6)) for r in suggest.suggest_by_values(a, b).collect()] == [("species", "fish", 2, round(2 / 3, 6))]
