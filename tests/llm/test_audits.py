"""Source divergence, conversation repair and licence scans against plain versions and edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from loomwork.llm import conversations, divergence, licences, queries


def by_oracle(name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(table, df.toArrow())
    return sorted(map(repr, con.sql(queries.ORACLE_SQL[name]).fetchall())), [d[0] for d in con.sql(queries.ORACLE_SQL[name]).description]


def rows_of(df, names):
    return sorted(repr(tuple(r)) for r in df.select(*names).collect())


# Divergence


def plain_divergence(docs, least_docs, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for text, lang, source in docs]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs_of = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in terms:
        words = [w.translate(lower) for w in words]
        counts[lang, source].update(words)
        docs_of[lang].update(set(words))
    kept = {lang: sorted(t for t, n in docs_of[lang].items() if n >= least_docs) for lang, _, _ in terms}
    out = set()

    def shares(of, lang):
        n, v = sum(of[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (of[t] + 2) // (n + 2 * v) for t in kept[lang]}

    for lang, source in counts:
        p = shares(counts[lang, source], lang)
        whole = sum((counts[g] for g in counts if g[0] == lang), Counter())
        q = shares(whole, lang)
        pair = []
        for other_lang, other in counts:
            if other_lang == lang and other != source:
                r = shares(counts[lang, other], lang)
                pair.append((other, sum((p[t] - r[t]) ** 2 // (p[t] + r[t]) for t in kept[lang])))
        used = [(t, (p[t] - q[t]) ** 2 // (p[t] + q[t])) for t in kept[lang] if counts[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pair, None), ("term", used, top)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


DOCS = "doc_id long, text string, lang string, source string"


def made_docs(seed, n, sources):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}É" for k in range(60)]
    out = []
    for k in range(n):
        lang = rng.choice(["en", "de", None])
        body = " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randrange(40)))
        out.append((k, rng.choice([body, body.upper() + ",x1y", None if k % 9 == 0 else body]), lang, rng.choice([*sources, None])))
    return out


@pytest.mark.parametrize(("block", "tile"), [(1_024, 64), (7, 2)])
def test_divergence_is_that_of_all_terms(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD", 50)
    docs = [*made_docs(3, 150, [f"s{k}" for k in range(7)]), (900, "", "xx", "s1"), (901, "alone here", "xx", "s2"), (902, "huge " * 50_000, "de", "s1")]
    got = divergence.audit(spark.createDataFrame(docs, DOCS).repartition(5))
    assert {tuple(r) for r in got.collect()} == plain_divergence([d[1:] for d in docs], 10, 10)
    assert got.count() == len(set(got.collect()))


def test_divergence_equals_its_sql_and_takes_clashing_columns(spark):
    df = spark.createDataFrame(made_docs(8, 80, ["a", "b"]), DOCS)
    want, names = by_oracle("op11_divergence", documents=df)
    clash = df.selectExpr("*", "1 AS TEXT2", "'x' AS `index`", "2 AS total")
    assert rows_of(divergence.audit(clash), names) == want
    assert divergence.audit(df.limit(0)).count() == 0


# Conversations


def plain_repair(rows):
    """The cheapest (cost, audit, lines) of one conversation's rows, by looking at all costs level by level."""
    seen, marked = set(), []
    for role, text in rows:
        last = re.search(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    # All audits of least cost: a shortest path over (row, state), paths kept whole.
    best = {(0, "0"): (0, [("", ())])}
    for i in range(len(marked) + 1):
        for _ in range(3):  # inserts
            for state, to, word in (("0", "u", "user"), ("s", "u", "user"), ("a", "u", "user"), ("u", "a", "assistant")):
                if (i, state) in best:
                    cost, ways = best[i, state]
                    add(best, (i, to), cost + 3, [(a + "I", lines + ((word + ":"),)) for a, lines in ways])
        if i == len(marked):
            break
        role, text, fault = marked[i]
        for state in "0sua":
            if (i, state) not in best:
                continue
            cost, ways = best[i, state]
            add(best, (i + 1, state), cost + 4, [(a + "D", lines) for a, lines in ways])
            if fault in ("blank", "duplicate"):
                continue
            more, to = 3 * (fault == "truncated"), "a" if state == "u" else "u"
            if role[:1] == to:
                add(best, (i + 1, to), cost + more, [(a + "K", lines + (f"{role}:{text}",)) for a, lines in ways])
            if role[:1] == "s" and state == "0":
                add(best, (i + 1, "s"), cost + more, [(a + "K", lines + (f"{role}:{text}",)) for a, lines in ways])
            name = {"u": "user", "a": "assistant"}[to]
            add(best, (i + 1, to), cost + more + 3, [(a + "R", lines + (f"{name}:{text}",)) for a, lines in ways])
    ends = [best[len(marked), q] for q in "0a" if (len(marked), q) in best]
    least = min(c for c, _ in ends)
    audit, lines = min(w for c, ways in ends if c == least for w in ways)
    faults = Counter(f for _, _, f in marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    return faults["blank"], faults["duplicate"], faults["truncated"], illegal, least, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def add(best, key, cost, ways):
    if key not in best or cost < best[key][0]:
        best[key] = cost, ways
    elif cost == best[key][0]:
        best[key] = cost, sorted({*best[key][1], *ways})[:400]


def plain_audit(table):
    def fault(conv, turn):
        return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20

    held = {conv: [] for conv, *_ in table}
    for conv, turn, role, text in table:
        role, text, f = " " if role is None else role, " " if text is None else text, fault(conv, turn)
        if f:
            row = (turn, "user" if f == 4 else role, "" if f == 1 else re.sub(r"[.!?]", "", text) if f == 2 else text)
            held[conv] += [row] * (2 if f == 3 else 1)
    out = set()
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, _, _ in rows if t is not None}
        out.add((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *plain_repair([r[1:] for r in rows])))
    return out


TALK = "conv_id long, turn long, role string, text string"
FACTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def talks(seed, n, longest=9, roles=("user", "assistant", "system", "tool", "", None, "usher")):
    rng, out = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in rng.sample([*range(12), None], rng.randrange(1, longest)):
            out += [(conv, turn, rng.choice(roles), rng.choice(["Yes.", "No", "What? ", "", " \n", None, f"Say {rng.random()}!", "ü?"]))] * rng.choice([1, 1, 1, 2])
    return out


@pytest.mark.parametrize("unresolved", [10_000, 2])
def test_repairs_are_the_cheapest(spark, monkeypatch, unresolved):
    monkeypatch.setattr(conversations, "UNRESOLVED", unresolved)
    table = talks(5, 250)
    df = spark.createDataFrame(table, TALK).repartition(3)
    got = conversations.audited(df, conversations.damage(df))
    assert {tuple(r) for r in got.select(*FACTS).collect()} == plain_audit(table)


@pytest.mark.parametrize("roles", [("user", "assistant"), ("tool",), ("user", "tool", "system"), ("assistant",)])
def test_a_conversation_may_span_tasks(spark, monkeypatch, request, roles):
    """Two long conversations over as many tasks as there are, some of them with ties that stay open for long."""
    monkeypatch.setattr(conversations, "UNRESOLVED", 5)
    rng = random.Random(7)
    table = [(c, t, rng.choice(roles), rng.choice(["Good.", "Bad", "", f"No {t}."])) for c in (1, 2) for t in range(90)]
    df = spark.createDataFrame(table, TALK)
    rows = conversations.damage(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    found = conversations.search(conversations.faults(rows))
    assert found.filter("conv_id = 1").select("part").distinct().count() > 1
    got = conversations.audited(df, rows)
    assert {tuple(r) for r in got.select(*FACTS).collect()} == plain_audit(table)


def test_unresolved_ways_are_freed_once_survivors_agree():
    search, most = conversations.Search(conversations.NOTHING), 0
    for k in range(5_000):
        search.feed((k, "", b"", 1), "ua"[k % 2], "none")
        search.shared()
        most = max(most, search.unresolved)
    assert most <= 3
    freed = conversations.Node(None, None, "", "", "")
    branch = conversations.Node(freed, None, "", "K", "")
    branch.refs += 1
    conversations.release(branch)
    assert freed.refs == 0 and branch.parent is None


def test_repaired_rows_read_as_they_should(spark):
    df = spark.createDataFrame(talks(11, 80), TALK)
    rows = conversations.damage(df)
    held = defaultdict(list)
    for r in conversations.repair(rows).collect():
        held[r["conv_id"]].append((r["place"]["there"] is None, r["place"]["there"] or False, r["place"]["turn"] or 0, (r["place"]["role"] or "").encode(), bytes(r["place"]["digest"] or b""), r["place"]["part"], r["role"], r["text"]))
    want = {r["conv_id"]: r["repaired_sha256"] for r in conversations.audited(df, rows).collect()}
    for conv, digest in want.items():
        lines = sorted(held[conv])
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[6][:1] for x in lines))
        assert hashlib.sha256("\n".join(f"{x[6]}:{x[7]}" for x in lines).encode()).hexdigest() == digest


def test_conversations_equal_their_sql_and_edges(spark):
    df = spark.createDataFrame([t for t in talks(2, 60) if t[1] is not None], TALK)
    want, names = by_oracle("op12_conversation_repair", conversations=df)
    clash = df.selectExpr("*", "1 AS n", "'x' AS digest", "2 AS PART", "0 AS fault")
    assert rows_of(conversations.audited(clash, conversations.damage(clash)), names) == want
    assert conversations.audited(df.limit(0), conversations.damage(df.limit(0))).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "long " * 400_000 + "."), (1, 1, "assistant", "ok.")], TALK)
    got = conversations.audited(long, long).first()
    assert (got["audit"], got["cost"]) == ("KK", 0)


def test_equal_rows_of_a_hot_conversation_are_one(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.")] * 3_000 + [(1, 2, "assistant", "Yes.")] * 2, TALK)
    assert conversations.faults(df).count() == 2
    got = conversations.audited(df, df).first()
    assert (got["duplicate"], got["cost"], got["audit"]) == (3_000, 12_000, "K" + "D" * 2_999 + "KD")


# Licences


MIT = licences.TEMPLATES[7].text
EDITED = MIT.replace("free of charge,", "free of charge").replace("associated documentation files", "all associated documentation and test files").replace("merge, ", "")


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licences.scan(df).collect()}


def test_notices_are_found_where_they_stand(spark):
    filler = " ".join(f"word{k % 97}" for k in range(400))
    shuffled = MIT.split()
    random.Random(1).shuffle(shuffled)
    two = f"{filler} {licences.TEMPLATES[9].text} {filler} {MIT} {filler}"
    no_phrase = MIT.replace("Permission is hereby granted", "Rights are hereby given")
    got = scanned(spark, [MIT, f"{filler} {EDITED}", " ".join(shuffled), two, no_phrase, "Licensed under CC BY-NC 4.0. " * 3, None, "", "No licence at all.", "Licensed under the Apache License, Version 2.0."])
    assert [got[k]["labels"] for k in range(10)] == ["mit", "mit", "", "bsd-2-clause,mit", "", "cc-by,cc-by-nc-4.0", "", "", "", "apache,apache-2.0"]
    assert got[1]["score"] > 0.6 and got[2]["score"] < 0.6 and got[6]["score"] == 0
    assert (got[5]["n_base"], got[5]["first_word"], got[5]["last_word"], got[5]["base_labels"], got[5]["score"]) == (3, 2, 16, "cc-by", 1.0)
    assert (got[6]["n_words"], got[6]["first_word"]) == (0, None)


def test_licences_equal_their_sql(spark):
    rng, parts = random.Random(4), [t.text for t in licences.TEMPLATES]
    texts = [None, "", "CC BY", "mit license", "x" * 300_000, "gnu general public license " * 5]
    for _ in range(150):
        words = " ".join(rng.choices(parts, k=rng.randrange(1, 3))).split()
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(3)] = rng.choices(words, k=rng.randrange(3))
        texts.append(" ".join(rng.choices(["the", "of", "É", "no"], k=rng.randrange(30)) + words))
    df = spark.createDataFrame([(k % 140, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want, names = by_oracle("op13_licences", documents=df)
    clash = df.selectExpr("*", "1 AS TEXT2", "2 AS row", "'y' AS words", "3 AS base")
    assert rows_of(licences.scan(clash), names) == want
    assert licences.scan(df.limit(0)).count() == 0


def test_long_texts_take_linear_time(spark):
    import time

    t = time.time()
    got = scanned(spark, ["permission license mit cc by the apache license gnu software " * 60_000])
    assert got[0]["n_base"] == 2 * 60_000 and time.time() - t < 90
