"""Brute-force versions, round trips and edge cases of the training-data operators."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import bpe, components, decontaminate, gam, hmm, queries, rules, simhash, text_stats, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def random_texts(n, seed=1, words=40, vocabulary=300):
    rng = random.Random(seed)
    v = ["".join(rng.choice("abcdefghijäß") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(v) if rng.random() < 0.9 else rng.choice(v).capitalize() + "." for _ in range(rng.randint(0, words))) for _ in range(n)]


EDGE_TEXTS = [None, "", " ", "\n\n\t", "one", "one two", "a b c", "a b c a b c", "\u00a0x\u2003y", "\U0001f600 é\u0085z", "A" * 5000, "na " * 3000]


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- components -------------------------------------------------------------


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(random.Random(k).randrange(120), random.Random(-k - 1).randrange(120)) for k in range(90)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components([(u, v) for u, v in edges if u != v])
    assert got == want


def test_components_take_strings_and_nulls(spark):
    rows = components.connected_components(spark.createDataFrame([("b", "a"), ("b", "c"), (None, "z"), ("y", None)], "u string, v string")).collect()
    assert sorted(map(tuple, rows)) == [("a", "a"), ("b", "a"), ("c", "a")]


# --- simhash ----------------------------------------------------------------


def brute_print(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, prints, radius):
    n = len(prints)
    found = brute_components([(i, j) for i in range(n) for j in range(n) if (prints[i] ^ prints[j]).bit_count() <= radius])
    least = {}
    for k, r in found.items():
        if ids[k] is not None:
            least[r] = min(least.get(r, ids[k]), ids[k])
    return [least.get(found[k]) for k in range(n)]


def test_simhash_against_all_pairs(spark):
    texts = random_texts(60, words=120) + EDGE_TEXTS
    texts += [t + " extra" for t in texts[:15]] + texts[3:9]
    ids = [*range(100, 100 + len(texts) - 3), 7, 7, None]
    got = sorted(map(tuple, simhash.near_duplicates(documents(spark, texts, ids)).collect()), key=repr)
    prints = [brute_print(t) for t in texts]
    want = zip(ids, [f"{p:016x}" for p in prints], brute_classes(ids, prints, 2), strict=True)
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("bucket_pairs", [1 << 22, 3])
def test_links_with_and_without_hot_buckets(spark, radius, bucket_pairs):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:20]:
        for _ in range(4):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)], "fp long, id long")
    got = {r["fp"] % (1 << 64): r["component_id"] for r in simhash.components_of(df, radius, bucket_pairs).collect()}
    assert [got[p] for p in prints] == brute_classes(range(len(prints)), prints, radius)


def test_thresholds_follow_the_generalised_pigeonhole():
    rng = random.Random(3)
    for m, radius in itertools.product((2, 3, 4), (0, 1, 2, 3)):
        costs = [[0.0] + sorted(rng.random() for _ in range(radius + 1)) for _ in range(m)]
        cost, t = simhash.allocate(costs, radius)
        brute = min(sum(c[x + 1] for c, x in zip(costs, pick, strict=True)) for pick in itertools.product(range(-1, radius + 1), repeat=m) if sum(pick) == radius - m + 1)
        assert sum(t) == radius - m + 1 and math.isclose(cost, brute)


def test_keep_one_row_of_each_group(spark):
    texts = ["x y z w"] * 3 + ["p q r s t u"] + [None, ""]
    docs = documents(spark, texts, [5, 5, None, 9, None, None]).withColumn("row", F.lit(1)).withColumn("fp", F.lit("a")).withColumn("COMPONENT_ID", F.lit(0))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 5), (False, 9), (True, 0)]
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# --- rules and text statistics ----------------------------------------------


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_text_stats_against_brute_force(spark):
    texts = EDGE_TEXTS + random_texts(40, vocabulary=6) + ["a\nb\na\n\n\na b\n", "# * $ % & | < >", "x y z\r\nx y z\r\n"]
    for t in texts:
        assert text_stats.stats_of((t or "").encode()) == brute_stats(t)
    got = documents(spark, texts).select("doc_id", text_stats.text_stats(F.col("text")).alias("s")).orderBy("doc_id").select("s.*").collect()
    assert [tuple(r) for r in got] == [brute_stats(t) for t in texts]


def test_repeated_words_numbers_long_texts_anew():
    ids = np.random.default_rng(0).integers(0, 50, 400)
    for width in (2, 3, 5, 12):
        words = [b"%d" % i for i in ids]
        windows = Counter(tuple(words[k : k + width]) for k in range(len(words) - width + 1))
        want = len({k + j for k in range(len(words) - width + 1) for j in range(width) if windows[tuple(words[k : k + width])] > 1})
        assert text_stats.repeated_words(text_stats.word_ids(words), width) == want


def labelled(spark, n=240):
    good = [t + " ." for t in random_texts(n, seed=5, words=160, vocabulary=2000)]
    texts = [f"# $ {t.replace(' ', '# ')} %" if k % 4 == 0 else t for k, t in enumerate(good)]
    return documents(spark, texts), spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(n)], "doc_id long, quality int, toxic int")


def test_rules_find_the_planted_rule(spark):
    docs, labels = labelled(spark)
    learned = rules.fit(docs, labels)
    assert learned and learned[0].precision >= 0.9
    rows = rules.judge(docs, learned).collect()
    for r in rows:
        words, chars, symbols, dup, repeat = brute_stats(docs.filter(F.col("doc_id") == r["doc_id"]).first()["text"]) if r["doc_id"] < 8 else (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (words, chars, symbols, dup, repeat)
        assert r["base_failed"] == (words < 50 or 100 * repeat > 50 * words)
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)
        if not r["base_failed"]:
            assert (r["rule"] is not None) == (r["doc_id"] % 4 == 0)
    kept = rules.keep_good(docs.withColumn("rule", F.lit(1)).withColumn("S", F.lit(1)), learned)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])


def test_grown_and_pruned_literals_are_the_best_of_all():
    rng = np.random.default_rng(3)
    for seed in range(6):
        x = {"a": rng.integers(0, 6, 60).astype(float), "b": rng.random(60).round(1), "c": np.zeros(60)}
        bad = (x["a"] > 3) & (x["b"] < 0.5) ^ (rng.random(60) < 0.1)
        grown = rules._grow(x, bad, 4)
        inside = np.ones(60, bool)
        for literal in grown:
            # every threshold between two values, either way, scored by p * (log2 of the precision after - that before)
            best, before = 0.0, math.log2(bad[inside].mean())
            for values in x.values():
                for low, high in itertools.pairwise(sorted(set(values[inside]))):
                    for side in (values > (low + high) / 2, values <= (low + high) / 2):
                        both = inside & side
                        if bad[both].any():
                            best = max(best, bad[both].sum() * (math.log2(bad[both].mean()) - before))
            now = inside & literal.holds(x)
            assert best > 0 and math.isclose(bad[now].sum() * (math.log2(bad[now].mean()) - before), best)
            inside = now
        assert grown
        y, worse = {k: v[::-1] for k, v in x.items()}, bad[::-1]
        worth = []
        for k in range(1, len(grown) + 1):
            held = np.logical_and.reduce([g.holds(y) for g in grown[:k]])
            worth.append((2 * worse[held].sum() - held.sum()) / held.sum() if held.any() else -1.0)
        assert len(rules._prune(grown, y, worse)) == 1 + int(np.argmax(np.round(worth, 12)))


def test_rules_judge_every_count_of_awkward_documents(spark):
    texts = EDGE_TEXTS + random_texts(20, seed=12, words=120, vocabulary=9)
    docs = documents(spark, texts).withColumn("N_WORDS", F.lit("x")).withColumn("kept", F.lit(1))
    for r in rules.judge(docs, []).collect():
        n, chars, symbols, dup, repeat = brute_stats(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["kept"] == (not (n < 50 or 100 * repeat > 50 * n))


def test_decision_list_agrees_with_its_spark_form(spark):
    docs, labels = labelled(spark)
    learned = rules.fit(docs, labels)
    rows = rules.judge(docs, learned).collect()
    x = {n: np.array([eval(e, {"greatest": max, "double": float}, r.asDict()) for r in rows], float) for n, e in rules.MEASURES.items()}
    first = np.full(len(rows), -1)
    for k in reversed(range(len(learned))):
        first[learned[k].holds(x)] = k
    assert [-1 if r["rule"] is None else r["rule"] for r in rows] == first.tolist()


def test_rules_of_nothing(spark):
    docs, labels = labelled(spark, 12)
    assert rules.fit(docs.limit(0), labels) == [] and rules.fit(docs, labels.limit(0)) == []
    assert rules.judge(docs.limit(0), []).count() == 0
    nulls = spark.createDataFrame([(None, 1, 0), (3, None, 0), (3, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert rules.fit(docs.union(docs), nulls) == []
    assert [r["kept"] for r in rules.judge(documents(spark, [None, ""], [None, None]), []).collect()] == [False, False]


# --- quality classifier -----------------------------------------------------


def test_gam_held_out_accuracy_and_folds(spark):
    docs, labels = labelled(spark, 300)
    model = gam.fit(docs, labels)
    rows = gam.classify(docs, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.9
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("quality", F.when(gam.learning_fold(), F.col("quality")).otherwise(1 - F.col("quality")))
    assert np.array_equal(gam.fit(docs, flipped).tables[2], model.tables[2])


def brute_features(text):
    words = WORD.findall(text)
    n, data = max(len(words), 1), text.encode()
    of = lambda chars: sum(c in chars for c in text)
    blank = sum(c in " \t\n\v\f\r" for c in text)
    digits, capitals, small = of("0123456789"), sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    _, chars, _, dup, repeat = brute_stats(text)
    return [
        math.log(1 + len(words)), chars / n, of("#*$%&<>@^~_=+\\{}[]") / n, digits / n, capitals / n, of(".,;:!?'\"-()/") / n, of("|") / n, (sum("!" <= c <= "~" for c in text) - digits - capitals - small) / n,
        sum(b >= 128 for b in data) / max(len(data), 1), dup / n, repeat / n, len(set(words)) / n, sum(a == b for a, b in itertools.pairwise(words)) / n, n / (text.count("\n") + 1),
        math.log(1 + max((len(w.encode()) for w in words), default=0)), blank / n,
    ]


def test_gam_features_against_plain_counts(spark):
    texts = [t or "" for t in EDGE_TEXTS] + random_texts(30, seed=7) + ["#a$ | B|9\n.b.\n.b.\n", "".join(map(chr, range(1, 300))), "x y x y x y\v\f"]
    for t in texts:
        assert np.allclose(gam.features_of(t.encode()), brute_features(t), atol=1e-12), t
    got = documents(spark, texts).select("doc_id", gam.text_features(F.col("text")).alias("x")).orderBy("doc_id").collect()
    assert np.allclose([r["x"] for r in got], [brute_features(t) for t in texts])


def test_gam_finds_an_interaction_no_single_feature_shows():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.train(x, y)
    test = rng.random((1000, 3))
    assert (0, 1) in model.pairs
    assert np.mean((model.score(test) >= 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))) > 0.95
    lookup = sum((t[model.bins(test)[:, k]] for k, t in enumerate(model.tables)), np.full(1000, model.intercept))
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        lookup = lookup + t[model.bins(test)[:, i], model.bins(test)[:, j]]
    assert np.allclose(lookup, model.margin(test))


def test_gam_edges(spark):
    docs, labels = labelled(spark, 30)
    model = gam.fit(docs, labels.limit(0))
    rows = gam.classify(documents(spark, EDGE_TEXTS).withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == len(EDGE_TEXTS) and {r["score"] for r in rows} == {0.5}
    assert gam.classify(docs.limit(0), model).count() == 0
    kept = gam.keep_good(docs.withColumn("s", F.lit(1)).withColumn("SCORE", F.lit(2)), model)
    assert kept.count() == 30 and kept.columns[-2:] == ["s", "SCORE"]
    assert all(math.isfinite(v) for t in EDGE_TEXTS for v in gam.features_of((t or "").encode()))


# --- decontamination --------------------------------------------------------


def brute_hits(text, items, width=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            g = w[k : k + width]
            for at in range(len(words) - len(g) + 1):
                if words[at : at + len(g)] == g:
                    hit.update(range(at, at + len(g)))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontamination_against_brute_force(spark, block):
    items = [(k, t) for k, t in enumerate(random_texts(12, seed=9, words=30))] + [(40, "Short one"), (41, ""), (42, None), (43, "x!"), (44, "Short one"), (None, "No name here"), (None, None), (43, "x!")]
    texts = EDGE_TEXTS + random_texts(20, seed=4, words=50)
    texts += [f"{a} ... {b.upper() if b else ''} {a}" for a, b in zip(random_texts(12, seed=8, words=200), [t for _, t in items[:12]], strict=True)]
    texts += ["short -- ONE two", "shortone", "x x x", "one short one short one", "no NAME, here! short one"]
    docs = documents(spark, texts).withColumn("N_HIT", F.lit("x"))
    got = decontaminate.scan(docs, spark.createDataFrame(items, "item_id long, text string"), most=block).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert tuple(r)[1:] == brute_hits(t, items), t


def test_decontamination_agrees_with_its_sql_on_null_ids(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(6)]
    items = [(None if k % 3 == 0 else k // 2, None if k == 5 else " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 14])))) for k in range(12)] + [(None, "nobody's words")]
    docs = documents(spark, [None, "", "Nobody s words"] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(30)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.withColumn("item_id", F.col("item_id").cast("string")).toPandas())
    got = sorted(map(tuple, decontaminate.scan(docs, bench).collect()), key=repr)
    assert got == sorted(con.execute(queries.OP8_SQL).fetchall(), key=repr) and any(r[2] and not r[3] for r in got)


def test_a_window_of_many_items_is_one_window(spark):
    shared = " ".join(f"s{k}" for k in range(13))
    bench = spark.createDataFrame([(k, f"{shared} own{k}") for k in range(1000)], "item_id long, text string")
    text = f"{shared} and " * 3000
    began = time.perf_counter()
    for most in (1_000_000, 700):
        row = decontaminate.scan(documents(spark, [text, None, ""]), bench, most=most).orderBy("doc_id").collect()
        digest = hashlib.sha256(",".join(sorted(map(str, range(1000)))).encode()).hexdigest()
        assert tuple(row[0]) == (0, 42_000, 39_000, 1000, digest, True)
        assert [tuple(r)[1:4] for r in row[1:]] == [(0, 0, 0)] * 2
    assert time.perf_counter() - began < 60
    assert decontaminate.scan(documents(spark, []), bench).count() == 0


def test_hash_set_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 1000, 70_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(rng.choice([1, 2, 1 << 40])))
        held = decontaminate.HashSet(keys)
        other = np.setdiff1d(rng.integers(0, 1 << 63, 1000, dtype=np.uint64), keys)
        assert np.array_equal(held.find(keys), np.arange(len(keys))) and (held.find(other) == -1).all()


def test_remove_documents_and_spans(spark):
    item = " ".join(f"w{k}" for k in range(15))
    texts = [f"Before, {item}! After.", "clean text", None, item, " ".join(f"z{k}" for k in range(400)) + " " + item]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, texts).withColumn("hits", F.lit(3))
    assert [r["doc_id"] for r in decontaminate.remove(docs, bench).orderBy("doc_id").collect()] == [1, 2, 4]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, bench, "spans").collect()}
    assert cut == {0: "Before, ! After.", 1: "clean text", 2: None, 3: "", 4: " ".join(f"z{k}" for k in range(400)) + " "}
    assert decontaminate.remove(docs, bench.limit(0)).count() == 5
    with pytest.raises(ValueError):
        decontaminate.remove(docs, bench, "words")


# --- BPE --------------------------------------------------------------------

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.TrieEncoder(bpe.Vocabulary.read(BPE_FILE))


def test_bpe_against_the_library(encoder):
    library = Tokenizer.from_file(BPE_FILE)
    rng = random.Random(0)
    texts = [t or "" for t in EDGE_TEXTS] + random_texts(50) + ["<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "don't I'LL we're", "  \n\n x\t", "ab" * 700, "日本語のテキスト", "\x00\x7f"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(161, 0x2000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(60)) for _ in range(60)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.decode(np.array(i, "<u4"), encoder.v) for i in got] == [library.decode(i, skip_special_tokens=False) for i in got] == texts


def test_bpe_forgets_without_changing_results(encoder, monkeypatch):
    texts = random_texts(20, seed=2)
    want = encoder.encode(texts)
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 10)
    monkeypatch.setattr(bpe, "MEMORY_PAIRS", 5)
    encoder.forget()
    assert [encoder.encode([t])[0] for t in texts] == want


def test_bpe_words_are_their_plain_merges(encoder):
    words = {w for t in random_texts(30, seed=6) for w in t.split()}
    encoder.learn(words)
    assert all(np.frombuffer(encoder.known[w], "<u4").tolist() == encoder.v.merge(w.encode()) for w in words)


def test_bpe_documents(spark):
    texts = [t for t in EDGE_TEXTS] * 2
    rows = bpe.encode_documents(documents(spark, texts, [None] * len(texts)).withColumn("n_tokens", F.lit("x")), BPE_FILE).collect()
    library = Tokenizer.from_file(BPE_FILE)
    want = []
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(documents(spark, texts).limit(0), BPE_FILE).count() == 0
    sent = bpe.send_vocabulary(spark, BPE_FILE)
    docs = documents(spark, texts).withColumn("ids", bpe.encoded(F.col("text"), sent))
    assert docs.filter(bpe.decoded(F.col("ids"), sent) != F.coalesce("text", F.lit(""))).count() == 0


# --- HMM --------------------------------------------------------------------


def brute_forward(m, codes):
    """The sum over all state paths."""
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(codes)):
        p = m.start[path[0]] * m.emit[path[0], codes[0]]
        for a, b, c in zip(path, path[1:], codes[1:], strict=False):
            p *= m.move[a, b] * m.emit[b, c]
        total += p
    return math.log10(total)


def small_model(states=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    return hmm.Hmm(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states))


def test_forward_is_the_sum_over_paths():
    m, rng = small_model(), np.random.default_rng(1)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6, 2, 6)]
    assert np.allclose(hmm.log10_forward(m, seqs), [brute_forward(m, s) for s in seqs])


@pytest.mark.parametrize("save", [1, 2, 3, 5, 1024])
def test_expected_counts_are_those_of_all_paths(save):
    m, rng = small_model(), np.random.default_rng(2)
    rows = [rng.integers(0, 5, n) for n in (5, 3, 1, 4)]
    start, move, emit, loglik = hmm._expected(m, *hmm._padded(rows), save=save)
    s2, m2, e2, l2 = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)), 0.0
    for codes in rows:
        weights = {}
        for path in itertools.product(range(3), repeat=len(codes)):
            p = m.start[path[0]] * m.emit[path[0], codes[0]]
            for a, b, c in zip(path, path[1:], codes[1:], strict=False):
                p *= m.move[a, b] * m.emit[b, c]
            weights[path] = p
        z = sum(weights.values())
        l2 += math.log(z)
        for path, p in weights.items():
            s2[path[0]] += p / z
            for k, s in enumerate(path):
                e2[s, codes[k]] += p / z
                if k:
                    m2[path[k - 1], s] += p / z
    assert np.allclose(start, s2, atol=1e-4) and np.allclose(move, m2, atol=1e-4) and np.allclose(emit, e2, atol=1e-4) and abs(loglik - l2) < 1e-3


@pytest.mark.parametrize("dictionary", [100_000, 20, 0])
def test_base_score_and_counts_against_brute_force(spark, dictionary):
    texts = random_texts(60, seed=3) + EDGE_TEXTS
    docs = documents(spark, texts).withColumn("score", F.lit("x"))
    rows = sorted(hmm.score_documents(docs, states=2, iterations=2, dictionary=dictionary).collect())
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [[*WORD.findall(lower(t)), None] for t in texts]
    counts = Counter(w for i, ws in enumerate(tokens) if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r, ws in zip(rows, tokens, strict=True):
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0


def brute_counts(m, codes):
    """Expected starts, moves and emissions of one sequence by the forward and backward recursions in double precision, with its log10 likelihood."""
    n, k = len(codes), len(m.start)
    a, b, c = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        a[t] = (m.start if t == 0 else a[t - 1] @ m.move) * m.emit[:, codes[t]]
        c[t] = a[t].sum()
        a[t] /= c[t]
    moves = np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        after = m.emit[:, codes[t + 1]] * b[t + 1] / c[t + 1]
        b[t] = m.move @ after
        moves += np.outer(a[t], after) * m.move
    emissions = np.zeros(m.emit.shape)
    for t in range(n):
        emissions[:, codes[t]] += a[t] * b[t]
    return a[0] * b[0], moves, emissions, np.log10(c).sum()


@pytest.mark.parametrize("dictionary", [100_000, 500])
def test_score_against_brute_force_from_texts_to_sums(spark, dictionary):
    texts = random_texts(70, seed=11, words=150, vocabulary=3000) + EDGE_TEXTS
    rows = sorted(hmm.score_documents(documents(spark, texts), states=2, iterations=2, dictionary=dictionary).collect())
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    tokens = [[w.encode() for w in WORD.findall(lower(t))] for t in texts]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    # words with a class of their own: the most frequent of those in the dictionary, which is cut at a level of counts
    level = {w: math.floor(math.log2(c) * 16) for w, c in counts.items()}
    listed = [w for w in counts if sum(x >= level[w] for x in level.values()) <= dictionary]
    own = {w: k for k, w in enumerate(sorted(listed, key=lambda w: (-counts[w], w))[: hmm.OWN_CLASSES])}
    class_of = lambda w: own[w] if w in own else hmm.OWN_CLASSES + zlib.crc32(w[-3:]) % hmm.ENDING_CLASSES
    total, distinct = Counter(), Counter()
    for w, c in counts.items():
        total[class_of(w)] += c
        distinct[class_of(w)] += 1
    sizes = np.zeros(hmm.CLASSES)
    for k, c in total.items():
        sizes[k] = c
    sizes[hmm.END] = held.count(False)
    codes = [[*map(class_of, ws), hmm.END] for ws in tokens]
    m = hmm.Hmm.initial(sizes, 2)
    for _ in range(2):
        sums = [np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit)]
        for seq, h in zip(codes, held, strict=True):
            if not h:
                sums = [x + y for x, y in zip(sums, brute_counts(m, seq)[:3], strict=True)]
        m = m.updated(*sums, sizes)
    within = lambda w: 0.0 if w in own else math.log10((counts[w] + 0.1) / (total[class_of(w)] + 0.1 * (distinct[class_of(w)] + 1)))
    for r, seq, ws in zip(rows, codes, tokens, strict=True):
        assert math.isclose(r["score"], brute_counts(m, seq)[3] + sum(map(within, ws)), rel_tol=1e-4), r["doc_id"]


def test_the_shares_of_a_class_make_one(spark):
    docs = documents(spark, random_texts(50, seed=3, words=200, vocabulary=4000))
    counts = hmm.materialize(hmm.word_counts(docs), "t")
    lex = hmm.lexicon(counts, 50)
    # in each ending class the shares of its words and of one unknown word make one
    shares, members = Counter(), Counter()
    for w, k in lex.number.items():
        shares[lex.cls[k]] += 10 ** lex.log_within[k]
        members[lex.cls[k]] += 1
    assert members and any(c >= hmm.OWN_CLASSES for c in shares)
    for c, share in shares.items():
        assert math.isclose(share if c < hmm.OWN_CLASSES else share + hmm.SMOOTH / 10 ** lex.class_log[c], 1)


def test_very_long_texts_are_learned_from_and_scored_whole(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") for _ in range(150_000))
    docs = documents(spark, [text, "a b", text, ""], [1, 2, 3, 4])
    rows = {r["doc_id"]: r for r in hmm.score_documents(docs, states=2, iterations=1).collect()}
    assert rows[1]["n_tokens"] == 150_001 and rows[1]["train_tokens"] >= 300_000 and rows[1]["score"] == rows[3]["score"]
    assert abs(rows[1]["score"] / 150_001 + math.log10(8)) < 0.05
    m = small_model()
    seq = np.random.default_rng(0).integers(0, 5, 5000).astype("<u2")
    got, want = hmm._expected(m, *hmm._padded([seq, seq[:77]]), save=100), [x + y for x, y in zip(brute_counts(m, seq), brute_counts(m, seq[:77]), strict=True)]
    assert all(np.allclose(g, w, rtol=1e-3, atol=1e-3) for g, w in zip(got[:3], want[:3], strict=True)) and math.isclose(got[3], want[3] * math.log(10), rel_tol=1e-5)


def test_training_raises_the_likelihood_and_beats_unigrams_held_out(spark):
    rng = random.Random(0)
    voc = [[f"{p}{k}" for k in range(40)] for p in "abc"]
    texts = [" ".join(rng.choice(v) for _ in range(30)) for _ in range(300) for v in [voc[rng.randrange(3)]]]
    docs = documents(spark, texts)
    rows = hmm.score_documents(docs, states=3, iterations=6).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.2 * sum(r["n_tokens"] for r in held)
    counts = hmm.materialize(hmm.word_counts(docs), "t")
    lex = hmm.lexicon(counts, 300)
    coded = hmm.encode(docs.withColumns({"row": F.col("doc_id"), "held_out": F.lit(False)}), spark.sparkContext.broadcast(lex))
    _, course = hmm.train(hmm.materialize(coded, "t"), lex.class_counts, 3, 5)
    assert all(b > a - 1e-3 * abs(a) for a, b in itertools.pairwise(course)) and course[-1] > course[0]


def test_hmm_edges(spark):
    docs = documents(spark, ["a b", "a b", None], [3, 3, None])
    rows = sorted(hmm.score_documents(docs, states=2, iterations=1).collect(), key=repr)
    assert len(rows) == 3 and rows[0]["score"] == rows[1]["score"] and rows[2]["held_out"]
    assert hmm.score_documents(docs.limit(0), states=2, iterations=1).count() == 0
    alone = hmm.score_documents(docs.filter("doc_id is null"), states=2, iterations=1).first()
    assert (alone["n_known"], alone["train_tokens"], alone["n_tokens"]) == (0, 0, 1) and math.isfinite(alone["score"])


# --- WARC -------------------------------------------------------------------


@pytest.mark.parametrize("segment,groups", [(32_768, 100_000), (50, 0)])
def test_warc_round_trip(spark, tmp_path, segment, groups):
    html = [None, "", "<p>one</p>", "<p>one</p>", "<p>one</p>", "é" * 3000, "x\r\n\r\nWARC/1.1\r\n\r\n", "long " * 30_000, "<p>two</p>", "<p>two</p>"]
    ids = [0, 1, 2, 9, 5, 6, 7, 8, None, None]
    pages = spark.createDataFrame([(i, None if i == 6 else f"http://h/{i}\r\nX: y", h, "e") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "a")
    warc.write_archives(pages.union(pages.filter("page_id = 8")), path, segment=segment, archive_records=3, broadcast_groups=groups)
    got = warc.read_pages(spark, path, pages.schema["page_id"].dataType, payloads=True).collect()
    largest = {h or "": max((i for i, g in zip(ids, html, strict=True) if (g or "") == (h or "") and i is not None), default=None) for h in html}
    want = []
    for i, h in [*zip(ids, html, strict=True), (8, html[7])]:
        data, keep = (h or "").encode(), largest[h or ""]
        revisit = keep is not None and i != keep
        want.append((i, len(data), warc.payload_digest(data), "revisit" if revisit else "response", keep if revisit else None, data))
    assert sorted(((*tuple(r)[:5], bytes(r["payload"])) for r in got), key=repr) == sorted(want, key=repr)


def test_payloads_of_one_sha1_stay_apart_and_each_record_is_a_member(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "aaaa"), (2, "v", "bbbb"), (3, "w", "bbbb"), (4, "x", "bbbbb")], "page_id long, url string, html string")
    monkeypatch.setattr(F, "sha1", lambda c: F.lit("ab" * 20))  # every payload collides
    assert {r["page_id"]: r["keep"] for r in warc.with_roles(pages).collect()} == {1: None, 2: 3, 3: 3, 4: None}
    monkeypatch.undo()
    warc.write_archives(pages, str(tmp_path / "m"))
    for content in (r["content"] for r in spark.read.format("binaryFile").load(str(tmp_path / "m")).collect()):
        members, rest = [], bytes(content)
        while rest:
            one = zlib.decompressobj(31)
            members.append(one.decompress(rest))
            rest = one.unused_data
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") and m.count(b"WARC-Record-ID") == 1 for m in members if m)
        assert b"".join(warc.unpacked(bytes(content), 7)) == b"".join(members)


def test_warc_empty_table_and_threshold(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    warc.write_archives(pages, str(tmp_path / "t"), least_bytes=2)
    kind = pages.schema["page_id"].dataType
    assert warc.read_pages(spark, str(tmp_path / "t"), kind).filter("record_type = 'response'").count() == 2
    assert warc.read_pages(spark, str(tmp_path / "e"), kind).count() == 0


def test_warc_faults_are_found():
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc", b""):
        with pytest.raises(ValueError):
            warc.dechunked(broken)
    assert warc.joined([2, 1], [4, None], [b"cd", b"ab"], "x") == (b"abcd", 1)
    assert warc.joined([2, 1, 1, 2], [4, None, None, 4], [b"cd", b"ab", b"ab", b"cd"], "x") == (b"abcd", 2)
    for numbers, totals, blocks in (([1, 3], [None, 4], [b"ab", b"cd"]), ([1, 2], [None, 5], [b"ab", b"cd"]), ([1, 2], [None, None], [b"ab", b"cd"]), ([1, 1], [2, 2], [b"ab", b"cd"])):
        with pytest.raises(ValueError):
            warc.joined(numbers, totals, blocks, "x")
    parser = warc.Parser()
    assert not list(parser.feed(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab"))
    with pytest.raises(ValueError):
        parser.close()
    with pytest.raises(ValueError):
        warc.verified(b"a", "WRONG", "x")


# --- URL filters ------------------------------------------------------------

PAGE = "page_id long, url string, html string"


def link(target):
    return f'<html><LINK href="{target}" rel="canonical"></html>'


def test_url_aliases_share_decisions_and_allow_wins(spark):
    rs = [urls.UrlRule.parse("block", "bad.com/"), urls.UrlRule.parse("allow", "bad.com/ok"), urls.UrlRule.parse("block", "com/x/")]
    rows = [
        (1, "http://a.org/1", link("http://bad.com/p")),  # alias of a blocked URL that is no page
        (2, "http://a.org/2", '<meta http-equiv="refresh" content="0; url=/1">'),  # through page 1
        (3, "https://a.org/3#frag", link("//BAD.com/ok")),  # alias of an allowed one
        (4, "http://a.org/4", link("http://a.org/5")),
        (5, "http://a.org/5", link("http://bad.com/q")),
        (6, "http://a.org/6", link("http://a.org/5").replace("</html>", '<meta http-equiv=refresh content="1;URL=http://bad.com/okay">')),  # allow and block meet
        (7, "http://WWW.Bad.com/z?q=1", None),
        (8, "http://www.bad.com/okay", ""),
        (9, "http://notbad.com/z", "canonical"),
        (10, "http://n.com/x/1", link("http://bad.com/ok")),  # its own rule stands
        (11, None, link("http://bad.com/")), (12, "no url", None), (12, "no url", None), (None, "x://", None),
        (13, "http://b.org/d/e", link("f&amp;g")), (14, "http://b.org/d/f&g", link("http://bad.com/p")),
    ]
    got = {(r["page_id"], r["verdict"], r["rule"], r["inherited"]) for r in urls.judge_urls(spark.createDataFrame(rows, PAGE).withColumn("rule", F.lit(1)).withColumn("node", F.lit(1)), rs).collect()}
    assert got == {
        (1, "block", None, True), (2, "block", None, True), (3, "allow", None, True), (4, "allow", None, True), (5, "allow", None, True), (6, "allow", None, True),
        (7, "block", "bad.com/", False), (8, "allow", "bad.com/ok", False), (9, "allow", None, False), (10, "block", "com/x/", False),
        (11, "allow", None, False), (12, "allow", None, False), (None, "allow", None, False), (13, "block", None, True), (14, "block", None, True),
    }
    assert urls.judge_urls(spark.createDataFrame([], PAGE), rs).count() == 0


def test_url_parts(spark):
    cases = [("http://A.b/c?d#e", "a.b", "/c"), ("http://x?y://z/w", "x", ""), ("x", "", ""), (None, "", ""), ("a\n://H#/p", "h", ""), ("://", "", ""), ("http://É.com/ä", "É.com", "/ä")]
    rows = spark.createDataFrame([(u,) for u, *_ in cases], "url string").select("url", urls.host_of(F.col("url")), urls.path_of(F.col("url"))).collect()
    assert [tuple(r) for r in rows] == cases
    for bad in (("block", "nohost"), ("deny", "a/"), ("block", "/x")):
        with pytest.raises(ValueError):
            urls.UrlRule.parse(*bad)
