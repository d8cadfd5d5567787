"""Language fusion and edit-aware counts against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter as Bag
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import bpe, language, token_counts

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")

# --- language -----------------------------------------------------------------

WORDS = {"de": "der die und nicht schön über straße wir gehen heute", "en": "the and with that from this they going house today", "fr": "le la et être nous avec très école maison jour"}
PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(0)
    rows = [(" ".join(rng.choice(WORDS[k].split()) for _ in range(40)), k) for k in WORDS for _ in range(15)] + [(None, "de"), ("no label", None), ("", "en")]
    return spark.createDataFrame(rows, "text string, lang string")


def html(lang, text, attr='lang="{}"'):
    return f"<!doctype html><html {attr.format(lang)}><script>the and with that from</script><body><p>{text}</p></body></html>"


PAGES = [
    (1, "http://a.b.de/x", html("de", "wir gehen heute nicht")), (2, "http://a.b.de/y", html("de-AT", "")), (3, "http://c.b.de/", html("fr", "die straße und der")), (4, "https://u:p@EN.co.uk:80/", html("en", "they going from this house")),
    (5, "http://x.co.uk", html("EN", "")), (6, None, None), (7, "nohost", "plain the house with that"), (8, "http://fr.fr/q", html("fr", "nous avec école", "data-lang='de' lang={}")), (9, "http://fr.fr/r", html("fr", "le la et être")),
    (9, "http://fr.fr/r", html("fr", "le la et être")), (None, "http://new.zz/", html("qq", "")),
]


class Seen(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.parts, self.hidden = [], False

    def handle_starttag(self, tag, attrs):
        self.hidden = tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden = False

    def handle_data(self, data):
        self.parts += [] if self.hidden else [data]


def seen(page):
    parser = Seen()
    parser.feed(page or "")
    parser.close()
    return " ".join(parser.parts)


def grams(text):
    """Buckets of the byte trigrams of letters in lower case, words apart by one space."""
    flat = " ".join(re.findall(r"[a-zA-Z\x80-\U0010ffff]+", text or ""))
    flat = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in flat.encode()) + b" "
    return [((flat[k] * 65536 + flat[k + 1] * 256 + flat[k + 2]) * 2654435761 % 2**32) // 2**18 for k in range(len(flat) - 2)]


def brute(pages, docs):
    """The same formulas, one page and language at a time."""
    rows = [(r["text"], r["lang"]) for r in docs.collect() if r["text"] is not None and r["lang"] is not None]
    langs = sorted({x for _, x in rows})
    counts = {x: Bag() for x in langs}
    for t, x in rows:
        counts[x].update(grams(t))
    every = sum(counts.values(), Bag())
    total = sum(every.values())
    share = lambda b: (every[b] + 0.01) / (total + 0.01 * 2**14)
    log = lambda x, b: math.log((counts[x][b] + 100 * share(b)) / (sum(counts[x].values()) + 100))
    facts = []
    for i, url, h in pages:
        g = grams(seen(h))
        ll = [sum(log(x, b) for b in g) / 3 for x in langs]
        m = re.match(r"[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = m[1].lower() or None if m else None
        d = re.search(r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,8})", h or "")
        best = ll.index(max(ll)) if len(set(ll)) > 1 else None
        facts.append({"id": i, "ll": [x - max(ll) for x in ll], "best": best, "host": host, "domain": host and ".".join(host.split(".")[-2:]), "suffix": host and host.split(".")[-1], "declared": d and d[1].lower()})
    n = len(langs)
    out = []
    for j, f in enumerate(facts):
        others = [o for k, o in enumerate(facts) if k != j and o["best"] is not None]
        same = lambda key, k=None: sum(f[key] is not None and o[key] == f[key] and (k is None or o["best"] == k) for o in others)  # noqa: B023, E731
        scores = []
        for k in range(n):
            p = (sum(o["best"] == k for o in facts) + 1) / (sum(o["best"] is not None for o in facts) + n)
            domain = (same("domain", k) + 4 * p) / (same("domain") + 4)
            host = (same("host", k) + 2 * domain) / (same("host") + 2)
            table = sum(math.log((same(key, k) + p) / ((same(key) + 1) * p)) for key in ("declared", "suffix"))
            scores.append(f["ll"][k] + math.log(host) + table)
        top = max(scores)
        z = sum(math.exp(s - top) for s in scores)
        out.append((f["id"], langs[scores.index(top)], round(1 / z, 9), None if f["best"] is None else langs[f["best"]], f["declared"], f["suffix"], f["host"]))
    return out


def test_fusion_against_brute_force(spark, docs):
    pages = spark.createDataFrame(PAGES, PAGE).withColumns({"best": F.lit("x"), "lang": F.lit("y")})
    got = [(*tuple(r)[:2], round(r["posterior"], 9), *tuple(r)[3:7]) for r in language.identify(pages, docs).collect()]
    assert sorted(got, key=repr) == sorted(brute(PAGES, docs), key=repr)
    by = {r[0]: r[1] for r in got}
    assert by[1] == by[2] == by[3] == "de" and by[4] == by[5] == by[7] == "en" and by[8] == by[9] == "fr"


def test_posteriors_sum_to_one_and_empty_tables(spark, docs):
    pages = spark.createDataFrame(PAGES, PAGE)
    assert all(math.isclose(sum(r["posteriors"].values()), 1) for r in language.identify(pages, docs).collect())
    assert language.identify(pages.limit(0), docs).count() == 0
    assert {r["language"] for r in language.identify(pages, docs.limit(0)).collect()} == {None}


def test_many_languages(spark, docs):
    rng = random.Random(4)
    own = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(150)}
    many = spark.createDataFrame([(" ".join(rng.choice(own[x]) for _ in range(30)), x) for x in own for _ in range(2)], "text string, lang string").coalesce(1)
    pages = spark.createDataFrame([(k, f"http://h{k}.x/", html("zz", " ".join(own[x]))) for k, x in enumerate(own)], PAGE)
    rows = language.identify(pages, many).collect()
    assert len(rows) == 150 and all(r["language"] == f"l{r['page_id']:03}" and len(r["posteriors"]) == 150 for r in rows)


def test_markup_that_does_not_end_is_read_once(spark, docs):
    parts = ["<", "<!--", "<script>", "<html ", "<html lang=", "<a href='", "<style ", "<!", "</", "x"]
    texts = [p * (1_000_000 // len(p)) for p in parts] + ["a < b the and with that", "<!-- <html lang=de> --><html\nxml:lang=de LANG = 'en-GB'>the and with", "<p lang=fr><html lang=de>"]
    pages = spark.createDataFrame([(k, None, t) for k, t in enumerate(texts)], PAGE).repartition(4).cache()
    pages.count()
    began = time.perf_counter()
    rows = {r["page_id"]: r for r in pages.select("page_id", language.visible(F.col("html")).alias("text"), language.declared_language(F.col("html")).alias("declared")).collect()}
    assert time.perf_counter() - began < 20
    assert rows[0]["text"].strip() == texts[0] and not rows[1]["text"].strip() and rows[9]["text"] == texts[9]
    assert rows[10]["text"] == texts[10] and [rows[k]["declared"] for k in (10, 11, 12)] == [None, "en", "de"]


def test_long_texts_are_counted_in_blocks_as_a_whole():
    text = ("abc déf " * 200_000).encode()
    flat = b" " + b" ".join(text.translate(language.LETTERS).split()) + b" "
    assert sum(len(c) for c in language.trigrams(text)) == len(flat) - 2
    first = next(language.trigrams(text))[:50]
    assert [int(c) for c in first] == [((flat[k] << 16 | flat[k + 1] << 8 | flat[k + 2]) * 2654435761 % 2**32) >> 18 for k in range(50)]


# --- token counts ---------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(bpe.TrieEncoder(bpe.Vocabulary.read(BPE_FILE)))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE_FILE)
    t.encode_special_tokens = True
    return t


PIECES = ["a", "b", " ", "  ", "\n", "\n\n", " \t", "'s", "'", "don't", "é", "9", "42", "!!", "<|endoftext|>", "日本", " x", " ", "\U0001f600"]


@pytest.mark.parametrize("leaf,crowded", [(1, 2), (3, 8), (32, 256)])
def test_edits_against_counting_anew(counter, library, monkeypatch, leaf, crowded):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    monkeypatch.setattr(token_counts, "CROWDED", crowded)
    rng = random.Random(leaf)
    some = lambda most: "".join(rng.choice(PIECES) for _ in range(rng.randint(0, most)))
    for _ in range(60):
        text = some(150)
        tree = token_counts.build_tree(text, counter)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b = rng.choice([a, min(len(text), a + rng.randint(0, 12)), rng.randint(a, len(text))])
            tree, text, _ = token_counts.edit_tree(tree, text, a, b, some(rng.choice([0, 1, 2, 30])), counter)
            assert (tree.tokens, tree.chars) == (len(library.encode(text, add_special_tokens=False).ids), len(text))
            assert np.array_equal(tree.sums[1], tree.sums[tree.size :].sum(axis=0)) and token_counts.Tree.unpacked(tree.packed()).tokens == tree.tokens


def test_an_edit_recounts_only_what_it_touches(counter):
    text = " ".join(f"word{k}" for k in range(20_000))
    tree = token_counts.build_tree(text, counter)
    _, edited, recounted = token_counts.edit_tree(tree, text, 70_000, 70_004, "other words", counter)
    assert edited[70_000:70_011] == "other words" and recounted < 1_000
    with pytest.raises(ValueError):
        token_counts.edit_tree(tree, "abc", 2, 9, "", counter)


MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")


def test_scrubbing_finds_what_plain_patterns_find():
    rng = random.Random(9)
    for k in range(3000):
        text = "".join(rng.choice("0123 ().-+a(٣") for _ in range(rng.randint(0, 40)))
        want = [(m.start(), m.end(), "<phone>") for m in re.finditer(r"[\d+(][\d ().-]{7,}\d", text)]
        assert token_counts.scrub_edits(text)[::-1] == want, text
    for text in ("x" * 100 + ".y@host.example.org!", "a@b@c.de", "a@b", "@c.de", "é.ü@ö.de,z+w@q-r.x.y"):
        assert [e[:2] for e in token_counts.scrub_edits(text) if e[2] == "<email>"][::-1] == [m.span() for m in MAIL.finditer(text)], text


def test_edits_at_once_are_those_one_by_one(library):
    rng, counter = random.Random(12), token_counts.Counter(bpe.TrieEncoder(bpe.Vocabulary(open(BPE_FILE).read())))
    some = lambda n: "".join(rng.choices("ab  \n1É'st.", k=n))
    for _ in range(150):
        text = some(rng.choice([0, 3, 90, 900, 4_000]))
        places = sorted(rng.choices(range(len(text) + 1), k=2 * rng.choice([1, 2, 9, 40])))
        edits = [(a, b, some(rng.choice([0, 0, 1, 5, 300]))) for a, b in zip(places[::2], places[1::2], strict=True)]
        edits = [e for k, e in enumerate(edits) if not k or edits[k - 1][1] <= e[0] and edits[k - 1][0] < e[0]]
        want = text
        for a, b, new in edits[::-1]:
            want = want[:a] + new + want[b:]
        tree, got, _ = token_counts.edit_all(token_counts.build_tree(text, counter), text, edits, counter)
        assert got == want and tree.chars == len(want) and tree.tokens == len(library.encode(want, add_special_tokens=False).ids)
        assert (tree.sums[1] == tree.sums[tree.size : 2 * tree.size].sum(axis=0)).all()
    assert [len(x) for x in token_counts.at_once([(9, 10, ""), (5, 7, ""), (6, 6, ""), (1, 2, "x")])] == [2, 2]


def test_many_edits_of_a_long_text_take_linear_time(library):
    """1 MB with 30,000 edits."""
    counter = token_counts.Counter(bpe.TrieEncoder(bpe.Vocabulary(open(BPE_FILE).read())))
    text = "write to a.b@mail.example.org now, " * 30_000
    tree, edits = token_counts.build_tree(text, counter), token_counts.scrub_edits(text)
    began = time.time()
    tree, now, _ = token_counts.edit_all(tree, text, edits, counter)
    assert time.time() - began < 5 and len(edits) == 30_000
    assert now == "write to <email> now, " * 30_000 and tree.tokens == len(library.encode(now, add_special_tokens=False).ids)


def test_scrubbing_takes_linear_time():
    began = time.perf_counter()
    for part in ("(", "+", "1 ", "+(", "@", "a@", "a.", "x" * 99 + "@", "9(", "-"):
        token_counts.scrub_edits(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 20


def test_scrubbed_documents(spark, library):
    texts = [None, "", "mail me@x.example.com or +1 (743) 555-3824, key " + "A1b2" * 10 + "!", "12345678901 a@b.co a@b.co", "plain", "x " * 40_000 + "q@w.example.org"]
    docs = spark.createDataFrame([(k // 2, t, "z") for k, t in enumerate(texts)] * 2, "doc_id long, text string, n_tokens string")
    want = []
    for k, t in enumerate(texts):
        now, n = t or "", 0
        for a, b, new in token_counts.scrub_edits(now):
            now, n = now[:a] + new + now[b:], n + 1
        count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
        want.append((k // 2, count(t or ""), count(now), n, len(now), hashlib.sha256(now.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens_before"], r["n_tokens"], r["n_edits"], r["n_chars"], r["text_sha256"]) for r in token_counts.count_scrubbed(docs, BPE_FILE).collect()]
    assert sorted(got) == sorted(want * 2) and want[2][3] == 3
    assert token_counts.count_scrubbed(docs.limit(0), BPE_FILE).count() == 0
    assert token_counts.scrub_edits(texts[2])[-1] == (5, 21, "<email>")


def test_runs_without_room_for_a_number_are_not_looked_at():
    assert not list(token_counts.PHONE_PARTS.finditer("some words (and) 1234 or +123456 more."))
    wide = re.compile(token_counts.PHONE_PARTS.pattern.replace("{8,}", "+"))
    rng = random.Random(13)
    for _ in range(3000):
        text = "".join(rng.choice("0123 ().-+ax") for _ in range(40))
        assert [m.span() for m in token_counts.PHONE_PARTS.finditer(text)] == [m.span() for m in wide.finditer(text) if len(m[0].lstrip("+")) >= 8], text
