"""Near copies by shingle sets: against all pairs, with small and large buckets."""

import random

import numpy as np
import pytest

from loomwork.llm import shingles, simhash
from tests.llm.test_operators import EDGE_TEXTS, brute_components, brute_print, documents, lower, random_texts


def brute_set(text):
    words = lower(text).split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def similar(a, b):
    return bool(a & b) and 5 * len(a & b) >= 4 * len(a | b)


def edited(text, edits, rng):
    words = text.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"edit{rng.randrange(1000)}"
    return " ".join(words)


def test_edited_copies_go(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 400))) for _ in range(40)]
    copies = [edited(t, 1, rng) for t in texts]
    docs = documents(spark, texts + copies)
    assert simhash.keep_one(docs).count() > 60  # two bits find hardly any
    kept = sorted(r["doc_id"] for r in shingles.keep_one(docs).collect())
    assert kept == list(range(40))


@pytest.mark.parametrize("small_bucket", [16, 1])
def test_no_two_near_copies_are_left(spark, small_bucket):
    rng = random.Random(6)
    texts = [t for t in random_texts(30, words=150)] + EDGE_TEXTS + ["one two three four five six", "one two three four five six seven"]
    base = " ".join(f"v{k}" for k in range(200))
    texts += [edited(base, k % 7, rng) for k in range(40)] + [t + " end" for t in texts[:20] if t] + [base.upper()]
    ids = [None, *range(900, 900 + len(texts) - 2), 901]
    docs = documents(spark, texts, ids)
    after = sorted(((r["doc_id"], r["text"]) for r in shingles.keep_one(docs, small_bucket=small_bucket).collect()), key=repr)
    before = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()), key=repr)
    sets = {x: brute_set(x[1]) for x in before}
    assert set(after) <= set(before) and len(after) < len(before)
    assert not [(a, b) for a in after for b in after if repr(a) < repr(b) and similar(sets[a], sets[b])]
    # what went is joined to something that stayed by near copies
    reached = set(after)
    while more := {b for b in before if b not in reached and any(similar(sets[a], sets[b]) for a in reached)}:
        reached |= more
    assert reached == set(before)
    assert shingles.keep_one(docs.limit(0)).count() == 0


def test_a_passage_that_many_texts_share_neither_joins_them_nor_hides_their_copies(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(120))
    texts = [passage + " " + " ".join(f"t{n}x{rng.randrange(1000)}" for _ in range(60)) for n in range(60)]
    others = [" ".join(f"o{n}x{k}" for k in range(80)) for n in range(5)]
    copies = [edited(t, 1, rng) for t in texts + others]
    sets = [brute_set(t) for t in texts]
    assert not any(similar(a, b) for a in sets for b in sets if a is not b)
    kept = sorted(r["doc_id"] for r in shingles.keep_one(documents(spark, texts + others + copies), small_bucket=4).collect())
    assert kept == list(range(65))


def kept_ids(docs, **limits):
    return sorted(r["doc_id"] for r in shingles.keep_one(docs, **limits).collect())


def least_of_components(texts):
    """Numbers of the texts that stay, by all pairs."""
    sets, prints = [brute_set(t) for t in texts], [brute_print(t) for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2 or similar(sets[a], sets[b])]
    root = brute_components(linked)
    return [k for k in range(len(texts)) if root.get(k, k) == k]


@pytest.mark.parametrize(("small_bucket", "block_shingles"), [(16, 200_000), (1, 200_000), (2, 1_500)])
def test_crowded_buckets_lose_no_link(spark, small_bucket, block_shingles):
    # around one text stand families, most of them too far from it and from each other, whose members are close to one another
    rng = random.Random(8)
    base = " ".join(f"v{k}" for k in range(150))
    families = [edited(base, 4 + k % 5, rng) for k in range(25)]
    texts = [edited(f, 1 + k % 3, rng) for k in range(4) for f in families]
    want = least_of_components(texts)
    assert 5 < len(want) < 60
    assert kept_ids(documents(spark, texts), small_bucket=small_bucket, block_shingles=block_shingles) == want


@pytest.mark.parametrize("dense", [64, 0])
def test_blocks_of_pairs_and_of_whole_sets_find_the_same(spark, dense):
    rng = random.Random(12)
    base = " ".join(f"v{k}" for k in range(150))
    families = [edited(base, 4 + k % 5, rng) for k in range(20)]
    texts = [edited(f, 1 + k % 3, rng) for k in range(3) for f in families]
    want = least_of_components(texts)
    assert 5 < len(want) < 40
    assert kept_ids(documents(spark, texts), small_bucket=1, dense=dense) == want


def test_whole_sets_are_not_brought_to_blocks_of_a_shared_passage(spark, monkeypatch):
    # all texts meet in the passage's buckets, but leave no room there for enough shared shingles; their sets went to every block before
    rng = random.Random(13)
    passage = " ".join(f"p{k}" for k in range(90))
    texts = [passage + " " + " ".join(f"t{n}x{rng.randrange(1000)}" for _ in range(14)) for n in range(40)]
    wanted = []
    by_row = shingles._by_row
    monkeypatch.setattr(shingles, "_by_row", lambda rows, texts: wanted.append(rows.count()) or by_row(rows, texts))
    assert kept_ids(documents(spark, texts), small_bucket=4) == least_of_components(texts)
    assert len(wanted) == 2 and wanted[1] < 10


def test_every_text_of_a_fingerprint_brings_its_links(spark):
    # repetition alone decides the fingerprint of the first two; the third is a near copy of the second only
    many, tails = "x y z " * 300, [" ".join(f"{t}{k}" for k in range(50)) for t in "ab"]
    texts = [many + tails[0], many + tails[1], tails[1]]
    prints = [simhash.fingerprint_of(t.encode()) for t in texts]
    assert prints[0] == prints[1] and (prints[1] ^ prints[2]).bit_count() > 2
    assert kept_ids(documents(spark, texts)) == least_of_components(texts) == [0]


def test_pairs_at_exactly_the_share(spark):
    rng = random.Random(9)
    texts = [" ".join(f"{n}x{k}" for k in range(rng.choice([8, 12, 24, 44, 84]))) for n in range(400)]
    copies = [t + "".join(f" e{n}x{k}" for k in range((len(t.split()) - 4) // 4)) for n, t in enumerate(texts)]
    assert all(5 * len(brute_set(a) & brute_set(b)) == 4 * len(brute_set(a) | brute_set(b)) for a, b in zip(texts, copies, strict=True))
    assert kept_ids(documents(spark, texts + copies)) == list(range(400))
    farther = [c + " more" for c in copies]
    assert len(kept_ids(documents(spark, texts + farther))) == len(least_of_components(texts + farther))


def test_shared_counts_of_blocks():
    rng = np.random.default_rng(10)
    for values in (60, 4000):  # many in common, few in common
        sides = [[np.unique(rng.integers(0, values, 40)) for _ in range(n)] for n in (30, 45)]
        flat = [x for s in sides for x in (np.concatenate(s), np.repeat(np.arange(len(s)), list(map(len, s))))]
        want = [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
        assert shingles._shared(*flat, (30, 45)).tolist() == want


def test_bitmaps_never_rule_out_what_is_shared():
    rng = np.random.default_rng(11)
    for n, m, both in [(1, 1, 1), (1, 1, 0), (100, 120, 90), (63, 65, 60), (500, 400, 400), (300, 300, 20)]:
        values = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = values[:n], values[n - both : n - both + m]
        most = shingles.may_share(shingles.bits_of(a), shingles.bits_of(b), n, m)
        assert both <= most <= min(n, m)
    assert most < 200  # the last sets are told apart
