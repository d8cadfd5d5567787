"""The corpus pipeline against a brute-force version, and its stages on awkward tables."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from loomwork.llm import gam, rules
from loomwork.llm.shared import discard, materialize, scratch, scratch_path
from tests.llm.test_operators import brute_components, brute_hits, brute_print, brute_stats
from tests.llm.test_shingles import brute_set, similar

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    # quality classifier: the fitted tables, looked up one text at a time
    model = gam.fit(docs, labels)
    rows = [(i, t) for i, t in rows if model.score(np.array([gam.features_of(t.encode())]))[0] >= 0.5]
    # quality rules, learned from all labelled documents
    learned = rules.fit(docs, labels)
    kept = []
    for i, t in rows:
        n, chars, symbols, dup, repeat = brute_stats(t)
        x = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
        x = {k: np.array([eval(e, {"greatest": max, "double": float}, x)]) for k, e in rules.MEASURES.items()}
        if not (n < 50 or 100 * repeat > 50 * n or any(r.holds(x)[0] for r in learned)):
            kept.append((i, t))
    # near-duplicates, decontamination, tokens
    prints, sets = [brute_print(t) for _, t in kept], [brute_set(t) for _, t in kept]
    linked = [(a, b) for a in range(len(kept)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2 or similar(sets[a], sets[b])]
    root = brute_components(linked)
    kept = [kept[k] for k in range(len(kept)) if root.get(k, k) == k]  # ids rise with k
    kept = [(i, t) for i, t in kept if not brute_hits(t, bench)[4]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in kept:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < 200


def test_stages_return_the_columns_of_documents(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "simhash near-dedup", "benchmark decontamination", "bpe encoding and decoding"]
    good = " ".join(f"word{k} other{k % 7}" for k in range(60))
    texts = [(1, good), (1, good), (None, good + " x"), (2, None), (None, None), (3, ""), (4, "long " * 50_000), (5, good.replace("word", "term"))]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.withColumns({"s": F.lit(1), "FP": F.lit("x"), "hits": F.lit(2), "c0": F.lit(3), "row": F.lit(4)})
    clash = clash.toDF(*clash.columns[:-1], "TEXT")  # a name that differs in case only
    for held in (docs, clash, docs.limit(0), clash.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, held, SMALL)
            assert out.columns == held.columns and [f.dataType for f in out.schema.fields] == [f.dataType for f in held.schema.fields], name
            assert out.count() <= held.count()
        last = corpus_pipeline.STAGES[-1][1](spark, held, SMALL)
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == held.count()
    one_each = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(str(r["doc_id"]) for r in one_each.collect()) == ["1", "2", "4", "5"] or one_each.count() == 5


def test_edited_copies_go_and_learned_rules_reject(spark):
    good = " ".join(f"word{k} other{k % 7}" for k in range(100))
    docs = spark.createDataFrame([(1, good, "en", "s", 1), (2, good.replace("word50", "edited"), "en", "s", 1), (3, good.replace("word", "term"), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()) == [1, 3]


def test_scratch_tables_go_when_their_scope_is_left(spark, tmp_path):
    outside = scratch_path(spark, "outside")
    with scratch(spark):
        df = materialize(spark.range(5), "inside")
        files = df.inputFiles()
        with scratch(spark):
            inner = materialize(spark.range(3), "inner").inputFiles()
        df.write.parquet(outside)
    left = [f for f in files + inner if os.path.exists(f.removeprefix("file://").removeprefix("file:"))]
    assert not left and spark.read.parquet(outside).count() == 5
    discard(spark, outside)
    discard(spark, outside)
    with pytest.raises(Exception, match="outside"):
        spark.read.parquet(outside).count()


def test_queries_are_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
