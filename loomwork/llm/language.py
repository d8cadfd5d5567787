"""Language identification by Bayesian fusion of a page's text with what is declared and known about its address.

Evidence on a page, each conditionally independent given the language:
the likelihood of its text under byte trigrams counted over all labelled
documents, to the power of one third, as each byte stands in three of them;
the language its markup declares; its address suffix; and, as the
prior, the share of languages on its host, smoothed towards its domain, that
towards all pages. Likelihood tables of declarations and suffixes and the
priors are grouped counts of the languages that page texts alone suggest; a
page's own text is left out of its own priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm import markup
from loomwork.llm.shared import materialize, pick, utf8

BUCKETS = 1 << 14
#: Languages whose counts a task holds before it sends them, 128 KB each.
HELD_LANGUAGES = 64
#: The power of a text's likelihood, the same for texts of all lengths: a text of n bytes has n trigrams, which say each byte three times.
TEMPER = 1 / 3
#: Weights of the coarser level in smoothing: all pages in a domain, a domain in a host, a language's share in a table.
SMOOTH_DOMAIN, SMOOTH_HOST, SMOOTH_TABLE = 4.0, 2.0, 1.0

#: Letters of ASCII in lower case and bytes of other characters stay, all else becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def trigrams(text: bytes, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's byte trigrams, words apart by one space, in blocks."""
    flat = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", np.uint8)
    for at in range(0, len(flat) - 2, block):
        part = flat[at : at + block + 2].astype(np.uint32)
        code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        yield (code * np.uint32(2654435761)) >> np.uint32(18)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram bucket | language)) from all labelled rows of ``docs`` (text, lang).

    Tasks count into one table for each language they meet, a bounded number
    of tables at a time; the driver gets languages x BUCKETS sums, so what it
    and each task hold grows with the number of languages only. Rows without a
    label or text count for nothing.
    """
    labelled = pick(docs, "lang", "text").dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.record_batch({"lang": pa.array(found, pa.string()), "n": pa.array([t.tolist() for t in found.values()], pa.list_(pa.int64()))})

        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                if lang not in found and len(found) == HELD_LANGUAGES:
                    yield rows()
                    found = {}
                table = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for codes in trigrams(text):
                    table += np.bincount(codes, minlength=BUCKETS)
        yield rows()

    sums = labelled.mapInArrow(count, "lang string, n array<long>").select("lang", F.posexplode("n").alias("bucket", "n")).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("lang").to_pylist()
    languages = sorted(set(names))
    at = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    counts[[at[x] for x in names], sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    # smoothed towards the buckets' shares in all languages
    share = (counts.sum(axis=0) + 0.01) / (counts.sum() + 0.01 * BUCKETS)
    return languages, np.log((counts + 100 * share) / (counts.sum(axis=1, keepdims=True) + 100))


def visible(html: Column) -> Column:
    """Text between tags; scripts, styles and comments are not text. Reads the text once, whatever is left open in it."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), markup.HIDDEN, " ")


HTML_TAG = rf"\A(?:[^<]++|{markup.COMMENT}|{markup.RAW}|(?!<{markup.letters('html')}[ \t\n\f\r/])(?:{markup.OTHER}|{markup.BOGUS}|<))*+<{markup.letters('html')}([ \t\n\f\r/]{markup.REST}>)"


def declared_language(html: Column) -> Column:
    """The primary subtag of the ``lang`` of the first ``html`` tag, in lower case; null without one."""
    items = F.regexp_extract_all(F.regexp_extract(F.coalesce(html, F.lit("")), HTML_TAG, 1), F.lit(markup.ATTRIBUTE), F.lit(0))
    own = F.get(F.filter(items, lambda i: i.rlike(r"^[lL][aA][nN][gG][ \t\n\f\r]*+=")), F.lit(0))
    return F.nullif(F.lower(F.coalesce(F.regexp_extract(own, r"""^[^=]*+=[ \t\n\f\r]*+["']?+([A-Za-z]{2,8})""", 1), F.lit(""))), F.lit(""))


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain of its last two labels, suffix of its last label), lower case; all null without a host."""
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def text_evidence(pages: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, loglik (one for each language, less the best), best (of the text alone; null without text)."""
    sent = pages.sparkSession.sparkContext.broadcast(logs)

    @F.arrow_udf("array<double>")
    def loglik(texts: pa.Array) -> pa.Array:
        table, out = sent.value, []
        for text in utf8(texts):
            total = np.zeros(len(table))
            for codes in trigrams(text, 4096):
                total += table[:, codes].sum(axis=1)
            out.append((total * TEMPER).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    host, domain, suffix = host_parts(F.col("url"))
    found = pick(pages, "page_id", "url", "html").select("page_id", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared_language(F.col("html")).alias("declared"), loglik(visible(F.col("html"))).alias("loglik"))
    top = F.array_max("loglik")
    best = F.when(F.size(F.array_distinct("loglik")) > 1, F.array_position("loglik", top) - 1).cast("int")
    return found.withColumn("best", best).withColumn("loglik", F.transform("loglik", lambda x: x - top))


def _counts(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and ``{key}_n``: pages of the key by the number of the language of their text, as a map."""
    found = rows.filter(F.col(key).isNotNull() & F.col("best").isNotNull()).groupBy(key, "best").count()
    return found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("best", "count"))).alias(f"{key}_n"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, language, posterior, text_language, declared, suffix, host, posteriors (by language) of every row of ``pages`` (page_id, url, html).

    A page without text, url or declaration is judged by the rest; one without
    any has the shares of all pages. Of equal posteriors the first language by
    name wins. A declaration or suffix no other page has says nothing. Without
    labelled documents there is no language and all is null. Any number of
    languages may be labelled. Very long pages are read whole, and once.
    Repeated rows come back as often; other columns are not read.
    """
    languages, logs = train(docs)
    n = len(languages)
    if not n:
        logs = np.zeros((1, BUCKETS))
    rows = materialize(text_evidence(pages, languages, logs), "language-evidence")
    if not n:
        null = F.lit(None)
        return rows.select("page_id", null.cast("string").alias("language"), null.cast("double").alias("posterior"), null.cast("string").alias("text_language"), "declared", "suffix", "host", null.cast("map<string,double>").alias("posteriors"))
    found = {r["best"]: r["count"] for r in rows.filter("best is not null").groupBy("best").count().collect()}
    shares = F.array(*[F.lit((found.get(k, 0) + 1.0) / (sum(found.values()) + n)) for k in range(n)])
    keys = ("host", "domain", "suffix", "declared")
    held = rows
    for key in keys:
        held = held.join(_counts(rows, key), key, "left")
    # a page's own text counts for none of its keys
    sums = {key: F.coalesce(F.aggregate(F.map_values(f"{key}_n"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) - F.when(F.col(key).isNotNull() & F.col("best").isNotNull(), 1).otherwise(0) for key in keys}
    held = held.withColumns({f"{key}_sum": x for key, x in sums.items()})

    def score(k: Column) -> Column:
        less = lambda key: F.coalesce(F.try_element_at(f"{key}_n", k), F.lit(0)) - F.when(F.col(key).isNotNull() & (F.col("best") == k), 1).otherwise(0)
        share = F.get(shares, k)
        domain = (less("domain") + SMOOTH_DOMAIN * share) / (F.col("domain_sum") + SMOOTH_DOMAIN)
        prior = (less("host") + SMOOTH_HOST * domain) / (F.col("host_sum") + SMOOTH_HOST)
        # P(value | language) over P(value): what a value of any frequency says about the language
        ratio = lambda key: F.ln((less(key) + SMOOTH_TABLE * share) / ((F.col(f"{key}_sum") + SMOOTH_TABLE) * share))
        return F.get("loglik", k) + F.ln(prior) + ratio("declared") + ratio("suffix")

    fused = held.withColumn("score", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), score)).withColumn("top", F.array_max("score"))
    fused = fused.withColumn("p", F.transform("score", lambda s: F.exp(s - F.col("top")))).withColumn("z", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    names = F.array(*[F.lit(x) for x in languages])
    return fused.select(
        "page_id", F.get(names, (F.array_position("score", F.col("top")) - 1).cast("int")).alias("language"), (1 / F.col("z")).alias("posterior"), F.get(names, F.col("best")).alias("text_language"),
        "declared", "suffix", "host", F.map_from_arrays(names, F.transform("p", lambda x: x / F.col("z"))).alias("posteriors"),
    )
