"""Registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import bpe, conversations, decontaminate, divergence, gam, hmm, language, licences, rules, simhash, token_counts, urls, warc
from loomwork.llm.shared import scratch_path, table


def op1_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


#: Most pages of the given tables are longer, so that their records come through continuation and reassembly.
OP2_SEGMENT_BYTES = 2_048


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), scratch_path(spark, "warc-archives")
    warc.write_archives(pages, path, segment=OP2_SEGMENT_BYTES)
    return warc.read_pages(spark, path, pages.schema["page_id"].dataType)


def op3_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gam.classify(docs, gam.fit(docs, table(spark, sf_dir, "labels")))


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_scrubbed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


URL_RULES = [
    urls.UrlRule.parse("block", "com/en/"),
    urls.UrlRule.parse("allow", "example.com/en/7"),
    urls.UrlRule.parse("block", "net/de/"),
    urls.UrlRule.parse("block", "example.net/de/8"),
    urls.UrlRule.parse("block", "org/es/"),
]


def op7_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return conversations.audited(talks, conversations.damage(talks))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm_score": op1_hmm_score,
    "op2_warc_segments": op2_warc_segments,
    "op3_gam_quality": op3_gam_quality,
    "op4_language_fusion": op4_language_fusion,
    "op5_edit_counts": op5_edit_counts,
    "op6_trie_bpe": op6_trie_bpe,
    "op7_url_aliases": op7_url_aliases,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_rules": op10_rules,
    "op11_divergence": op11_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_licences": op13_licences,
}

#: Links, components and rules of op7 in DuckDB: tags and attributes by linear patterns, dot segments one at a time, the graph's closure by a recursive query.
OP7_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), tag AS (
  SELECT DISTINCT url, unnest(regexp_extract_all(html, '<!--(?:-?>|(?s:.*?)(?:-->|--!>|\z))'
    || '|<[sS][cC][rR][iI][pP][tT](?:[ \t\n\f\r/]REST)?(?:>(?s:.*?)(?:</[sS][cC][rR][iI][pP][tT][ \t\n\f\r/>]|\z)|\z)'
    || '|<[sS][tT][yY][lL][eE](?:[ \t\n\f\r/]REST)?(?:>(?s:.*?)(?:</[sS][tT][yY][lL][eE][ \t\n\f\r/>]|\z)|\z)'
    || '|<[tT][iI][tT][lL][eE](?:[ \t\n\f\r/]REST)?(?:>(?s:.*?)(?:</[tT][iI][tT][lL][eE][ \t\n\f\r/>]|\z)|\z)'
    || '|<[tT][eE][xX][tT][aA][rR][eE][aA](?:[ \t\n\f\r/]REST)?(?:>(?s:.*?)(?:</[tT][eE][xX][tT][aA][rR][eE][aA][ \t\n\f\r/>]|\z)|\z)'
    || '|(<(?:[lL][iI][nN][kK]|[mM][eE][tT][aA])[ \t\n\f\r/]REST(?:>|\z))|</?[a-zA-Z]REST(?:>|\z)|<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\z)', 1)) AS t
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), held AS (
  SELECT url, translate(t[2:5], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS tag, list_transform(
    regexp_extract_all(t[6:], '[^ \t\n\f\r/>=]+(?:[ \t\n\f\r]*=[ \t\n\f\r]*(?:"[^"]*"?|''[^'']*''?|[^ \t\n\f\r>"''][^ \t\n\f\r>]*)?)?'),
    lambda x: {'n': translate(regexp_extract(x, '^[^ \t\n\f\r/>=]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'v': regexp_extract(x, '^[^=]*=[ \t\n\f\r]*((?s:.*))$', 1)}) AS a
  FROM tag WHERE ends_with(t, '>')
), closed AS (
  SELECT url, tag, list_transform(a, lambda x: {'n': x.n, 'v': CASE WHEN x.v[1:1] IN ('"', '''') THEN x.v[2:-2] ELSE x.v END}) AS a
  FROM held WHERE len(list_filter(a, lambda x: x.v[1:1] IN ('"', '''') AND (length(x.v) = 1 OR x.v[-1:] <> x.v[1:1]))) = 0
), named_attribute AS (
  SELECT url, tag, list_filter(a, lambda x: x.n = 'rel')[1].v AS rel, list_filter(a, lambda x: x.n = 'href')[1].v AS href,
    list_filter(a, lambda x: x.n = 'http-equiv')[1].v AS equiv, list_filter(a, lambda x: x.n = 'content')[1].v AS content FROM closed
), link AS (
  SELECT url, href AS raw FROM named_attribute WHERE tag = 'link' AND regexp_matches(rel, '(?:^|[ \t\n\f\r])[cC][aA][nN][oO][nN][iI][cC][aA][lL](?:[ \t\n\f\r]|$)')
  UNION ALL
  SELECT url, nullif(CASE r[1:1] WHEN '"' THEN regexp_extract(r, '^"([^"]*)', 1) WHEN '''' THEN regexp_extract(r, '^''([^'']*)', 1) ELSE r END, '') FROM (
    SELECT url, regexp_extract(content, '^[ \t\n\f\r]*[0-9.]+(?:[ \t\n\f\r]*[;,]|[ \t\n\f\r])[ \t\n\f\r]*(?:[uU][rR][lL][ \t\n\f\r]*=[ \t\n\f\r]*)?((?s:.*))$', 1) AS r
    FROM named_attribute WHERE tag = 'meta' AND regexp_matches(equiv, '^[ \t\n\f\r]*[rR][eE][fF][rR][eE][sS][hH][ \t\n\f\r]*$'))
), target AS (
  SELECT l.url, replace(translate(trim(raw, chr(32) || chr(9) || chr(10) || chr(12) || chr(13)), chr(9) || chr(10) || chr(13), ''), '&amp;', '&') AS t,
    translate(regexp_extract(l.url, '^(?s:(.*?))://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme, p.host,
    coalesce(nullif(p.path, ''), '/') AS path, coalesce(nullif(regexp_extract(p.path, '^((?s:.*/))', 1), ''), '/') AS folder
  FROM link l JOIN (SELECT DISTINCT url, host, path FROM p) p USING (url) WHERE raw IS NOT NULL
), absolute AS (
  SELECT url, CASE
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN
      CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') AND translate(split_part(t, ':', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ('http', 'https', scheme) THEN t END
    WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN scheme || '://' || host || t
    WHEN starts_with(t, '?') THEN scheme || '://' || host || path || t WHEN t = '' OR starts_with(t, '#') THEN url
    ELSE scheme || '://' || host || folder || t END AS t
  FROM target
), part AS (
  SELECT u, translate(regexp_extract(u, '^(?s:(.*?))://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme,
    translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(nullif(regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), ''), '/') AS path, regexp_extract(u, '^(?s:.*?)://[^?#]*(\?[^#]*)', 1) AS query
  FROM (SELECT url AS u FROM pages UNION SELECT t FROM absolute WHERE t IS NOT NULL) WHERE instr(u, '://') > 0
), dots(path, now) AS (
  SELECT DISTINCT path, path FROM part
  UNION
  SELECT path, CASE WHEN regexp_matches(now, '^/\.\.?(/|$)') THEN regexp_replace(now, '^/\.\.?(/|$)', '/')
    WHEN regexp_matches(now, '/\.(/|$)') THEN regexp_replace(now, '/\.(/|$)', '/') ELSE regexp_replace(now, '/[^/]*/\.\.(/|$)', '/') END
  FROM dots WHERE regexp_matches(now, '/\.\.?(/|$)')
), named AS (
  SELECT u, CASE WHEN scheme = 'http' AND ends_with(host, ':80') THEN host[:-4] WHEN scheme = 'https' AND ends_with(host, ':443') THEN host[:-5] ELSE host END || now || query AS node
  FROM part JOIN dots USING (path) WHERE NOT regexp_matches(now, '/\.\.?(/|$)')
), edge AS (
  SELECT a.node AS u, b.node AS v FROM absolute x JOIN named a ON a.u = x.url JOIN named b ON b.u = x.t WHERE a.node <> b.node
), pair AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
reach(node, other) AS (SELECT DISTINCT u, u FROM pair UNION SELECT r.node, b.v FROM reach r JOIN pair b ON b.u = r.other),
rules(allow, h, q) AS (VALUES (false, 'com', '/en/'), (true, 'example.com', '/en/7'), (false, 'net', '/de/'), (false, 'example.net', '/de/8'), (false, 'org', '/es/')),
ruled AS (
  SELECT other, arg_max(allow, length(h || q)) AS allow
  FROM (SELECT DISTINCT other, regexp_extract(other, '^[^/?]*') AS host, regexp_extract(other, '^[^/?]*(/[^?]*)', 1) AS path FROM reach) JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY other
), alias AS (SELECT node, bool_or(allow) AS allow FROM reach JOIN ruled USING (other) GROUP BY node),
own AS (
  SELECT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(allow, length(h || q)) AS allow
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY host, path
)
SELECT page_id, p.host, p.path, own.rule, CASE WHEN coalesce(own.allow, alias.allow, true) THEN 'allow' ELSE 'block' END AS verdict,
  own.rule IS NULL AND alias.allow IS NOT NULL AS inherited
FROM p LEFT JOIN named ON named.u = p.url LEFT JOIN alias USING (node) LEFT JOIN own ON own.host = p.host AND own.path = p.path
""".replace("REST", r"""(?:[^ \t\n\f\r/>=]+|[ \t\n\f\r/]+|=[ \t\n\f\r]*(?:"[^"]*"?|''[^'']*''?|[^ \t\n\f\r>"''][^ \t\n\f\r>]*)?)*""")

#: DuckDB has no base32: the digits are read off the SHA-1, five bits at a time.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS keep, sha1(html) AS x FROM p),
bits AS (SELECT DISTINCT html, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', x[i:i]) - 1), 4, '0')), lambda a, b: a || b) AS b FROM h),
digest AS (SELECT html, list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5*i+1:5*i+1]::INT + 8 * b[5*i+2:5*i+2]::INT + 4 * b[5*i+3:5*i+3]::INT + 2 * b[5*i+4:5*i+4]::INT + b[5*i+5:5*i+5]::INT]), lambda a, c: a || c) AS payload_digest FROM bits)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM keep OR keep IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keep AND keep IS NOT NULL THEN keep END AS refers_to
FROM h JOIN digest USING (html)
"""

#: Window matches of op8 in DuckDB.
OP8_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, list_slice(w, k, k + least(len(w), 13) - 1) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
here AS (SELECT r, k, n, list_slice(w, k, k + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, k, here.n, item FROM here JOIN win ON here.g = win.g),
counted AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN counted USING (r) LEFT JOIN items USING (r)
"""

#: Term counts of op11 in DuckDB; shares and distances are HUGEINT.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c JOIN kept USING (lang, term) WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS n FROM g),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS count, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (total + 2)) // (lang_n + 2 * v.v) AS q
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE count > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

#: op12 in DuckDB: CRC-32 a bit at a time; the best (cost, audit, repaired lines) of each state, row by row, in a recursive query.
OP12_SQL = r"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(key) + 1), lambda i: list_concat([ord(key[i:i])::BIGINT], [256::BIGINT, 256, 256, 256, 256, 256, 256, 256])))),
  lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS fault FROM raw),
rows AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM crc, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM rows),
marked AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
row_ AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM marked),
step AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, [{'s': 0, 'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}] AS best FROM placed
  UNION ALL
  SELECT p.conv_id, p.i + 1, (SELECT list(m) FROM (SELECT min(struct_pack(cost := o.cost, audit := o.audit, s := o.s, lines := o.lines)) AS m0, struct_pack(s := any_value(o.s), cost := min(struct_pack(cost := o.cost, audit := o.audit, lines := o.lines)).cost, audit := min(struct_pack(cost := o.cost, audit := o.audit, lines := o.lines)).audit, lines := min(struct_pack(cost := o.cost, audit := o.audit, lines := o.lines)).lines) AS m
    FROM (SELECT unnest(flatten(list_transform(p.best, lambda x: list_filter([
        {'s': x.s, 'cost': x.cost + 4, 'audit': x.audit || 'D', 'lines': x.lines},
        CASE WHEN r.fault NOT IN ('b', 'd') AND x.s = 0 AND r.c = 's' THEN {'s': 1, 'cost': x.cost + t, 'audit': x.audit || 'K', 'lines': list_append(x.lines, r.role || ':' || r.text)} END,
        CASE WHEN r.fault NOT IN ('b', 'd') AND x.s <> 2 AND r.c = 'u' THEN {'s': 2, 'cost': x.cost + t, 'audit': x.audit || 'K', 'lines': list_append(x.lines, r.role || ':' || r.text)} END,
        CASE WHEN r.fault NOT IN ('b', 'd') AND x.s = 2 AND r.c = 'a' THEN {'s': 3, 'cost': x.cost + t, 'audit': x.audit || 'K', 'lines': list_append(x.lines, r.role || ':' || r.text)} END,
        CASE WHEN r.fault NOT IN ('b', 'd') AND x.s <> 2 THEN {'s': 2, 'cost': x.cost + t + 3, 'audit': x.audit || 'R', 'lines': list_append(x.lines, 'user:' || r.text)} END,
        CASE WHEN r.fault NOT IN ('b', 'd') AND x.s = 2 THEN {'s': 3, 'cost': x.cost + t + 3, 'audit': x.audit || 'R', 'lines': list_append(x.lines, 'assistant:' || r.text)} END,
        CASE WHEN r.fault NOT IN ('b', 'd') AND x.s <> 2 AND r.c = 'a' THEN {'s': 3, 'cost': x.cost + t + 3, 'audit': x.audit || 'IK', 'lines': list_concat(x.lines, ['user:', r.role || ':' || r.text])} END,
        CASE WHEN r.fault NOT IN ('b', 'd') AND x.s = 2 AND r.c = 'u' THEN {'s': 2, 'cost': x.cost + t + 3, 'audit': x.audit || 'IK', 'lines': list_concat(x.lines, ['assistant:', r.role || ':' || r.text])} END,
        CASE WHEN r.fault NOT IN ('b', 'd') AND x.s <> 2 THEN {'s': 3, 'cost': x.cost + t + 6, 'audit': x.audit || 'IR', 'lines': list_concat(x.lines, ['user:', 'assistant:' || r.text])} END,
        CASE WHEN r.fault NOT IN ('b', 'd') AND x.s = 2 THEN {'s': 2, 'cost': x.cost + t + 6, 'audit': x.audit || 'IR', 'lines': list_concat(x.lines, ['assistant:', 'user:' || r.text])} END
      ], lambda y: y IS NOT NULL)))) AS o) GROUP BY o.s))
  FROM step p JOIN (SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t FROM row_) r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
),
ended AS (
  SELECT conv_id, list_min(list_transform(best, lambda x: {'cost': x.cost + CASE x.s WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': x.audit || CASE x.s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'lines': list_concat(x.lines, CASE x.s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)})) AS e
  FROM step WHERE i = (SELECT max(i) FROM placed q WHERE q.conv_id IS NOT DISTINCT FROM step.conv_id)
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM row_ GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost,
  coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
"""



def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"({k}, '{t.label}', {_words(t.words)})" for k, t in enumerate(licences.TEMPLATES))
_PHRASES = ", ".join(f"({k}, {n}, {licences.place_in(t.words, p)}, {_words(p.split(' '))})" for k, t in enumerate(licences.TEMPLATES) for n, p in enumerate(t.phrases))
_BASE = ", ".join(f"({_words(p.split(' '))}, '{label}')" for p, label in licences.BASE.items())

#: op13 in DuckDB: every word of every text is a row; votes and phrases by joins.
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (SELECT r, k - 1 AS place, w[k] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
t(template, label, w) AS (VALUES {_TEMPLATES}), phr(template, phrase, start, p) AS (VALUES {_PHRASES}), b(p, label) AS (VALUES {_BASE}),
tw AS (SELECT template, k - 1 AS start, w[k] AS word FROM (SELECT template, w, unnest(range(1, len(w) + 1)) AS k FROM t)),
df AS (SELECT word, count(DISTINCT r) AS n FROM pos WHERE word IN (SELECT word FROM tw) GROUP BY word),
ranked AS (SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY coalesce(n, 0), word) AS k, length(bin((SELECT count(*) FROM d) // greatest(coalesce(n, 0), 1))) AS weight
  FROM (SELECT DISTINCT template, word FROM tw) LEFT JOIN df USING (word) QUALIFY k <= 16),
whole AS (SELECT template, sum(weight) FILTER (k <= 8) AS whole FROM ranked GROUP BY template),
mine AS (SELECT r, template, word, weight FROM (SELECT DISTINCT r, word FROM pos) JOIN ranked USING (word) QUALIFY row_number() OVER (PARTITION BY r, template ORDER BY k) <= 8),
may AS (SELECT r, template FROM mine JOIN whole USING (template) GROUP BY r, template, whole HAVING 100 * sum(weight) >= 60 * whole),
votes AS (SELECT r, template, word, weight, place - start AS o FROM mine JOIN may USING (r, template) JOIN pos USING (r, word) JOIN tw USING (template, word)),
grid(g) AS (VALUES (0), (1)),
agreed AS (SELECT r, template, g, bin, sum(weight) AS weight FROM (SELECT DISTINCT r, template, g, floor((o + g * 8)::DOUBLE / 16) AS bin, word, weight FROM votes, grid) GROUP BY ALL),
starts AS (SELECT r, template, phrase, p, k - start AS o FROM (SELECT r, w, template, phrase, p, start, unnest(range(0, len(w) - len(p) + 1)) AS k FROM (SELECT * FROM d WHERE r IN (SELECT r FROM may)), phr) WHERE list_slice(w, k + 1, k + len(p)) = p),
near AS (SELECT r, template, g, bin, count(DISTINCT phrase) AS seen FROM (SELECT r, template, phrase, g, floor((o + g * 8)::DOUBLE / 16) AS bin FROM starts, grid) GROUP BY ALL),
told AS (SELECT r, list(DISTINCT label) FILTER (100 * weight >= 60 * whole AND seen = (SELECT count(*) FROM phr WHERE phr.template = agreed.template)) AS more, max(weight / whole) AS share
  FROM agreed JOIN whole USING (template) JOIN (SELECT template, label FROM t) USING (template) LEFT JOIN near USING (r, template, g, bin) GROUP BY r),
base AS (SELECT r, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, list(DISTINCT label) AS labels FROM (SELECT r, w, p, label, unnest(range(0, len(w) - len(p) + 1)) AS k FROM d, b) WHERE list_slice(w, k + 1, k + len(p)) = p GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN told USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op13_licences": OP13_SQL, "op12_conversation_repair": OP12_SQL, "op11_divergence": OP11_SQL, "op2_warc_segments": OP2_SQL, "op7_url_aliases": OP7_SQL, "op8_decontaminate": OP8_SQL}
