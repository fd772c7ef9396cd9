"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import tables
from lectern.llm.chat import paired_replies, preference_pairs
from lectern.llm.decontam import contaminated
from lectern.llm.exact import exact_groups
from lectern.llm.langid import identify
from lectern.llm.licenses import BLOCK_LINES, TEMPLATES, THRESHOLD, rendered_paths, scan
from lectern.llm.lm import STRENGTH, lm_scores
from lectern.llm.neardup import minhash_components
from lectern.llm.quality import quality_scores
from lectern.llm.sentencepiece import tokenised
from lectern.llm.sharding import balanced_shards
from lectern.llm.simhash import simhash_components
from lectern.llm.trie import prefix_trie
from lectern.llm.whitening import whiten


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_pairs(paired_replies(tables(spark, sf_dir, "conversations")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(tables(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(tables(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(tables(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(tables(spark, sf_dir, "documents"), width=3)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to the millionth, so that sums in another order give the same."""
    scores = lm_scores(tables(spark, sf_dir, "documents"))
    return scores.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(rendered_paths(tables(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(tables(spark, sf_dir, "documents"), shards=8)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(tables(spark, sf_dir, "conversations"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(tables(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(tables(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t
), a AS (
  SELECT conv_id, max(i) AS at, arg_max(text, i) AS reply FROM o WHERE lower(role) = 'assistant' GROUP BY conv_id
), s AS (
  SELECT o.conv_id, o.i, o.role, o.text AS c, CASE WHEN o.i = a.at THEN b.reply ELSE o.text END AS r, a.at IS NOT NULL AND b.at IS NOT NULL AS two
  FROM o LEFT JOIN a USING (conv_id) LEFT JOIN a AS b ON b.conv_id = xor(o.conv_id, 1)
), f AS (
  SELECT conv_id, bool_and(two) AS two, count(*) AS n,
         CASE WHEN NOT bool_and(two) THEN 0 ELSE coalesce(min(CASE WHEN c <> r THEN i END) - 1, count(*)) END AS n_common
  FROM s GROUP BY conv_id
), x AS (
  SELECT s.conv_id, s.i, f.n_common, f.n, f.two, CASE WHEN lower(s.role) = 'assistant' THEN '+' ELSE '-' END AS sign,
         '<|im_start|>' || replace(s.role, '<|im_', '<| im_') || chr(10) || replace(s.c, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS c,
         '<|im_start|>' || replace(s.role, '<|im_', '<| im_') || chr(10) || replace(s.r, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS r
  FROM s JOIN f USING (conv_id)
)
SELECT conv_id AS pair_id, CAST(any_value(n_common) AS INTEGER) AS n_common,
       coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i <= n_common), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i > n_common), '') AS chosen,
       coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE i > n_common AND two), '') AS rejected,
       coalesce(string_agg(sign || length(c), ',' ORDER BY i) FILTER (WHERE i > n_common), '') AS chosen_mask,
       coalesce(string_agg(sign || length(r), ',' ORDER BY i) FILTER (WHERE i > n_common AND two), '') AS rejected_mask,
       CASE WHEN NOT any_value(two) THEN 'unpaired' WHEN any_value(n_common) = any_value(n) THEN 'same' ELSE 'ok' END AS status
FROM x GROUP BY conv_id
"""

#: crc32 of an id's decimal text, bit by bit.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"
)
#: Words end with one end (a text of one space, which no word is) and begin after a start (two spaces).
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce({_CRC} % 7, 0) = 2 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS w
  FROM documents
), t AS (
  SELECT doc_id, held_out, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] ELSE '  ' END AS b, CASE WHEN i > 2 THEN w[i - 2] WHEN i = 2 THEN '  ' END AS a
  FROM (SELECT doc_id, held_out, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), one AS (SELECT c, count(*) AS n1 FROM t WHERE NOT held_out GROUP BY c),
two AS (SELECT b, c, count(*) AS n2 FROM t WHERE NOT held_out GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n3 FROM t WHERE NOT held_out AND a IS NOT NULL GROUP BY a, b, c),
after AS (SELECT c AS b, n1 AS m1 FROM one UNION ALL SELECT '  ', count(*) FROM d WHERE NOT held_out),
pairs AS (SELECT b AS a, c AS b, n2 AS m2 FROM two),
total AS (SELECT coalesce(sum(n1), 0) AS n, count(*) AS v FROM one),
p AS (
  SELECT doc_id, held_out, i, a, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, n, (coalesce(n1, 0) + 1) / (n + v + 1)::DOUBLE AS p1
  FROM t CROSS JOIN total LEFT JOIN one USING (c) LEFT JOIN two USING (b, c) LEFT JOIN three USING (a, b, c) LEFT JOIN after USING (b) LEFT JOIN pairs USING (a, b)
), q AS (SELECT *, (n2 + {STRENGTH[0]} * p1) / (m1 + {STRENGTH[0]}) AS p2 FROM p)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (n1 > 0) AS n_known, any_value(n)::BIGINT AS train_tokens,
       round(sum(log10(p1)), 6) AS base_score, round(sum(log10(CASE WHEN a IS NULL THEN p2 ELSE (n3 + {STRENGTH[1]} * p2) / (m2 + {STRENGTH[1]}) END)), 6) AS score
FROM q GROUP BY doc_id
"""

OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM h
"""


def _op7_sql() -> str:
    """TF-IDF cosine of every unit of every text to every template, and the nearest directory that declares a licence."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(TEMPLATES))
    words = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')".format
    return rf"""
WITH tpl(k, license, body) AS (VALUES {templates}),
tterm AS (SELECT k, unnest({words("body")}) AS term FROM tpl),
f AS (
  SELECT doc_id, coalesce(text, '') AS body, coalesce(source, 'unknown') AS s, coalesce(doc_id, 0) AS n FROM documents
), named AS (
  SELECT doc_id, body, CASE WHEN n % 20000 BETWEEN 40 AND 59 THEN s || '/NOTICE.' || n WHEN n % 2000 BETWEEN 20 AND 39 THEN s || '/' || n // 2000 || '/COPYING.' || n
    WHEN n % 200 < 20 THEN s || '/' || n // 2000 || '/' || n // 200 || '/LICENSE.' || n ELSE s || '/' || n // 2000 || '/' || n // 200 || '/' || n || '.txt' END AS path FROM f
), files AS (
  SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_matches(path, '/(LICENSE|COPYING|NOTICE)\.[^/]*$') AS holder FROM named
), size AS (SELECT count(*) AS total FROM files),
df AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({words("body")}) AS term FROM files) SEMI JOIN tterm USING (term) GROUP BY term),
idf AS (SELECT DISTINCT term, ln((total + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM tterm LEFT JOIN df USING (term), size),
tv AS (SELECT k, term, count(*) * any_value(idf) AS w FROM tterm JOIN idf USING (term) GROUP BY k, term),
tvec AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM tv),
lines AS (SELECT path, holder, body, list_filter(string_split_regex(body, '
|[

]'), lambda x: regexp_matches(lower(x), '[a-z0-9]')) AS l FROM files),
units AS (
  SELECT DISTINCT path, unnest(l || flatten(list_transform(l, lambda y: string_split_regex(y, '\.\s+'))) || CASE WHEN holder THEN [body] ELSE [] END) AS unit FROM lines
  UNION SELECT path, array_to_string(l[i : i + n - 1], ' ') FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM lines), (SELECT unnest(range(2, {BLOCK_LINES} + 1)) AS n)
), uterm AS (SELECT path, unit, term, count(*) AS tf FROM (SELECT path, unit, unnest({words("unit")}) AS term FROM units) GROUP BY ALL),
weighed AS (SELECT path, unit, term, tf * coalesce(idf, ln(total + 1) + 1) AS w FROM uterm LEFT JOIN idf USING (term), size),
norms AS (SELECT path, unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT path, unit, k, sum(x.w * t.w) AS dot FROM weighed x JOIN tvec t USING (term) GROUP BY ALL),
own AS (
  SELECT path, license, score FROM (SELECT path, k, round(dot / norm, 6) AS score, row_number() OVER (PARTITION BY path ORDER BY round(dot / norm, 6) DESC, k) AS r FROM dots JOIN norms USING (path, unit)) JOIN tpl USING (k)
  WHERE r = 1 AND score >= {THRESHOLD}
), licensed AS (SELECT dir AS above, arg_min(license, (-score, license)) AS of_dir FROM own JOIN files USING (path) WHERE holder GROUP BY dir),
above AS (
  SELECT dir, up, array_to_string(string_split(dir, '/')[1 : len(string_split(dir, '/')) - up], '/') AS above
  FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS up FROM (SELECT DISTINCT dir FROM files))
), nearest AS (SELECT dir, min(up) AS up, arg_min(of_dir, up) AS of_dir FROM above JOIN licensed USING (above) GROUP BY dir)
SELECT doc_id, path, coalesce(license, of_dir) AS license, CASE WHEN license IS NOT NULL THEN 'header' WHEN of_dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS found, score,
       CASE WHEN license IS NULL THEN up END::INT AS distance
FROM files LEFT JOIN own USING (path) LEFT JOIN nearest USING (dir)
"""


#: Nodes as lists of turns; of a conversation's equal turn numbers (none in the tables) the order is that of role and text.
OP11_SQL = rf"""
WITH t AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, {_CRC.replace("doc_id", "conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base, list(x ORDER BY i) AS l FROM t GROUP BY conv_id),
p AS (SELECT c.conv_id, list_concat(coalesce(b.l[1 : c.h], []), c.l[c.h + 1 :]) AS l FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
d AS (
  SELECT conv_id, len(l) AS n, depth, sha256(to_json(l[1 : depth])::VARCHAR) AS k, CASE WHEN depth > 0 THEN sha256(to_json(l[1 : depth - 1])::VARCHAR) END AS up, CASE WHEN depth > 0 THEN length(l[depth].t) ELSE 0 END AS chars
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM p)
), node AS (
  SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends
  FROM d GROUP BY depth, k
), kids AS (SELECT up AS k, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT a.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(node.saved) AS saved
  FROM (SELECT DISTINCT b.k AS k, d.k AS under FROM d JOIN d AS b ON b.conv_id = d.conv_id AND b.depth <= d.depth) AS a JOIN node ON node.k = a.under LEFT JOIN kids ON kids.k = node.k GROUP BY a.k
)
SELECT node.conv_id, node.depth, over.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN node AS over ON over.k = node.up
"""

#: Every two documents of like sizes that share a shingle, counted; components by reaching out along links.
OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM common WHERE 100 * c >= 80 * (nu + nv - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.other)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_language_id": op4_language_id,
        "op5_simhash": op5_simhash,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_license_scan": op7_license_scan,
        "op8_sharding": op8_sharding,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_decontamination": op10_decontamination,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_minhash": op12_minhash,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op6_lm_scoring": OP6_SQL, "op7_license_scan": _op7_sql(), "op11_conversation_trie": OP11_SQL, "op12_minhash": OP12_SQL}
