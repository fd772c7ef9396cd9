"""Queries of predicates and text functions over varied text, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import jsontext, text, units
from lectern.operators import blocks, merge, papers, records, skeleton
from lectern.plans import recipes
from lectern.plans.catalog import query
from lectern.plans.extraction import NON_CORE_SQL, PAPERS_SQL, TEXT_SQL, _ruled, _S, _sides, _sql
from lectern.plans.recipes import LABELS_SQL, chosen, q, table

_ITEMS = "list_distinct(list_filter(list_transform(string_split_regex({0}, '[,;/]'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> ''))".format


@query("u01_token_jaccard", _ruled("Experiment", f"CASE WHEN len({_ITEMS('g')}) > 0 AND len({_ITEMS('p')}) > 0 THEN len(list_intersect({_ITEMS('g')}, {_ITEMS('p')}))::DOUBLE / len(list_distinct({_ITEMS('g')} || {_ITEMS('p')})) END AS j"))
def _(spark, sf_dir):
    rows = _sides(spark, sf_dir).filter("field = 'Experiment' AND matched")
    return rows.select("paper_id", "ab_idx", text.jaccard(text.list_tokens(F.col("gt")), text.list_tokens(F.col("pred"))).alias("j"))


_K, _K1 = _S("k"), _S("k + 1")
_VALUES = [
    f"concat({_K}, ' to ', {_K1}, ' nM')", f"concat({_K}, ', ', {_K1}, ' nM')", f"concat('> ', {_K}, ' nM')", f"concat({_K}, '.5 nM')", f"concat({_S('k % 9')}, '.7 x 10^-', {_S('k % 7')}, ' M')",
    f"concat({_K}, ' ± 2')", f"concat('KD ', {_K}, 'e-9')", f"concat({_K}, ' nM; ', {_K})", f"concat({_K}, ' 1/Ms')",
]
QUANTITY_SQL = f"SELECT k, {chosen(2, *_VALUES)} AS t FROM (SELECT p_partkey AS k FROM part) AS keys"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(t, '[×xX\*]\s*10\s*\^?\s*[\(\[]?\s*-?\d+\s*[\)\]]?', '', 'g'), '\d+\.?\d*[eE][+-]?\d+', 'NUM', 'g'), '\b1/[A-Za-z]+', '', 'g')"


@query("m01_ambiguous", rf"SELECT k, regexp_matches(t, '\b(and|or|to|respectively)\b|,\s*\d|[;；]|>\s*\d|<\s*\d|±|\brange\b') OR len(regexp_extract_all({_BARE}, '\b\d+\.?\d*\b')) > 1 AS several FROM ({QUANTITY_SQL})")
def _(spark, sf_dir):
    return _sql(spark, sf_dir, "part", QUANTITY_SQL).select("k", units.several(F.col("t")).alias("several"))


@query("a19_name_like_tokens", """SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9-]{3,}'), lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]'))))::INT AS n FROM documents""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.name_like_tokens(F.col("text")).alias("n"))


@query("a29_protected_tokens", """SELECT doc_id, list_sort(regexp_extract_all(text, '(\\d+)')) = list_sort(regexp_extract_all(other, '(\\d+)')) AS same
  FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN lower(text) WHEN 1 THEN replace(text, '1', '7') ELSE substr(text, 20) END AS other FROM documents)""")
def _(spark, sf_dir):
    d = F.col("doc_id") % 3
    other = F.when(d == 0, F.lower("text")).when(d == 1, F.replace("text", F.lit("1"), F.lit("7"))).otherwise(F.substr("text", F.lit(20)))
    return table(spark, sf_dir, "documents").select("doc_id", records.same_tokens(F.col("text"), other, r"(\d+)").alias("same"))


@query("f19_plain_text", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.plain(F.col("html")).alias("t"))


@query("p12_may_create", f"""SELECT k, NOT regexp_matches(target, 'control mAbs') AND (length(loop) >= 5) AND (k % 3 = 0 OR kd <> '' OR k % 7 = 1) AS may FROM ({NON_CORE_SQL})""")
def _(spark, sf_dir):
    r = _sql(spark, sf_dir, "part", NON_CORE_SQL)
    may = records.may_create(records.cited(F.col("target")), F.col("k") % 3 == 0, F.lit("short"), F.col("loop"), F.col("kd"), F.when(F.col("k") % 7 == 1, "IgG1").otherwise(""))
    return r.select("k", may.alias("may"))


_NAME = f"concat('C', {_S('k % 40')})"
_CONTEXTS = [f"concat('heavy ', {_NAME}, ' (h)')", f"concat({_NAME}, 'x')", "'C-1 and C 39x'", f"concat('c-', {_S('k % 40')}, '.')", "'nothing of it'", "'the alias ZZ9'"]
CONTEXT_SQL = f"SELECT k, {_NAME} AS name, {chosen(3, *_CONTEXTS)} AS t FROM (SELECT p_partkey AS k FROM part) AS keys"


@query("j04_accession_scores", f"""SELECT k, CASE WHEN regexp_matches(lower(t), '(^|[^a-z0-9])' || lower(name) || '([^a-z0-9]|$)') THEN 4 WHEN contains(regexp_replace(lower(t), '[^a-z0-9]', '', 'g'), lower(name)) THEN 3 WHEN contains(t, 'ZZ9') THEN 2 ELSE 0 END AS score FROM ({CONTEXT_SQL})""")
def _(spark, sf_dir):
    return _sql(spark, sf_dir, "part", CONTEXT_SQL).select("k", papers.name_score(F.col("t"), F.col("name"), F.array(F.lit("ZZ9"), F.lit("q"))).alias("score"))


@query("p07_auxiliary_names", f"""SELECT k, name, regexp_matches(name, '(?i)^IG[HKL]V\\d|^V[HKL]\\d+-\\d+') OR regexp_matches(name, '(?i).+-[HL]\\d+$') OR regexp_matches(name, '(?i).*/KJ\\d+$') AS auxiliary
  FROM (SELECT k, unnest(string_split_regex(genes || ' ' || names || ' ab7-H3 C05/KJ' || k, '\\s+')) AS name FROM ({PAPERS_SQL}))""")
def _(spark, sf_dir):
    p = _sql(spark, sf_dir, "part", PAPERS_SQL)
    words = F.split(F.concat_ws(" ", "genes", "names", F.concat(F.lit("ab7-H3 C05/KJ"), F.col("k").cast("string"))), r"\s+")
    n = p.select("k", F.explode(words).alias("name"))
    return n.withColumn("auxiliary", records.auxiliary_name(F.col("name")))


@query("p08_precise_type", f"""WITH {LABELS_SQL} SELECT t.paper_id, t.ab_idx, CASE WHEN lower(t.g) IN ('mab', 'monoclonal antibody') AND contains(lower(i.g), 'igg') THEN 'IgG' WHEN lower(t.g) IN ('mab', 'monoclonal antibody') AND contains(lower(i.g), 'igm') THEN 'IgM' ELSE t.g END AS kind
  FROM sides t JOIN sides i ON i.paper_id = t.paper_id AND i.ab_idx = t.ab_idx WHERE t.field = 'Antibody_Type' AND i.field = 'Antibody_Isotype'""")
def _(spark, sf_dir):
    return recipes.ground_truth(spark, sf_dir).select("paper_id", "ab_idx", records.precise_type(F.col("Antibody_Type"), F.col("Antibody_Isotype")).alias("kind"))


_SEQ = recipes.region_sql("k")
_PLACES = [f"concat('x', substr({_SEQ}, 7, 14), ' ', substr({_SEQ}, 21, 30))", f"lower(substr({_SEQ}, 1, 40))", f"substr({_SEQ}, 3, 7)", "'WWWWWWWWWWWWWWWWWW'", f"substr({_SEQ}, 5, 9)"]
FOUND_SQL = f"SELECT k, {_SEQ} AS s, {chosen(3, *_PLACES)} AS t FROM (SELECT c_custkey AS k FROM customer) AS keys"


def _windows() -> str:
    """Whether any window of any size stands in the text: sizes 18 to 8, half a size apart."""
    return " OR ".join(f"len(list_filter(range(1, greatest(length(s) - {n} + 1, 1) + 1, {n // 2}), lambda i: contains(b, substr(s, i::INT, {n})))) > 0" for n in (18, 15, 12, 10, 8))


@query("j12_corroborated", f"SELECT k, {_windows()} AS found FROM (SELECT k, s, upper(replace(t, ' ', '')) AS b FROM ({FOUND_SQL}))")
def _(spark, sf_dir):
    return _sql(spark, sf_dir, "customer", FOUND_SQL).select("k", records.corroborated(F.col("s"), F.col("t")).alias("found"))


@query("p10_public_json", """SELECT o_orderkey, '{"status":"' || o_orderstatus || '","list":[{"n":' || o_orderkey || '}]}' AS body FROM orders""")
def _(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('", "_x": {"a": 1}, "list": [{"n": '), k, F.lit(', "_note": "b"}]}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", records.public_json(body).alias("body"))


@query("f24_source_priority", "SELECT source, p, count(*) AS n FROM (SELECT c_mktsegment AS source, 0 AS p FROM customer UNION ALL SELECT v, p FROM (VALUES ('text', 1), ('figure', 1), ('table', 1), ('sequence_image', 2), ('api', 3)) t(v, p), nation) GROUP BY ALL")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "nation").select(F.explode(F.array(*map(F.lit, ["text", "figure", "table", "sequence_image", "api"]))).alias("source"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("source")).unionByName(own)
    return rows.groupBy("source", merge.priority(F.col("source")).alias("p")).agg(F.count("*").alias("n"))


_SECTION = f"concat('# Intro', chr(10), structures, chr(10), {chosen(5, q('# References'), q('# Acknowledgements and funding'), q('## Methods'))}, chr(10), accession, chr(10), refs, chr(10), '# Results', chr(10), names, chr(10))"
SECTIONS_SQL = f"SELECT k, {_SECTION} AS t, accession FROM ({PAPERS_SQL}) AS papers"


@query("w12_drop_sections", f"""SELECT k, list_aggregate(list_filter(string_split(replace(t, chr(10) || '#', chr(10) || chr(1) || '#'), chr(1)), lambda p: NOT regexp_matches(p, '^#+ (References|Acknowledgements)') OR contains(lower(p), 'genbank')), 'string_agg', '') AS t FROM ({SECTIONS_SQL})""")
def _(spark, sf_dir):
    return _sql(spark, sf_dir, "part", SECTIONS_SQL).select("k", blocks.drop_sections(F.col("t"), "(?i)^(references|acknowledg)", "(?i)genbank").alias("t"))


@query("g05_json_salvage", f"""SELECT k, CASE WHEN k % 5 = 0 THEN NULL ELSE '{{"k":' || k || ',"names":"' || names || '"}}' END AS found FROM ({PAPERS_SQL})""")
def _(spark, sf_dir):
    k = F.col("k").cast("string")
    one = F.concat(F.lit('{"names": "'), "names", F.lit('", "k": '), k, F.lit("}"))
    reply = F.when(F.col("k") % 5 == 0, F.concat(F.lit("no object {here: "), k)).when(F.col("k") % 5 == 1, one).when(F.col("k") % 5 == 2, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(F.col("k") % 5 == 3, F.concat(F.lit('Sure: {"draft": {"k": 1}} then '), one)).otherwise(F.concat(F.lit("{broken "), one, F.lit(" end")))
    return _sql(spark, sf_dir, "part", PAPERS_SQL).select("k", jsontext.json_object(reply).alias("found"))


@query("f01_match_keys", f"SELECT k, regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') AS key, regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), ' ', '', 'g'), '-', '', 'g'), '_', '', 'g') AS name FROM ({TEXT_SQL})")
def _(spark, sf_dir):
    return _sql(spark, sf_dir, "part", TEXT_SQL).select("k", text.match_key(F.col("t")).alias("key"), text.name_key(F.col("t")).alias("name"))


@query("n03_identity_keys", f"""WITH {LABELS_SQL}, w AS (SELECT ab_idx, max(CASE WHEN field = 'Target_Name' THEN g END) AS t, max(CASE WHEN field = 'Antibody_Type' THEN g END) AS a, max(CASE WHEN field = 'Experiment' THEN g END) AS e, max(CASE WHEN field = 'Structure' THEN g END) AS s FROM sides GROUP BY ab_idx)
  SELECT k, lower(c_name) || CASE WHEN t || a || e || s <> '' THEN '|' || lower(t || '|' || a || '|' || e || '|' || s) ELSE '' END AS key FROM w JOIN base ON k = ab_idx""")
def _(spark, sf_dir):
    gt = recipes.ground_truth(spark, sf_dir)
    m = F.create_map(*[x for f in skeleton.KEY_FIELDS for x in (F.lit(f), F.col(f))])
    return gt.select(F.col("ab_idx").alias("k"), skeleton.identity(m).alias("key"))
