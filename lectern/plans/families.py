"""Queries of antibodies' families: parents of variants and the chains that these take over, with SQL over the same names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import inheritance, papers
from lectern.plans.catalog import query
from lectern.plans.extraction import _S, _sql
from lectern.plans.recipes import chosen, region_sql

_KEYS = "SELECT c_custkey AS k, cast(floor(c_custkey / 6) as bigint) AS p, c_custkey % 6 AS i FROM customer"
_BASE = f"concat('Ab', {_S('p')})"
_NAME = f"CASE i WHEN 0 THEN {_BASE} WHEN 1 THEN concat({_BASE}, '-H2') WHEN 2 THEN concat({_BASE}, '-H2-LS') WHEN 3 THEN concat('x', {_BASE}, ' wild-type') WHEN 4 THEN concat({_BASE}, ' D54G') ELSE concat('Zq', {_S('k')}) END"
_VALUE = f"CASE WHEN (k * {{0}} + p) % 4 < {{1}} THEN '{{2}}' WHEN (k + p) % 7 = 0 THEN 'short' ELSE concat('{{3}}', {region_sql('k')}) END"
#: Six names a paper: a parent, variants of it and of each other, and one of another family.
FAMILY_SQL = f"SELECT k, p, {_NAME} AS name, {_VALUE.format(3, 2, '', 'A')} AS vh, {_VALUE.format(5, 3, 'N/A', 'C')} AS vl FROM ({_KEYS}) AS keys"
_SAYS = [
    chosen(5, f"concat('The heavy chain of {{0}}-H2 is', chr(10), 'not told; the light chain of ', {_BASE}, '-H2 is identical to that of ', {_BASE}, '.')", f"concat({_BASE}, '-H2 retained the VH of the original.')", "'Nothing is said.'", k="p"),
    chosen(7, f"concat({_BASE}, '-H2-LS shared the  light chain of ', {_BASE}, '-H2: the heavy chain of ', {_BASE}, '-H2-LS is unchanged from ', {_BASE}, '-H2')", f"concat('LS has the same VL as ', {_BASE}, '-H2; ')", "'The light chain was made.'", k="p"),
    chosen(11, f"concat('D54G: the vh is the same as in WT. The kappa chain of ', {_BASE}, ' D54G is unchanged relative to WT')", f"concat('x', {_BASE}, ' wild-type retained both heavy chain and light chain of ', {_BASE}, '.')", "''", k="p"),
]
TEXT_SQL = f"SELECT p, concat({', chr(10), '.join(s.replace('{0}', 'Ab') for s in _SAYS)}) AS t FROM (SELECT DISTINCT cast(floor(c_custkey / 6) as bigint) AS p FROM customer) AS keys"

_PLAIN = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')".format
_NOISE = "\\b(wt|wild[- ]type|variant|mutant|mutation|chimera|chimeric|delet(e|ed|ion)|del|fr\\d+([- ]\\d+)?|cdr\\d+([- ]?[a-z0-9]+)?|[a-z]\\d{1,3}[a-z]|ls)\\b"
#: Every two names of a paper, compared.
_PAIRS = f"""fam AS ({FAMILY_SQL}), n AS (SELECT DISTINCT p, name, {_PLAIN('name')} AS key, {_PLAIN(f"regexp_replace(lower(name), '{_NOISE}', ' ', 'g')")} AS bare FROM fam),
  pairs AS (SELECT * FROM (SELECT c.p, c.name AS child, d.name AS parent, length(d.key) AS size, d.key AS pkey, c.key AS ckey,
    CASE WHEN c.bare = d.key THEN 3 WHEN starts_with(c.key, d.key) OR ends_with(c.key, d.key) THEN 2 WHEN starts_with(c.bare, d.key) OR ends_with(c.bare, d.key) THEN 1 END AS rank
    FROM n c JOIN n d ON c.p = d.p AND c.name <> d.name AND d.key <> '' AND length(d.key) < length(c.key)) WHERE rank IS NOT NULL)"""
_CLAUSES = f"""doc AS ({TEXT_SQL}), parts AS (SELECT p, string_split(regexp_replace(array_to_string(list_transform(string_split_regex(t, '\\n+'), lambda x: regexp_replace(trim(x), '\\s+', ' ', 'g')), chr(1)), '([.;:])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS c FROM doc),
  clause AS (SELECT p, pos, trim(c[pos]) AS clause, lower(c[pos]) AS low, {_PLAIN('c[pos]')} AS key FROM (SELECT p, c, unnest(range(1, len(c) + 1)) AS pos FROM parts) WHERE regexp_matches(lower(c[pos]), 'identical|same|unchanged|retain|shared')),
  told AS (
    SELECT pairs.p, child, parent, rank, size, field, arg_min(clause, pos) AS evidence FROM pairs JOIN clause USING (p), (VALUES ('vh_sequence_aa', 'heavy chain|vh|heavy-chain'), ('vl_sequence_aa', 'light chain|vl|light-chain|kappa chain|lambda chain')) f(field, words)
    WHERE regexp_matches(low, words) AND (contains(key, ckey) OR contains(key, pkey) OR len(list_filter(string_split_regex(lower(child), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ('wt', 'wild', 'type') AND NOT list_contains(string_split_regex(lower(parent), '[^a-z0-9]+'), x) AND contains(low, x))) > 0)
      AND (contains(key, pkey) OR regexp_matches(low, 'wt|wild type|wild-type|parent|template|original')) GROUP BY ALL
  )"""
_OWN = "v0 AS (SELECT p, name, 'vh_sequence_aa' AS field, vh AS value, name AS origin FROM fam WHERE length(vh) > 90 UNION ALL SELECT p, name, 'vl_sequence_aa', vl, name FROM fam WHERE length(vl) > 90)"
_OPEN = "open AS (SELECT p, name, 'vh_sequence_aa' AS field FROM fam WHERE vh = '' UNION ALL SELECT p, name, 'vl_sequence_aa' FROM fam WHERE vl = 'N/A')"


def _generation(n: int) -> str:
    """What names take when their parents have what the generation before left them."""
    return f"""o{n} AS (SELECT t.*, v.value, v.origin, -rank * 1000000 - size * 1000 + rn AS ord FROM (SELECT *, dense_rank() OVER (PARTITION BY p ORDER BY parent) AS rn FROM told) t JOIN open ON open.p = t.p AND open.name = t.child AND open.field = t.field JOIN v{n - 1} v ON v.p = t.p AND v.name = t.parent AND v.field = t.field),
  t{n} AS (SELECT * FROM (SELECT *, min(ord) OVER (PARTITION BY p, child) AS first FROM o{n}) WHERE ord = first), v{n} AS (SELECT * FROM v0 UNION ALL SELECT p, child, field, value, origin FROM t{n})"""


def _family(spark, sf_dir):
    paper = F.concat(F.lit("P"), F.col("p").cast("string")).alias("paper_id")
    f = _sql(spark, sf_dir, "customer", FAMILY_SQL)
    rows = f.select(paper, F.col("k").alias("idx"), "name", F.col("vh").alias("vh_sequence_aa"), F.col("vl").alias("vl_sequence_aa"), F.lit("given").alias("CDRH3_Sequence"))
    return rows, _sql(spark, sf_dir, "customer", TEXT_SQL).select(paper, F.col("t").alias("text"))


@query("j06_variant_parents", f"""WITH {_PAIRS} SELECT 'P' || p AS paper_id, child, parent, rank FROM (SELECT *, row_number() OVER (PARTITION BY p, child ORDER BY rank DESC, size DESC, parent) AS r FROM pairs) WHERE r = 1""")
def _(spark, sf_dir):
    return inheritance.variant_parents(_family(spark, sf_dir)[0])


@query("f26_chain_evidence", f"""WITH {_PAIRS}, {_CLAUSES} SELECT 'P' || pairs.p AS paper_id, pairs.child, pairs.parent, coalesce(evidence, '') AS evidence FROM pairs LEFT JOIN told ON told.p = pairs.p AND told.child = pairs.child AND told.parent = pairs.parent AND field = 'vl_sequence_aa'""")
def _(spark, sf_dir):
    rows, texts = _family(spark, sf_dir)
    pairs = inheritance.candidate_parents(rows).join(texts, "paper_id")
    return pairs.select("paper_id", "child", "parent", papers.chain_evidence(F.col("text"), F.col("child"), F.col("parent"), "vl_sequence_aa").alias("evidence"))


@query("j06_inherited_chains", f"""WITH {_PAIRS}, {_CLAUSES}, {_OWN}, {_OPEN}, {_generation(1)}, {_generation(2)}, {_generation(3)}, {_generation(4)}
  SELECT 'P' || t.p AS paper_id, k AS idx, child AS name, t.field, value, parent AS from_antibody, lower(origin) AS origin, evidence FROM t4 t JOIN fam ON fam.p = t.p AND fam.name = t.child""")
def _(spark, sf_dir):
    return inheritance.inherited_chains(*_family(spark, sf_dir))
