"""Queries of image triage, with SQL that scores the same images by windows and regular expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import triage
from lectern.plans.catalog import query
from lectern.plans.extraction import _S, _sql
from lectern.plans.recipes import chosen, region_sql

_RUN = f"substr({region_sql('k')}, 1, 50)"
_OCR = f"concat('<!-- OCR extracted from a.png -->', chr(10), substr({region_sql('k')}, 1, 70), chr(10), repeat(concat(substr({region_sql('k + 1')}, 1, 20), '.', substr({region_sql('k')}, 1, 25), chr(10)), cast(k % 6 as int)), '<!-- end OCR -->')"
_CONTEXT = chosen(
    3, f"concat('Figure ', {_S('k')}, ' KD of Ab', {_S('k % 9')}, ' by SPR')", _OCR, f"concat('clones C05 B-12 D77 E9x F1.2 ', {_RUN})", "'survival of mice after challenge'", f"concat('ab', {_S('k % 9')}, ' and Ab', {_S('(k + 1) % 9')}, ' ', {_RUN})", "'a map of the site'", "'an alignment of the heavy chain'", "'Table of people'", "'an empty page'", "'another page'",
)
#: Images in twenty papers, targets in most of them, and the images that are known.
IMAGES_SQL = f"""SELECT k % 20 AS p, cast(floor(k / 20) as bigint) AS pos, concat('images/', {_S('k')}, '.png') AS image, CASE WHEN k % 4 = 0 THEN concat('images/', {_S('k + 1')}, '-b.png') ELSE '' END AS part, {_CONTEXT} AS context,
  {chosen(7, "''", "''", "'kinetics-plot'", "'SEQUENCE_DATA'", "'NOT_RELEVANT'", "' Efficacy chart'")} AS category, {chosen(2, "9000", "20000", "50000", "-1")} AS pixels, {chosen(5, "'_sequence'", "'KINETICS_DATA yes'", "'nothing'", "NULL", "'Quantitative'")} AS reply FROM (SELECT p_partkey AS k FROM part) AS keys"""
_FIELDS = chosen(1, "'vh_sequence_aa'", "'Binding_EC50'", "'In_Vivo_Efficacy'", "'Epitope'", "'CDRH3_Sequence'", "'vl_sequence_aa'", k="(k % 20 + cast(floor(k / 20) as bigint))")
TARGETS_SQL = f"SELECT k % 20 AS p, concat(' Ab', {_S('k % 9')}) AS name, {_FIELDS} AS field FROM (SELECT p_partkey AS k FROM part WHERE p_partkey < 55 AND p_partkey % 20 <> 19) AS keys"
KNOWN_SQL = f"SELECT k % 20 AS p, concat('images/', {_S('k')}, '.png') AS image FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 17 = 0) AS keys UNION ALL SELECT k % 20 AS p, concat('images/', {_S('k + 1')}, '-b.png') AS image FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 28 = 0) AS keys"

_CATEGORY = "CASE WHEN regexp_matches({0}, '(?i)^\\s*_*sequence') THEN 'SEQUENCE_DATA' WHEN regexp_matches({0}, '(?i)^\\s*_*kinetics') THEN 'KINETICS_DATA' WHEN regexp_matches({0}, '(?i)^\\s*_*quantitative') THEN 'QUANTITATIVE_TABLE' WHEN regexp_matches({0}, '(?i)^\\s*_*efficacy') THEN 'EFFICACY_DATA' ELSE 'NOT_RELEVANT' END".format


def _words(k: int) -> str:
    words, weight = triage.WORDS[k]
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN {weight} ELSE 0 END" for w in words)


_RELEVANT = f"""img AS ({IMAGES_SQL}), known AS (SELECT DISTINCT p, image FROM ({KNOWN_SQL})), target AS ({TARGETS_SQL}),
  gaps AS (SELECT p, list(lower(trim(name))) AS names, count(*) FILTER (field IN ('vh_sequence_aa', 'vl_sequence_aa', 'CDRH3_Sequence')) > 0 AS seq, count(*) FILTER (field = 'Binding_EC50') > 0 AS kin, count(*) FILTER (field = 'In_Vivo_Efficacy') > 0 AS eff FROM target GROUP BY p),
  asked AS (SELECT *, CASE WHEN seq::INT + kin::INT + eff::INT IN (0, 3) THEN ['SEQUENCE_DATA', 'KINETICS_DATA', 'QUANTITATIVE_TABLE', 'EFFICACY_DATA']
    ELSE CASE WHEN seq THEN ['SEQUENCE_DATA'] ELSE [] END || CASE WHEN kin THEN ['KINETICS_DATA', 'QUANTITATIVE_TABLE'] ELSE [] END || CASE WHEN eff THEN ['EFFICACY_DATA'] ELSE [] END || CASE WHEN eff AND NOT seq AND NOT kin THEN ['QUANTITATIVE_TABLE'] ELSE [] END END AS allowed FROM gaps),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY pos, image) AS rn FROM img WHERE pixels < 0 OR pixels + CASE WHEN part <> '' THEN 4000 ELSE 0 END >= 10000) WHERE rn <= 40),
  tagged AS (
    SELECT f.*, allowed, names, seq, kin, eff, o.image IS NOT NULL AS own, CASE WHEN o.image IS NOT NULL OR q.image IS NOT NULL THEN 'SEQUENCE_DATA' ELSE category END AS cat
    FROM firsts f JOIN asked USING (p) LEFT JOIN known o ON o.p = f.p AND o.image = f.image LEFT JOIN known q ON q.p = f.p AND q.image = f.part
  ), texts AS (SELECT *, lower(' ' || image || ' ' || context || ' ' || cat) AS t, {_CATEGORY('cat')} AS preset FROM tagged),
  told AS (
    SELECT *, list_contains(allowed, preset) AS fits, len(list_filter(names, lambda n: contains(t, n))) AS hits, regexp_matches(upper(t), '[A-Z-]{{40,}}') AS run,
      len(list_distinct(list_filter(regexp_extract_all(t, '\\b[a-z0-9]+([._-][a-z0-9]+)*\\b'), lambda x: length(x) >= 3 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')))) AS cluster,
      len(list_filter(string_split(regexp_extract(context, '(?s)<!-- OCR extracted from .*?-->\\s*(.*?)\\s*<!-- end OCR -->', 1), chr(10)), lambda x: contains(x, '.') AND length(x) >= 40)) >= 4 AS aligned FROM texts
  ), scored AS (
    SELECT *, own::INT * 100 + fits::INT * 40 + 25 * least(hits, 3) + CASE WHEN seq THEN {_words(0)} + CASE WHEN cluster >= 4 THEN 5 * least(cluster, 6) + run::INT * 18 ELSE 0 END ELSE 0 END + CASE WHEN kin THEN {_words(1)} ELSE 0 END + CASE WHEN eff THEN {_words(2)} ELSE 0 END
      + contains(t, 'fig')::INT * 2 + contains(t, 'table')::INT * 2 AS base, own OR (preset = 'SEQUENCE_DATA' AND fits) OR regexp_matches(t, '{'|'.join(triage.WORDS[0][0])}') OR aligned OR (run AND (cluster >= 4 OR hits >= 2)) AS evidence FROM told
  ), near AS (SELECT a.p, a.rn, min(abs(a.rn - b.rn)) AS d FROM scored a JOIN scored b ON a.p = b.p AND b.evidence GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, rn, image) AS place FROM (SELECT s.*, base + CASE d WHEN 0 THEN 12 WHEN 1 THEN 22 WHEN 2 THEN 10 ELSE 0 END AS score FROM scored s LEFT JOIN near USING (p, rn)))"""


def _relevant(spark, sf_dir):
    paper = F.concat(F.lit("P"), F.col("p").cast("string")).alias("paper_id")
    none = F.array().cast("array<string>")
    i = _sql(spark, sf_dir, "part", IMAGES_SQL)
    sizes = F.array(F.when(F.col("pixels") >= 0, F.col("pixels")), F.when(F.col("part") != "", F.lit(4000)).otherwise(F.lit(0)))
    images = i.select(paper, "pos", "image", F.when(F.col("part") != "", F.array("part")).otherwise(none).alias("parts"), F.lit(None).cast("string").alias("alt"), "context", "category", sizes.alias("pixels"))
    targets = _sql(spark, sf_dir, "part", TARGETS_SQL).select(paper, "name", F.array("field").alias("missing_fields"))
    return triage.relevant_images(images, targets, _sql(spark, sf_dir, "part", KNOWN_SQL).select(paper, "image")), i.select(paper, "image", "reply")


@query("x05_relevant_images", f"WITH {_RELEVANT} SELECT 'P' || p AS paper_id, image, (rn - 1)::INT AS idx, score::INT AS score, cat AS category FROM placed WHERE place <= 30")
def _(spark, sf_dir):
    return _relevant(spark, sf_dir)[0].drop("allowed")


@query("x05_triaged_images", f"""WITH {_RELEVANT} SELECT 'P' || p AS paper_id, image, (rn - 1)::INT AS idx, score::INT AS score, CASE WHEN fits THEN preset ELSE {_CATEGORY("coalesce(reply, '')")} END AS category
  FROM placed WHERE place <= 30 AND (fits OR list_contains(allowed, {_CATEGORY("coalesce(reply, '')")}))""")
def _(spark, sf_dir):
    return triage.triaged_images(*_relevant(spark, sf_dir))
