"""Queries of sequence databases' flat files and of what they give to a paper's antibodies, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import accessions
from lectern.plans.catalog import query
from lectern.plans.extraction import _S, _sql
from lectern.plans.recipes import chosen, region_sql
from lectern.sources import flatfiles

_NL, _IN = "chr(10)", "'                     '"


def _text(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _wrapped(value: str, at: int) -> str:
    """A qualifier's value over two lines."""
    return f"substr({value}, 1, {at}), {_NL}, {_IN}, substr({value}, {at + 1}, 400)"


_ACCESSION = f"concat('MN', {_S('100000 + k')})"
_NAME = f"concat('Nq', {_S('k % 50')}, '-', {_S('k')})"
#: What a record says it is of: its own antibody as a word, run together or by its last part, another one, or none.
_OF = chosen(3, _NAME, f"replace({_NAME}, '-', '')", f"concat('x', {_S('k')}, 'HC')", f"concat('clone Z', {_S('k')})", "'none'", f"concat('isolate ', {_NAME}, ';')")
_PRODUCT = chosen(2, f"concat('immunoglobulin heavy chain', {_NL}, {_IN}, 'variable region')", "'immunoglobulin kappa light chain'", "'hypothetical protein'", "'IGHV3 product'", f"concat('anti-X light chain', {_NL}, {_IN}, 'variable region')")
_OTHER = chosen(5, "'immunoglobulin light chain, v-region'", "'immunoglobulin heavy chain'", "'VH domain'", "'lambda chain variable domain'")
_N = "cast(k % 97 + 1 as int)"
_AT = chosen(
    7, f"concat('<', {_S(_N)}, '..', {_S('k % 97 + 300')})", f"concat('complement(', {_S(_N)}, '..>', {_S('k % 97 + 120')}, ')')", f"concat('join(', {_S(_N)}, '..150,', {_NL}, {_IN}, 'complement(160..', {_S('170 + k % 9')}, '))')",
    f"concat('complement(join(', {_S(_N)}, '..110,', {_S('120 + k % 7')}, '..136,140))')", f"concat('order(5..9,complement(join(11..', {_S('15 + k % 9')}, ',complement(30..33))))')",
)
#: A record of every part: two coding features, a third of whose translations are missing.
FLAT_SQL = f"""SELECT k, cast(floor(k / 3) as bigint) AS p, {_text(
    "'LOCUS       '", _ACCESSION, "'   400 bp    mRNA    linear   PRI 01-JAN-2020'", _NL, "'DEFINITION  Homo sapiens isolate '", _OF, "' anti-X'", _NL, "'            monoclonal antibody mRNA, partial cds.'", _NL,
    "'ACCESSION   '", _ACCESSION, _NL, "'VERSION     '", _ACCESSION, "'.'", _S("k % 3 + 1"), _NL, "'SOURCE      Homo sapiens (human)'", _NL, "'  ORGANISM  Homo sapiens'", _NL, "'            Eukaryota.'", _NL, "'FEATURES             Location/Qualifiers'", _NL,
    "'     source          1..400'", _NL, _IN, "'/organism=\"Homo sapiens\"'", _NL,
    "'     CDS             '", _AT, _NL, _IN, "'/codon_start=1'", _NL, _IN, "'/product=\"'", _PRODUCT, "'\"'", _NL, _IN, "'/note=\"a \"\"quoted\"\"'", _NL, _IN, "'note ' ", _S("k % 4"), "'\"'", _NL, _IN, "'/protein_id=\"QK'", _S("k"), "'.1\"'", _NL, _IN, "'/translation=\"'",
    _wrapped(f"substr(concat({region_sql('k')}, {region_sql('k + 7')}), 1, cast(k % 60 + 80 as int))", 44), "'\"'", _NL,
    "'     CDS             7..300'", _NL, _IN, "'/product=\"'", _OTHER, "'\"'", _NL, f"CASE WHEN k % 3 = 0 THEN '' ELSE concat({_IN}, '/translation=\"', substr({region_sql('k + 3')}, 1, cast(k % 11 + 86 as int)), '\"', {_NL}) END",
    "'ORIGIN'", _NL, "'        1 acgtacgtac ggttaaccgg'", _NL)} AS t FROM (SELECT p_partkey AS k FROM part) AS keys"""

#: The features of a record's text by regular expressions: lines of a key begin after five spaces.
_BLOCKS = f"""flat AS ({FLAT_SQL}), blocks AS (
    SELECT regexp_extract(t, 'ACCESSION +(\\S+)', 1) AS accession, regexp_extract(t, 'VERSION +(\\S+)', 1) AS record_id, regexp_replace(regexp_extract(t, 'DEFINITION +([^.]*)\\.\\n', 1), '\\n +', ' ', 'g') AS description,
      unnest(string_split(regexp_replace(regexp_extract(t, '(?s)FEATURES[^\\n]*(\\n.*)ORIGIN', 1), '\\n {{5}}([A-Za-z])', chr(1) || '\\1', 'g'), chr(1))[2:]) AS b, generate_subscripts(string_split(regexp_replace(regexp_extract(t, '(?s)FEATURES[^\\n]*(\\n.*)ORIGIN', 1), '\\n {{5}}([A-Za-z])', chr(1) || '\\1', 'g'), chr(1))[2:], 1) - 1 AS pos FROM flat
  ), feats AS (
    SELECT accession, record_id, description, pos, regexp_extract(b, '^(\\S+)', 1) AS key, regexp_replace(regexp_extract(b, '^\\S+\\s+([^/]*)', 1), '\\s', '', 'g') AS loc,
      regexp_replace(regexp_extract(b, '/product="([^"]*)"', 1), '\\n +', ' ', 'g') AS product, replace(regexp_replace(regexp_extract(b, '/note="((?:[^"]|"")*)"', 1), '\\n +', ' ', 'g'), '""', '"') AS note,
      regexp_extract(b, '/protein_id="([^"]*)"', 1) AS protein_id, regexp_replace(regexp_extract(b, '/translation="([^"]*)"', 1), '\\s', '', 'g') AS translation FROM blocks
  ), told AS (
    SELECT *, CASE WHEN regexp_matches(w, 'immunoglobulin (variable region )?heavy chain|heavy chain (variable|variable region)|ighv|vh\\b') THEN 'heavy'
        WHEN regexp_matches(w, 'immunoglobulin (variable region )?(kappa |lambda )?light chain|light chain (variable|variable region)|igk|igl|vk\\b|vl\\b|kappa|lambda') THEN 'light' ELSE 'unknown' END AS chain,
      regexp_matches(w, 'variable region|variable domain|v-region|v region') AS variable
    FROM (SELECT *, lower(product || ' ' || note) AS w FROM feats)
  ), coding AS (SELECT * FROM told WHERE key = 'CDS' AND translation <> '')"""
#: What stands open before each span: closed brackets are taken out from within, and open complements are counted.
_CLOSED = "regexp_replace(" * 4 + "array_to_string(tokens[1 : i - 1], ',')" + ", '\\w+\\([^()]*\\)', '', 'g')" * 4


def _records(spark, sf_dir):
    return flatfiles.parse_records(_sql(spark, sf_dir, "part", FLAT_SQL), "t")


@query("b13_flat_features", f"""WITH {_BLOCKS}, tokens AS (SELECT *, regexp_extract_all(loc, '(\\w+\\(|\\)|[^(),]+)', 1) AS tokens FROM feats),
  spans AS (SELECT accession, pos, tokens[i] AS s, {_CLOSED} AS open FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM tokens) WHERE NOT regexp_matches(tokens[i], '[()]')),
  placed AS (SELECT accession, pos, string_agg(regexp_extract(s, '(\\d+)', 1) || CASE WHEN contains(s, '<') THEN '<' ELSE '' END || '-' || regexp_extract(s, '(\\d+)$', 1) || CASE WHEN contains(s, '>') THEN '>' ELSE '' END
    || CASE WHEN ((length(open) - length(replace(open, 'complement(', ''))) // 11) % 2 = 1 THEN '-' ELSE '+' END, ' ' ORDER BY regexp_extract(s, '(\\d+)', 1)::INT) AS spans FROM spans GROUP BY ALL)
  SELECT accession, record_id, description, pos::INT AS pos, key, loc AS location, spans, product, note, protein_id, translation FROM feats JOIN placed USING (accession, pos)""")
def _(spark, sf_dir):
    f = _records(spark, sf_dir).select("accession", "record_id", "description", F.posexplode("features").alias("pos", "f"))
    found = F.array_sort(flatfiles.spans(F.col("f.location")), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    mark = lambda on, m: F.when(on, m).otherwise("")
    shown = F.transform(found, lambda s: F.concat(s["start"].cast("string"), mark(s["open_start"], "<"), F.lit("-"), s["stop"].cast("string"), mark(s["open_stop"], ">"), F.when(s["strand"] < 0, "-").otherwise("+")))
    get = lambda n: flatfiles.qualifier(F.col("f"), n).alias(n)
    return f.select("accession", "record_id", "description", "pos", "f.key", "f.location", F.array_join(shown, " ").alias("spans"), get("product"), flatfiles.all_qualifiers(F.col("f"), "note").alias("note"), get("protein_id"), get("translation"))


_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accession, chain ORDER BY variable DESC,
    CASE chain WHEN 'heavy' THEN length(translation) BETWEEN 95 AND 140 ELSE length(translation) BETWEEN 90 AND 130 END DESC, length(translation) DESC, pos) AS r FROM coding WHERE chain <> 'unknown') WHERE r = 1)"""


@query("b13_best_regions", f"WITH {_BLOCKS}, {_BEST} SELECT accession, max(translation) FILTER (chain = 'heavy') AS heavy, max(translation) FILTER (chain = 'light') AS light FROM best GROUP BY 1")
def _(spark, sf_dir):
    r = _records(spark, sf_dir)
    s = accessions.record_summaries(r, flatfiles.coding_features(r)).filter("heavy <> '' OR light <> ''")
    return s.select("accession", F.nullif("heavy", F.lit("")).alias("heavy"), F.nullif("light", F.lit("")).alias("light"))


@query("s18_chain_infos", f"""WITH {_BLOCKS} SELECT accession, 'VL' AS chain_type, arg_min(product, pos) AS product, arg_min(protein_id, pos) AS protein_id, arg_min(translation, pos) AS translation FROM coding WHERE chain = 'light' GROUP BY 1""")
def _(spark, sf_dir):
    return flatfiles.chain_infos(flatfiles.coding_features(_records(spark, sf_dir)), "VL").drop("location")


_HINTS = {
    "vh_sequence_aa": chosen(11, f"concat('GenBank ', {_ACCESSION})", f"concat('GenBank MN', {_S('100001 + k')})", f"concat('accession MN_', {_S('99998 + k')}, ' to MN_', {_S('100002 + k')})", "''", f"concat('GenBank MN', {_S('99999 + k')}, ' and MN', {_S('100000 + k')})", f"concat('Thermo catalog ', {_ACCESSION})"),
    "vl_sequence_aa": chosen(13, "''", f"concat('GenBank ', {_ACCESSION})", "'see the supplement'", f"concat('MN', {_S('100001 + k')})", f"concat('accession MN', {_S('100000 + k')}, ' through MN', {_S('100001 + k')})"),
    "CDRH3_Sequence": chosen(17, "''", "''", f"concat('GenBank ', {_ACCESSION})", f"concat('cds of MN', {_S('99999 + k')})"),
}
#: Antibodies of papers of three, and of single ones in every fifth paper; each asks for its own record.
AB_SQL = f"""SELECT k, cast(floor(k / 3) as bigint) AS p, {_NAME} AS name, {', '.join(f'{c} AS {f}' for f, c in _HINTS.items())} FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 15 < 12 OR p_partkey % 3 = 0) AS keys"""
_PLAUSIBLE = "CASE WHEN contains(lower({0}), 'thermo') THEN [] WHEN regexp_matches(lower({0}), 'genbank|accession|cds') OR regexp_matches({0}, '^MN\\d+$') THEN regexp_extract_all(replace({0}, '_', ''), 'MN\\d+') ELSE [] END"


def _stage(field: str, chain: str, at: int) -> str:
    """Candidates of a field: stage (0 named, 1 exact, 2 the only record, 3 the one end of a range) and their order."""
    ids, ranged = _PLAUSIBLE.format(field), f"(len({_PLAUSIBLE.format(field)}) > 1 AND regexp_matches({field}, '\\b(to|through)\\b'))"
    return f"""SELECT p, k, {at} AS field, CASE WHEN usable AND score > 0 THEN 0 WHEN NOT {ranged} AND list_contains({ids}, accession) THEN 1 WHEN usable AND m = 1 AND n = 1 AND {field} = '' THEN 2 WHEN {ranged} AND list_contains({ids}, accession) THEN 3 END AS stage,
      -named AS o1, CASE WHEN usable AND score > 0 THEN -score ELSE list_position({ids}, accession) END AS o2, rk, accession, {chain} AS sequence, {field} <> '' AS present, len({ids}) > 0 AS has_ids FROM pairs WHERE {chain} IS NOT NULL"""


_KEYS = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')".format
_MATCH = "CASE WHEN regexp_matches({0}, '(?i)\\b' || name || '\\b') THEN 4 WHEN contains(" + _KEYS("{0}") + ", " + _KEYS("name") + ") THEN 3 WHEN length(string_split(name, '-')[2]) >= 3 AND contains(" + _KEYS("{0}") + ", string_split(name, '-')[2]) THEN 2 ELSE 0 END"


@query("j04_backfilled_chains", f"""WITH {_BLOCKS}, {_BEST}, ab AS (SELECT *, count(*) OVER (PARTITION BY p) AS n FROM ({AB_SQL})),
  recs AS (
    SELECT f.k AS rk, f.p, b.accession, b.record_id, b.description, h.translation AS heavy, l.translation AS light, TRUE AS usable FROM flat f JOIN (SELECT DISTINCT accession, record_id, description FROM feats) b
      ON b.accession = 'MN' || (100000 + f.k) LEFT JOIN best h ON h.accession = b.accession AND h.chain = 'heavy' LEFT JOIN best l ON l.accession = b.accession AND l.chain = 'light' WHERE f.k % 4 <> 1
  ), counted AS (SELECT *, count(*) OVER (PARTITION BY p) AS m FROM recs),
  pairs AS (SELECT ab.*, rk, accession, heavy, light, usable, m, greatest({_MATCH.format("description")}, {_MATCH.format("record_id")}) AS score, {_MATCH.format("description")} AS named FROM ab JOIN counted r USING (p)),
  tried AS ({_stage("vh_sequence_aa", "heavy", 0)} UNION ALL {_stage("vl_sequence_aa", "light", 1)} UNION ALL {_stage("CDRH3_Sequence", "heavy", 2)}),
  able AS (SELECT * FROM (SELECT *, count(*) FILTER (stage = 3) OVER (PARTITION BY k, field) AS ends, min(stage) OVER (PARTITION BY k, field) AS first FROM tried) WHERE stage = first AND (stage < 3 OR ends = 1)),
  picked AS (SELECT p, k, field, arg_min({{'a': accession, 's': sequence}}, (o1, o2, rk)) AS x, any_value(present) AS present, any_value(has_ids) AS has_ids FROM able GROUP BY ALL),
  sides AS (SELECT ab.p, ab.k, ab.name, coalesce(h.x, CASE WHEN c.has_ids THEN c.x END) AS h, l.x AS l, CASE WHEN c.present THEN c.x END AS c FROM ab LEFT JOIN picked h ON h.k = ab.k AND h.field = 0 LEFT JOIN picked l ON l.k = ab.k AND l.field = 1 LEFT JOIN picked c ON c.k = ab.k AND c.field = 2)
  SELECT 'P' || p AS paper_id, k AS idx, name, coalesce(h.s, '') AS vh, coalesce(l.s, '') AS vl, array_to_string(list_filter(CASE WHEN h.a = l.a THEN [h.a] ELSE [h.a, l.a] END, lambda x: x IS NOT NULL), ',') AS ids FROM sides WHERE h IS NOT NULL OR l IS NOT NULL""")
def _(spark, sf_dir):
    flat = _sql(spark, sf_dir, "part", FLAT_SQL)
    records = flatfiles.parse_records(flat, "t")
    summaries = accessions.record_summaries(records, flatfiles.coding_features(records))
    paper = F.concat(F.lit("P"), F.col("p").cast("string")).alias("paper_id")
    asked = flat.filter("k % 4 <> 1").select(paper, F.col("k").alias("pos"), F.concat(F.lit("MN_"), (F.col("k") + 100000).cast("string"), F.lit(".1")).alias("accession"))
    one = lambda f: (F.lit(f), F.struct(F.col(f).alias("pointer"), F.lit(None).cast("string").alias("quote"), F.lit("").alias("value")))
    ab = _sql(spark, sf_dir, "part", AB_SQL).select(paper, F.col("k").alias("idx"), "name", F.create_map(*[x for f in _HINTS for x in one(f)]).alias("hints"))
    return accessions.backfilled(ab, accessions.fetched_records(asked, summaries)).select("paper_id", "idx", "name", "vh", "vl", "ids")
