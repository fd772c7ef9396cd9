"""Queries of scanners, tables, evidence, validation and reports, each with SQL that computes the same from the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import judge, scan, sequences, text, units, validate
from lectern.operators import blocks, evidence, images, matching, merge, records, scoring, skeleton, tables
from lectern.plans import recipes
from lectern.plans.catalog import micro, query
from lectern.plans.recipes import LABELS_SQL, chosen, q, table
from lectern.sources import reports

_RES = recipes.residues_sql("concat('n', cast(k as string))")
_S = "cast({} as string)".format
#: Sentences as papers have them, by the number of a part.
PIECES = {
    "structures": chosen(2, "'Structures 1ABC and 2WAY'", "concat('PDB 7K', chr(cast(65 + k % 26 as int)), 'Z and 6XYZ')", "'no entry'"),
    "accession": chosen(3, f"concat('GenBank accession MN', {_S('100000 + k')}, '.1 and MN ', {_S('200000 + k')})", f"concat('antibody cat. AB', {_S('10000 + k')})", f"concat('protein AAA', {_S('10000 + k % 80000')})", f"concat('lot (Foo Inc. X', {_S('10000 + k')}, ')')", f"concat('SA0', {_S('1000 + k')})", "'none'"),
    "genes": chosen(5, f"concat('IGHV3-', {_S('k % 60 + 1')}, '*01 IGHD3-10 IGHJ4')", f"concat('VH1-', {_S('k % 40')}, '/D3-10/JH4')", "'VK1-5/JK2 with 95.2% identity, VH identity: 91'"),
    "loops": chosen(2, f"concat('CDRH3: CAR', substr({_RES}, 1, cast(6 + k % 8 as int)), 'W')", f"concat('loop CQQ', substr({_RES}, 3, 5), 'T here')", "'CONSTRUCT COPYRIGHT CCCCCCCCW'", f"concat('CDR-L3 CQH', substr({_RES}, 2, 6), 'F')", f"concat('C', substr({_RES}, 1, 12), 'G')"),
    "refs": chosen(3, f"concat('doi 10.1038/s', {_S('k')}, '.)')", f"concat('PMID: ', {_S('10000000 + k')})", f"concat('PubMed ID ', {_S('20000000 + k')}, '; 10.1000/a', {_S('k')}, ', 10.1000/b')"),
    "names": chosen(5, f"concat('clone 4G', {_S('k % 9')})", f"concat({_S('k % 900 + 100')}, '-H', {_S('k % 9')})", "'bevacizumab and COVID'", f"concat('mAb C', {_S('100 + k % 800')}, ' VH3')", "'EMD-1234 ABC12345 DH270'"),
    "tables": chosen(2, "'<table><tr><td>x</td></tr></table>'", "concat(chr(10), '| a | b |', chr(10), '| --- | --- |', chr(10), '| 1 | 2 |', chr(10))", "''"),
}
PAPERS_SQL = f"SELECT k, {', '.join(f'{v} AS {n}' for n, v in PIECES.items())} FROM (SELECT p_partkey AS k FROM part) AS keys"
TEXT_SQL = f"SELECT k, concat_ws(' ', {', '.join(PIECES)}) AS t FROM ({PAPERS_SQL}) AS papers"


def _sql(spark, sf_dir: str, name: str, body: str) -> DataFrame:
    """SQL over one of the shared tables."""
    table(spark, sf_dir, name).createOrReplaceTempView(f"lectern_{name}")
    return spark.sql(body.replace(f"FROM {name}", f"FROM lectern_{name}"))


def _dealt(spark, sf_dir: str, name: str, key: str, body: str) -> DataFrame:
    """SQL over one of the shared tables whose keys are dealt out first: its file is small, so few tasks read it, and the texts rendered from it are not."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table(spark, sf_dir, name).select(key).repartition(n, key).createOrReplaceTempView(f"lectern_{name}_keys")
    return spark.sql(body.replace(f"FROM {name}", f"FROM lectern_{name}_keys"))


def _texts(spark, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "part", TEXT_SQL)


def _j(c) -> F.Column:
    return F.array_join(c, ",")


def _all(pattern: str, t: str = "t") -> str:
    """Every match of the pattern's group, sorted, once."""
    flags = ", 'i'" if pattern.startswith("(?i)") else ""
    return f"list_sort(list_distinct(regexp_extract_all({t}, {q(pattern.removeprefix('(?i)'))}, 1{flags})))"


def _s(items: str) -> str:
    return f"array_to_string({items}, ',')"


_NOT = "[" + ", ".join(map(q, scan.NOT_STRUCTURES)) + "]"


@query("r01_structure_ids", f"SELECT k, {_s(f'list_filter({_all(scan.STRUCTURE_ID)}, lambda x: NOT list_contains({_NOT}, x))')} AS ids FROM ({TEXT_SQL})")
def _(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", _j(scan.structure_ids(F.col("t"))).alias("ids"))


_WORDS = "[" + ", ".join(map(q, scan.REAGENT_WORDS)) + "]"
_PREFIXES = "[" + ", ".join(map(q, scan.REAGENT_PREFIXES)) + "]"
_ACC = scan.ACCESSION.removeprefix("(?i)")


@query("r02_accessions", f"""WITH p AS ({PAPERS_SQL}), h AS (SELECT k, accession AS t, unnest(regexp_extract_all(accession, {q(_ACC)}, 1, 'i')) AS raw FROM p),
  i AS (SELECT *, regexp_replace(regexp_replace(upper(raw), '[\\s_-]+', '', 'g'), '\\.\\d+$', '') AS id FROM h),
  n AS (SELECT *, CASE WHEN regexp_matches(id, '^[A-Z]{{1,2}}\\d{{5,8}}$') THEN 'nucleotide' WHEN regexp_matches(id, '^[A-Z]{{3}}\\d{{5}}$') THEN 'protein' END AS kind,
    len(list_filter({_WORDS}, lambda w: contains(lower(t), w))) > 0 OR len(list_filter({_PREFIXES}, lambda w: starts_with(id, w))) > 0 OR contains(t, 'Inc.') AS reagent FROM i)
  SELECT k, id, kind, reagent FROM n WHERE kind IS NOT NULL""")
def _(spark, sf_dir):
    p = _sql(spark, sf_dir, "part", PAPERS_SQL)
    return p.select("k", F.inline(scan.accession_hits(F.col("accession"))))


@query("r03_protein_ids", f"SELECT k, {_s(_all(scan.PROTEIN_ID))} AS ids FROM ({TEXT_SQL})")
def _(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", _j(scan.protein_ids(F.col("t"))).alias("ids"))


@query("r04_genes", f"SELECT k, {', '.join(f'{_s(_all(p))} AS {n}' for n, p in scan.GENES.items())}, len(regexp_extract_all(t, {q(scan.IDENTITY)}, 0))::INT AS identity_mentions FROM ({TEXT_SQL})")
def _(spark, sf_dir):
    g = _texts(spark, sf_dir).select("k", scan.genes(F.col("t")).alias("g"))
    return g.select("k", *[_j(F.col(f"g.{n}")).alias(n) for n in scan.GENES], F.col("g.identity_mentions"))


_BAD = "[" + ", ".join(map(q, scan.NOT_LOOPS)) + "]"


def _loops(*keys: str) -> str:
    both = " || ".join(_all(scan.LOOPS[k]) for k in keys)
    return f"list_sort(list_distinct(list_filter({both}, lambda s: len(list_distinct(string_split(s, ''))) > 3 AND NOT list_contains({_BAD}, upper(s)))))"


@query("r05_loops", f"""WITH l AS (SELECT k, {_loops('h3', 'h3_anchor')} AS h3, {_loops('l3', 'l3_anchor')} AS l3, {_loops('other')} AS o FROM ({TEXT_SQL}))
  SELECT k, {_s('h3')} AS h3, {_s('l3')} AS l3, {_s('list_filter(o, lambda s: NOT list_contains(h3, s) AND NOT list_contains(l3, s))')} AS other FROM l""")
def _(spark, sf_dir):
    x = _texts(spark, sf_dir).select("k", scan.loops(F.col("t")).alias("l"))
    return x.select("k", *[_j(F.col(f"l.{n}")).alias(n) for n in ("h3", "l3", "other")])


@query("u06_other_loops", f"""WITH l AS (SELECT k, {_loops('h3', 'h3_anchor')} || {_loops('l3', 'l3_anchor')} AS used, {_loops('other')} AS o FROM ({TEXT_SQL}))
  SELECT k, len(list_filter(o, lambda s: NOT list_contains(used, s)))::INT AS n FROM l""")
def _(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", F.size(scan.loops(F.col("t"))["other"]).alias("n"))


_DOIS = f"list_sort(list_distinct(list_transform({_all(scan.DOI)}, lambda d: regexp_replace(d, '[.)]+$', ''))))"


@query("r06_references", f"SELECT k, {_s(_DOIS)} AS dois, {_s(_all(scan.PUBMED))} AS pubmed FROM ({TEXT_SQL})")
def _(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", _j(scan.dois(F.col("t"))).alias("dois"), _j(scan.pubmed_ids(F.col("t"))).alias("pubmed"))


_OTHER = "[" + ", ".join(map(q, scan.OTHER_NAMES)) + "]"
_FALSE = "[" + ", ".join(map(q, scan.NOT_NAMES)) + "]"
_NAMES = "list_sort(list_distinct(list_filter(" + " || ".join(_all(p) for p in scan.NAMES) + f""", lambda n: NOT list_contains({_FALSE}, n) AND length(n) >= 3 AND NOT ends_with(lower(n), '-treated')
   AND NOT regexp_matches(n, '^[A-Z]{{2,4}}\\d{{5,}}$') AND len(list_filter({_OTHER}, lambda w: starts_with(upper(n), w))) = 0)))"""


@query("r08_antibody_names", f"SELECT k, {_s(_NAMES)} AS names FROM ({TEXT_SQL})")
def _(spark, sf_dir):
    return _texts(spark, sf_dir).select("k", _j(scan.antibody_names(F.col("t"))).alias("names"))


@query("r09_documents", f"""SELECT doc_id, length(text)::INT AS chars, len(list_filter({_all(scan.STRUCTURE_ID, 'text')}, lambda x: NOT list_contains({_NOT}, x)))::INT AS structures, len({_all(scan.PROTEIN_ID, 'text')})::INT AS proteins,
  len({_DOIS.replace('(t,', '(text,')})::INT AS dois, len({_all(scan.PUBMED, 'text')})::INT AS pubmed, len({_NAMES.replace('(t,', '(text,')})::INT AS names FROM documents""")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", scan.bundle(F.col("text")).alias("s"))
    return s.select("doc_id", "s.chars", *[F.size(f"s.{c}").alias(n) for c, n in (("structure_ids", "structures"), ("protein_ids", "proteins"), ("dois", "dois"), ("pubmed_ids", "pubmed"), ("names", "names"))])


def _listed(items: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN array_to_string({items}, ', ') ELSE 'None found' END"


@query("r09_hint_text", f"""WITH s AS (SELECT k, list_filter({_all(scan.STRUCTURE_ID)}, lambda x: NOT list_contains({_NOT}, x)) AS p, {_loops('h3', 'h3_anchor')} AS h, {_DOIS} AS d, {_all(scan.PUBMED)} AS m, {_NAMES} AS n FROM ({TEXT_SQL}))
  SELECT k, '- PDB IDs: ' || {_listed('p')} AS pdb, '- CDRH3 candidates: ' || {_listed('h')} AS h3, '- DOI: ' || {_listed('d')} AS doi, '- PMID: ' || {_listed('m')} AS pmid, '- Antibody name candidates: ' || {_listed('n')} AS names FROM s""")
def _(spark, sf_dir):
    lines = _texts(spark, sf_dir).select("k", F.split(scan.hint_text(scan.bundle(F.col("t"))), "\n").alias("l"))
    line = lambda head: F.get(F.filter("l", lambda x: F.startswith(x, F.lit(head))), F.lit(0))
    return lines.select("k", line("- PDB IDs").alias("pdb"), line("- CDRH3").alias("h3"), line("- DOI").alias("doi"), line("- PMID").alias("pmid"), line("- Antibody name").alias("names"))


#: A text in which only the piece of accessions has any, and none is far from a word that tells of a reagent.
ROUTED_SQL = f"SELECT k, accession, concat_ws(' ', structures, accession, tables) AS t FROM ({PAPERS_SQL}) AS papers"


@query("p23_routes", f"""WITH p AS ({ROUTED_SQL}), h AS (SELECT k, t, unnest(regexp_extract_all(accession, {q(_ACC)}, 1, 'i')) AS raw FROM p), i AS (SELECT k, t, regexp_replace(regexp_replace(upper(raw), '[\\s_-]+', '', 'g'), '\\.\\d+$', '') AS id FROM h),
  n AS (SELECT k, count(DISTINCT id) FILTER (regexp_matches(id, '^[A-Z]{{1,2}}\\d{{5,8}}$')) AS acids, count(DISTINCT id) FILTER (regexp_matches(id, '^[A-Z]{{3}}\\d{{5}}$')) AS proteins FROM i
    WHERE len(list_filter({_WORDS}, lambda w: contains(lower(t), w))) = 0 AND len(list_filter({_PREFIXES}, lambda w: starts_with(id, w))) = 0 AND NOT contains(t, 'Inc.') GROUP BY k),
  s AS (SELECT p.k, len(list_filter({_all(scan.STRUCTURE_ID)}, lambda x: NOT list_contains({_NOT}, x))) AS codes, coalesce(acids, 0) AS acids, coalesce(proteins, 0) AS proteins, contains(t, '<table') AS html, contains(t, '| --- |') AS pipe FROM p LEFT JOIN n USING (k))
  SELECT k, concat_ws(chr(10), CASE WHEN codes > 0 THEN 'Track A (API Fetch): ' || codes || ' PDB ID(s) → RCSB API' END, CASE WHEN acids > 0 THEN 'Track A (API Fetch): ' || acids || ' nucleotide GenBank ID(s) → NCBI Entrez' END, CASE WHEN proteins > 0 THEN 'Track A (API Fetch): ' || proteins || ' protein accession(s) → NCBI Entrez' END,
    CASE WHEN html THEN 'Track C (Script Extract): 1 HTML table(s)' END, CASE WHEN pipe THEN 'Track C (Script Extract): 1 Markdown table(s)' END, CASE WHEN codes + acids + proteins = 0 THEN 'Track A not applicable: No external DB IDs found' END,
    CASE WHEN NOT html AND NOT pipe THEN 'Track C not applicable: No tables found in document' END, 'Track B (Supplementary): Always check supplementary materials') AS routes FROM s""")
def _(spark, sf_dir):
    return _sql(spark, sf_dir, "part", ROUTED_SQL).select("k", F.array_join(scan.routes(scan.bundle(F.col("t"))), "\n").alias("routes"))


# ---------------------------------------------------------------- rules over the rendered records


def _sides(spark, sf_dir) -> DataFrame:
    gt, pred = recipes.ground_truth(spark, sf_dir), recipes.predictions(spark, sf_dir)
    return matching.long_pairs(gt, pred, gt.join(pred.select("paper_id", "ab_idx"), ["paper_id", "ab_idx"]).select("paper_id", F.col("ab_idx").alias("gt_idx"), F.col("ab_idx").alias("pred_idx")), scoring.FIELDS)


def _ruled(field: str, value: str, where: str = "") -> str:
    return f"WITH {LABELS_SQL} SELECT paper_id, ab_idx, {value} FROM ruled WHERE field = '{field}' AND matched {where}"


@query("p04_is_empty", f"WITH {LABELS_SQL} SELECT paper_id, ab_idx, field, no_g AS gt_empty, no_p AS pred_empty FROM ruled")
def _(spark, sf_dir):
    return _sides(spark, sf_dir).select("paper_id", "ab_idx", "field", text.is_empty(F.col("gt")).alias("gt_empty"), text.is_empty(F.col("pred")).alias("pred_empty"))


@query("p05_has_output", f"WITH {LABELS_SQL} SELECT field, count(*) AS n, count(*) FILTER (p <> '') AS filled FROM ruled GROUP BY field")
def _(spark, sf_dir):
    return _sides(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"), F.sum(text.has_output(F.col("pred")).cast("long")).alias("filled"))


_NUMBERS = "('Binding_Kinetics_KD', 'Binding_EC50', 'Binding_Kinetics_kon', 'Binding_Kinetics_koff', 'Thermal_Stability_Tm')"


@query("m05_quantities", f"WITH {LABELS_SQL} SELECT paper_id, ab_idx, field, floor(a * 1000000 + 0.5)::BIGINT AS gt_micro, floor(b * 1000000 + 0.5)::BIGINT AS pred_micro FROM ruled WHERE field IN {_NUMBERS}")
def _(spark, sf_dir):
    rows = _sides(spark, sf_dir).filter(F.col("field").isin(list(units.NUMERIC_FIELDS)))
    return rows.select("paper_id", "ab_idx", "field", *[micro(units.quantity(F.col("field"), F.col(c))).alias(f"{c}_micro") for c in ("gt", "pred")])


@query("m06_numeric_label", f"""WITH {LABELS_SQL} SELECT paper_id, ab_idx, field, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN abs(b - a) <= 0.10e0 * abs(a) THEN 'exact' WHEN greatest(a / b, b / a) <= 3 THEN 'partial' ELSE 'wrong' END AS label
  FROM ruled WHERE field IN {_NUMBERS}""")
def _(spark, sf_dir):
    rows = _sides(spark, sf_dir).filter(F.col("field").isin(list(units.NUMERIC_FIELDS)))
    n = lambda c: units.quantity(F.col("field"), F.col(c))
    return rows.select("paper_id", "ab_idx", "field", units.numeric_label(n("gt"), n("pred")).alias("label"))


_JUDGED = {"g02_method_label": ("Experiment", judge.method_label, "len(mg) > 0 AND len(mp) > 0"), "g03_type_label": ("Antibody_Type", judge.type_label, "len(tg) > 0 AND len(tp) > 0")}
for _name, (_field, _rule, _when) in _JUDGED.items():

    @query(_name, _ruled(_field, f"CASE WHEN {_when} THEN judged END AS label"))
    def _(spark, sf_dir, field=_field, rule=_rule):
        rows = _sides(spark, sf_dir).filter((F.col("field") == field) & F.col("matched"))
        return rows.select("paper_id", "ab_idx", rule(F.col("gt"), F.col("pred")).alias("label"))


@query("f14_reference_label", _ruled("Reference_Source", "CASE WHEN doi_g <> '' AND doi_g = doi_p THEN 'exact' WHEN who_g <> '' AND who_g = who_p AND year_g <> '' AND year_g = year_p THEN 'exact' END AS label"))
def _(spark, sf_dir):
    rows = _sides(spark, sf_dir).filter("field = 'Reference_Source' AND matched")
    return rows.select("paper_id", "ab_idx", judge.reference_label(F.col("gt"), F.col("pred")).alias("label"))


@query("f12_reference_parts", _ruled("Reference_Source", "doi_p AS doi, year_p AS year, who_p AS author"))
def _(spark, sf_dir):
    rows = _sides(spark, sf_dir).filter("field = 'Reference_Source' AND matched")
    return rows.select("paper_id", "ab_idx", text.doi(F.col("pred")).alias("doi"), text.year(F.col("pred")).alias("year"), text.first_author(F.col("pred")).alias("author"))


@query("b12_sequence_label", f"WITH {LABELS_SQL} SELECT paper_id, ab_idx, field, judged AS label FROM ruled WHERE field IN ('CDRH3_Sequence', 'vh_sequence_aa', 'vl_sequence_aa') AND length(sg) >= 8 AND length(sp) >= 8 AND NOT no_g AND NOT no_p")
def _(spark, sf_dir):
    rows = _sides(spark, sf_dir).filter(F.col("field").isin(judge.SEQUENCE_FIELDS) & ~text.is_empty(F.col("gt")) & ~text.is_empty(F.col("pred")))
    rows = rows.filter((F.length(judge.residues(F.col("gt"))) >= 8) & (F.length(judge.residues(F.col("pred"))) >= 8))
    return rows.select("paper_id", "ab_idx", "field", judge.sequence_label(F.col("gt"), F.col("pred")).alias("label"))


@query("f15_assay_list", f"""WITH {LABELS_SQL}, m AS (SELECT paper_id, ab_idx, p, list_filter([CASE WHEN regexp_matches(lower(p), '\\belisa\\b') THEN 'ELISA' END, CASE WHEN regexp_matches(lower(p), '\\bbli\\b') THEN 'BLI' END,
    CASE WHEN regexp_matches(lower(p), '\\bspr\\b') THEN 'SPR' END], lambda x: x IS NOT NULL) AS f FROM ruled WHERE field = 'Experiment' AND matched)
  SELECT paper_id, ab_idx, CASE WHEN len(f) > 0 THEN array_to_string(f, ', ') ELSE p END AS assays FROM m""")
def _(spark, sf_dir):
    rows = _sides(spark, sf_dir).filter("field = 'Experiment' AND matched")
    return rows.select("paper_id", "ab_idx", validate.assay_list(F.col("pred")).alias("assays"))


@query("v06_type_and_scope", f"""WITH {LABELS_SQL} SELECT t.paper_id, t.ab_idx, CASE WHEN contains(lower(t.p), 'monoclonal antibody') THEN 'warn' END AS type, CASE WHEN contains(lower(e.p), 'western blot') THEN 'Western blot' ELSE '' END AS scope
  FROM ruled t JOIN ruled e ON e.paper_id = t.paper_id AND e.ab_idx = t.ab_idx WHERE t.field = 'Antibody_Type' AND e.field = 'Experiment' AND t.matched""")
def _(spark, sf_dir):
    rows = _sides(spark, sf_dir).filter("matched").groupBy("paper_id", "ab_idx").agg(*[F.max(F.when(F.col("field") == f, F.col("pred"))).alias(f) for f in ("Antibody_Type", "Experiment")])
    return rows.select("paper_id", "ab_idx", validate.type_check(F.col("Antibody_Type")).alias("type"), _j(validate.experiment_check(F.col("Experiment"))).alias("scope"))


@query("p29_annotation_defaults", f"""WITH {LABELS_SQL} SELECT paper_id, ab_idx, field, CASE WHEN label IN ('wrong', 'miss', 'partial') THEN 'reviewed' ELSE 'ignored' END AS status,
    CASE label WHEN 'wrong' THEN 'value_mismatch' WHEN 'miss' THEN 'missing_prediction' WHEN 'partial' THEN 'incomplete_value' ELSE '' END AS error_types,
    CASE WHEN label IN ('wrong', 'miss', 'partial') THEN 'medium' ELSE 'low' END AS severity, label IN ('wrong', 'miss', 'partial') AND ab_idx % 3 <> 0 AS needs_review FROM scored""")
def _(spark, sf_dir):
    s = _scored(spark, sf_dir)
    d = s.withColumn("d", validate.annotation_defaults(F.col("label"), F.col("weight")))
    stored = F.when(F.col("ab_idx") % 3 == 0, "reviewed").when(F.col("ab_idx") % 3 == 1, "pending")
    return d.select("paper_id", "ab_idx", "field", "d.status", _j(F.col("d.error_types")).alias("error_types"), "d.severity", validate.needs_review(F.col("label"), stored).alias("needs_review"))


def _scored(spark, sf_dir) -> DataFrame:
    return scoring.score_fields(_sides(spark, sf_dir))


@query("a24_field_analytics", f"""WITH {LABELS_SQL} SELECT field, count(*) AS count, floor(avg(score) * 1000000 + 0.5)::BIGINT AS avg_micro, count(*) FILTER ((g <> '' OR p <> '') AND label <> 'skip') AS active,
    floor(avg(score) FILTER ((g <> '' OR p <> '') AND label <> 'skip') * 1000000 + 0.5)::BIGINT AS active_micro, count(*) FILTER (g <> '') AS gt_filled, count(*) FILTER (p <> '') AS pred_filled,
    count(*) FILTER (g = '' AND p = '' AND label = 'exact') AS both_empty_exact FROM scored GROUP BY field""")
def _(spark, sf_dir):
    a = reports.field_analytics(_scored(spark, sf_dir))
    return a.select("field", "count", micro(F.col("avg_score")).alias("avg_micro"), "active", micro(F.col("active_avg")).alias("active_micro"), "gt_filled", "pred_filled", "both_empty_exact")


@query("s09_report_round_trip", f"""WITH {LABELS_SQL} SELECT paper_id, 'ab ' || ab_idx AS record, matched, field, weight, CASE WHEN length(g) > 50 THEN substr(g, 1, 50) || '...' ELSE g END AS gt, CASE WHEN length(p) > 50 THEN substr(p, 1, 50) || '...' ELSE p END AS pred, label, score FROM scored""")
def _(spark, sf_dir):
    fields = _scored(spark, sf_dir).withColumn("reason", F.lit("by rule"))
    per = scoring.score_records(fields).withColumn("name", F.concat(F.lit("ab "), F.col("ab_idx").cast("string")))
    papers = scoring.score_papers(per, spark.createDataFrame([], "paper_id string, nfp long"))
    return reports.parse_report(reports.markdown_report(papers, per, fields))


@query("s07_result_json", f"""WITH {LABELS_SQL}, r AS (SELECT paper_id, ab_idx, count(*) FILTER (label <> 'skip') AS n, sum(score) AS s FROM scored GROUP BY ALL)
  SELECT paper_id, count(*) AS records, sum(n)::BIGINT AS fields, sum(s)::DOUBLE AS score FROM r GROUP BY paper_id""")
def _(spark, sf_dir):
    fields = _scored(spark, sf_dir)
    per = scoring.score_records(fields)
    papers = scoring.score_papers(per, spark.createDataFrame([], "paper_id string, nfp long"))
    shape = "antibodies array<struct<total_fields:bigint,score_sum:double,fields:array<struct<field:string>>>>"
    j = reports.result_json(papers, per, fields).select("paper_id", F.from_json("value", shape).alias("v"))
    total = lambda f: F.aggregate(f"v.antibodies", F.lit(0.0), lambda n, a: n + a[f])
    return j.select("paper_id", F.size("v.antibodies").cast("long").alias("records"), total("total_fields").cast("long").alias("fields"), total("score_sum").alias("score"))


# ---------------------------------------------------------------- sequences


_HEAVY = f"concat('EVQLVESGGGLVQPGGSLRLSCAAS', substr({_RES}, 1, 20), 'WVRQAPGKGLEWVSADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAR', substr({_RES}, 9, cast(5 + k % 9 as int)), 'WGQGTLVTVSS')"
_LIGHT = f"concat('DIQMTQSPSSLSASVGDRVTITCRAS', substr({_RES}, 1, 24), 'WYQQKPGKAPKLLIYAASSLQSGVPSRFSGSGSGTDFTLTISSLQPEDFATYYCQQ', substr({_RES}, 3, 5), 'FGQGTKVEIK')"
CHAINS_SQL = f"""SELECT k, {_HEAVY} AS heavy, {_LIGHT} AS light, CASE k % 3 WHEN 0 THEN 'MKT' WHEN 1 THEN '' ELSE 'MAGSWT' END AS lead, CASE k % 2 WHEN 0 THEN 'ASTKGPSVFP' ELSE '' END AS tail,
  {chosen(2, "'Fab heavy chain'", "'kappa light chain'", "'Nanobody Nb7'", "'spike protein'", "'scFv 12'", "'antibody_VH'")} AS description FROM (SELECT p_partkey AS k FROM part) AS keys"""


def _chains(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, "part", CHAINS_SQL)


@query("b07_variable_domain", f"SELECT k, heavy AS h, light AS l FROM ({CHAINS_SQL})")
def _(spark, sf_dir):
    whole = lambda c: F.concat("lead", c, "tail")
    return _chains(spark, sf_dir).select("k", sequences.variable_domain(whole("heavy"), "H").alias("h"), sequences.variable_domain(whole("light"), "L").alias("l"))


#: A heavy and a light chain joined by a linker, in either order, some too short to be two domains.
JOINED_SQL = f"SELECT k, CASE WHEN k % 7 = 0 THEN substr(heavy, 1, 90) WHEN k % 2 = 0 THEN concat(heavy, 'GGGGSGGGGSGGGGS', light) ELSE concat(light, 'GGGGSGGGGSGGGGS', heavy) END AS s FROM ({CHAINS_SQL}) AS chains"


def _places_sql(s: str, chain: str, upto: str) -> str:
    """Places at which a chain's motifs begin, in order."""
    found = " OR ".join(f"(substr({s}, i, {len(m)}) = '{m}' AND i + {len(m) - 1} <= {upto})" for m in sequences.STARTS[chain])
    return f"list_filter(range(1, {upto} + 1), lambda i: {found})"


def _domain_sql(s: str, chain: str) -> str:
    """A chain's domain: from its first motif within 80 residues to its first ending, of the patterns in order, or the window."""
    first = " , ".join(f"nullif(instr(left({s}, 80), '{m}'), 0)" for m in sequences.STARTS[chain])
    tail = f"substr({s}, least({first})::BIGINT)"
    ended = ", ".join(f"nullif(regexp_extract({tail}, '^(.*?{p})', 1), '')" for p in sequences.ENDS[chain])
    return f"coalesce({ended}, left({tail}, {sequences.WINDOW[chain]}))"


def _split_sql(first: str, second: str, gap: int) -> str:
    """Pairs of a place of the first chain and the next one of the second, and the domains of the two parts."""
    return f"""{first}{second} AS (SELECT k, s, a, b, {_domain_sql('substr(s, a, b - a)', first)} AS d{first}, {_domain_sql('substr(s, b)', second)} AS d{second} FROM (SELECT k, s, a, list_min(list_filter({second}, lambda x: x >= a + {gap})) AS b FROM (SELECT *, unnest({first}) AS a FROM placed)) WHERE b IS NOT NULL),
  best{first}{second} AS (SELECT k, arg_min(dH, a) AS h, arg_min(dL, a) AS l FROM {first}{second} WHERE length(dH) BETWEEN 95 AND 160 AND length(dL) BETWEEN 85 AND 140 GROUP BY k)"""


@query("b08_single_chain", f"""WITH placed AS (SELECT k, s, {_places_sql('s', 'H', 'least(length(s), 140)')} AS H, {_places_sql('s', 'L', 'length(s)')} AS L FROM ({JOINED_SQL})),
  {_split_sql('H', 'L', 70)}, {_split_sql('L', 'H', 60)}
  SELECT k, CASE WHEN able THEN coalesce(x.h, y.h, '') ELSE '' END AS h, CASE WHEN able THEN coalesce(x.l, y.l, '') ELSE '' END AS l FROM (SELECT k, length(s) >= 180 AND len(H) > 0 AND len(L) > 0 AS able FROM placed) LEFT JOIN bestHL x USING (k) LEFT JOIN bestLH y USING (k)""")
def _(spark, sf_dir):
    d = _dealt(spark, sf_dir, "part", "p_partkey", JOINED_SQL).select("k", sequences.single_chain_domains(F.col("s")).alias("d"))
    return d.select("k", F.col("d.heavy").alias("h"), F.col("d.light").alias("l"))


_REGION = chosen(
    3, "heavy", "replace(heavy, 'YYC', 'YHC')", "concat('MK', heavy)", "light", "lower(substr(heavy, 1, 75))", "replace(replace(heavy, 'YYC', 'YVC'), 'WGQG', 'WGRG')", "concat(substr(heavy, 1, 60), '-', substr(heavy, 61, 100), 'AS')", "replace(heavy, 'WGQG', 'FGQG')", "concat('QQQQ', light)", "replace(heavy, 'YYC', 'XXC')",
)
#: Regions whole, cut, marked and changed at their anchors, with loops as others give them, and what a chain is called.
_LEAD, _TAIL = chosen(2, "''", "'C'", "'CC'"), chosen(5, "''", "'QQ'", "'QQSYSTPLT'", "'wgqg'")
REGIONS_SQL = f"SELECT k, description, {_REGION} AS region, concat({_LEAD}, 'AR', substr({_RES}, 9, cast(5 + k % 9 as int)), {_TAIL}) AS given FROM ({CHAINS_SQL}) AS chains"
_CORE = f"""letters AS (SELECT *, regexp_replace(upper(region), '[^A-Z]', '', 'g') AS s FROM ({REGIONS_SQL})), stops AS (SELECT *, length(s) - length(right(s, 15)) + length(regexp_extract(right(s, 15), '^(.*?)WG[A-Z]G', 1)) AS stop FROM letters),
  starts AS (SELECT *, greatest(stop - 29, 80) AS low, coalesce({', '.join(f"nullif(length(regexp_extract(left(s, stop), '^(.*{m})', 1)), 0)" for m in sequences.BEFORE_LOOP)}) AS motif FROM stops),
  bounds AS (SELECT *, coalesce(motif, low + nullif(length(regexp_extract(substr(left(s, stop), low + 1), '^(.*C)', 1)), 0)) AS start FROM starts),
  cores AS (SELECT *, coalesce(CASE WHEN length(s) >= 80 AND regexp_matches(right(s, 15), 'WG[A-Z]G') AND stop - start >= 3 THEN substr(s, start + 1, stop - start) END, '') AS core FROM bounds)"""


def _anchored(end: str) -> str:
    """The last loop up to an end that begins in the second half of a region."""
    loop = f"regexp_extract(m, '^(C[A-Z]{{3,30}}?{end})G[A-Z]{{1,4}}$', 1)"
    good = f"list_filter(regexp_extract_all(s, '(C[A-Z]{{3,30}}?{end}G[A-Z]{{1,4}})', 1), lambda m: length(s) - instr(reverse(s), reverse(m)) - length(m) + 1 >= length(s) // 2 AND regexp_matches({loop}, '^[ACDEFGHIKLMNPQRSTVWY]{{5,30}}$'))"
    return f"regexp_extract({good}[-1], '^(C[A-Z]{{3,30}}?{end})G[A-Z]{{1,4}}$', 1)"


@query("b04_b05_loops", f"WITH {_CORE} SELECT k, coalesce(nullif({_anchored('W')}, ''), {_anchored('F')}, '') AS anchored, core FROM cores")
def _(spark, sf_dir):
    r = _sql(spark, sf_dir, "part", REGIONS_SQL)
    return r.select("k", sequences.loop_of(F.col("region")).alias("anchored"), sequences.loop_core(F.col("region")).alias("core"))


@query("b06_untangled", f"""WITH {_CORE}, loops AS (SELECT k, core, regexp_replace(upper(given), '[^A-Z]', '', 'g') AS a FROM cores), bare AS (SELECT *, regexp_replace(a, '^C+', '') AS b FROM loops)
  SELECT k, CASE WHEN core <> '' AND length(b) > length(core) + 3 AND starts_with(b, left(core, 10)) THEN CASE WHEN starts_with(a, 'C') AND NOT starts_with(core, 'C') THEN 'C' || core ELSE core END ELSE a END AS loop FROM bare""")
def _(spark, sf_dir):
    return _sql(spark, sf_dir, "part", REGIONS_SQL).select("k", sequences.untangled(F.col("given"), F.col("region")).alias("loop"))


def _first_motif(chain: str) -> str:
    return "least(" + ", ".join(f"CASE WHEN instr(s, '{m}') BETWEEN 1 AND 3 THEN instr(s, '{m}') ELSE 9 END" for m in sequences.STARTS[chain]) + ")"


@query("b09_b10_chains", f"""WITH r AS (SELECT *, regexp_replace(upper(region), '[^A-Z]', '', 'g') AS s, regexp_replace(lower(description), '[_-]+', ' ', 'g') AS d FROM ({REGIONS_SQL})),
  c AS (SELECT k, CASE {' '.join(f"WHEN regexp_matches(d, {q(p)}) THEN '{role}'" for role, p in sequences.ROLES)} ELSE 'other' END AS role, CASE WHEN NOT regexp_matches(s, '^[ACDEFGHIKLMNPQRSTVWY]{{80,160}}$') THEN 'unknown' WHEN {_first_motif('H')} < {_first_motif('L')} THEN 'heavy' WHEN {_first_motif('L')} < {_first_motif('H')} THEN 'light' ELSE 'unknown' END AS chain FROM r)
  SELECT k, role, chain, chain <> 'light' AS fits FROM c""")
def _(spark, sf_dir):
    r = _sql(spark, sf_dir, "part", REGIONS_SQL)
    return r.select("k", sequences.chain_role(F.col("description")).alias("role"), sequences.chain_of(F.col("region")).alias("chain"), sequences.fits_chain(F.lit("vh_sequence_aa"), F.col("region")).alias("fits"))


# ---------------------------------------------------------------- tables, images, records


@query("w09_fragment_tables", f"""SELECT k, 'mAb ' || k AS name, CASE WHEN k % 2 = 0 THEN 'VH' ELSE 'VL' END AS chain, {_RES} || {_RES} || {_RES} AS sequence FROM (SELECT p_partkey AS k FROM part) WHERE k % 4 < 3""")
def _(spark, sf_dir):
    parts = _sql(spark, sf_dir, "part", f"SELECT k, {_RES} AS r FROM (SELECT p_partkey AS k FROM part) AS keys")
    piece = lambda a: F.concat_ws("</td><td>", *[F.substring("r", a + 8 * i, 8) for i in range(4)])
    name = F.concat(F.lit("mAb "), F.col("k").cast("string"), F.lit(" ("), F.when(F.col("k") % 2 == 0, "VH").otherwise("light"), F.lit(")"))
    row = lambda head: F.concat(F.lit("<tr><td>"), head, F.lit("</td><td>7</td><td>"), piece(1), F.lit("</td></tr>"))
    third = F.when(F.col("k") % 4 < 3, row(F.lit(""))).otherwise(F.lit("<tr><td>note</td><td></td><td>see text</td></tr>"))
    t = F.concat(F.lit("<table><tr><th>Antibody</th><th>SEQ ID NO</th><th>Sequence</th></tr>"), row(name), row(F.lit("")), third, F.lit("</table>"))
    return tables.fragment_records(tables.table_cells(parts.select("k", t.alias("t")), "k", "t"), "k").select("k", "name", "chain", "sequence")


@query("w16_alignments", f"""SELECT k, 'ab' || i || CASE i WHEN 0 THEN 'K' ELSE '' END AS name, substr({_RES}, 1, 0) || 'QVQ' || substr(r, 4, 10 + i) || 'W' || substr(r, 15 + i) AS sequence
  FROM (SELECT k, i, 'QVQ' || substr({_RES} || {_RES}, 4) AS r FROM (SELECT p_partkey AS k FROM part), range(5) t(i))""")
def _(spark, sf_dir):
    parts = _dealt(spark, sf_dir, "part", "p_partkey", f"SELECT k, concat('QVQ', substr(concat({_RES}, {_RES}), 4, 61)) AS r FROM (SELECT p_partkey AS k FROM part) AS keys")
    names = F.lit("ab0K\nab1\nab2\nab3\nab4\n")
    diffs = [F.concat(F.repeat(F.lit("."), F.lit(13 + i)), F.lit("W"), F.repeat(F.lit("."), F.lit(50 - i))) for i in range(5)]
    block = F.concat(names, F.col("r"), F.lit("\n"), F.concat_ws("\n", *diffs))
    return images.alignment_records(parts.select("k", block.alias("block"), F.lit("heavy chain").alias("context")), ["k"]).select("k", "name", "sequence")


@query("j19_image_groups", """SELECT user_id, a || '+' || b AS images FROM (SELECT user_id, event_id::VARCHAR AS a, lead(event_id::VARCHAR) OVER w AS b, lead(event_id % 3) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE b IS NOT NULL AND gap < 2""")
def _(spark, sf_dir):
    k = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("image"), F.when(k == 0, " A ").when(k == 1, "<!-- x\ny -->").otherwise("some words between").alias("gap"))
    return images.image_groups(e, "user_id", most=2).select("user_id", F.array_join("images", "+").alias("images"))


@query("w11_nearest_section", """SELECT doc_id, pos, last_value(CASE WHEN pos % 3 = 0 THEN md5(doc_id || '-' || pos) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section
  FROM (SELECT doc_id, unnest(range(5)) AS pos FROM documents)""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("pos"))
    line = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("# "), F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string"))))).otherwise("# not a hash")
    return images.nearest_section(d.withColumn("line", line), "doc_id").select("doc_id", "pos", "section")


@query("a18_identical_clusters", f"""WITH r AS (SELECT c_nationkey AS n, c_custkey % 5 AS g, c_custkey AS k FROM customer), c AS (SELECT n, g, count(*) AS size, count(DISTINCT k % 2) = 1 AS shared_light FROM r GROUP BY ALL)
  SELECT 'P' || n AS paper_id, 'img' || g AS image, size, shared_light, NOT shared_light AS review FROM c WHERE size > 1""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("paper_id"), F.concat(F.lit("img"), (k % 5).cast("string")).alias("image"), F.concat(F.lit("ab"), k.cast("string")).alias("name"),
        recipes.region(F.col("c_nationkey")).alias("vh"), recipes.region(k % 2).alias("vl"), F.lit("").alias("loop"), F.lit("one figure").alias("context"))
    return images.identical_clusters(r).select("paper_id", "image", "size", "shared_light", "review")


EVIDENCE_SQL = f"""SELECT concat('P', {_S('o_custkey')}) AS paper_id, concat('Ab-', {_S('o_orderkey % 3')}) AS name, o_orderkey AS seq, {recipes.region_sql('o_orderkey % 7')} AS vh_sequence_aa,
  CASE o_orderkey % 4 WHEN 0 THEN 'api_fetch' WHEN 1 THEN 'table_extract' WHEN 2 THEN 'sequence_image' ELSE 'figure_or_image' END AS source, concat({_S('o_orderkey % 5 + 1')}, ' nM') AS kd FROM orders"""


@query("or1_merge_evidence", f"""WITH e AS ({EVIDENCE_SQL}), p AS (SELECT *, CASE source WHEN 'api_fetch' THEN 3 WHEN 'sequence_image' THEN 2 ELSE 1 END AS rank FROM e), m AS (SELECT *, max(rank) OVER (PARTITION BY paper_id, name ORDER BY seq) AS top FROM p),
  w AS (SELECT *, coalesce(lag(top) OVER (PARTITION BY paper_id, name ORDER BY seq), 0) AS before FROM m)
  SELECT paper_id, lower(name) AS name_key, arg_max(vh_sequence_aa, seq) FILTER (rank > before OR (rank = 3 AND before = 3)) AS vh, arg_min(kd, seq) AS kd FROM w GROUP BY 1, 2""")
def _(spark, sf_dir):
    e = _sql(spark, sf_dir, "orders", EVIDENCE_SQL)
    e = e.select("paper_id", "name", "seq", "vh_sequence_aa", "source", F.col("kd").alias("Binding_Kinetics_KD"), F.lit("").alias("pointer"), F.lit("").alias("context"), F.lit(False).alias("pdb"), F.lit("").alias("isotype"))
    none = spark.createDataFrame([], "paper_id string, name string")
    m = evidence.merge_evidence(none, e).filter("action = 'value'")
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    return m.groupBy("paper_id", "name_key").agg(value("vh_sequence_aa").alias("vh"), value("Binding_Kinetics_KD").alias("kd"))


@query("n04_source_entries", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'API Fetch: PDB 7ABC' WHEN 1 THEN 'Sequence image: img' || p_size || '.png' ELSE 'Table S' || p_size END AS label,
  CASE p_partkey % 3 WHEN 2 THEN 'Table S' || p_size END AS place FROM part""")
def _(spark, sf_dir):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    kind = evidence.source_type(F.lit(False), F.when(k == 0, "7ABC").otherwise(""), k == 1, F.lit(""))
    entry = evidence.source_entry(kind, F.lit(None).cast("string"), F.when(k == 2, F.concat(F.lit("as given in Table S"), size, F.lit(" of the paper"))).otherwise(""), F.when(k == 1, F.concat(F.lit("img"), size, F.lit(".png"))).otherwise(""), F.when(k == 0, "7ABC").otherwise(""), F.lit("pdb"))
    return table(spark, sf_dir, "part").select("p_partkey", entry.alias("e")).select("p_partkey", F.col("e.source_label").alias("label"), F.col("e.paper_location").alias("place"))


REPLY_SQL = f"""SELECT concat('P', {_S('c_custkey')}) AS paper_id, CASE c_custkey % 4 WHEN 0 THEN concat('{{"P', {_S('c_custkey')}, '": {{"antibodies": [', r, ']}}}}') WHEN 1 THEN concat('{{"antibodies": [', r, ']}}')
  WHEN 2 THEN concat('[', r, ']') ELSE concat('{{"other": {{"antibodies": [', r, ']}}}}') END AS reply
  FROM (SELECT c_custkey, concat('{{"Antibody_Name": "', c_name, '", "Affinity_nM": "', {_S('c_custkey % 9')}, ' nM", "PK_source": "x", "Target_Name": {{"value": "", "quote": "', c_mktsegment, '"}}, "CDRH3_Sequence": "see Table 2 for the sequence"}}') AS r FROM customer) AS made"""


@query("n01_reply_records", "SELECT 'P' || c_custkey AS paper_id, 0 AS ab_idx, c_name AS name, c_custkey % 9 || ' nM' AS kd, c_mktsegment AS target, '' AS loop FROM customer")
def _(spark, sf_dir):
    r = skeleton.reply_records(_sql(spark, sf_dir, "customer", REPLY_SQL))
    get = lambda f: F.try_element_at("record", F.lit(f))
    return r.select("paper_id", "ab_idx", get("Antibody_Name").alias("name"), get("Binding_Kinetics_KD").alias("kd"), get("Target_Name").alias("target"), get("CDRH3_Sequence").alias("loop"))


@query("w06_pages", """WITH p AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 4 AS n FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY c, n ORDER BY page) = 1 AS new FROM p),
  s AS (SELECT c, min(page) FILTER (NOT new OR page = 3) AS last FROM f GROUP BY c) SELECT 'P' || f.c AS paper_id, count(DISTINCT n) AS records FROM f JOIN s USING (c) WHERE s.last IS NULL OR f.page <= s.last GROUP BY 1""")
def _(spark, sf_dir):
    pages = _sql(spark, sf_dir, "orders", f"SELECT concat('P', {_S('o_custkey')}) AS paper_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 4 AS n FROM orders")
    record = F.create_map(F.lit("Antibody_Name"), F.concat(F.lit("ab"), F.col("n").cast("string")))
    pages = pages.select("paper_id", "page", (F.col("page") != 3).alias("has_more"), F.lit(0).alias("ab_idx"), record.alias("record"))
    return skeleton.one_list(pages, 100).groupBy("paper_id").agg(F.count("*").alias("records"))


@query("j13_expand_targets", """WITH r AS (SELECT c_custkey AS k, c_custkey % 3 AS m FROM customer) SELECT 'P' || k AS paper_id, t AS target, CASE WHEN m = 0 AND t = 'RBD 1' THEN k || ' nM' WHEN m = 0 THEN k + 1 || ' nM' ELSE 'old' END AS kd
  FROM r, unnest(CASE WHEN m = 0 THEN ['RBD 1', 'A35'] ELSE ['RBD 1'] END) u(t)""")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("paper_id"))
    nm = lambda n: F.concat((F.col("k") + n).cast("string"), F.lit(" nM"))
    r = c.select("paper_id", F.lit("Ab-1").alias("name"), F.lit("RBD 1").alias("Target_Name"), F.lit("old").alias("Binding_Kinetics_KD"), F.lit("PDB").alias("Structure"))
    some = F.when(F.col("k") % 3 == 0, F.array(F.struct(F.lit("RBD 1").alias("t"), nm(0).alias("v")), F.struct(F.lit("A35").alias("t"), nm(1).alias("v")))).when(F.col("k") % 3 == 1, F.array(F.struct(F.lit("RBD 1").alias("t"), nm(0).alias("v")))).otherwise(
        F.array(F.struct(F.lit("RBD 1").alias("t"), F.lit("").alias("v")), F.struct(F.lit("A35").alias("t"), nm(1).alias("v"))))
    e = c.select("paper_id", "k", F.posexplode(some).alias("seq", "x")).select("paper_id", F.lit("ab-1").alias("name"), F.col("x.t").alias("Target_Name"), F.col("x.v").alias("Binding_Kinetics_KD"), "seq")
    return merge.expand_targets(r, e).select("paper_id", F.col("Target_Name").alias("target"), F.col("Binding_Kinetics_KD").alias("kd"))


@query("j14_cross_reactive", """WITH r AS (SELECT c_nationkey AS n, c_custkey AS k FROM customer) SELECT 'P' || n AS paper_id, 'ab' || k % 50 AS name, 'CD' || k % 4 AS target, '5 nM' AS kd FROM r
  UNION ALL SELECT DISTINCT 'P' || r.n, 'ab' || k % 50, 'RBD', '' FROM r
  UNION ALL SELECT DISTINCT 'P' || n, 'ab' || k % 50, 'CD' || (k % 3), '' FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.n = r.n AND o.k % 50 = r.k % 50 AND o.k % 4 = r.k % 3)""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    r = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("P"), s(F.col("c_nationkey"))).alias("paper_id"), F.concat(F.lit("ab"), s(k % 50)).alias("name"), F.concat(F.lit("CD"), s(k % 4)).alias("Target_Name"),
        F.concat(F.lit("RBD; broad reactivity | CD"), s(k % 3)).alias("Cross_Reactivity"), F.lit("5 nM").alias("kd"))
    return records.cross_reactive(r, metrics=("kd",)).select("paper_id", "name", F.col("Target_Name").alias("target"), "kd")


_ABOUT = chosen(3, "'spike'", "'amplification failed for this clone'", "'control antibody only'", "''")
NON_CORE_SQL = f"SELECT k, {chosen(2, _S('k'), 'concat(' + q('mrca-') + ', ' + _S('k') + ')', q('AB1h2k'))} AS name, {_ABOUT} AS target, CASE WHEN k % 2 = 0 THEN '' ELSE 'CARDYW' END AS loop, CASE WHEN k % 5 = 0 THEN '' ELSE '1 nM' END AS kd, CASE k % 7 WHEN 0 THEN 'Chimeric IgG' ELSE 'IgG' END AS kind FROM (SELECT p_partkey AS k FROM part) AS keys"


@query("p09_non_core", f"""SELECT k, (contains(target, 'failed') AND loop = '') OR (contains(target, 'control antibody') AND loop = '' AND kd = '') OR contains(name, 'mrca') OR name = 'AB1h2k' OR contains(kind, 'Chimeric') AS dropped FROM ({NON_CORE_SQL})""")
def _(spark, sf_dir):
    r = _sql(spark, sf_dir, "part", NON_CORE_SQL)
    fields = {"Antibody_Name": "name", "Target_Name": "target", "CDRH3_Sequence": "loop", "Binding_Kinetics_KD": "kd", "Antibody_Type": "kind"}
    return r.select("k", records.non_core({f: F.col(c) for f, c in fields.items()}).alias("dropped"))


@query("p11_p13_phrases", f"""SELECT k, contains(t, 'control mAb') OR contains(t, 'previously described') AS cited, regexp_matches(lower(t), 'not reported|unknown') OR (contains(lower(t), 'sequence') AND regexp_matches(lower(t), '\\bfigure\\b')) AS worded
  FROM (SELECT p_partkey AS k, {chosen(3, q('used as control mAbs here'), q('Sequence shown in Figure 2'), q('previously described by others'), q('ACDEFG'), q('Not Reported'), q('sequence data'), k='p_partkey')} AS t FROM part)""")
def _(spark, sf_dir):
    r = _sql(spark, sf_dir, "part", f"SELECT p_partkey AS k, {chosen(3, q('used as control mAbs here'), q('Sequence shown in Figure 2'), q('previously described by others'), q('ACDEFG'), q('Not Reported'), q('sequence data'), k='p_partkey')} AS t FROM part")
    return r.select("k", records.cited(F.col("t")).alias("cited"), records.without_sequence(F.col("t")).alias("worded"))


@query("v05_germline", f"""SELECT k, CASE WHEN v < 80 THEN 'warn' ELSE 'pass' END AS identity, g LIKE 'IGK%' AS mismatch FROM (SELECT p_partkey AS k, p_size + 50 AS v, CASE p_partkey % 2 WHEN 0 THEN 'IGHV1-2' ELSE 'IGKV1-5' END AS g FROM part)""")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "IGHV1-2").otherwise("IGKV1-5"), F.lit(" ("), (F.col("p_size") + 50).cast("string"), F.lit(" %)")).alias("g"))
    c = p.select("k", validate.germline_checks(F.col("g"), F.lit("")).alias("c"))
    status = lambda n: F.get(F.filter("c", lambda x: x["check"] == n), F.lit(0))["status"]
    return c.select("k", status("VH_germline_identity").alias("identity"), (F.coalesce(status("VH_germline_chain_mismatch"), F.lit("")) == "fail").alias("mismatch"))


@query("w05_name_ranking", f"""SELECT k, name, 1 + (k % 2 = 0)::INT - 2 * (k % 3 = 0)::INT AS score FROM (SELECT k, unnest(n) AS name FROM (SELECT k, {_NAMES.replace('(t,', '(names,')} AS n FROM ({PAPERS_SQL})))""")
def _(spark, sf_dir):
    p = _sql(spark, sf_dir, "part", PAPERS_SQL).select("k", "names", scan.antibody_names(F.col("names")).alias("n"))
    says = F.concat(F.lit("Of the names "), "names", F.lit(" each antibody was isolated"), F.when(F.col("k") % 2 == 0, " (Table 2)").otherwise(""), F.when(F.col("k") % 3 == 0, " for its germline").otherwise(""), F.lit(". More."))
    return blocks.ranked_names(p.select("k", F.col("n").alias("names"), says.alias("t")), "k").select("k", "name", "score")
