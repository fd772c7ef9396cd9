"""Queries of records without a model, of prompts, of resumed replies and of a run's spans, with SQL by other means."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import heuristic, trace
from lectern.plans.catalog import query
from lectern.plans.extraction import _S, _sql
from lectern.plans.recipes import chosen, residues_sql
from lectern.sources import replies

_K = _S("k")
_ROW = "concat('<tr><td>', {0}, '</td><td>', {1}, '</td><td>', {2}, '</td><td>', {3}, '</td></tr>')".format
_LOOP = f"substr({residues_sql(_K)}, 1, 14)"
_TABLE = f"""concat('<table><tr><th>mAb</th><th>CDRH3</th><th>KD</th><th>Constant region genes</th></tr>', {_ROW(f"concat('Ab', {_K})", _LOOP, f"concat({_K}, ' nM')", chosen(2, "'IGHG1*01'", "'IGHA2'", "'none'", "'IGHM'"))}, {_ROW(f"concat('ab', {_K})", "'repeated'", "''", "''")}, {_ROW("'EV35-2'", "''", "'3 nM'", "'ighg1'")}, {_ROW("''", "'x'", "''", "''")}, '</table>')"""
_STRUCTURES = "concat('<table><tr><td>Data collection</td><td>EV35-2 + A35</td><td>other</td></tr><tr><td>PDB code</td><td> 8ABC </td><td>9XYZ</td></tr></table>')"
_WORDS = chosen(3, "'cross-reactive to VACV, by ELISA and SPR'", "'MPXV A35 (Clade IIb) binding by biolayer interferometry'", "'complement-dependent killing, EV35-7 + A35'", "'nothing'")
_NAMED = f"concat('clones 100-B', {_S('k % 90')}, ' and 77-C1, again 77-C1')"
#: Papers with tables of antibodies, with names alone, or with neither.
PAPERS_SQL = f"SELECT k, concat('P', {_K}) AS paper_id, {chosen(5, f'concat(chr(47), chr(80), {_K}, chr(47), chr(97))', f'concat(chr(47), chr(70), {_K}, chr(47), chr(97))')} AS path, concat({_WORDS}, chr(10), {chosen(2, _TABLE, f'concat({_TABLE}, chr(10), {_STRUCTURES})', _NAMED, chr(39) + 'no name' + chr(39))}) AS text FROM (SELECT p_partkey AS k FROM part) AS keys"


@query("n07_heuristic_records", f"""WITH p AS ({PAPERS_SQL}), t AS (
    SELECT *, contains(text, '<th>mAb') AS tabled, contains(text, 'Data collection') AS placed, CASE WHEN starts_with(path, '/F') THEN 'F' || k ELSE paper_id END AS title, CASE WHEN contains(text, 'MPXV A35 (Clade IIb)') THEN 'MPXV A35 (Clade IIb)' WHEN regexp_matches(text, 'EV35-\\d+ \\+ A35') THEN 'MPXV A35' ELSE '' END AS target,
      concat_ws('; ', CASE WHEN contains(text, 'cross-reactive') THEN 'Cross-reactive binding' END, CASE WHEN contains(text, 'complement-dependent') THEN 'Complement-dependent activity' END) AS mechanism,
      concat_ws(', ', CASE WHEN contains(text, 'ELISA') THEN 'ELISA' END, CASE WHEN contains(text, 'biolayer') THEN 'BLI' END, CASE WHEN contains(text, 'SPR') THEN 'SPR' END) AS experiment FROM p
  ), cells AS (SELECT *, unnest(range(1, 3)) AS r FROM t WHERE tabled), rows AS (SELECT *, regexp_extract_all(regexp_extract_all(text, '<tr>(.*?)</tr>', 1)[CASE r WHEN 1 THEN 2 ELSE 4 END], '<td>([^<]*)</td>', 1) AS c FROM cells)
  SELECT paper_id, (r - 1)::INT AS idx, TRUE AS from_table, c[1] AS name, c[2] AS loop, c[3] AS kd, CASE WHEN upper(c[4]) LIKE 'IGHG1%' THEN 'Monoclonal IgG1' WHEN upper(c[4]) LIKE 'IGHA%' THEN 'Monoclonal IgA' WHEN upper(c[4]) LIKE 'IGHM%' THEN 'Monoclonal IgM' ELSE '' END AS kind, target,
    CASE WHEN contains(text, 'cross-reactive') AND contains(text, 'VACV') THEN 'VACV A33' ELSE '' END AS cross_reactivity, mechanism, experiment, CASE WHEN placed AND c[1] = 'EV35-2' THEN 'A35 complex (PDB: 8ABC)' ELSE '' END AS structure, title AS reference FROM rows
  UNION ALL SELECT paper_id, (row_number() OVER (PARTITION BY k ORDER BY name) - 1)::INT, FALSE, name, '', '', '', '', '', '', '', '', paper_id FROM (SELECT DISTINCT k, paper_id, unnest(regexp_extract_all(text, '(\\d+-[A-Z]\\d+|EV35)')) AS name FROM t WHERE NOT tabled)""")
def _(spark, sf_dir):
    r = heuristic.heuristic_records(_sql(spark, sf_dir, "part", PAPERS_SQL).select("paper_id", "path", "text"))
    fields = {"name": "Antibody_Name", "loop": "CDRH3_Sequence", "kd": "Binding_Kinetics_KD", "kind": "Antibody_Type", "target": "Target_Name", "cross_reactivity": "Cross_Reactivity", "mechanism": "Mechanism_of_Action", "experiment": "Experiment", "structure": "Structure", "reference": "Reference_Source"}
    return r.select("paper_id", "idx", "from_table", *[F.element_at("record", f).alias(n) for n, f in fields.items()])


_TEMPLATE = "Hints: {REGEX_HINTS}\nPaper {PAPER_ID}\nFocus: {PAPER_FOCUS_ANALYSIS}\n---\n{DOCUMENT_TEXT}\n---"
DOCS_SQL = f"SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN substr(text, 1, 90) ELSE '' END AS reduced, CASE WHEN doc_id % 3 = 0 THEN 'names: {{A-1}}' ELSE '' END AS hints, CASE WHEN doc_id % 5 = 0 THEN 'fix it' ELSE '' END AS corrections, CASE WHEN doc_id % 7 = 0 THEN 'hint' ELSE '' END AS image_hints FROM documents"


@query("n08_document_prompts", f"""WITH d AS (SELECT *, CASE WHEN reduced <> '' THEN reduced ELSE coalesce(text, '') END AS body FROM ({DOCS_SQL}))
  SELECT doc_id, length(body) > 300 AS cut, md5(CASE WHEN reduced <> '' THEN '{heuristic.REDUCED[:-2]}' || chr(10) || chr(10) ELSE '' END || 'Hints: ' || hints || chr(10) || 'Paper P' || doc_id || chr(10) || 'Focus: ' || CASE doc_id % 3 WHEN 0 THEN 'as told'
      WHEN 1 THEN '- entity_risks: a; b' || chr(10) || '- split_policy: none' ELSE '{heuristic.NO_FOCUS}' END || chr(10) || '---' || chr(10) || CASE WHEN length(body) > 300 THEN left(body, 300) || chr(10) || chr(10) || '[... truncated ...]' ELSE body END || chr(10) || '---'
    || CASE WHEN image_hints <> '' THEN chr(10) || chr(10) || image_hints ELSE '' END || CASE WHEN corrections <> '' THEN chr(10) || chr(10) || '[修正要求 - 请根据以下反馈修正你的输出]:' || chr(10) || corrections ELSE '' END) AS prompt_md5 FROM d""")
def _(spark, sf_dir):
    d = _sql(spark, sf_dir, "documents", DOCS_SQL)
    case, none = F.col("doc_id") % 3, F.lit(None).cast("array<string>")
    focus = F.struct(F.when(case == 0, " as told ").otherwise("").alias("paper_focus_text"), none.alias("paper_type"), none.alias("primary_evidence_sources"), F.when(case == 1, F.array(F.lit("a"), F.lit("b"))).alias("entity_risks"), F.array().cast("array<string>").alias("sequence_focus"), F.when(case == 1, "none").alias("split_policy"))
    p = heuristic.document_prompts(d.withColumn("paper_id", F.concat(F.lit("P"), F.col("doc_id").cast("string"))).withColumn("focus", focus), _TEMPLATE, 300)
    return p.select(F.substring("paper_id", 2, 20).cast("long").alias("doc_id"), "cut", F.md5("prompt").alias("prompt_md5"))


@query("n08_packed_sections", """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS pos, l_quantity::INT % 3 AS pri, repeat(l_returnflag || ' ', l_linenumber::INT % 4) || l_linenumber AS t FROM lineitem),
  r AS (SELECT *, sum(length(t) + 2) OVER (PARTITION BY k ORDER BY pri, pos, t ROWS UNBOUNDED PRECEDING) - 2 <= 45 AS ok FROM s)
  SELECT k, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY pos, t) FILTER (ok), '') AS text, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM r GROUP BY k""")
def _(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    words = F.concat(F.repeat(F.concat("l_returnflag", F.lit(" ")), (F.col("l_linenumber") % 4).cast("int")), F.col("l_linenumber").cast("string"))
    s = li.select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_linenumber").alias("p"), words.alias("t")).alias("pos"), (F.col("l_quantity").cast("int") % 3).alias("priority"), words.alias("text"))
    return heuristic.packed_sections(s, "k", 45)


@query("s29_resumed_runs", """WITH w AS (SELECT c_custkey AS k, '{"n":' || c_custkey || ',"list":[' || array_to_string(list_transform(range(1 + c_custkey % 9), lambda i: '"' || i || 'of' || c_custkey || '",'), '') || '0]}' AS reply FROM customer)
  SELECT k, reply, ((length(reply) - 1) // 24)::INT AS rounds, TRUE AS whole FROM w WHERE length(reply) <= 72""")
def _(spark, sf_dir):
    """A model that says 24 characters at a time, from the second on with the last nine before them; three calls at most, so longer replies stay cut off."""

    def call(prompt: str) -> str:
        n = int(prompt.split("\n")[0])
        whole = f'{{"n":{n},"list":[' + "".join(f'"{i}of{n}",' for i in range(1 + n % 9)) + "0]}"
        at = len(prompt.partition("\n")[2].removesuffix(replies.CONTINUE))
        return whole[max(0, at - 9) : at + 24]

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("prompt"))
    asked = c.withColumn("key", replies.reply_key(F.lit("model"), F.col("prompt")))
    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    told = replies.resumed(asked, f"{folder}/lectern/resumed-{uuid.uuid4().hex}", 1, call, 2)
    return asked.select("k", "key").join(told.filter("whole"), "key").select("k", "reply", "rounds", "whole")


_R = "k % 40"
#: Spans of fifty papers and more: phases side by side, agents across them, tools in, out of and between both.
RUN_SQL = f"""SELECT cast(floor(k / 40) as bigint) AS p, k AS id, CASE WHEN {_R} < 4 THEN 'phase' WHEN {_R} < 14 THEN 'agent' ELSE 'tool' END AS kind, CASE WHEN {_R} < 4 THEN concat('phase ', cast({_R} as string)) ELSE 'x' END AS name, CASE WHEN k % 11 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN {_R} < 4 THEN {_R} * 1000 WHEN {_R} < 14 THEN ({_R} * 377 + k) % 4000 ELSE (k * 291) % 4000 END AS s, CASE WHEN {_R} < 4 THEN {_R} * 1000 + 900 WHEN {_R} < 14 THEN ({_R} * 377 + k) % 4000 + (k * 53) % 700 ELSE (k * 291) % 4000 + (k * 17) % 150 END AS e, k % 500 AS tokens FROM (SELECT p_partkey AS k FROM part) AS keys"""


@query("a31_paper_table", f"""WITH r AS ({RUN_SQL}), around AS (
    SELECT i.*, arg_max(o.name, (o.s, -o.e)) FILTER (o.kind = 'phase') AS phase, count(o.id) FILTER (o.kind = 'agent') > 0 AS in_agent
    FROM r i LEFT JOIN r o ON i.p = o.p AND o.s <= i.s AND o.e >= i.e AND o.id <> i.id AND o.kind IN ('phase', 'agent') WHERE i.kind <> 'phase' GROUP BY ALL
  ), every AS (SELECT p, kind, status, s, e, tokens, phase, in_agent FROM around UNION ALL SELECT p, kind, status, s, e, tokens, name, FALSE FROM r WHERE kind = 'phase')
  SELECT 'P' || p AS paper_id, phase, count(*) FILTER (kind = 'phase') AS phases, coalesce(sum(e - s) FILTER (kind = 'phase'), 0)::BIGINT AS ms, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (kind = 'agent') AS agents, count(*) FILTER (kind = 'tool') AS tools,
    count(*) FILTER (kind = 'tool' AND in_agent) AS agent_tools, coalesce(sum(e - s) FILTER (kind = 'tool'), 0)::BIGINT AS tool_ms, coalesce(sum(tokens) FILTER (kind = 'tool'), 0)::BIGINT AS tokens FROM every GROUP BY ALL""")
def _(spark, sf_dir):
    r = _sql(spark, sf_dir, "part", RUN_SQL)
    return trace.paper_table(r.select(F.concat(F.lit("P"), F.col("p").cast("string")).alias("paper_id"), "id", "kind", "name", "status", F.col("s").alias("start"), F.col("e").alias("end"), "tokens"))
