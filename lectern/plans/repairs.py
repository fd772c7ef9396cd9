"""Queries of text repair, of the reply cache and of workbooks, with SQL that computes the same by other means."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lectern.operators import repair
from lectern.plans.catalog import query
from lectern.plans.extraction import _S, _sql
from lectern.plans.recipes import chosen, q, region_sql
from lectern.sources import replies, workbooks

_N = _S("k")
_TABLE = f"concat('Table ', {_N}, ': SPR results for the mutant antibodies of the paper', chr(10), '<table><tr><td>Fen</td><td>Fe(Fe)</td></tr><tr><td>WT</td><td>', {_N}, '.5</td></tr><tr><td>A28V</td><td>8.08</td></tr></table>')"
_WORDS = f"concat('The binding of GenBank MN', {_S('100000 + k')}, ' to', chr(10), 'the spike was measured at ', {_N}, '.5 nM by SPR; the region ', substr({region_sql('k')}, 1, 40), chr(10), 'was cloned & expressed in cells of the ovary and purified')"
_PLAIN = "concat('Words without any numbers that go on', chr(10), 'for a while, as texts do which tell of methods and', chr(10), 'of many authors and of how samples were kept on ice')"
#: Three blocks a paper, each too long to share a chunk of 260 characters with another.
BLOCKS_SQL = f"SELECT k, i, CASE i WHEN 1 THEN {_TABLE} WHEN 2 THEN {_WORDS} ELSE {_PLAIN} END AS block FROM (SELECT p_partkey AS k FROM part) AS keys CROSS JOIN (VALUES (1), (2), (3)) AS turns(i)"
_JSON = "concat('{{\"changed\": true, \"notes\": \"', {1}, '\", \"repaired_text\": \"', replace({0}, chr(10), concat(chr(92), 'n')), '\"}}')".format
_HEADER = "replace(replace(block, '<td>Fen</td>', '<th>Variant</th>'), '<td>Fe(Fe)</td>', '<th>KD (nM)</th>')"
_REPLY = chosen(
    5, _JSON("replace(block, chr(10), ' ')", "''"), _JSON("replace(block, '.5', '5')", "'digits'"), _JSON(_HEADER, "''"), _JSON("replace(block, 'Fen', 'Nonsense')", "''"), _JSON(f"replace({_HEADER}, '8.08', '8.09')", "''"), "'no json'", "'{\"changed\": true}'",
    _JSON("replace(block, 'AC', 'CA')", "''"), _JSON("replace(block, ' the ', '  the  ')", "'spaces'"), _JSON("concat('  ', block)", "''"), _JSON("''", "''"), "concat('```json', chr(10), " + _JSON("replace(block, 'words', 'text')", "''") + ", chr(10), '```')", k="(k + i * 7)",
)
ANSWERS_SQL = f"SELECT k, i, block, CASE WHEN (k + i) % 13 = 0 THEN NULL ELSE {_REPLY} END AS reply FROM ({BLOCKS_SQL}) AS blocks"



def _tokens(c: str) -> str:
    found = lambda p: f"regexp_extract_all({c}, '{p}')"
    return f"list_sort(list_concat(list_concat(list_transform({found(repair.PROTECTED_IDS)}, lambda x: regexp_replace(upper(x), '\\s+', '', 'g')), {found(repair.PROTECTED_DIGITS)}), {found(repair.PROTECTED_SEQUENCES)}))"


_OUTSIDE = "trim(regexp_replace(regexp_replace({0}, '(?s)<table.*</table>', ' ', 'g'), '\\s+', ' ', 'g'))"
_HEAD = "regexp_extract_all(regexp_extract({0}, '<tr>(.*?)</tr>', 1), '<t[dh]>([^<]*)</t[dh]>', 1)"
_JUDGED = f"""answers AS ({ANSWERS_SQL}), read AS (
    SELECT *, regexp_extract(reply, '"notes": "([^"]*)"', 1) AS notes, CASE WHEN contains(reply, '"repaired_text"') THEN trim(replace(regexp_extract(reply, '"repaired_text": "([^"]*)"', 1), chr(92) || 'n', chr(10))) END AS new FROM answers
  ), guarded AS (
    SELECT *, CASE WHEN reply IS NULL THEN 'llm_repair_failed_keep_original' WHEN NOT contains(reply, '{{') THEN 'payload_not_dict_keep_original' WHEN new IS NULL THEN 'missing_repaired_text_keep_original' WHEN new = '' THEN 'empty_repaired_text_keep_original' WHEN new = block THEN coalesce(nullif(notes, ''), 'no_change') END AS kept,
      {_tokens('new')} = {_tokens('block')} AS same,
      contains(block, '<table') AND {_OUTSIDE.format('new')} = {_OUTSIDE.format('block')} AND regexp_extract(new, '</tr>(.*)</table>', 1) = regexp_extract(block, '</tr>(.*)</table>', 1)
        AND len({_HEAD.format('new')}) = 2 AND ({_HEAD.format('new')} = {_HEAD.format('block')} OR len(list_filter({_HEAD.format('new')}, lambda x: NOT list_contains([{', '.join(map(q, repair.HEADERS))}], regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')))) = 0) AS header
    FROM read
  ), judged AS (
    SELECT *, kept IS NULL AND (same OR header) AS changed, kept IS NULL AND NOT same AND NOT header AS rejected,
      coalesce(kept, CASE WHEN same THEN coalesce(nullif(notes, ''), 'chunk_repaired') WHEN header THEN coalesce(nullif(notes, ''), 'table_header_whitelist_repair') ELSE 'protected_tokens_changed_keep_original' END) AS note FROM guarded
  )"""


def _judged(spark, sf_dir):
    blocks = _sql(spark, sf_dir, "part", BLOCKS_SQL)
    paper = F.concat(F.lit("P"), F.col("k").cast("string")).alias("paper_id")
    papers = blocks.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "block"))), lambda x: x["block"]), "\n\n").alias("text")).select(paper, "text")
    answers = _sql(spark, sf_dir, "part", ANSWERS_SQL).select(paper, F.col("i").alias("chunk_index"), "reply", F.lit(None).cast("string").alias("error"))
    return papers, repair.judged_repairs(repair.repair_chunks(papers, 260), answers)


@query("x01_chunk_repairs", f"WITH {_JUDGED} SELECT 'P' || k AS paper_id, i AS chunk_index, 3 AS n_chunks, CASE WHEN changed THEN new ELSE block END AS repaired, changed, rejected, note FROM judged")
def _(spark, sf_dir):
    return _judged(spark, sf_dir)[1].select("paper_id", "chunk_index", "n_chunks", "repaired", "changed", "rejected", "note")


@query("x01_repaired_texts", f"""WITH {_JUDGED} SELECT 'P' || k AS paper_id, string_agg(CASE WHEN changed THEN new ELSE block END, chr(10) || chr(10) ORDER BY i) AS repaired_text, bool_or(changed) AS used_repaired_text,
    count(*) FILTER (changed) AS changed_chunks, count(*) FILTER (rejected) AS rejected_chunks, count(*) FILTER (reply IS NULL) AS failed_chunks FROM judged GROUP BY k""")
def _(spark, sf_dir):
    papers, judged = _judged(spark, sf_dir)
    return repair.repaired_texts(papers, judged, 1).select("paper_id", "repaired_text", "used_repaired_text", "changed_chunks", "rejected_chunks", "failed_chunks")


@query("s12_reply_cache", """SELECT c_custkey AS k, '{"digest":"' || substr(md5(c_mktsegment || c_nationkey), 1, 8) || '","chars":' || length(c_mktsegment || c_nationkey) || '}' AS reply, 1 AS tries, 2 - (c_nationkey % 2 = 0)::INT AS version FROM customer""")
def _(spark, sf_dir):
    """Two runs through one cache: the second, with all prompts, asks only for those that the first had not."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), "c_nationkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("prompt"))
    asked = rows.withColumn("key", replies.reply_key(F.lit("model"), F.col("prompt")))
    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    path = f"{folder}/lectern/replies-{uuid.uuid4().hex}"
    replies.ask(asked.filter("c_nationkey % 2 = 0"), path, 1)
    told = replies.ask(asked, path, 2)
    return told.join(replies.read_replies(spark, path).select("key", "tries", F.col("version").cast("int").alias("version")), "key").select("k", "reply", "tries", "version")


_ROWS = {
    "Antibody_Name": "CASE WHEN k % 11 = 0 THEN ' ' ELSE c_name END", "Anitbody_Isotype": chosen(3, "'IgG1'", "' none '", "'IgM & more <x>'"), "Target_Name": "c_mktsegment", "Epitope": chosen(2, "'NaN'", "concat('site ', cast(k % 9 as string))"), "Not a field": "'x'",
    "Reference Source": chosen(5, "concat('Smith et al. Nat Med ', cast(1990 + k % 30 as string), '. doi: 10.1000/x', cast(k as string), '.')", "concat('(A. B. Kim et al.) Cell Host Microbe ', cast(2000 + k % 20 as string))", "'unpublished'", "''"), "Epitope ": "'repeated'",
}
#: A column a customer, a sheet a nation and segment, a workbook a nation.
SHEETS_SQL = f"SELECT k, n, c_mktsegment AS sheet, {', '.join(f'{c} AS f{i}' for i, c in enumerate(_ROWS.values()))} FROM (SELECT c_custkey AS k, c_nationkey AS n, c_name, c_mktsegment FROM customer) AS keys"
_CLEAN = "CASE WHEN lower(trim({0})) IN ('', 'nan', 'none', 'null') THEN '' ELSE trim({0}) END".format


def _books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A workbook of each row's sheets: heading, labels in column 0, a column a record."""
    for batch in batches:
        out = []
        for n, columns in zip(batch["n"], batch["columns"], strict=True):
            sheets: dict[str, dict] = {}
            filled: dict[str, int] = {}
            for c in columns:
                cells = sheets.setdefault(c["sheet"], {(0, 0): "Field"} | {(i, 0): label for i, label in enumerate(_ROWS, 1)})
                at = filled[c["sheet"]] = filled.get(c["sheet"], 0) + 1
                cells[0, at] = float(c["k"])
                cells.update({(i, at): value for i, value in enumerate(c["values"], 1)})
            out.append((f"book-{n}.xlsx", workbooks.workbook(sheets)))
        yield pd.DataFrame(out, columns=["path", "content"])


@query("s05_workbook_records", f"""SELECT 'book-' || n || '.xlsx' AS path, sheet, (row_number() OVER (PARTITION BY n, sheet ORDER BY k) - 1)::INT AS ab_idx, trim(f0) AS name, {_CLEAN('f1')} AS isotype, {_CLEAN('f3')} AS epitope,
    CASE WHEN starts_with(f5, 'Smith') THEN 'Smith et al. Smith . Nat Med, ' || regexp_extract(f5, '(\\d{{4}})', 1) || '. DOI: ' || regexp_extract(f5, '(10[.]1000/x\\d+)', 1) WHEN starts_with(f5, '(') THEN 'Kim et al. Cell Host Microbe, ' || regexp_extract(f5, '(\\d{{4}})', 1) ELSE f5 END AS reference
  FROM ({SHEETS_SQL}) WHERE trim(f0) <> ''""")
def _(spark, sf_dir):
    columns = _sql(spark, sf_dir, "customer", SHEETS_SQL)
    each = F.struct("k", "sheet", F.array(*[f"f{i}" for i in range(len(_ROWS))]).alias("values"))
    files = columns.groupBy("n").agg(F.array_sort(F.collect_list(each)).alias("columns")).mapInPandas(_books, "path string, content binary")
    r = workbooks.workbook_records(workbooks.workbook_cells(files), ("path", "sheet"))
    return r.select("path", "sheet", "ab_idx", *[F.element_at("record", f).alias(n) for f, n in (("Antibody_Name", "name"), ("Antibody_Isotype", "isotype"), ("Epitope", "epitope"), ("Reference_Source", "reference"))])
