"""Queries of a paper's joins and roll-ups, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import jsontext, similarity, text, validate
from lectern.functions.scan import STRUCTURE_ID
from lectern.operators import annotations, images, papers, records, tables, trace
from lectern.plans import recipes
from lectern.plans.catalog import micro, query
from lectern.plans.extraction import CHAINS_SQL, PAPERS_SQL, _j, _s, _dealt, _S, _scored, _sql
from lectern.plans.recipes import LABELS_SQL, SPANS_SQL, chosen, q, table
from lectern.sources import files

_HINT = chosen(2, f"concat('VH of MN', {_S('100000 + k')}, ' and MN', {_S('500000 + k')}, '; cds')", f"concat('MN', {_S('400000 + k')}, ' - MN', {_S('400009 + k')}, ', Sigma reagent')", f"concat('heavy chain GenBank MN', {_S('100000 + k')})", f"concat('Thermo catalog AB', {_S('100000 + k')})", f"concat('MN', {_S('200000 + k')})", f"concat('see MN', {_S('300000 + k')})", f"concat('accession AB', {_S('100000 + k')}, ' to AB', {_S('100005 + k')})")
HINT_SQL = f"SELECT k, {_HINT} AS hint FROM (SELECT p_partkey AS k FROM part) AS keys"


def _said(words: list[str], c: str) -> str:
    """Whether a text has any of the words, case aside."""
    return f"len(list_filter([{', '.join(map(q, words))}], lambda w: contains(lower({c}), w))) > 0"


@query("p25_plausible_accessions", f"""WITH h AS (SELECT k, hint, regexp_extract_all(hint, '[A-Z]{{2}}[0-9]{{6,8}}') AS ids FROM ({HINT_SQL})),
  o AS (SELECT k, hint, CASE WHEN {_said(papers.REJECT, 'hint')} THEN [] WHEN {_said(papers.SUPPORT, 'hint')} OR replace(hint, ' ', '') = ids[1] THEN list_distinct(ids) ELSE [] END AS ids FROM h)
  SELECT k, array_to_string(list_sort(ids), ',') AS ids, len(ids) > 1 AND regexp_matches(hint, '\\b(to|through|thru)\\b|[-–—…]') AS ranged FROM o""")
def _(spark, sf_dir):
    h = _sql(spark, sf_dir, "part", HINT_SQL).withColumn("f", papers.plausible_accessions(F.col("hint")))
    return h.select("k", F.array_join(F.array_sort(F.transform("f", lambda x: x["id"])), ",").alias("ids"), papers.accession_range(F.col("hint"), F.col("f")).alias("ranged"))


@query("b13_best_features", """WITH f AS (SELECT o_custkey AS c, o_orderkey AS k, CASE o_orderkey % 2 WHEN 0 THEN 'heavy' ELSE 'light' END AS chain, o_orderkey % 3 = 0 AS named, o_orderkey % 60 + 80 AS n FROM orders)
  SELECT 'A' || c AS accession, chain, max(named::INT * 100000 + (CASE WHEN chain = 'heavy' THEN n BETWEEN 95 AND 140 ELSE n BETWEEN 90 AND 130 END)::INT * 1000 + n) % 1000 AS n FROM f GROUP BY 1, 2""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    named = F.when(k % 3 == 0, " variable region").otherwise("")
    f = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("accession"), F.concat(F.when(k % 2 == 0, "immunoglobulin heavy chain").otherwise("immunoglobulin kappa light chain"), named).alias("product"),
        F.lit("").alias("gene"), F.lit("").alias("note"), F.substr(F.concat(recipes.region(k), recipes.region(k)), F.lit(1), (k % 60 + 80).cast("int")).alias("translation"))
    return papers.best_features(f).select("accession", "chain", F.length("sequence").cast("long").alias("n"))


@query("j20_sequence_records", f"SELECT 'P' || k AS paper_id, CASE WHEN k % 3 = 0 THEN '' ELSE heavy END AS vh, light AS vl, CASE WHEN k % 3 = 0 THEN 'L' || k ELSE 'H' || k || ',L' || k END AS ids FROM ({CHAINS_SQL})")
def _(spark, sf_dir):
    c = _sql(spark, sf_dir, "part", CHAINS_SQL).withColumn("paper_id", F.concat(F.lit("P"), F.col("k").cast("string")))
    acc = lambda x: F.concat(F.lit(x), F.col("k").cast("string"))
    best = c.filter("k % 3 <> 0").select(acc("H").alias("accession"), F.lit("heavy").alias("chain"), F.concat("heavy", "tail").alias("sequence")).unionByName(c.select(acc("L").alias("accession"), F.lit("light").alias("chain"), F.col("light").alias("sequence")))
    ways = F.explode(F.array(*[F.struct(F.lit(ch).alias("chain"), F.lit(r).alias("rank"), acc(x).alias("accession")) for ch, r, x in (("heavy", 0, "none"), ("heavy", 1, "H"), ("light", 0, "L"))]))
    wanted = c.select("paper_id", F.lit("Ab-1").alias("name"), ways.alias("w")).select("paper_id", "name", "w.*")
    return papers.sequence_records(wanted, best).select("paper_id", "vh", "vl", "ids")


@query("j05_structure_matches", f"""SELECT 'P' || k AS paper_id, 'Nq-' || i AS name, CASE WHEN i = 1 THEN '1AB' || k % 10 ELSE '2CD' || k % 10 END AS code, CASE WHEN i = 1 THEN heavy ELSE '' END AS vh FROM ({CHAINS_SQL}), range(1, 4) t(i) WHERE i < 3""")
def _(spark, sf_dir):
    c = _sql(spark, sf_dir, "part", CHAINS_SQL).withColumn("paper_id", F.concat(F.lit("P"), F.col("k").cast("string")))
    digit = (F.col("k") % 10).cast("string")
    a = c.select("paper_id", F.explode(F.array(*[F.struct(F.lit(f"Nq-{i}").alias("name"), (F.concat(F.lit("PDB 1ab"), digit) if i == 1 else F.lit("")).alias("structure"), F.lit("").alias("hint")) for i in (1, 2, 3)])).alias("x")).select("paper_id", "x.*")
    two = F.array(F.struct(F.concat(F.lit("1AB"), digit).alias("code"), F.lit("complex").alias("title"), F.concat("heavy", "tail").alias("heavy"), F.col("light").alias("light")), F.struct(F.concat(F.lit("2CD"), digit).alias("code"), F.lit("Fab of Nq-2 bound").alias("title"), F.lit("").alias("heavy"), F.lit("").alias("light")))
    s = c.select("paper_id", F.explode(two).alias("x")).select("paper_id", "x.*")
    return papers.structure_matches(a, s).select("paper_id", "name", "code", "vh")


@query("j21_preferred", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS v FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0 OR c_custkey % 5 = 0")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    a = c.filter("k % 3 = 0 OR k % 5 = 0").select("k", F.when(F.col("k") % 3 == 0, F.col("c_name")).otherwise(" ").alias("v"))
    return papers.preferred(a, c.filter("k % 2 = 0").select("k", F.col("c_mktsegment").alias("v")), ["k"], ["v"])


@query("j22_matched_sources", f"""SELECT k, CASE k % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'table' WHEN 2 THEN 'api' END AS source FROM ({CHAINS_SQL})""")
def _(spark, sf_dir):
    c = _dealt(spark, sf_dir, "part", "p_partkey", CHAINS_SQL).withColumns({"paper_id": F.col("k").cast("string"), "name": F.lit("a")})
    k, loop = F.col("k") % 4, F.regexp_extract("heavy", "YYC(AR.*)WGQG", 1)
    field = F.when(k == 1, "Structure").otherwise("CDRH3_Sequence")
    own = c.select("k", "paper_id", "name", field.alias("field"), F.when(k == 0, loop).when(k == 1, "7ABC").when(k == 2, F.concat(F.lit("c"), F.lower(loop))).otherwise("CXXXW").alias("value"))
    said = c.select("paper_id", "name", F.explode(F.array(F.struct(F.lit("vh_sequence_aa").alias("field"), F.col("heavy").alias("value"), F.lit("api").alias("source"), F.lit(1).alias("seq")), F.struct(F.lit("Structure").alias("field"), F.lit("7ABC ").alias("value"), F.lit("table").alias("source"), F.lit(2).alias("seq")))).alias("x")).select("paper_id", "name", "x.*")
    return papers.matched_sources(own, said).select("k", "source")


@query("j16_combined_targets", "SELECT o_custkey AS paper_id, 'ab' || o_orderkey % 3 AS name_key, array_to_string(list_sort(list_distinct(list('f' || o_orderkey % 5))), ',') AS missing, bool_and(o_orderkey % 2 = 0) AS validation_only FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id"), F.concat(F.lit(" Ab"), (k % 3).cast("string")).alias("name"), F.array(F.concat(F.lit("f"), (k % 5).cast("string"))).alias("missing_fields"), (k % 2 == 0).alias("validation_only"))
    return papers.combined_targets(t).select("paper_id", "name_key", _j("missing_fields").alias("missing"), "validation_only")


#: Groups of two images that users have seen, and the images that are known of some users.
SEEN_SQL = "SELECT event_id, user_id, concat('i', cast(event_id as string)) AS a, concat('i', cast(event_id + 1 + event_id % 5 as string)) AS b FROM events"
KNOWN_SQL = "SELECT user_id, concat('i', cast(event_id + event_id % 4 as string)) AS image FROM events WHERE event_id % 3 = 0"


@query("j17_known_images", f"WITH s AS ({SEEN_SQL}), w AS ({KNOWN_SQL}) SELECT event_id, EXISTS (SELECT 1 FROM w WHERE w.user_id = s.user_id AND w.image IN (s.a, s.b)) AS known FROM s")
def _(spark, sf_dir):
    groups = _sql(spark, sf_dir, "events", SEEN_SQL).select("event_id", "user_id", F.array("a", "b").alias("images"))
    return images.known_images(groups, _sql(spark, sf_dir, "events", KNOWN_SQL), "user_id").select("event_id", "known")


_SHOWN = chosen(3, "concat('![](images/', cast(doc_id as string), '.png)')", "concat('words ![a b](', cast(doc_id + 1 as string), '.png) more')", "'plain'", "concat('![](x/y/', cast(doc_id as string), '.jpg)')", k="doc_id")
_READ = chosen(5, "concat('read ', cast(doc_id as string), chr(10), '![](self.png)')", "' '", "concat('two', chr(10), chr(10), 'lines ')", "'![](only.png)'", k="doc_id")
#: A line of each document, and what was read in images, most of which no line shows.
SHOWN_SQL = f"SELECT doc_id, {_SHOWN} AS line, concat(cast(doc_id + doc_id % 2 as string), '.png') AS image, {_READ} AS ocr FROM documents"


@query("j11_ocr_lines", f"""WITH d AS ({SHOWN_SQL}), o AS (SELECT *, regexp_extract(line, '!\\[[^\\]]*\\]\\((?:[^)]*/)?([^/)]+)\\)', 1) AS shown, trim(array_to_string(list_filter(string_split(ocr, chr(10)), lambda x: NOT regexp_matches(x, '!\\[[^\\]]*\\]\\([^)]+\\)')), chr(10)), ' ') AS body FROM d)
  SELECT doc_id, line || CASE WHEN shown = image AND body <> '' THEN chr(10) || '<!-- OCR extracted from ' || image || ' -->' || chr(10) || body || chr(10) || '<!-- end OCR -->' ELSE '' END AS line FROM o""")
def _(spark, sf_dir):
    d = _sql(spark, sf_dir, "documents", SHOWN_SQL)
    return images.with_ocr(d.select("doc_id", F.lit(0).alias("pos"), "line"), d.select("doc_id", "image", F.col("ocr").alias("ocr_text")), "doc_id").select("doc_id", "line")


#: Lines of documents: blocks of recognised text that open and close in places that differ, some twice, some never closed.
LINES_SQL = f"SELECT doc_id, pos, {chosen(3, q('text'), 'concat(' + q('<!-- OCR extracted from ') + ', cast(doc_id + pos as string), ' + q('.png -->') + ')', q('more'), q('<!-- end OCR -->'), q('words'), q('text'), k='(doc_id * 5 + pos)')} AS line FROM (SELECT doc_id FROM documents) AS d CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) AS places(pos)"


@query("w10_ocr_owner", f"""WITH l AS (SELECT *, CASE WHEN starts_with(line, '<!-- OCR') THEN regexp_extract(line, 'from (.*) -->', 1) WHEN starts_with(line, '<!-- end') THEN '' END AS mark FROM ({LINES_SQL})),
  o AS (SELECT doc_id, pos, mark, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS owner FROM l) SELECT doc_id, pos, CASE WHEN mark IS NULL THEN nullif(owner, '') END AS owner FROM o""")
def _(spark, sf_dir):
    return images.ocr_owner(_sql(spark, sf_dir, "documents", LINES_SQL), "doc_id").select("doc_id", "pos", "owner")


_POS = "cast(pos as string)"
_LABEL = chosen(3, f"concat('Figure ', {_POS}, ': words')", f"concat('in Table', {_POS}, ' of the')", "'no label'", f"concat('fig. S', {_POS}, ' (left)')", "'TABLE X'", k="(doc_id + pos)")
#: Four blocks a document: labels, and images that come again in the next block.
BLOCKS_SQL = f"SELECT doc_id, pos, CASE WHEN pos < 3 THEN concat({_LABEL}, chr(10), '![x](i', {_POS}, '.png) ![y](i', cast(greatest(pos - 1, 0) as string), '.png)') ELSE concat(' ', {_LABEL}, ' last words') END AS block FROM (SELECT doc_id FROM documents) AS d CROSS JOIN (VALUES (0), (1), (2), (3)) AS places(pos)"


@query("r10_image_manifest", f"""WITH b AS ({BLOCKS_SQL}), two AS (SELECT a.doc_id, a.pos, a.block, trim(a.block) || ' ' || trim(n.block) AS around FROM b a JOIN b n ON n.doc_id = a.doc_id AND n.pos = a.pos + 1),
  seen AS (SELECT doc_id, pos, around, unnest(regexp_extract_all(block, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS image FROM two), first AS (SELECT doc_id, image, min(pos) AS pos, arg_min(around, pos) AS around FROM seen GROUP BY ALL)
  SELECT doc_id, image, pos, regexp_extract(around, '(?i)\\b(Fig(?:ure)?\\.?\\s*[A-Za-z0-9]+|Table\\s*[A-Za-z0-9]+)\\b', 1) AS figure_label, around AS caption FROM first""")
def _(spark, sf_dir):
    return images.manifest(_sql(spark, sf_dir, "documents", BLOCKS_SQL), "doc_id").select("doc_id", "image", "pos", "figure_label", "caption")


@query("r11_structure_codes", f"SELECT k, {_s('list_sort(list_distinct(regexp_extract_all(upper(structures), ' + q(chr(92) + 'b([0-9][A-Z][A-Z0-9]{2})' + chr(92) + 'b') + ', 1)))')} AS codes FROM ({PAPERS_SQL})")
def _(spark, sf_dir):
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper("structures"), F.lit(STRUCTURE_ID), F.lit(1))))
    return _sql(spark, sf_dir, "part", PAPERS_SQL).select("k", _j(codes).alias("codes"))


_MISSING = ["Epitope", *[f for fields, *_ in papers.GAPS for f in fields]]
#: Fields that records miss, by number.
MISSING_SQL = f"SELECT k, concat_ws(',', {', '.join(f'CASE WHEN (k * {3 + 2 * i} + cast(floor(k / {i + 2}) as bigint)) % {4 + i} = 0 THEN {q(f)} END' for i, f in enumerate(_MISSING))}) AS missing FROM (SELECT p_partkey AS k FROM part) AS keys"


def _wants(group: int) -> str:
    return f"list_has_any(string_split(missing, ','), [{', '.join(map(q, papers.GAPS[group][0]))}])"


@query("p16_gap_categories", f"""WITH m AS (SELECT k, {_wants(0)} AS s, {_wants(1)} AS n, {_wants(2)} AS e FROM ({MISSING_SQL}))
  SELECT k, array_to_string(list_sort(CASE WHEN s = n AND n = e THEN ['SEQUENCE_DATA', 'KINETICS_DATA', 'QUANTITATIVE_TABLE', 'EFFICACY_DATA'] WHEN s AND n THEN ['SEQUENCE_DATA', 'KINETICS_DATA', 'QUANTITATIVE_TABLE'] WHEN s AND e THEN ['SEQUENCE_DATA', 'EFFICACY_DATA']
    WHEN n AND e THEN ['KINETICS_DATA', 'QUANTITATIVE_TABLE', 'EFFICACY_DATA'] WHEN s THEN ['SEQUENCE_DATA'] WHEN n THEN ['KINETICS_DATA', 'QUANTITATIVE_TABLE'] ELSE ['EFFICACY_DATA', 'QUANTITATIVE_TABLE'] END), ',') AS categories FROM m""")
def _(spark, sf_dir):
    m = _sql(spark, sf_dir, "part", MISSING_SQL)
    return m.select("k", _j(F.array_sort(papers.gap_categories(F.split("missing", ",")))).alias("categories"))


@query("p17_known_records", "SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 0 OR (o_orderkey % 3 < 2 AND (o_orderkey % 2 = 0 OR o_orderkey % 5 < 3))")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Ab"), (k % 3).cast("string"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("paper_id"), name.alias("name"), F.when((k % 2 == 1) & (F.col("o_custkey") % 4 != 0), "protects").otherwise("").alias("efficacy"), F.when(k % 5 < 3, F.concat(F.lit("mice with "), F.upper(name))).otherwise("mice").alias("context"))
    names = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("paper_id"), F.explode(F.array(F.lit("ab0"), F.lit("AB1"))).alias("name"))
    return papers.known_records(r, names).select("o_orderkey")


@query("p18_image_sizes", "SELECT p_partkey, p_size % 7 = 0 OR p_size * 100 + p_size * 200 >= 10000 AS keep FROM part")
def _(spark, sf_dir):
    s = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", papers.large_enough(F.array(F.when(s % 7 != 0, s * 100), s * 200)).alias("keep"))


#: Texts with supplements of two names among their sections, and runs of blank lines.
SUPPLEMENTED_SQL = f"""SELECT doc_id, concat('# One', chr(10), chr(10), chr(10), chr(10), coalesce(text, ''), chr(10), '# Excel Supplement: bad.xlsx sheet', chr(10), 'rows', chr(10), '## below', chr(10), 'more', chr(10),
  {chosen(2, "concat('# Two', chr(10), 'kept', chr(10))", "concat('# Excel Supplement: good.xlsx', chr(10), 'kept too', chr(10), '# Excel Supplement: bad.xlsx', chr(10), 'gone')", "''", k="doc_id")}, chr(10), chr(10), ' ') AS body FROM documents"""


@query("p19_supplements", f"""WITH l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(body, chr(10)) AS lines FROM ({SUPPLEMENTED_SQL})))),
  owned AS (SELECT doc_id, i, line, last_value(CASE WHEN starts_with(line, '# ') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM l)
  SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\s+$', '') || chr(10)) AS t FROM owned WHERE head IS NULL OR NOT starts_with(head, '# Excel Supplement: bad.xlsx') GROUP BY doc_id""")
def _(spark, sf_dir):
    d = _sql(spark, sf_dir, "documents", SUPPLEMENTED_SQL)
    return d.select("doc_id", F.md5(images.without_supplements(F.col("body"), ["bad.xlsx"])).alias("t"))


#: Payloads of annotations: status, label as written, and error types with commas between them.
PAYLOAD_SQL = f"SELECT k, {chosen(2, q('reviewed'), q('ignored'), q('pending'), 'NULL')} AS status, {chosen(3, q('exact'), q(' '), q(''), q('wrong'), q('partial'))} AS label, {chosen(5, q(''), q('typo'), q('unit,typo,unit'), q('none'))} AS types FROM (SELECT o_orderkey AS k FROM orders) AS keys"


@query("p24_payloads", f"""WITH p AS (SELECT *, list_filter(string_split(types, ','), lambda x: x <> '') AS t FROM ({PAYLOAD_SQL}))
  SELECT k, CASE WHEN status = 'reviewed' AND trim(label) = '' THEN 'final_label is required' WHEN label = 'exact' AND len(t) > 0 THEN 'error_types must be empty' END AS problem, CASE WHEN status = 'ignored' AND trim(label) = '' THEN 'miss' ELSE label END AS final_label,
    CASE WHEN status = 'ignored' THEN '' ELSE array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') END AS types FROM p""")
def _(spark, sf_dir):
    types = F.filter(F.split("types", ","), lambda x: x != "")
    kept = validate.settled_payload(F.col("status"), F.col("label"), F.lit("miss"), types)
    return _sql(spark, sf_dir, "orders", PAYLOAD_SQL).select("k", validate.payload_problem(F.col("status"), F.col("label"), types).alias("problem"), kept["final_label"].alias("final_label"), _j(kept["error_types"]).alias("types"))


@query("a23_reduced", """SELECT o_custkey AS paper_id, count(*) FILTER (o_orderkey % 3 > 0) AS kept, count(*) FILTER (o_orderkey % 3 = 0) AS dropped, count(*) FILTER (o_orderkey % 5 = 0) AS failed,
  coalesce(string_agg('part ' || o_orderkey, chr(10) || chr(10) ORDER BY o_orderkey) FILTER (o_orderkey % 3 > 0), 'whole') AS reduced_text FROM orders GROUP BY 1""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    chunks = o.select(F.col("o_custkey").alias("paper_id"), k.alias("chunk_index"), F.when(k % 3 > 0, F.concat(F.lit(" part "), k.cast("string"))).otherwise(" ").alias("filtered_text"), F.when(k % 5 == 0, "late").alias("error"))
    return papers.reduced(chunks, o.select(F.col("o_custkey").alias("paper_id"), F.lit("whole").alias("text")).distinct()).select("paper_id", "kept", "dropped", "failed", "reduced_text")


@query("a26_keep_longest", "SELECT o_custkey AS k, max_by(o_orderpriority, (length(o_orderpriority), -o_orderkey)) AS v, arg_max(o_orderkey::VARCHAR, o_orderkey) AS context FROM orders GROUP BY 1")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").cast("string").alias("context"), "o_orderkey")
    return papers.keep_longest(o, ["k"], ["v"], "context", "o_orderkey")


_FAMILIES = {"numbers": [r"\d+"], "vowels": [r"a", r"e"], "ends": [r"\bthe\b", r"\bde\b"]}


@query("a30_focus", """WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\\d+')) AS n, len(regexp_extract_all(lower(text), 'a')) + len(regexp_extract_all(lower(text), 'e')) AS v,
    len(regexp_extract_all(lower(text), '\\bthe\\b')) + len(regexp_extract_all(lower(text), '\\bde\\b')) AS e FROM documents)
  SELECT doc_id, n::INT AS numbers, v::INT AS vowels, e::INT AS ends, n >= 1 AND v >= 200 AND e >= 10 AS hard FROM c""")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", papers.pattern_counts(F.col("text"), _FAMILIES).alias("c"))
    return c.select("doc_id", "c.*", papers.focus_flags(F.col("c"), {"numbers": (1, "table-heavy"), "vowels": (200, "long"), "ends": (10, "prose")})["hard"].alias("hard"))


_STATUS = chosen(3, "'completed'", "'error'", "'timeout'", "'extract'", "'completed'", "NULL", k="event_id")


@query("a31_a32_run_counts", f"""SELECT user_id, count(*) AS total, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'timeout') AS timeouts, count(*) FILTER (s IS NULL OR s = 'extract') AS running
  FROM (SELECT user_id, {_STATUS} AS s FROM events) GROUP BY 1""")
def _(spark, sf_dir):
    return trace.progress(_sql(spark, sf_dir, "events", f"SELECT user_id, {_STATUS} AS status FROM events"), ["user_id"])


_RUN = "concat('/reports/', cast(k % 40 as string), '/run', cast(k as string))"
#: Files of runs: results in the run's folder or in its benchmark folder, predictions of most of them, and other files.
FILES_SQL = f"""SELECT concat({_RUN}, {chosen(3, "'/eval_result_latest.json'", "'/benchmark/eval_result_latest.json'", "'/eval_result_1.json'")}) AS path FROM (SELECT p_partkey AS k FROM part) AS keys
  UNION ALL SELECT concat({_RUN}, '/agent/benchmark_predictions.json') AS path FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 4 > 0) AS keys
  UNION ALL SELECT concat('/other', {_RUN}, '/eval_result_latest.json') AS path FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 9 = 0) AS keys"""


@query("s14_result_views", f"""WITH f AS ({FILES_SQL}), v AS (SELECT path, regexp_replace(path, '^/reports/(.*)/[^/]*$', '\\1') AS id FROM f WHERE regexp_matches(path, '^/reports/.*/eval_result_latest.json$'))
  SELECT id, string_split(id, '/')[-1] AS title, path AS results, CASE WHEN list_contains((SELECT list(path) FROM f), '/reports/' || replace(id, '/benchmark', '') || '/agent/benchmark_predictions.json') THEN '/reports/' || replace(id, '/benchmark', '') || '/agent/benchmark_predictions.json' END AS predictions FROM v""")
def _(spark, sf_dir):
    return papers.result_views(_sql(spark, sf_dir, "part", FILES_SQL), "/reports/")


@query("n05_first_filled", "SELECT c_custkey, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), ''), '') AS v FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' ' WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS a, CASE WHEN c_custkey % 5 > 0 THEN '' ELSE ' ' || c_name || ' ' END AS b, CASE WHEN c_custkey % 7 > 2 THEN c_mktsegment END AS c FROM customer)")
def _(spark, sf_dir):
    c = _sql(spark, sf_dir, "customer", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' ' WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS a, CASE WHEN c_custkey % 5 > 0 THEN '' ELSE concat(' ', c_name, ' ') END AS b, CASE WHEN c_custkey % 7 > 2 THEN c_mktsegment END AS c FROM customer")
    return c.select("c_custkey", text.first_filled(F.col("a"), F.col("b"), F.col("c")).alias("v"))


@query("w13_missing_names", "SELECT p_size AS image, 'AB' || p_partkey AS name FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("image"), F.concat(F.lit("AB"), F.col("p_partkey").cast("string")).alias("name"))
    seen = p.filter("p_partkey % 3 <> 0").select("image", F.concat(F.lit(" "), F.lower("name")).alias("name"))
    return papers.missing_names(p.select("image", "name"), seen, ["image"])


@query("w15_last_events", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type NOT IN ('start', 'end')) WHERE r <= 5")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("event", F.col("event_type"))
    return papers.last_events(e, ["user_id"], "event_id", 5).select("user_id", "event_id")


@query("u04_u05_union_tracks", "SELECT name, arg_min(v, t) AS v FROM (SELECT lower(c_mktsegment) AS name, 'first' AS v, 0 AS t FROM customer UNION ALL SELECT lower(n_name), 'second', 1 FROM nation UNION ALL SELECT lower(c_mktsegment), 'second', 1 FROM customer) GROUP BY 1")
def _(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    one = c.select(F.col("c_mktsegment").alias("name"), F.lit("first").alias("v"))
    two = n.select(F.col("n_name").alias("name"), F.lit("second").alias("v")).unionByName(c.select(F.lower("c_mktsegment").alias("name"), F.lit("second").alias("v")))
    return papers.union_tracks([one, two], ["name"]).select(F.lower("name").alias("name"), "v")


_PAPER = chosen(2, q("binding by elisa and SPR"), q("surface plasmon resonance"), q("no assay"), k="p_partkey")


@query("f16_refined_experiment", f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'ITC, ELISA' ELSE array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'BLI' END, CASE WHEN t LIKE '%elisa%' THEN 'ELISA' END,
    CASE WHEN t LIKE '%SPR%' OR t LIKE '%plasmon%' THEN 'SPR' END, CASE WHEN t NOT LIKE '%elisa%' AND p_partkey % 2 = 0 THEN 'ELISA' END], lambda x: x IS NOT NULL), ',') END AS experiment FROM (SELECT p_partkey, {_PAPER} AS t FROM part)""")
def _(spark, sf_dir):
    p = _sql(spark, sf_dir, "part", f"SELECT p_partkey, {_PAPER} AS t FROM part")
    k = F.col("p_partkey")
    return p.select("p_partkey", papers.refined_experiment(F.when(k % 5 == 0, "ITC, ELISA").otherwise("other"), F.col("t"), k % 3 == 0, F.lit(True), k % 2 == 0).alias("experiment"))


@query("n09_merged_names", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ',b' ELSE c_name || ',b,c' END AS names FROM customer")
def _(spark, sf_dir):
    a = F.array("c_name", F.lit(" b"), F.lit(""))
    b = F.when(F.col("c_custkey") % 2 == 0, F.array(F.upper("c_name"), F.lit("B"))).otherwise(F.array(F.lit("c"), F.lit("d")))
    return table(spark, sf_dir, "customer").select("c_custkey", _j(papers.merged_names(a, b, 3)).alias("names"))


_ANY = chosen(3, "heavy", "'--'", "concat(' ', lower(substr(heavy, 1, 30)), '-', substr(heavy, 31, 20))", "''", "'Ala-Cys Asp gly'")
#: Records of sequences as models give them: names that are blank, sequences in both codes, with marks, or none.
GIVEN_SQL = f"SELECT k, {chosen(2, chr(39) + ' ab ' + chr(39), chr(39) + ' ' + chr(39), 'NULL', chr(39) + 'N/A' + chr(39))} AS name, {_ANY} AS vh, {chosen(7, 'NULL', chr(39) + '12' + chr(39), 'light')} AS vl FROM ({CHAINS_SQL}) AS chains"


@query("n11_sequence_rows", f"""WITH g AS (SELECT k, trim(name) AS name, CASE WHEN vh LIKE 'Ala-%' THEN 'ACDG' ELSE regexp_replace(upper(coalesce(vh, '')), '[^A-Z]', '', 'g') END AS vh, regexp_replace(upper(coalesce(vl, '')), '[^A-Z]', '', 'g') AS vl FROM ({GIVEN_SQL}))
  SELECT * FROM g WHERE name <> '' AND vh || vl <> ''""")
def _(spark, sf_dir):
    r = _sql(spark, sf_dir, "part", GIVEN_SQL)
    return papers.sequence_rows(r.select("k", "name", F.col("vh").alias("vh_sequence_aa"), F.col("vl").alias("vl_sequence_aa"))).select("k", "name", F.col("vh_sequence_aa").alias("vh"), F.col("vl_sequence_aa").alias("vl"))


_HINTED = chosen(3, "lower(heavy)", "concat(' ', substr(heavy, 1, 60), '-', substr(heavy, 61, 100), ' ')", "'ACD'", "concat(heavy, heavy)", "concat(substr(heavy, 1, 90), 'XB')", "NULL")
_ANSWER = chosen(5, "concat(heavy, 'A')", "'short'", "heavy", "concat('12 ', lower(heavy))", "concat(light, heavy)")
#: Records with blank or filled regions, hints that hold a whole region or not, and what a second reading says.
HYDRATED_SQL = f"SELECT k, heavy, {chosen(2, chr(39) + chr(39), 'heavy', chr(39) + ' ' + chr(39))} AS vh, {_HINTED} AS vh_hint, {chosen(7, chr(39) + chr(39), 'light')} AS vl, {chosen(11, 'light', chr(39) + 'see text' + chr(39))} AS vl_hint, {_ANSWER} AS answer FROM ({CHAINS_SQL}) AS chains"
_LETTERS = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z]', '', 'g')".format


def _filled(field: str, hint: str) -> str:
    return f"CASE WHEN trim(coalesce({field}, '')) <> '' THEN {field} WHEN regexp_matches({_LETTERS(hint)}, '^[ACDEFGHIKLMNPQRSTVWY]{{80,160}}$') THEN {_LETTERS(hint)} ELSE '' END"


@query("b14_b15_hydrated", f"""WITH h AS (SELECT k, {_filled('vh', 'vh_hint')} AS vh, {_filled('vl', 'vl_hint')} AS vl, {_LETTERS('answer')} AS a FROM ({HYDRATED_SQL}))
  SELECT k, vh, vl, CASE WHEN length(a) >= 80 AND a <> {_LETTERS('vh')} THEN a ELSE vh END AS told, length(a) >= 80 AND a <> {_LETTERS('vh')} AS changed FROM h""")
def _(spark, sf_dir):
    r = _sql(spark, sf_dir, "part", HYDRATED_SQL).withColumnsRenamed({"vh": "vh_sequence_aa", "vl": "vl_sequence_aa"}).withColumn("CDRH3_Sequence", F.lit(""))
    h = papers.hydrated(r).withColumn("v", papers.verified(F.col("vh_sequence_aa"), F.col("answer")))
    return h.select("k", F.col("vh_sequence_aa").alias("vh"), F.col("vl_sequence_aa").alias("vl"), F.col("v.value").alias("told"), "v.changed")


@query("s21_merged_outputs", """SELECT o_custkey AS batch, coalesce(string_agg('# f' || o_orderkey || chr(10) || chr(10) || 'text', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY 'dir/f' || o_orderkey || '.md') FILTER (o_orderkey % 4 > 0), '') AS merged,
  count(*) FILTER (o_orderkey % 4 > 0) AS done, count(*) FILTER (o_orderkey % 4 = 0) AS failed FROM orders GROUP BY 1""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.concat(F.lit("dir/f"), k.cast("string"), F.lit(".md")).alias("path"), F.lit("text ").alias("text"), (k % 4 > 0).alias("ok"))
    return papers.merged_outputs(f)


@query("s14_s15_loaded", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'paper-' || (p_size + 1) ELSE p_name END AS paper_id, CASE WHEN p_partkey % 2 = 0 THEN 'Antibody ' || (p_partkey + 1) ELSE p_brand END AS name FROM part")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.col("p_size").alias("pos"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")).alias("paper_id"), F.col("p_partkey").alias("record_pos"), F.when(F.col("p_partkey") % 2 != 0, F.col("p_brand")).alias("name"))
    return papers.loaded(rows).select("p_partkey", "paper_id", "name")


@query("s26_front_matter", "SELECT c_custkey, 'prompts/' || c_custkey || '.md' AS prompt, c_name AS name FROM customer")
def _(spark, sf_dir):
    body = F.concat(F.lit("---\nprompt: prompts/"), F.col("c_custkey").cast("string"), F.lit('.md\nname: "'), F.col("c_name"), F.lit('"\n---\nbody: no'))
    m = table(spark, sf_dir, "customer").select("c_custkey", papers.front_matter(body).alias("m"))
    return m.select("c_custkey", F.try_element_at("m", F.lit("prompt")).alias("prompt"), F.try_element_at("m", F.lit("name")).alias("name"))


_CELL = chosen(3, "'KD (nM)'", "'κ chain'", "'Variants'", "' low affinity  ka1'", "'Nonsense'", "'t½ β'", "'k0'", k="(o * 3 + n)")
#: Rows of a table before and after repair: headers, and bodies that sometimes differ in spaces, in words or in a row that is gone.
REPAIRED_SQL = f"""SELECT o, n, CASE WHEN n = 1 THEN 'k0' ELSE concat('cell ', cast(p as string)) END AS a, CASE WHEN n = 1 THEN {_CELL} WHEN (o + n) % 11 = 0 THEN concat('word ', cast(p as string)) WHEN n % 2 = 0 THEN concat(' cell&nbsp;&nbsp;', cast(p as string)) ELSE concat('cell ', cast(p as string)) END AS b, (o * 7 + n) % 37 = 0 AS gone
  FROM (SELECT o, p, row_number() OVER (PARTITION BY o ORDER BY l, p) AS n FROM (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p FROM lineitem) AS x) AS y"""


@query("f20_header_repairs", f"""WITH r AS ({REPAIRED_SQL}), w AS (SELECT *, trim(regexp_replace(replace(b, '&nbsp;', ' '), '\\s+', ' ', 'g')) AS plain FROM r)
  SELECT o, bool_and(NOT gone AND (plain = a OR (n = 1 AND list_contains([{', '.join(map(q, papers.HEADERS))}], regexp_replace(replace(replace(replace(lower(plain), 'β', 'beta'), 'κ', 'kappa'), '½', '1/2'), '[^a-z0-9]+', '', 'g'))))) AS ok FROM w GROUP BY o""")
def _(spark, sf_dir):
    r = _sql(spark, sf_dir, "lineitem", REPAIRED_SQL)
    side = lambda c: [F.col("o"), F.lit(1).alias("table_no"), (F.col("n") - 1).alias("row_no"), F.array(c).alias("cells")]
    return papers.allowed_header(r.select(*side("a")), r.filter("NOT gone").select(*side("b")), "o")


@query("v15_record_checks", "SELECT c_custkey, 2 + (c_custkey % 2 = 0)::INT AS warned, 3 - (c_custkey % 3 = 0)::INT AS noted, c_custkey % 5 = 0 AS vague FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    has = [f for f in validate.REQUIRED if f not in ("vh_sequence_aa", "Structure")]
    r = F.map_from_arrays(F.array(*map(F.lit, [*has, "source", "Old"])), F.array(*[F.when(k % 5 == 0, "monoclonal antibody").otherwise("IgG1") if f == "Antibody_Type" else F.lit("x") for f in has], F.when(k % 3 == 0, "yes").otherwise("N/A"), F.lit("v")))
    r = F.when(k % 2 == 0, F.map_filter(r, lambda f, v: f != "Target_Name")).otherwise(r)
    c = table(spark, sf_dir, "customer").select("c_custkey", papers.checked_record(r, {"Old": "New"}).alias("c"))
    n = lambda s, p: F.size(F.filter("c", lambda x: (x["status"] == s) & F.startswith(x["check"], F.lit(p))))
    return c.select("c_custkey", (n("warn", "missing") + n("warn", "field_name")).alias("warned"), n("info", "").alias("noted"), (n("warn", "antibody_type") > 0).alias("vague"))


#: Records as texts of keys and values, the statuses of their checks, and how often they were tried.
CHECKED_SQL = f"SELECT k, {chosen(2, q('x=a;y=b'), q('y=b;z=c'), q('z=c'), q('z=c;x='), q('y=d;x=e'))} AS fields, {chosen(3, q('pass,fail'), q('warn'), q('pass,failure'), q('fail'))} AS statuses, k % 5 AS tries FROM (SELECT o_orderkey AS k FROM orders) AS keys"


@query("v07_v08_review", f"""WITH c AS (SELECT *, list_filter(string_split(fields, ';'), lambda f: starts_with(f, 'x=')) AS x, list_filter(string_split(fields, ';'), lambda f: starts_with(f, 'y=')) AS y FROM ({CHECKED_SQL}))
  SELECT k, substr(CASE WHEN len(x) > 0 THEN x[1] ELSE y[1] END, 3) AS value, CASE WHEN NOT list_contains(string_split(statuses, ','), 'fail') THEN 'accept' WHEN tries < 2 THEN 'retry' ELSE 'give_up' END AS step FROM c""")
def _(spark, sf_dir):
    c = _sql(spark, sf_dir, "orders", CHECKED_SQL)
    return c.select("k", validate.first_of(F.str_to_map("fields", F.lit(";"), F.lit("=")), ["x", "y"]).alias("value"), validate.review(F.split("statuses", ","), F.col("tries")).alias("step"))


@query("f10_f25_differences", "SELECT c_custkey, 'replace@3:' || substr(c_name, 3, 1) || '>#' AS first, c_name AS left, substr(c_name, 1, 2) || '#' || substr(c_name, 4) AS right FROM customer")
def _(spark, sf_dir):
    other = F.concat(F.substring("c_name", 1, 2), F.lit("#"), F.substr("c_name", F.lit(4)))
    d = table(spark, sf_dir, "customer").select("c_custkey", F.get(similarity.edit_previews(F.col("c_name"), other), F.lit(0)).alias("first"), similarity.character_diffs(F.col("c_name"), other).alias("d"))
    side = lambda s: F.array_join(F.transform(F.filter("d", lambda r: r[s]), lambda r: r["run"]), "")
    return d.select("c_custkey", "first", side("left").alias("left"), side("right").alias("right"))


@query("t01_open_spans", f"WITH {SPANS_SQL} SELECT user_id, count(*) AS spans FROM spans GROUP BY 1")
def _(spark, sf_dir):
    s = trace.pair_spans(recipes.trace_events(spark, sf_dir))
    return s.groupBy(F.regexp_extract("span_id", r"^(\d+)-", 1).cast("long").alias("user_id")).agg(F.count("*").alias("spans"))


@query("f23_image_scores", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 100 ELSE 0 END + 25 * least(p_size % 5, 3) + CASE WHEN p_size > 25 THEN 8 ELSE 0 END + 5 * least(p_size % 9, 6) + CASE WHEN p_size % 3 = 0 THEN 30 WHEN p_size % 2 = 0 THEN 18 ELSE 0 END + 2 AS score FROM part")
def _(spark, sf_dir):
    s = F.col("p_size")
    score = images.image_score(F.col("p_partkey") % 2 == 0, F.lit(False), s % 5, F.when(s > 25, "an alignment of CDR").otherwise("x"), s % 9, s % 3 == 0, s % 2 == 0, F.lit(True), [("alignment", 8)])
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@query("w_antibody_tables", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING l_orderkey % 2 = 0")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("| "), F.col("l_partkey").cast("string"), F.lit(" |  |"))), "\n").alias("rows"))
    head = F.when(F.col("l_orderkey") % 2 == 0, "| Clone | VH sequence |\n|---|---|\n").otherwise("| Item | Price |\n|---|---|\n")
    t = o.select("l_orderkey", F.concat(head, "rows").alias("t"))
    return tables.antibody_records(tables.table_cells(t, "l_orderkey", "t"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("p07_export_counts", "SELECT c_nationkey, count(*) FILTER (c_custkey % 3 > 0) AS kept, count(*) FILTER (c_custkey % 3 = 0) AS dropped FROM customer GROUP BY 1")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select("c_nationkey", F.when(k % 3 > 0, F.col("c_name")).when(k % 2 == 0, "IGHV1-2").otherwise("ab7-H3").alias("name"))
    return records.export_counts(r, ["c_nationkey"], "name")



_SEEN = chosen(3, q("anti-Strep western blot"), q("FR1 FR2 of the germline"), q("DAPI overlay with CDR"), q(""))
_AROUND = chosen(2, q("Figure 2. Sequence alignment"), q("Mice were weighed"), q("MK1 MK2 MK3 MK4 EVQLVESGGGLVQPGGSLRLSCAAS"))


@query("p20_sequence_images", f"""SELECT k, CASE WHEN o = 'anti-Strep western blot' THEN false WHEN o <> '' THEN true ELSE starts_with(c, 'Figure') OR starts_with(c, 'MK1') END AS shows FROM (SELECT p_partkey AS k, {_SEEN.replace('k *', 'p_partkey *').replace('floor(k', 'floor(p_partkey')} AS o, {_AROUND.replace('k *', 'p_partkey *').replace('floor(k', 'floor(p_partkey')} AS c FROM part)""")
def _(spark, sf_dir):
    p = _sql(spark, sf_dir, "part", f"SELECT k, {_SEEN} AS o, {_AROUND} AS c FROM (SELECT p_partkey AS k FROM part) AS keys")
    return p.select("k", images.shows_sequences(F.col("c"), F.col("o")).alias("shows"))


@query("n10_crops", "SELECT user_id, 'i' || (event_id % 50) AS image, 'i' || (event_id % 50) || CASE WHEN c = 0 THEN '' ELSE '#crop:c' || c END AS key FROM events, range(3) t(c) WHERE c = 0 OR event_id % 50 % 2 = 0 GROUP BY ALL")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("n")).withColumn("image", F.concat(F.lit("i"), F.col("n").cast("string")))
    crops = e.filter("n % 2 = 0").select("user_id", "image", F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("crop"))
    return images.with_crops(e.select("user_id", "image"), crops, "user_id").select("user_id", "image", "key")


@query("s06_record_sets", "SELECT 'set' || r_regionkey AS record_set, i::INT AS pos, r_name || i AS field, '$.*.' || r_name || i AS json_path FROM region, range(3) t(i)")
def _(spark, sf_dir):
    field = lambda i: F.concat(F.lit('{"name": "'), "r_name", F.lit(f'{i}", "dataType": "sc:Text", "source": {{"extract": {{"jsonPath": "$.*.'), "r_name", F.lit(f'{i}"}}}}}}'))
    body = F.concat(F.lit('{"recordSet": [{"name": "set'), F.col("r_regionkey").cast("string"), F.lit('", "field": ['), F.concat_ws(", ", *map(field, range(3))), F.lit("]}]}"))
    return files.record_set_fields(table(spark, sf_dir, "region").select(body.alias("value"))).drop("data_type")


@query("s20_s22_outputs", """SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 3 = 0 THEN 'p/' || c_custkey || '/full.md' ELSE 'p/' || c_custkey || '/a/full.md' END AS path, c_custkey % 2 = 0 AS done, c_custkey % 4 AS images FROM customer""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    at = lambda end: F.concat(F.lit("p/"), k.cast("string"), F.lit(end))
    paths = F.concat(F.array(at("/b/full.md"), at("/a/full.md")), F.when(k % 3 == 0, F.array(at("/full.md"))).otherwise(F.array().cast("array<string>")), F.when(k % 2 == 0, F.array(at("/x/images_ocr_merged.md"))).otherwise(F.array().cast("array<string>")), F.transform(F.filter(F.array(*map(F.lit, range(4))), lambda i: i < k % 4), lambda i: F.concat(at("/images/"), i.cast("string"), F.lit(".PNG"))))
    f = table(spark, sf_dir, "customer").select(k.alias("paper_id"), F.explode(paths).alias("path"))
    return files.best_output(f).join(files.ocr_status(f), "paper_id")


@query("s23_numbered", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS Master_ID FROM orders")
def _(spark, sf_dir):
    return files.numbered(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"])


@query("s29_resumed_replies", """SELECT o_custkey, '{"k":[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || ']}' AS found FROM orders GROUP BY 1""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ", ").alias("l"))
    return o.select("o_custkey", jsontext.json_closed(F.concat(F.lit('Here: {"k": ['), "l")).alias("found"))


@query("p26_gap_fill_runs", "SELECT p_partkey, p_size % 3 > 0 AND p_size % 5 > 0 AND p_size % 2 = 0 AS runs FROM part")
def _(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", papers.gap_fill_runs(s % 3, s % 5, s % 2 == 0).alias("runs"))


_SAYS = chosen(3, "'Homo sapiens Immunoglobulin heavy chain'", "'spike protein of a virus'", "concat('Fab ', cast(k as string))", "NULL", "'kinase with a VHH domain'", "'a fabric'", "'Variable Region'")
FETCHED_SQL = f"SELECT k, {_SAYS} AS description, k % 4 = 0 AS region FROM (SELECT p_partkey AS k FROM part) AS keys"


@query("p27_usable_fetches", f"SELECT k, region OR {_said(papers.OF_ANTIBODY, "coalesce(description, '')")} AS usable FROM ({FETCHED_SQL})")
def _(spark, sf_dir):
    f = _sql(spark, sf_dir, "part", FETCHED_SQL)
    return f.select("k", papers.usable_fetch(F.when(F.col("region"), F.array(F.lit("heavy"))).otherwise(F.array().cast("array<string>")), F.col("description")).alias("usable"))


@query("n06_notes", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a,b' ELSE 'a' END AS notes FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey") % 3
    notes = papers.appended(F.array(F.lit("a")), F.when(k == 0, "b").when(k == 1, "a"))
    return table(spark, sf_dir, "customer").select("c_custkey", _j(notes).alias("notes"))


# ---------------------------------------------------------------- annotations and runs


#: Annotations: of each record whose number is 0 or 1 modulo 3, in fields whose name is of even length.
_NOTES = "notes AS (SELECT paper_id, ab_idx, field, CASE ab_idx % 3 WHEN 0 THEN 'reviewed' ELSE 'pending' END AS status FROM labels WHERE ab_idx % 3 < 2 AND length(field) % 2 = 0)"
_VIEW = f"WITH {LABELS_SQL}, {_NOTES}, v AS (SELECT l.*, n.status, l.label IN ('wrong', 'miss', 'partial') AS issue FROM labels l LEFT JOIN notes n USING (paper_id, ab_idx, field))"
_PROGRESS = f"{_VIEW}, g AS (SELECT paper_id, count(*) FILTER (issue) AS issues, count(status) AS annotated, count(*) FILTER (issue AND status = 'reviewed') AS reviewed FROM v GROUP BY 1)"


def _view(spark, sf_dir):
    facts = _scored(spark, sf_dir).select("paper_id", "ab_idx", "field", "label")
    notes = facts.filter("ab_idx % 3 < 2 AND length(field) % 2 = 0").select("paper_id", "ab_idx", "field", F.when(F.col("ab_idx") % 3 == 0, "reviewed").otherwise("pending").alias("status"))
    return annotations.annotated(facts, notes)


@query("j08_annotation_join", f"{_VIEW} SELECT paper_id, ab_idx, field, label, status FROM v")
def _(spark, sf_dir):
    return _view(spark, sf_dir).select("paper_id", "ab_idx", "field", "label", F.col("annotation.status").alias("status"))


@query("a09_label_counts", f"WITH {LABELS_SQL} SELECT field, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in annotations.LABELS) + ", 0::BIGINT AS other FROM labels GROUP BY field")
def _(spark, sf_dir):
    return annotations.label_counts(_scored(spark, sf_dir), ["field"])


@query("a10_annotation_progress", f"{_PROGRESS} SELECT paper_id, issues, annotated, reviewed, greatest(issues - reviewed, 0) AS pending, floor(CASE WHEN issues = 0 THEN 1e8 ELSE 1e8 * reviewed / issues END + 0.5)::BIGINT AS progress_micro FROM g")
def _(spark, sf_dir):
    p = annotations.annotation_progress(_view(spark, sf_dir), ["paper_id"])
    return p.withColumn("progress_micro", micro(F.col("progress_pct"))).drop("progress_pct")


@query("a11_dataset_summary", f"{_PROGRESS} SELECT count(*) AS papers, count(*) FILTER (annotated > 0) AS started, count(*) FILTER (reviewed >= issues) AS completed, sum(annotated)::BIGINT AS annotated FROM g")
def _(spark, sf_dir):
    return annotations.dataset_summary(annotations.annotation_progress(_view(spark, sf_dir), ["paper_id"]))


@query("a12_feedback_summary", "SELECT count(*) AS n, count(DISTINCT user_id) AS papers, count(DISTINCT user_id || '::' || event_id % 7) AS records, max(event_id) AS last FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), (F.col("event_id") % 7).alias("ab_idx"), F.col("event_id").alias("created"))
    return annotations.feedback_summary(e)


@query("a15_batch_summary", "SELECT coalesce(o_orderstatus, 'all') AS status, count(*) AS papers, sum(o_orderkey % 10)::BIGINT AS antibodies FROM orders GROUP BY ROLLUP (o_orderstatus)")
def _(spark, sf_dir):
    return annotations.batch_summary(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 10).alias("antibodies")))


_IDS = "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'WO' || s_suppkey WHEN 1 THEN 'us' || s_suppkey || 'B2' WHEN 2 THEN s_name ELSE 'EPatitis ' || s_suppkey END AS paper_id FROM supplier UNION ALL SELECT n_name FROM nation"


def _ids(spark, sf_dir):
    k = F.col("s_suppkey")
    n = k.cast("string")
    own = F.when(k % 4 == 0, F.concat(F.lit("WO"), n)).when(k % 4 == 1, F.concat(F.lit("us"), n, F.lit("B2"))).when(k % 4 == 2, F.col("s_name")).otherwise(F.concat(F.lit("EPatitis "), n))
    return table(spark, sf_dir, "supplier").select(own.alias("paper_id")).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("paper_id")))


_PATENT = "regexp_matches(paper_id, '(?i)^(WO|US|EP|CN|JP|KR|AU|CA|DE|FR|GB|IN)[0-9]')"


@query("p01_category", f"SELECT paper_id, CASE WHEN {_PATENT} THEN 'patent' ELSE 'paper' END AS category FROM ({_IDS})")
def _(spark, sf_dir):
    return _ids(spark, sf_dir).withColumn("category", text.category(F.col("paper_id")))


@query("p02_p03_subsets", f"SELECT unnest(['all', CASE WHEN {_PATENT} THEN 'patent' ELSE 'paper' END]) AS subset, count(*) AS n FROM ({_IDS}) GROUP BY 1")
def _(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    named = [annotations.in_subset(ids, name).agg(F.count("*").alias("n")).select(F.lit(text.subset_name(name)).alias("subset"), "n") for name in (None, "Literature", "patents")]
    return named[0].unionByName(named[1]).unionByName(named[2])
