"""Queries of the library's own operators and the SQL each is compared with; names begin with rows of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import jsontext, judge, scan, sequences, similarity, text, units
from lectern.operators import blocks, matching, merge, records, scoring, tables, trace
from lectern.plans import recipes
from lectern.plans.recipes import LABELS_SQL, SIMS_SQL, SPANS_SQL, table
from lectern.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def micro(c: Column) -> Column:
    """A double as whole millionths: sums in any order give the same."""
    return F.floor(c * 1000000 + 0.5).cast("long")


# ---------------------------------------------------------------- matching and scores


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    gt, pred = recipes.ground_truth(spark, sf_dir), recipes.predictions(spark, sf_dir)
    pairs = matching.match_records(gt, pred)
    return gt, pred, pairs, scoring.score_fields(matching.long_pairs(gt, pred, pairs, scoring.FIELDS))


_ORDERS = "SELECT a.v AS o0, b.v AS o1, c.v AS o2, d.v AS o3 FROM (VALUES (0), (1), (2), (3)) a(v), (VALUES (0), (1), (2), (3)) b(v), (VALUES (0), (1), (2), (3)) c(v), (VALUES (0), (1), (2), (3)) d(v) WHERE len(list_distinct([a.v, b.v, c.v, d.v])) = 4"
#: Similarities of the pairs, four records a side at most, numbered within their paper.
_PAIRED = f"""{SIMS_SQL}, sims AS (
    SELECT paper_id, gi, pi, CASE WHEN n IS NULL THEN 0 WHEN c IS NULL THEN n WHEN a = b THEN least(1, 0.98e0 + 0.02e0 * c) WHEN n >= 0.95 THEN least(1, 0.8e0 * n + 0.2e0 * c) ELSE 0.85e0 * n + 0.15e0 * c END AS sim,
      dense_rank() OVER (PARTITION BY paper_id ORDER BY gi) - 1 AS g, dense_rank() OVER (PARTITION BY paper_id ORDER BY pi) - 1 AS p FROM named)"""


@query("j01_assignment", f"""WITH {_PAIRED}, orders AS ({_ORDERS}), tried AS (
    SELECT paper_id, o0, o1, o2, o3, sum(sim) AS total FROM sims, orders WHERE p = CASE g WHEN 0 THEN o0 WHEN 1 THEN o1 WHEN 2 THEN o2 ELSE o3 END GROUP BY ALL)
  SELECT paper_id, floor(max(total) * 1000 + 0.2718)::BIGINT AS total_milli FROM tried GROUP BY 1 HAVING max(total) >= 0.5""")
def _(spark, sf_dir):
    found = matching.match_records(*recipes.names(spark, sf_dir))
    return found.groupBy("paper_id").agg(F.floor(F.sum("sim") * 1000 + 0.2718).cast("long").alias("total_milli"))


def _greedy_sql() -> str:
    """Four times the best pair that is left in each paper."""
    out, left = [], "(SELECT * FROM sims WHERE sim >= 0.5)"
    for k in range(4):
        out.append(f"best{k} AS (SELECT paper_id, gi, pi, sim FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY sim DESC, gi, pi) AS r FROM {left}) WHERE r = 1)")
        out.append(f"left{k} AS (SELECT l.* FROM {left} l JOIN best{k} b USING (paper_id) WHERE l.gi <> b.gi AND l.pi <> b.pi)")
        left = f"left{k}"
    return ", ".join(out)


@query("j02_greedy_assignment", f"WITH {_PAIRED}, {_greedy_sql()} SELECT paper_id, gi AS gt_idx, pi AS pred_idx, floor(sim * 1000000 + 0.5)::BIGINT AS sim_micro FROM (FROM best0 UNION ALL FROM best1 UNION ALL FROM best2 UNION ALL FROM best3)")
def _(spark, sf_dir):
    found = matching.match_records(*recipes.names(spark, sf_dir), optimal=False)
    return found.select("paper_id", "gt_idx", "pred_idx", micro(F.col("sim")).alias("sim_micro"))


@query("a01_field_labels", f"WITH {LABELS_SQL} SELECT paper_id, ab_idx, field, label, score, weight, score * weight AS weighted_score FROM scored")
def _(spark, sf_dir):
    return _scored(spark, sf_dir)[3].select("paper_id", "ab_idx", "field", "label", "score", "weight", "weighted_score")


@query("a02_record_scores", f"WITH {LABELS_SQL} SELECT paper_id, ab_idx, matched, weight_sum, weighted_sum, n_fields FROM records")
def _(spark, sf_dir):
    return scoring.score_records(_scored(spark, sf_dir)[3]).drop("ratio")


def _papers(spark, sf_dir):
    gt, pred, pairs, fields = _scored(spark, sf_dir)
    extra = matching.unmatched(pred.select("paper_id", "ab_idx"), pairs, "pred_idx").groupBy("paper_id").agg(F.count("*").alias("nfp"))
    return scoring.score_papers(scoring.score_records(fields), extra, gt.select("paper_id"))


@query("a03_paper_scores", f"""WITH {LABELS_SQL} SELECT paper_id, ngs, ntp, nfn, nfp, floor(raw * 1000000 + 0.5)::BIGINT AS raw_micro,
  floor(penalty * 1000000 + 0.5)::BIGINT AS penalty_micro, floor(raw * penalty * 1000 + 0.2718)::BIGINT AS accuracy_milli FROM penalised""")
def _(spark, sf_dir):
    return _papers(spark, sf_dir).select("paper_id", "ngs", "ntp", "nfn", "nfp", micro(F.col("raw")).alias("raw_micro"), micro(F.col("penalty")).alias("penalty_micro"), F.floor(F.col("accuracy") * 1000 + 0.2718).cast("long").alias("accuracy_milli"))


@query("a05_benchmark_score", f"""WITH {LABELS_SQL}, has AS (SELECT DISTINCT paper_id FROM pr WHERE trim(pred) <> '' OR ab_idx >= 10000000)
  SELECT count(*) AS papers, (SELECT count(*) FROM penalised ANTI JOIN has USING (paper_id)) AS papers_without_output, sum(ngs)::BIGINT AS ngs, sum(ntp)::BIGINT AS ntp, sum(nfn)::BIGINT AS nfn, sum(nfp)::BIGINT AS nfp,
         floor(avg(raw * penalty) * 1000000 + 0.5)::BIGINT AS accuracy_micro, floor(sum(ntp) / sum(ntp + nfp) * 1000000 + 0.5)::BIGINT AS precision_micro,
         floor(sum(ntp) / sum(ngs) * 1000000 + 0.5)::BIGINT AS recall_micro
  FROM penalised JOIN has USING (paper_id)""")
def benchmark_score(spark, sf_dir):
    out = scoring.score_benchmark(_papers(spark, sf_dir), scoring.papers_with_output(recipes.predictions(spark, sf_dir)))
    return out.select("papers", "papers_without_output", "ngs", "ntp", "nfn", "nfp", micro(F.col("accuracy")).alias("accuracy_micro"), micro(F.col("ab_precision")).alias("precision_micro"), micro(F.col("ab_recall")).alias("recall_micro"))


@query("p06_papers_with_output", f"WITH base AS ({recipes.BASE_SQL}) SELECT DISTINCT paper_id FROM base WHERE (k % 7 <> 0 OR k % 3 = 0) AND (k // 8) % 11 <> 5")
def _(spark, sf_dir):
    return scoring.papers_with_output(recipes.predictions(spark, sf_dir))


@query("a04_penalty", """SELECT o_orderkey, CASE WHEN ngs = 0 THEN CASE WHEN ntp + nfp = 0 THEN 1.0 ELSE 0.0 END WHEN ntp = 0 THEN 0.0
    ELSE greatest(0.0, 1.0e0 - 0.01e0 * (nfp // 5) - 0.05e0 * nfn) END::DOUBLE AS penalty
  FROM (SELECT o_orderkey, o_orderkey % 6 AS ngs, o_orderkey % 4 AS ntp, o_orderkey % 9 AS nfn, o_orderkey % 23 AS nfp FROM orders)""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.penalty(k % 6, k % 4, k % 9, k % 23).alias("penalty"))


@query("a06_field_weights", f"WITH {LABELS_SQL} SELECT DISTINCT field, weight FROM labels")
def _(spark, sf_dir):
    return spark.createDataFrame([(f,) for f in scoring.FIELDS], "field string").select("field", scoring.field_weight(F.col("field")).alias("weight"))


@query("a07_field_stats", f"""WITH {LABELS_SQL}, n AS (SELECT field, count(*) AS total, count(*) FILTER (label = 'exact') AS exact, count(*) FILTER (label = 'partial') AS partial,
  count(*) FILTER (label = 'wrong') AS wrong, count(*) FILTER (label = 'miss') AS miss, count(*) FILTER (label = 'skip') AS skip FROM labels GROUP BY field)
  SELECT *, floor(1e8 * (partial + wrong) / total + 0.5)::BIGINT AS partial_micro, floor(1e8 * miss / total + 0.5)::BIGINT AS mismatch_micro FROM n""")
def _(spark, sf_dir):
    return scoring.field_stats(_scored(spark, sf_dir)[3]).withColumns({"partial_micro": micro(F.col("partial_pct")), "mismatch_micro": micro(F.col("mismatch_pct"))}).drop("partial_pct", "mismatch_pct")


@query("a08_issue_board", f"""WITH {LABELS_SQL} SELECT field, paper_id, count(*) AS total, count(*) FILTER (label = 'exact') AS exact, count(*) FILTER (label = 'partial') AS partial,
  count(*) FILTER (label = 'wrong') AS wrong, count(*) FILTER (label = 'miss') AS miss, count(*) FILTER (label = 'skip') AS skip,
  count(*) FILTER (label IN ('wrong', 'miss', 'partial')) AS issues FROM labels WHERE field IN ('CDRH3_Sequence', 'vh_sequence_aa', 'vl_sequence_aa') GROUP BY field, paper_id""")
def _(spark, sf_dir):
    return scoring.issue_board(_scored(spark, sf_dir)[3])


@query("a25_field_quality", f"""WITH {LABELS_SQL}, q AS (SELECT field, count(*) AS total, count(*) FILTER (label = 'exact') AS exact, count(*) FILTER (label = 'partial') AS partial,
    count(*) FILTER (label = 'wrong') AS wrong, count(*) FILTER (label = 'miss') AS miss FROM labels WHERE label <> 'skip' GROUP BY field), p AS (SELECT *, 100.0e0 * (exact + 0.5e0 * partial) / total AS quality FROM q)
  SELECT field, total, exact, partial, floor(quality * 1000000 + 0.5)::BIGINT AS quality_micro, floor(1e8 * wrong / total + 0.5)::BIGINT AS wrong_micro, floor(1e8 * miss / total + 0.5)::BIGINT AS miss_micro,
    CASE WHEN quality >= 85 THEN 'S' WHEN quality >= 70 THEN 'A' WHEN quality >= 55 THEN 'B' WHEN quality >= 40 THEN 'C' WHEN quality >= 25 THEN 'D' ELSE 'F' END AS grade FROM p""")
def _(spark, sf_dir):
    q = scoring.field_quality(_scored(spark, sf_dir)[3])
    return q.select("field", "total", "exact", "partial", *[micro(F.col(c)).alias(n) for c, n in (("quality", "quality_micro"), ("wrong_pct", "wrong_micro"), ("miss_pct", "miss_micro"))], "grade")


_HITS = "SELECT count(*) AS n, floor(avg((label IN ('exact', 'partial'))::INT) * 1000000 + 0.5)::BIGINT AS hit_micro FROM parts2 WHERE label <> 'skip' AND NOT no_g AND field IN"
_JUDGED = "parts2 AS (SELECT l.*, r.no_g FROM labels l JOIN ruled r USING (paper_id, ab_idx, field))"


@query("a27_sequence_hits", f"WITH {LABELS_SQL}, {_JUDGED} {_HITS} ('CDRH3_Sequence', 'vh_sequence_aa', 'vl_sequence_aa')")
def _(spark, sf_dir):
    return scoring.hit_rate(_scored(spark, sf_dir)[3], judge.SEQUENCE_FIELDS).select("n", micro(F.col("hit_rate")).alias("hit_micro"))


@query("a27_affinity_hits", f"WITH {LABELS_SQL}, {_JUDGED} {_HITS} ('Binding_Kinetics_KD', 'Binding_Kinetics_kon', 'Binding_Kinetics_koff', 'Binding_EC50')")
def _(spark, sf_dir):
    return scoring.hit_rate(_scored(spark, sf_dir)[3], ["Binding_Kinetics_KD", "Binding_Kinetics_kon", "Binding_Kinetics_koff", "Binding_EC50"]).select("n", micro(F.col("hit_rate")).alias("hit_micro"))


@query("a20_gap_report", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'KD,Target' WHEN c_custkey % 2 = 0 THEN 'KD' ELSE 'Target' END AS missing
  FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, "n.d.").otherwise("1 nM").alias("KD"), F.when(k % 3 == 0, "").otherwise("HER2").alias("Target"))
    return scoring.gap_report(rows, ["Target", "KD"]).select("c_custkey", F.array_join("missing", ",").alias("missing"))


# ---------------------------------------------------------------- names, text, similarity


@query("f01_match_key", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.match_key(F.col("p_name")).alias("key"))


@query("f02_name_key", "SELECT c_custkey, replace(replace(replace(lower(c_name || ' A-1_b'), ' ', ''), '-', ''), '_', '') AS key FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.name_key(F.concat("c_name", F.lit(" A-1_b"))).alias("key"))


@query("f05_name_rules", """SELECT n1, n2, CASE WHEN a = b THEN 1.0 WHEN n2 NOT LIKE '% %' AND (starts_with(a, b) OR starts_with(b, a)) AND abs(length(a) - length(b)) <= 2 THEN 0.85
    WHEN contains(a, b) OR contains(b, a) THEN 0.95 END::DOUBLE AS sim
  FROM (SELECT replace(x.n_name, '_', '') AS n1, replace(y.n_name, '_', '') || (CASE y.n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '7' ELSE ' long' END) AS n2,
        replace(lower(x.n_name), '_', '') AS a, replace(replace(lower(y.n_name || (CASE y.n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '7' ELSE ' long' END)), ' ', ''), '_', '') AS b
        FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey)""")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    m = F.col("n_nationkey") % 3
    n = n.withColumn("n_name", F.replace("n_name", F.lit("_"), F.lit("")))
    other = n.select("n_regionkey", F.concat("n_name", F.when(m == 0, "").when(m == 1, "7").otherwise(" long")).alias("n2"))
    pairs = n.select("n_regionkey", F.col("n_name").alias("n1")).join(other, "n_regionkey")
    return pairs.select("n1", "n2", similarity.name_similarity_rules(F.col("n1"), F.col("n2")).alias("sim"))


@query("f04_gestalt_ratio")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    pairs = n.select("n_regionkey", F.col("n_name").alias("n1")).join(n.select("n_regionkey", F.col("n_name").alias("n2")), "n_regionkey")
    return pairs.select("n1", "n2", similarity.gestalt_ratio(F.col("n1"), F.col("n2")).alias("ratio"))


@query("f09_levenshtein", "SELECT x.p_partkey, levenshtein(x.p_name, y.p_name) AS d FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(other, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").cast("long").alias("d"))


# ---------------------------------------------------------------- quantities and rules


@query("m03_concentration", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN cents * 0.001e0 WHEN 1 THEN cents * 1.0e0 WHEN 2 THEN cents * 1000.0e0 ELSE NULL END AS nm
  FROM (SELECT p_partkey, cast(floor(p_retailprice * 100) AS BIGINT) AS cents FROM part)""")
def _(spark, sf_dir):
    k, n = F.col("p_partkey"), F.floor(F.col("p_retailprice") * 100).cast("string")
    t = F.when(k % 4 == 0, F.concat(F.lit("KD = "), n, F.lit(" pM"))).when(k % 4 == 1, n).when(k % 4 == 2, F.concat(n, F.lit(" uM"))).otherwise(F.concat(n, F.lit("-"), n, F.lit(" nM and more")))
    return table(spark, sf_dir, "part").select("p_partkey", units.quantity(F.lit("Binding_Kinetics_KD"), t).alias("nm"))


@query("m02_scientific", "SELECT p_partkey, p_size * pow(10.0e0, -(p_partkey % 3 + 1)) AS v FROM part")
def _(spark, sf_dir):
    k, s, e = F.col("p_partkey"), F.col("p_size").cast("string"), (F.col("p_partkey") % 3 + 1).cast("string")
    t = F.when(k % 2 == 0, F.concat(s, F.lit(" × 10^(-"), e, F.lit(") 1/s"))).otherwise(F.concat(s, F.lit("e-"), e))
    return table(spark, sf_dir, "part").select("p_partkey", units.quantity(F.lit("Binding_Kinetics_koff"), t).alias("v"))


@query("m04_temperature", "SELECT p_partkey, CASE WHEN p_size + 10 >= 20 THEN (p_size + 10)::DOUBLE END AS t FROM part")
def _(spark, sf_dir):
    t = F.concat(F.lit("Tm = "), (F.col("p_size") + 10).cast("string"), F.lit(" °C"))
    return table(spark, sf_dir, "part").select("p_partkey", units.quantity(F.lit("Thermal_Stability_Tm"), t).alias("t"))


@query("m07_kd_sort_key", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size / 2.0e0 ELSE p_size * 0.001e0 END AS k FROM part")
def _(spark, sf_dir):
    s = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", units.sort_key(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<"), s, F.lit(" nM"))).otherwise(F.concat(s, F.lit(" pM")))).alias("k"))


# ---------------------------------------------------------------- sequences and checks


@query("b03_sequence_gates", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE s END AS region, substr(s, 1, 20) AS loop FROM (SELECT c_custkey,
  translate(upper(md5('a' || c_custkey)), '0123456789ABCDEF', 'ACDEFGHIKLMNPQRS') || translate(upper(md5('b' || c_custkey)), '0123456789ABCDEF', 'ACDEFGHIKLMNPQRS')
  || translate(upper(md5('c' || c_custkey)), '0123456789ABCDEF', 'ACDEFGHIKLMNPQRS') AS s FROM customer)""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    s = recipes.region(k)
    return table(spark, sf_dir, "customer").select("c_custkey", sequences.region_or_blank(F.when(k % 3 == 0, F.substring(s, 1, 79)).otherwise(s)).alias("region"), sequences.loop_or_blank(F.lower(F.substring(s, 1, 20))).alias("loop"))


@query("b01_three_letter", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'ARN' ELSE 'ALAARG' END AS s FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sequences.one_letter(F.when(F.col("o_orderkey") % 2 == 0, "Ala-Arg Asn").otherwise("Ala Arg")).alias("s"))


@query("b11_alignment", "SELECT c_custkey, substr(s, 1, 3) || 'WQ' || substr(s, 7) AS s FROM (SELECT c_custkey, translate(upper(md5('r' || c_custkey)), '0123456789ABCDEF', 'ACDEFGHIKLMNPQRS') AS s FROM customer)")
def _(spark, sf_dir):
    ref = recipes.residue_text(F.concat(F.lit("r"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", sequences.from_alignment(ref, F.lit("...WO-....")).alias("s"))


@query("f11_sequence_conflict", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'near' ELSE 'different' END AS verdict FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    s = recipes.region(k)
    b = F.when(k % 3 == 0, F.concat(s, F.lit("WHHHHHH"))).when(k % 3 == 1, F.concat(F.lit("W"), F.substring(s, 2, 95))).otherwise(recipes.region(k + 7000000))
    return table(spark, sf_dir, "customer").select("c_custkey", sequences.conflict(F.when(k % 3 == 0, F.concat(s, F.lit("W"))).otherwise(s), b).alias("verdict"))


@query("v01_v04_checks", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'pass' ELSE 'fail' END AS residues, CASE WHEN n BETWEEN 5 AND 30 THEN 'pass' ELSE 'warn' END AS loop_length,
  CASE WHEN m BETWEEN 110 AND 135 THEN 'pass' WHEN m < 90 OR m > 160 THEN 'fail' ELSE 'warn' END AS region_length
  FROM (SELECT c_custkey, c_custkey % 40 + 1 AS n, c_custkey % 100 + 80 AS m FROM customer)""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", sequences.residue_check(F.when(k % 2 == 0, "ACDW").otherwise("ACBZ")).alias("residues"), sequences.loop_length(F.repeat(F.lit("A"), (k % 40 + 1).cast("int")), "H").alias("loop_length"),
        sequences.region_length(F.repeat(F.lit("G"), (k % 100 + 80).cast("int")), "H").alias("region_length"))


@query("a16_validation_rollup", """WITH s AS (SELECT c_nationkey, CASE WHEN c_custkey % 50 = 0 THEN 'fail' WHEN c_custkey % 3 = 0 THEN 'warn' ELSE 'pass' END AS status FROM customer)
  SELECT c_nationkey, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'fail') AS fail,
    CASE WHEN bool_or(status = 'fail') THEN 'FAIL' WHEN bool_or(status = 'warn') THEN 'WARN' ELSE 'PASS' END AS overall FROM s GROUP BY 1""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select("c_nationkey", F.when(k % 50 == 0, "fail").when(k % 3 == 0, "warn").otherwise("pass").alias("status"))
    n = lambda x: F.count(F.when(F.col("status") == x, 1)).alias(x)
    return s.groupBy("c_nationkey").agg(n("pass"), n("warn"), n("fail"), F.collect_set("status").alias("all")).select("c_nationkey", "pass", "warn", "fail", sequences.overall(F.col("all")).alias("overall"))


@query("a17_duplicate_sequences", """WITH d AS (SELECT doc_id, upper(md5(lower(trim(text)))) AS sequence FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY sequence) AS n FROM d)
  SELECT 'text' AS field, sequence, n, doc_id AS name FROM n WHERE n > 1 AND sequence IS NOT NULL""")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("text"))
    return merge.duplicate_values(d, ["text"], "doc_id")


# ---------------------------------------------------------------- scanners, tables, blocks


@query("r_page_links", r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS n, len(regexp_extract_all(html, '(<li>)', 1)) AS items FROM pages""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(scan.links(F.col("html"))).cast("long").alias("n"), F.size(F.regexp_extract_all("html", F.lit("(<li>)"), F.lit(1))).cast("long").alias("items"))


def _order_tables(spark, sf_dir, html: bool) -> DataFrame:
    row = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p"), "l_returnflag")
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    if html:
        body = F.transform("rows", lambda r: F.concat(F.lit("<tr><td>"), r["p"], F.lit("</td><td>"), r["l_returnflag"], F.lit("</td></tr>")))
        t = F.concat(F.lit("text <table><tr><th>Clone</th><th>Antigen</th></tr>"), F.array_join(body, ""), F.lit("</table> end"))
    else:
        body = F.transform("rows", lambda r: F.concat(F.lit("| "), r["p"], F.lit(" | "), r["l_returnflag"], F.lit(" |")))
        t = F.concat(F.lit("text\n| Clone | Antigen |\n|---|---|\n"), F.array_join(body, "\n"), F.lit("\nend"))
    return o.select("l_orderkey", t.alias("text"))


ORDER_ROWS_SQL = """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR, l_returnflag)::INT AS row_no,
  l_partkey::VARCHAR AS mab, l_returnflag AS target FROM lineitem"""


@query("w07_html_tables", ORDER_ROWS_SQL)
def _(spark, sf_dir):
    r = tables.table_records(tables.table_cells(_order_tables(spark, sf_dir, True), "l_orderkey", "text"), "l_orderkey")
    return r.select("l_orderkey", "row_no", F.col("record")["mAb"].alias("mab"), F.col("record")["Target"].alias("target"))


@query("w08_pipe_tables", ORDER_ROWS_SQL)
def _(spark, sf_dir):
    r = tables.table_records(tables.table_cells(_order_tables(spark, sf_dir, False), "l_orderkey", "text"), "l_orderkey")
    return r.select("l_orderkey", "row_no", F.col("record")["mAb"].alias("mab"), F.col("record")["Target"].alias("target"))


@query("w_blocks", r"SELECT doc_id, len([x for x in string_split(text, chr(10)) if trim(x) <> '']) AS n FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(blocks.blocks(F.col("text"))).cast("long").alias("n"))


@query("w02_chunks")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(blocks.chunked(F.col("text"), 4000, "\n")).alias("c"))
    return d.select("doc_id", "c.*")


@query("w01_first_occurrence", """SELECT doc_id, len(list_distinct([lower(x) for x in string_split(text, chr(10))])) AS n FROM documents""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(blocks.first_occurrences(F.split("text", "\n"))).cast("long").alias("n"))


@query("w03_top_k", """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3""")
def _(spark, sf_dir):
    return blocks.top_k(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey")


@query("w08_islands", """WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  i AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS run FROM n WHERE event_type IN ('view', 'click'))
  SELECT user_id, min(n)::INT AS first, max(n)::INT AS last, count(*) AS length FROM i GROUP BY user_id, run""")
def _(spark, sf_dir):
    return blocks.islands(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type").isin("view", "click"))


# ---------------------------------------------------------------- merging and lookups


@query("j03_merge_by_priority", """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'table' ELSE 'sequence_image' END AS source,
    CASE l_linenumber % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS p FROM lineitem)
  SELECT 'o' || l_orderkey AS paper_id, arg_max(source, p * 1000 - l_linenumber) AS source, count(*) AS n_evidence FROM e GROUP BY l_orderkey""")
def _(spark, sf_dir):
    m = F.col("l_linenumber") % 3
    e = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("paper_id"), F.lit("ab-1").alias("name"), F.lit("vh_sequence_aa").alias("field"), recipes.region(F.col("l_partkey")).alias("value"),
        F.when(m == 0, "api").when(m == 1, "table").otherwise("sequence_image").alias("source"), F.col("l_linenumber").alias("seq"))
    return merge.merge_fields(e).select("paper_id", "source", "n_evidence")


@query("j07_chain_lookup", """SELECT c_custkey, h.s AS vh, l.s AS vl FROM customer LEFT JOIN (SELECT p_size AS id, arg_max(p_name, length(p_name) * 1000000 - p_partkey) AS s FROM part GROUP BY 1) h ON h.id = c_custkey % 60
  LEFT JOIN (SELECT p_size AS id, arg_max(p_name, length(p_name) * 1000000 - p_partkey) AS s FROM part GROUP BY 1) l ON l.id = c_nationkey""")
def _(spark, sf_dir):
    chains = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("chain_id"), F.col("p_name").alias("sequence"), F.col("p_partkey").alias("seq"))
    wanted = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 60).alias("heavy"), F.col("c_nationkey").cast("long").alias("light"))
    return merge.chain_lookup(wanted, chains).select("c_custkey", "vh", "vl")


@query("j09_nth_occurrence", """WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem),
    r AS (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_size) AS n FROM part)
  SELECT l_orderkey, l_linenumber, p_partkey AS r_partkey FROM l LEFT JOIN r ON p_size = l_suppkey AND k = least(i, n)""")
def _(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    right = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("key"), F.struct(F.col("p_partkey"), F.lit(0).alias("x")).alias("at"))
    out = matching.nth_occurrence_join(left, right, ["key"], "at")
    return out.select("at.l_orderkey", "at.l_linenumber", F.col("r_at.p_partkey").alias("r_partkey"))


@query("j18_nearest_evidence", """WITH i AS (SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::BIGINT AS pos, c_custkey % 7 = 0 AS evidence FROM customer)
  SELECT a.doc_id, a.pos, CASE min(abs(a.pos - b.pos)) WHEN 0 THEN 12 WHEN 1 THEN 22 WHEN 2 THEN 10 ELSE 0 END AS bonus
  FROM i a LEFT JOIN i b ON b.doc_id = a.doc_id AND b.evidence AND abs(a.pos - b.pos) <= 2 GROUP BY a.doc_id, a.pos""")
def _(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    i = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.row_number().over(w).cast("long").alias("pos"), (F.col("c_custkey") % 7 == 0).alias("evidence"))
    return merge.nearest_evidence(i).select("doc_id", "pos", "bonus")


@query("a21_consensus", """SELECT l_orderkey, CASE WHEN count(DISTINCT lower(l_returnflag)) = 1 THEN min(l_returnflag) ELSE '' END AS flag FROM lineitem GROUP BY 1""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(merge.consensus(F.col("l_returnflag")).alias("flag"))


@query("a28_fill_within_name", """WITH g AS (SELECT p_size, arg_min(p_name, (1000 - length(p_name)) || p_name) AS best FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1)
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN coalesce(best, '') ELSE p_name END AS name FROM part LEFT JOIN g USING (p_size)""")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("name"))
    return merge.fill_within_name(p, ["p_size"], ["name"]).select("p_partkey", "name")


# ---------------------------------------------------------------- traces, annotations, dashboards


@query("j10_spans", f'WITH {SPANS_SQL} SELECT span_id, name, start, "end" FROM spans')
def _(spark, sf_dir):
    return trace.pair_spans(recipes.trace_events(spark, sf_dir)).select("span_id", "name", "start", "end")


@query("a13_span_stats", f"""WITH {SPANS_SQL} SELECT name, count(*) AS n, floor(avg(epoch_us("end") - epoch_us(start)))::BIGINT AS avg_us, sum(epoch_us("end") - epoch_us(start))::BIGINT AS total_us, max(epoch_us("end") - epoch_us(start)) AS max_us FROM spans GROUP BY name""")
def _(spark, sf_dir):
    s = trace.pair_spans(recipes.trace_events(spark, sf_dir)).withColumn("us", F.expr("timestampdiff(MICROSECOND, start, end)"))
    return trace.span_stats(s, "us").drop("kind").withColumn("avg_us", F.floor("avg_us"))


PEAK_SQL = f"""WITH {SPANS_SQL}, p AS (SELECT start AS t, 1 AS up, 0 AS down FROM spans UNION ALL SELECT "end", 0, 1 FROM spans),
  s AS (SELECT t, sum(up) AS up, sum(down) AS down FROM p GROUP BY t),
  r AS (SELECT coalesce(sum(up - down) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + up AS open FROM s)
  SELECT max(open)::BIGINT AS peak FROM r"""


@query("a14_peak_concurrency", PEAK_SQL)
def _(spark, sf_dir):
    return trace.peak_concurrency(trace.pair_spans(recipes.trace_events(spark, sf_dir)))


@query("t02_annotation_latest", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def _(spark, sf_dir):
    return trace.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


# ---------------------------------------------------------------- sources and sinks


@query("s01_choose_markdown", """SELECT 'paper' || s_suppkey AS paper, CASE s_suppkey % 3 WHEN 0 THEN 'in/paper' || s_suppkey || '/vlm/images_ocr_merged.md' WHEN 1 THEN 'in/paper' || s_suppkey || '/x_enhanced.md' ELSE 'in/paper' || s_suppkey || '/paper' || s_suppkey || '.md' END AS path FROM supplier""")
def _(spark, sf_dir):
    k, p = F.col("s_suppkey"), F.concat(F.lit("in/paper"), F.col("s_suppkey").cast("string"))
    stem = F.concat(p, F.lit("/paper"), k.cast("string"), F.lit(".md"))
    each = F.array(stem, F.concat(p, F.lit("/zz.md")), F.concat(p, F.lit("/.hidden.md")), F.when(k % 3 == 0, F.concat(p, F.lit("/vlm/images_ocr_merged.md"))).when(k % 3 == 1, F.concat(p, F.lit("/x_enhanced.md"))).otherwise(stem))
    return files.choose_markdown(table(spark, sf_dir, "supplier").select(F.explode(each).alias("path")))


@query("s03_paper_id", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'folder' || s_suppkey ELSE 'stem' || s_suppkey END AS paper_id FROM supplier")
def _(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    path = F.concat(F.lit("a/folder"), k, F.lit("/"), F.when(F.col("s_suppkey") % 2 == 0, "index.md").otherwise(F.concat(F.lit("stem"), k, F.lit(".v1.md"))))
    path = F.when(F.col("s_suppkey") % 2 == 0, path).otherwise(F.replace(path, F.lit(".v1"), F.lit("")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", files.paper_id(path).alias("paper_id"))


@query("s04_record_sets", """SELECT 'P' || c_nationkey AS paper_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS ab_idx, c_name AS name FROM customer""")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("paper_id"), F.col("c_custkey").alias("ab_idx"), F.create_map(F.lit("Antibody_Name"), F.col("c_name")).alias("record"))
    sets = files.record_sets(c).select(F.concat(F.lit('{"'), "paper_id", F.lit('": '), "value", F.lit("}")).alias("value"))
    return files.parse_records(sets).select("paper_id", "ab_idx", F.col("record")["Antibody_Name"].alias("name"))


@query("s05_workbook", """SELECT c_nationkey::VARCHAR AS paper_id, c_custkey AS ab_idx, f AS field, CASE WHEN f = 'name' THEN c_name WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS value
  FROM customer, (VALUES ('name'), ('target')) v(f)""")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    sheet = F.col("c_nationkey").cast("string").alias("sheet")
    segment = F.when(F.col("c_custkey") % 3 == 0, "NaN").otherwise(F.col("c_mktsegment"))
    rows = F.explode(F.array(F.struct(F.lit(0).alias("row_no"), F.col("c_name").alias("cell")), F.struct(F.lit(1).alias("row_no"), segment.alias("cell")), F.struct(F.lit(2).alias("row_no"), F.lit("repeated").alias("cell")))).alias("r")
    body = c.select(sheet, (F.col("c_custkey") + 1).alias("col_no"), rows).select("sheet", "r.row_no", "col_no", "r.cell")
    labels = F.explode(F.array(*[F.struct(F.lit(i).alias("row_no"), F.lit(0).cast("long").alias("col_no"), F.lit(x).alias("cell")) for i, x in enumerate(["name", "target", "target"])])).alias("r")
    heads = c.select(sheet).distinct().select("sheet", labels).select("sheet", "r.row_no", "r.col_no", "r.cell")
    return files.unpivot_sheet(heads.unionByName(body)).withColumn("ab_idx", F.col("ab_idx") - 1)


@query("s19_fasta", """SELECT 'p' || p_partkey || '|Chain H|' || p_brand AS header, 'Chain H' AS chain, translate(upper(md5('f' || p_partkey)), '0123456789ABCDEF', 'ACDEFGHIKLMNPQRS') AS sequence FROM part""")
def _(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    s = recipes.residue_text(F.concat(F.lit("f"), k))
    entry = F.concat(F.lit(">p"), k, F.lit("|Chain H|"), "p_brand", F.lit("\n"), F.substring(s, 1, 20), F.lit("\n"), F.substring(s, 21, 12), F.lit("\n"))
    raw = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_join(F.collect_list(entry), "").alias("value"))
    return files.parse_fasta(raw).select("header", F.get("parts", F.lit(1)).alias("chain"), "sequence")


# ---------------------------------------------------------------- records


@query("a22_evidence_score", """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 5 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS score,
  1 + (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT AS filled FROM customer""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    r = {"vh_sequence_aa": F.when(k % 4 == 0, "ACDEFG").otherwise(recipes.region(k)), "vl_sequence_aa": F.lit(" "), "CDRH3_Sequence": F.when(k % 2 == 0, "CARW"), "Target_Name": F.when(k % 3 == 0, "x").otherwise("")}
    return table(spark, sf_dir, "customer").select("c_custkey", records.evidence_score(r).alias("score"), records.filled_fields(list(r.values())).alias("filled"))


@query("j15_positional_zip", """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
  SELECT l_orderkey, 'L' || l_partkey AS label, 'S' || l_partkey AS line FROM n""")
def _(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("i"))
    labels = n.select("l_orderkey", F.col("i").alias("pos"), F.concat(F.lit("L"), F.col("l_partkey").cast("string")).alias("label"))
    lines = n.select("l_orderkey", (F.col("i") + 20).alias("pos"), F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("line"))
    return records.zipped_by_position(labels, lines, "l_orderkey").select("l_orderkey", "label", "line")


@query("p22_score_bands", f"""WITH {LABELS_SQL} SELECT CASE WHEN raw * penalty >= 70 THEN 'high' WHEN raw * penalty >= 40 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM penalised GROUP BY 1""")
def _(spark, sf_dir):
    return _papers(spark, sf_dir).groupBy(records.score_band(F.col("accuracy")).alias("band")).agg(F.count("*").alias("n"))


@query("p28_review_queue", """WITH a AS (SELECT source, count(*) FILTER (quality = 0) AS issues, count(*) FILTER (quality = 0 AND toxic = 1) AS reviewed, count(quality) AS touched FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
  SELECT source, issues, CASE WHEN reviewed >= issues THEN 'completed' WHEN touched > 0 THEN 'started' ELSE 'pending' END AS state FROM a""")
def _(spark, sf_dir):
    n = lambda c: F.count(F.when(c, 1))
    a = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    a = a.groupBy("source").agg(n(F.col("quality") == 0).alias("issues"), n((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("reviewed"), F.count("quality").alias("touched"))
    return a.select("source", "issues", records.review_state(F.col("issues"), F.col("reviewed"), F.col("touched")).alias("state"))


@query("w04_evidence_cap", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber * 1000000 + l_partkey) AS rn FROM lineitem) WHERE rn <= 2")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_linenumber") * 1000000 + F.col("l_partkey"))
    return records.capped(li, ["l_orderkey"], F.col("l_quantity"), "pos", 2).select("l_orderkey", "l_linenumber")


@query("g06_json_closed", """SELECT o_orderkey, '{"k":[' || o_orderkey || ',{"n":"x"}]}' AS found FROM orders""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", jsontext.json_closed(F.concat(F.lit('{"k": ['), F.col("o_orderkey").cast("string"), F.lit(', {"n": "x'))).alias("found"))


@query("s08_markdown_report", """SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS value FROM region UNION ALL SELECT '| r_regionkey | r_name |' UNION ALL SELECT '| --- | --- |'""")
def _(spark, sf_dir):
    return files.markdown_table(table(spark, sf_dir, "region"), ["r_regionkey", "r_name"], ["r_regionkey"])
