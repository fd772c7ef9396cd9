"""Inputs of the library's operators, rendered from the shared tables.

Most are SQL text that Spark and DuckDB read alike, so a query and the SQL that
it is compared with begin from the same rows and part ways only in what they
compute from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue_text(*salted: Column) -> Column:
    """32 residues for each column, from the digits of its md5."""
    return F.concat(*[F.translate(F.upper(F.md5(c)), "0123456789ABCDEF", "ACDEFGHIKLMNPQRS") for c in salted])


def region(k: Column) -> Column:
    s = k.cast("string")
    return residue_text(F.concat(F.lit("a"), s), F.concat(F.lit("b"), s), F.concat(F.lit("c"), s))


def residues_sql(*salted: str) -> str:
    """32 residues for each SQL text, from the digits of its md5."""
    return "concat(" + ", ".join(f"translate(upper(md5({s})), '0123456789ABCDEF', 'ACDEFGHIKLMNPQRS')" for s in salted) + ", '')"


def region_sql(k: str) -> str:
    """96 residues that depend on k."""
    return residues_sql(*[f"concat('{x}', cast({k} as string))" for x in "abc"])


def chosen(salt: int, *options: str, k: str = "k") -> str:
    """One of the SQL options, by an arithmetic of k that differs from salt to salt."""
    turn = f"(({k} * {salt}) + cast(floor({k} / 7) as bigint)) % {len(options)}"
    return f"CASE {turn} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CENTS = "cast(cast(cents as bigint) as string)"
_SEQ, _OTHER = region_sql("k"), region_sql("k + 1000000")
_HIT = f"concat(substr({_SEQ}, 1, 40), CASE WHEN substr({_SEQ}, 41, 1) = 'W' THEN 'Y' ELSE 'W' END, substr({_SEQ}, 42, 60))"
_REF = "concat('Smith', ' et al. Nat Med, ', cast(1990 + k % 30 as string), '. DOI: 10.1000/x', cast(k as string))"
_REF_BARE = "concat('(A. Smith et al.) Nat Med ', cast(1990 + k % 30 as string))"
#: For each scored field what the ground truth and what the predictions hold, as SQL over k, cents and seg.
FIELD_VALUES = {
    "CDRH3_Sequence": (chosen(3, f"substr({_SEQ}, 1, 16)", "'N/A'", f"substr({_SEQ}, 1, 12)"), chosen(5, f"lower(substr({_SEQ}, 1, 16))", f"substr({_SEQ}, 3, 9)", f"substr({_OTHER}, 1, 16)", "''")),
    "vh_sequence_aa": (chosen(2, _SEQ, _SEQ, "''"), chosen(3, _SEQ, f"substr({_SEQ}, 1, 90)", _HIT, _OTHER, "'N/A'", "''")),
    "vl_sequence_aa": (chosen(7, _OTHER, "'not reported'"), chosen(2, _OTHER, _SEQ, "''", f"concat('  ', lower({_OTHER}))")),
    "Binding_Kinetics_KD": (chosen(3, f"concat({_CENTS}, ' pM')", f"concat('KD = ', {_CENTS}, ' nM')", "''"), chosen(2, f"concat(cast(cast(cents as bigint) * 105 as string), ' pM')", f"concat({_CENTS}, ' nM')", f"concat({_CENTS}, ' to 7 nM')", "'N/A'", "''")),
    "Target_Name": (chosen(2, "seg", "concat(seg, ' (human)')", "'n.d.'"), chosen(3, "lower(seg)", "concat(seg, '-B')", "'OTHER'", "''")),
    "Epitope": (chosen(5, "concat('site ', cast(k % 9 as string))", "''"), chosen(3, "concat('Site-', cast(k % 9 as string))", "'site'", "'not specified'")),
    "Antibody_Type": (chosen(3, "'IgG1'", "'mAb'", "'Fab'", "'N/A'"), chosen(2, "'IgG4'", "'monoclonal antibody'", "'scFv fragment'", "'chimera'")),
    "Mechanism_of_Action": (chosen(2, "'blocks binding of the receptor'", "'-'"), chosen(3, "'Blocks binding'", "'blocks binding of the receptor.'", "''", "'lysis'")),
    "Experiment": (chosen(3, "'ELISA, SPR'", "'surface plasmon resonance'", "'ITC; BLI'", "''"), chosen(5, "'SPR, ELISA'", "'ELISA; SPR; Western blot'", "'BLI'", "'other assay'")),
    "Binding_Kinetics_kon": (chosen(2, "concat(cast(k % 9 + 1 as string), 'e5')", "concat(cast(k % 9 + 1 as string), ' x 10^5 1/Ms')"), chosen(3, "concat(cast(k % 9 + 1 as string), 'E5')", "concat(cast(k % 9 + 1 as string), 'e6')", "''")),
    "Binding_Kinetics_koff": (chosen(5, "concat(cast(k % 9 + 1 as string), ' × 10^(-4)')", "'nd'"), chosen(2, "concat(cast(2 * (k % 9 + 1) as string), 'e-4')", "concat(cast(k % 9 + 1 as string), 'e-4')", "'fast'")),
    "Binding_EC50": (chosen(3, f"concat({_CENTS}, ' nM')", f"concat({_CENTS}, ' uM')", "''"), chosen(2, f"{_CENTS}", f"concat({_CENTS}, ' nM')", "'0.5 and 0.7 nM'")),
    "Structure": (chosen(2, "concat(cast(k % 9 + 1 as string), 'ABC')", "''"), chosen(5, "concat(cast(k % 9 + 1 as string), 'abc')", "'PDB 7XYZ'", "''")),
    "source": ("'patent family A'", chosen(2, "'Patent Family A'", "'patent'", "'paper'")),
    "Reference_Source": (chosen(3, _REF, _REF_BARE, "''"), chosen(2, _REF, "concat('doi:10.1000/X', cast(k as string), '.')", _REF_BARE, "'Kim et al. Cell, 1901'")),
    "Target_Type": (chosen(2, "'protein'", "'viral protein'"), chosen(3, "'Protein'", "'virus'", "''")),
    "Antibody_Isotype": (chosen(3, "'IgG1'", "'IgM'", "'n/a'"), chosen(2, "'igg1'", "'IgG'", "'none'")),
    "Cross_Reactivity": (chosen(2, "'mouse; rat'", "''"), chosen(5, "'Mouse, rat'", "'mouse'", "''", "'human'")),
    "Quantitative_Metric": (chosen(5, "concat('IC50 ', cast(k % 5 as string))", "'未报道'"), chosen(2, "concat('ic50=', cast(k % 5 as string))", "'IC50'", "''")),
    "In_Vivo_Half_Life": (chosen(2, "concat(cast(k % 20 as string), ' days')", "''"), chosen(3, "concat(cast(k % 20 as string), 'days')", "concat(cast(k % 19 as string), ' days')", "''")),
    "In_Vivo_Efficacy": ("'none'", chosen(3, "''", "'protects mice'", "'N/A (not tested)'")),
    "Thermal_Stability_Tm": (chosen(2, "concat(cast(k % 60 + 40 as string), ' °C')", "''"), chosen(3, "concat('Tm ', cast(k % 60 + 42 as string), ' C')", "'high'", "cast(k % 60 + 90 as string)")),
}
BASE_SQL = "SELECT c_custkey AS k, concat('P', cast(cast(floor(c_custkey / 8) as bigint) as string)) AS paper_id, c_name, c_mktsegment AS seg, floor(c_acctbal * 100) + 200000 AS cents FROM customer"
GT_SQL = f"SELECT paper_id, k AS ab_idx, c_name AS Antibody_Name, {', '.join(f'{g} AS {f}' for f, (g, _) in FIELD_VALUES.items())} FROM base"
#: Six of seven records under a varied name, and one of another name for every third; papers whose number is 5 modulo 11 have none.
PRED_SQL = f"""SELECT paper_id, k AS ab_idx, upper(replace(c_name, '#', '# ')) AS Antibody_Name, {', '.join(f'{p} AS {f}' for f, (_, p) in FIELD_VALUES.items())} FROM base
  WHERE k % 7 <> 0 AND cast(floor(k / 8) as bigint) % 11 <> 5
  UNION ALL SELECT paper_id, k + 10000000, concat('zz', translate(md5(cast(k as string)), '0123456789abcdef', 'abdfghijklnpqvwx')), {', '.join("''" for _ in FIELD_VALUES)} FROM base
  WHERE k % 3 = 0 AND cast(floor(k / 8) as bigint) % 11 <> 5"""


def base(spark: SparkSession, sf_dir: str) -> None:
    table(spark, sf_dir, "customer").createOrReplaceTempView("lectern_customer")
    spark.sql(BASE_SQL.replace("FROM customer", "FROM lectern_customer")).createOrReplaceTempView("lectern_base")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    base(spark, sf_dir)
    return spark.sql(GT_SQL.replace("FROM base", "FROM lectern_base"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base(spark, sf_dir)
    return spark.sql(PRED_SQL.replace("FROM base", "FROM lectern_base"))


_MARKERS = "('', 'n/a', 'n.a.', 'n.d.', 'nd', 'not reported', 'not specified', '未报道', '未提供', '未提及', 'none', 'null', '无', '-', '—')"
_ASIDES = r"\s*[\(（].*?[\)）]\s*"


def _empty(c: str) -> str:
    return f"(lower(trim({c})) IN {_MARKERS} OR trim(regexp_replace(lower(trim({c})), '{_ASIDES}', '', 'g')) IN {_MARKERS} OR regexp_matches(lower(trim({c})), '^not\\s+(reported|specified|provided|mentioned|applicable)$'))"


def _measure(c: str) -> str:
    """The number of a field's text by its kind, null for none or several."""
    sci = f"coalesce(try_cast(regexp_extract({c}, '^(-?\\d+\\.?\\d*)[eE]([+-]?\\d+)', 1) AS DOUBLE) * pow(10e0, try_cast(regexp_extract({c}, '^(-?\\d+\\.?\\d*)[eE]([+-]?\\d+)', 2) AS DOUBLE)), try_cast(regexp_extract({c}, '(-?\\d+\\.?\\d*)\\s*[x×]\\s*10\\^\\(?(-?\\d+)', 1) AS DOUBLE) * pow(10e0, try_cast(regexp_extract({c}, '(-?\\d+\\.?\\d*)\\s*[x×]\\s*10\\^\\(?(-?\\d+)', 2) AS DOUBLE)))"
    unit = f"CASE regexp_extract({c}, '(\\d+\\.?\\d*)\\s*(pM|nM|uM|mM)', 2) WHEN 'pM' THEN 0.001e0 WHEN 'uM' THEN 1000e0 WHEN 'mM' THEN 1e6 ELSE 1e0 END"
    # a bare number loses leading digits that the optional name before it may have too
    bare = "'^[=≈~:KDkdECec50]*\\s*(\\d+\\.?\\d*)\\s*$'"
    conc = f"CASE WHEN regexp_matches({c}, '(pM|nM|uM|mM)') THEN try_cast(regexp_extract({c}, '(\\d+\\.?\\d*)', 1) AS DOUBLE) * {unit} WHEN regexp_matches({c}, {bare}) THEN try_cast(regexp_extract({c}, {bare}, 1) AS DOUBLE) END"
    warm = f"CASE WHEN try_cast(regexp_extract({c}, '(\\d+\\.?\\d*)', 1) AS DOUBLE) BETWEEN 20 AND 120 THEN try_cast(regexp_extract({c}, '(\\d+\\.?\\d*)', 1) AS DOUBLE) END"
    return f"""CASE WHEN regexp_matches({c}, '\\b(and|to)\\b') THEN NULL WHEN field IN ('Binding_Kinetics_KD', 'Binding_EC50') THEN {conc}
      WHEN field IN ('Binding_Kinetics_kon', 'Binding_Kinetics_koff') THEN {sci} WHEN field = 'Thermal_Stability_Tm' THEN {warm} END"""


def _tags(c: str, pairs: list[tuple[str, str]]) -> str:
    return f"list_filter([{', '.join(f'CASE WHEN regexp_matches(lower({c}), {q(p)}) THEN {q(t)} END' for p, t in pairs)}], lambda x: x IS NOT NULL)"


_TYPES = [(r"\bscfv\b", "scfv"), (r"\bfab\b", "fab"), (r"\bigg[1-4]?\b", "igg"), (r"monoclonal antibody|\bmab\b", "mab")]
_METHODS = [(r"\belisa\b", "elisa"), (r"\bitc\b", "itc"), (r"\bbli\b", "bli"), (r"\bspr\b|surface plasmon resonance", "spr"), (r"western blot", "westernblot")]


def _methods(c: str) -> str:
    plain = f"list_filter(list_transform(string_split_regex({c}, '[,;/]'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> '')"
    return f"CASE WHEN len({_tags(c, _METHODS)}) > 0 THEN {_tags(c, _METHODS)} ELSE {plain} END"


def _key(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def _letters(c: str) -> str:
    return f"regexp_replace(upper({c}), '[^A-Z]', '', 'g')"


_PART = {"doi": r"10\.\d{4,9}/[-._;()/:a-z0-9]*[a-z0-9]", "year": r"\b(19|20)\d\d\b", "who": r"([a-z]+) et al"}


def _part(c: str, name: str) -> str:
    return f"regexp_extract(lower({c}), {q(_PART[name])}, {1 if name == 'who' else 0})"


#: Labels of all scored fields by SQL over the rendered text, and what is summed up from them.
LABELS_SQL = f"""
base AS ({BASE_SQL}),
gt AS (UNPIVOT ({GT_SQL}) ON {', '.join(FIELD_VALUES)} INTO NAME field VALUE gt),
pr AS (UNPIVOT ({PRED_SQL}) ON {', '.join(FIELD_VALUES)} INTO NAME field VALUE pred),
sides AS (
  SELECT gt.paper_id, gt.ab_idx, gt.field, trim(gt.gt) AS g, trim(coalesce(pr.pred, '')) AS p, pr.ab_idx IS NOT NULL AS matched
  FROM gt LEFT JOIN pr ON pr.paper_id = gt.paper_id AND pr.ab_idx = gt.ab_idx AND pr.field = gt.field
),
parts AS (
  SELECT *, {_empty('g')} AS no_g, {_empty('p')} AS no_p, {_measure('g')} AS a, {_measure('p')} AS b, {_letters('g')} AS sg, {_letters('p')} AS sp,
    {_tags('g', _TYPES)} AS tg, {_tags('p', _TYPES)} AS tp, {_methods('g')} AS mg, {_methods('p')} AS mp, {_key('g')} AS kg, {_key('p')} AS kp,
    {', '.join(f"{_part(c, n)} AS {n}_{c}" for n in _PART for c in 'gp')}
  FROM sides
),
ruled AS (
  SELECT *, CASE
    WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN abs(b - a) <= 0.10e0 * abs(a) THEN 'exact' WHEN greatest(a / b, b / a) <= 3 THEN 'partial' ELSE 'wrong' END
    WHEN field IN ('CDRH3_Sequence', 'vh_sequence_aa', 'vl_sequence_aa') THEN CASE WHEN no_p THEN 'wrong' WHEN contains(sg, sp) OR contains(sp, sg) THEN 'exact'
      WHEN length(sg) >= 8 AND length(sp) >= 8 AND levenshtein(sg, sp) <= 0.10e0 * greatest(length(sg), length(sp)) THEN 'partial' ELSE 'wrong' END
    WHEN field = 'Antibody_Type' AND len(tg) > 0 AND len(tp) > 0 THEN CASE WHEN list_has_any(tg, tp) OR (tg = ['mab'] AND tp = ['igg']) THEN 'exact' ELSE 'wrong' END
    WHEN field = 'Experiment' AND len(mg) > 0 AND len(mp) > 0 THEN CASE
      WHEN list_has_all(mp, mg) AND list_has_all(mg, mp) THEN 'exact' WHEN list_has_all(mp, mg) AND list_contains(mp, 'westernblot') THEN 'partial'
      WHEN list_has_all(mp, mg) THEN 'exact' WHEN list_has_any(mg, mp) THEN 'partial' ELSE 'wrong' END
    WHEN field = 'Reference_Source' AND doi_g <> '' AND doi_g = doi_p THEN 'exact'
    WHEN field = 'Reference_Source' AND who_g <> '' AND who_g = who_p AND year_g <> '' AND year_g = year_p THEN 'exact'
    WHEN kg = kp THEN 'exact' WHEN kg <> '' AND kp <> '' AND (contains(kg, kp) OR contains(kp, kg)) THEN 'partial' ELSE 'wrong' END AS judged
  FROM parts
),
labels AS (
  SELECT paper_id, ab_idx, field, matched, g, p,
    CASE WHEN NOT matched THEN CASE WHEN no_g THEN 'skip' ELSE 'miss' END WHEN no_g AND no_p THEN 'exact' WHEN no_g THEN 'skip' WHEN p = '' THEN 'miss' ELSE judged END AS label,
    (CASE WHEN field IN ('CDRH3_Sequence', 'vh_sequence_aa', 'vl_sequence_aa', 'Binding_Kinetics_KD') THEN 2.0
      WHEN field IN ('source', 'Reference_Source', 'Target_Type', 'Antibody_Isotype', 'Cross_Reactivity', 'Quantitative_Metric', 'In_Vivo_Half_Life', 'In_Vivo_Efficacy', 'Thermal_Stability_Tm')
      THEN 0.5 ELSE 1.0 END)::DOUBLE AS weight
  FROM ruled
),
scored AS (SELECT *, CASE label WHEN 'exact' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM labels),
records AS (
  SELECT paper_id, ab_idx, any_value(matched) AS matched, sum(CASE WHEN label = 'skip' THEN 0 ELSE weight END)::DOUBLE AS weight_sum,
         sum(CASE WHEN label = 'skip' THEN 0 ELSE weight * score END)::DOUBLE AS weighted_sum, count(*) FILTER (label <> 'skip') AS n_fields
  FROM scored GROUP BY paper_id, ab_idx
),
extra AS (SELECT paper_id, count(*) AS nfp FROM pr WHERE field = 'source' AND ab_idx >= 10000000 GROUP BY 1),
papers AS (
  SELECT r.paper_id, count(*) AS ngs, count(*) FILTER (matched) AS ntp, count(*) FILTER (NOT matched) AS nfn, coalesce(any_value(nfp), 0) AS nfp,
         sum(CASE WHEN weight_sum > 0 THEN weighted_sum / weight_sum ELSE 0 END) / count(*) * 100 AS raw
  FROM records r LEFT JOIN extra e ON e.paper_id = r.paper_id GROUP BY r.paper_id
),
penalised AS (
  SELECT *, CASE WHEN ntp = 0 THEN 0 ELSE greatest(0, 1.0e0 - 0.01e0 * (nfp // 5) - 0.05e0 * nfn) END AS penalty FROM papers
)
"""

#: Records whose names are parts of one another or share no character, four on each side of a paper, with and without a target.
_LONG = "translate(md5(cast(cast(floor(p_partkey / 4) as bigint) as string)), '0123456789abcdef', 'abcdefghijklmnop')"
_FAR = "translate(md5(cast(p_partkey as string)), '0123456789abcdef', 'qrstuvwxyz012345')"
NAMES_GT_SQL = f"""SELECT concat('Q', cast(cast(floor(p_partkey / 4) as bigint) as string)) AS paper_id, p_partkey AS ab_idx, substr({_LONG}, 1, 4 + cast(p_partkey * 5 + p_size as int) % 7) AS Antibody_Name,
  {chosen(3, "'tgt'", "'tgtab'", "''", k='(p_partkey + p_size)')} AS Target_Name FROM part"""
NAMES_PRED_SQL = f"""SELECT concat('Q', cast(cast(floor(p_partkey / 4) as bigint) as string)) AS paper_id, p_partkey AS ab_idx,
  CASE WHEN p_size % 5 = 0 THEN substr({_FAR}, 1, 9) WHEN p_size % 5 = 1 THEN upper(substr({_LONG}, 2, 3)) ELSE concat('  ', substr({_LONG}, 1, 4 + cast(p_partkey * 3 + p_size as int) % 8)) END AS Antibody_Name,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE {chosen(5, "'TGT'", "'tgt-ab'", "'zq9'", "''", k='(p_partkey + p_size)')} END AS Target_Name FROM part"""
_BARE = "replace(lower(trim({0})), ' ', '')"
SIMS_SQL = f"""
g AS ({NAMES_GT_SQL}), p AS ({NAMES_PRED_SQL}),
keys AS (
  SELECT g.paper_id, g.ab_idx AS gi, p.ab_idx AS pi, lower(trim(g.Antibody_Name)) AS a, lower(trim(p.Antibody_Name)) AS b, {_key('g.Target_Name')} AS ta, {_key('p.Target_Name')} AS tb
  FROM g JOIN p USING (paper_id)
),
named AS (
  SELECT *, CASE WHEN a = b THEN 1.0e0 WHEN (starts_with(a, b) OR starts_with(b, a)) AND abs(length(a) - length(b)) <= 2 THEN 0.85e0 WHEN contains(a, b) OR contains(b, a) THEN 0.95e0 ELSE NULL END AS n,
    CASE WHEN ta = '' OR tb = '' THEN NULL WHEN ta = tb THEN 1.0e0 WHEN contains(ta, tb) OR contains(tb, ta) THEN 0.9e0 ELSE 0.0e0 END AS c
  FROM keys
)
"""


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table(spark, sf_dir, "part").createOrReplaceTempView("lectern_part")
    return spark.sql(NAMES_GT_SQL.replace("FROM part", "FROM lectern_part")), spark.sql(NAMES_PRED_SQL.replace("FROM part", "FROM lectern_part"))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order: an odd one starts a span that the next one ends."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w))
    return e.select(
        F.when(F.col("n") % 2 == 1, "start").otherwise("end").alias("event"), F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor((F.col("n") - 1) / 2).cast("string")).alias("span_id"),
        F.col("event_type").alias("name"), F.lit("user").alias("kind"), "ts", "user_id")


SPANS_SQL = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
spans AS (
  SELECT user_id, user_id || '-' || ((n - 1) // 2) AS span_id, min(ts) AS start, max(ts) AS "end", max(CASE WHEN n % 2 = 0 THEN event_type END) AS name
  FROM numbered GROUP BY user_id, (n - 1) // 2 HAVING count(*) = 2
)
"""
