"""Scores: field -> record -> paper -> benchmark, as one fact table and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import judge, text, units
from lectern.functions.binding import bound

#: Scored fields by weight.
WEIGHTS = {
    2.0: ["CDRH3_Sequence", "vh_sequence_aa", "vl_sequence_aa", "Binding_Kinetics_KD"],
    1.0: ["Target_Name", "Epitope", "Antibody_Type", "Mechanism_of_Action", "Experiment", "Binding_Kinetics_kon", "Binding_Kinetics_koff", "Binding_EC50", "Structure"],
    0.5: ["source", "Reference_Source", "Target_Type", "Antibody_Isotype", "Cross_Reactivity", "Quantitative_Metric", "In_Vivo_Half_Life", "In_Vivo_Efficacy", "Thermal_Stability_Tm"],
}
FIELDS = [f for fields in WEIGHTS.values() for f in fields]


def field_weight(field: Column) -> Column:
    return F.when(field.isin(WEIGHTS[2.0]), 2.0).when(field.isin(WEIGHTS[0.5]), 0.5).otherwise(1.0)


def equal_label(gt: Column, pred: Column) -> Column:
    """The deterministic stand-in for a model: equal keys are exact, containment is partial, else wrong."""
    a, b = text.match_key(gt), text.match_key(pred)
    return F.when(a == b, "exact").when((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), "partial").otherwise("wrong")


def score_fields(pairs: DataFrame, model=equal_label) -> DataFrame:
    """pairs (paper_id, ab_idx, field, gt, pred, matched) -> the same with label, score, weight and weighted score.

    label is exact, partial, wrong, miss or skip: blanks first, then numbers,
    then the rules, and `model` decides what these leave open.
    """
    kept = pairs.columns
    out = bound(pairs, _g=text.clean(F.col("gt")), _p=text.clean(F.col("pred")))
    out = bound(out, _no_gt=text.is_empty(F.col("_g")), _no_pred=text.is_empty(F.col("_p")))
    number = F.col("field").isin(list(units.NUMERIC_FIELDS))
    out = bound(out, _a=F.when(number, units.quantity(F.col("field"), F.col("_g"))), _b=F.when(number, units.quantity(F.col("field"), F.col("_p"))))
    out = bound(out, _x=judge.parts(F.col("field"), F.col("_g")), _y=judge.parts(F.col("field"), F.col("_p")))
    judged = F.coalesce(units.numeric_label(F.col("_a"), F.col("_b")), judge.label_of_parts(F.col("field"), F.col("_x"), F.col("_y")), model(F.col("_g"), F.col("_p")))
    label = (
        F.when(~F.col("matched"), F.when(F.col("_no_gt"), "skip").otherwise("miss"))
        .when(F.col("_no_gt") & F.col("_no_pred"), "exact")
        .when(F.col("_no_gt"), "skip")
        .when(F.col("_p") == "", "miss")
        .otherwise(judged)
    )
    out = bound(out.withColumn("label", label), score=judge.label_score(F.col("label")), weight=field_weight(F.col("field")))
    return out.select(*kept, "label", "score", "weight", (F.col("score") * F.col("weight")).alias("weighted_score"))


def score_records(fields: DataFrame) -> DataFrame:
    """Accuracy of each record: weighted mean over fields that count; a record not found earns nothing."""
    counts = F.col("label") != "skip"
    out = fields.groupBy("paper_id", "ab_idx", "matched").agg(
        F.sum(F.when(counts, F.col("weight")).otherwise(0.0)).alias("weight_sum"),
        F.sum(F.when(counts, F.col("weighted_score")).otherwise(0.0)).alias("weighted_sum"),
        F.sum(F.when(counts, 1).otherwise(0)).cast("long").alias("n_fields"),
    )
    return out.withColumn("ratio", F.coalesce(F.try_divide("weighted_sum", "weight_sum"), F.lit(0.0)))


def penalty(ngs: Column, ntp: Column, nfn: Column, nfp: Column) -> Column:
    """1 or 0 without records to find; 0 with none found; else less .01 for each five false and .05 for each missing record."""
    step = F.floor(nfp / 5)
    return F.when(ngs == 0, F.when(ntp + nfp == 0, 1.0).otherwise(0.0)).when(ntp == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.01 * step - 0.05 * nfn))


def score_papers(records: DataFrame, extra: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """Scores of the papers that have a ground truth.

    records: of the ground truth, scored; extra (paper_id, nfp): predictions
    that matched none; papers (paper_id): those with a ground truth, which may
    hold no record, by default those of records.  Predictions for other papers
    count nowhere.
    """
    by = records.groupBy("paper_id").agg(
        F.count("*").alias("ngs"), F.sum(F.col("matched").cast("long")).alias("ntp"), F.sum((~F.col("matched")).cast("long")).alias("nfn"), F.sum("ratio").alias("ratios"))
    if papers is not None:
        by = papers.select("paper_id").distinct().join(by, "paper_id", "left")
    both = by.join(extra, "paper_id", "left").na.fill(0, ["ngs", "ntp", "nfn", "ratios", "nfp"])
    both = both.withColumn("raw", F.coalesce(F.try_divide("ratios", "ngs"), F.lit(0.0)) * 100)
    both = both.withColumn("penalty", penalty(F.col("ngs"), F.col("ntp"), F.col("nfn"), F.col("nfp")))
    return both.select("paper_id", "ngs", "ntp", "nfn", "nfp", "raw", "penalty", (F.col("raw") * F.col("penalty")).alias("accuracy"))


def papers_with_output(pred: DataFrame, but: tuple[str, ...] = ("field_sources",)) -> DataFrame:
    """paper_id of the papers in which some record has any text in any field (other than ids and provenance)."""
    fields = [c for c in pred.columns if c not in ("paper_id", "ab_idx", *but)]
    some = F.exists(F.array(*[F.col(c).cast("string") for c in fields]), text.has_output)
    return pred.filter(some).select("paper_id").distinct()


def score_benchmark(papers: DataFrame, with_output: DataFrame) -> DataFrame:
    """Mean accuracy of papers that have any output, totals, and how many were left out; precision and recall of records beside them."""
    has = with_output.select("paper_id", F.lit(True).alias("_has")).distinct()
    marked = papers.join(has, "paper_id", "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    some = lambda c: F.when(F.col("_has"), F.col(c))
    total = marked.agg(
        F.count(some("paper_id")).alias("papers"), F.count(F.when(~F.col("_has"), 1)).alias("papers_without_output"),
        *[F.coalesce(F.sum(some(c)), F.lit(0)).cast("long").alias(c) for c in ("ngs", "ntp", "nfn", "nfp")], F.coalesce(F.avg(some("accuracy")), F.lit(0.0)).alias("accuracy"))
    return total.withColumns({"ab_precision": F.try_divide(F.col("ntp").cast("double"), F.col("ntp") + F.col("nfp")), "ab_recall": F.try_divide(F.col("ntp").cast("double"), F.col("ngs"))})


def hit_rate(fields: DataFrame, of: list[str]) -> DataFrame:
    """Share of exact or partial labels among fields that have a ground truth and are not skipped."""
    used = fields.filter(F.col("field").isin(of) & (F.col("label") != "skip") & ~text.is_empty(F.col("gt")))
    return used.agg(F.count("*").alias("n"), F.avg(F.col("label").isin("exact", "partial").cast("double")).alias("hit_rate"))


def field_stats(fields: DataFrame) -> DataFrame:
    """Counts by label for each field, with the shares of partial or wrong and of missing values."""
    label = F.when(F.col("label").isin("exact", "partial", "wrong", "miss"), F.col("label")).otherwise("skip")
    n = lambda x: F.sum((label == x).cast("long")).alias(x)
    out = fields.groupBy("field").agg(F.count("*").alias("total"), *[n(x) for x in ("exact", "partial", "wrong", "miss", "skip")])
    return out.withColumns({"partial_pct": 100.0 * (F.col("partial") + F.col("wrong")) / F.col("total"), "mismatch_pct": 100.0 * F.col("miss") / F.col("total")})


def stats_order() -> list[Column]:
    return [F.desc("mismatch_pct"), F.desc("partial_pct"), F.desc("total"), F.asc("field")]


def issue_board(fields: DataFrame) -> DataFrame:
    """Counts by label for each sequence field and paper; issues are wrong, miss and partial."""
    some = fields.filter(F.col("field").isin(judge.SEQUENCE_FIELDS))
    n = lambda x: F.sum((F.col("label") == x).cast("long")).alias(x)
    out = some.groupBy("field", "paper_id").agg(F.count("*").alias("total"), *[n(x) for x in ("exact", "partial", "wrong", "miss", "skip")])
    return out.withColumn("issues", F.col("wrong") + F.col("miss") + F.col("partial"))


def grade(quality: Column) -> Column:
    return F.when(quality >= 85, "S").when(quality >= 70, "A").when(quality >= 55, "B").when(quality >= 40, "C").when(quality >= 25, "D").otherwise("F")


def field_quality(fields: DataFrame) -> DataFrame:
    """Quality of each field over labels that are not skipped, the shares of wrong and missing ones, and its grade."""
    n = lambda x: F.sum((F.col("label") == x).cast("long")).alias(x)
    some = fields.filter("label <> 'skip'").groupBy("field").agg(F.count("*").alias("total"), *map(n, ("exact", "partial", "wrong", "miss")))
    share = lambda c: 100.0 * c / F.col("total")
    out = some.withColumns({"quality": share(F.col("exact") + 0.5 * F.col("partial")), "wrong_pct": share(F.col("wrong")), "miss_pct": share(F.col("miss"))})
    return out.withColumn("grade", grade(F.col("quality")))


def gap_report(records: DataFrame, fields: list[str]) -> DataFrame:
    """For each record the sorted list of fields it lacks; complete records are left out."""
    lacks = F.array_sort(F.filter(F.array(*[F.when(text.is_empty(F.col(f)), F.lit(f)) for f in fields]), lambda x: x.isNotNull()))
    return records.withColumn("missing", lacks).filter(F.size("missing") > 0)
