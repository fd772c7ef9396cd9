"""Views and roll-ups of annotations, feedback and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.validate import ISSUES

#: Labels that are counted, whether they occur or not.
LABELS = ["exact", "partial", "wrong", "miss", "skip"]
KEY = ["paper_id", "ab_idx", "field"]


def _n(condition) -> F.Column:
    return F.count(F.when(condition, 1))


def annotated(facts: DataFrame, annotations: DataFrame) -> DataFrame:
    """facts with the annotation of their (paper, record, field), null where there is none; annotations hold one row a key."""
    rest = [c for c in annotations.columns if c not in KEY]
    return facts.join(annotations.select(*KEY, F.struct(*rest).alias("annotation")), KEY, "left")


def label_counts(facts: DataFrame, by: list[str]) -> DataFrame:
    """How often each label occurs for a key; other labels count as `other`."""
    return facts.groupBy(*by).agg(*[_n(F.col("label") == x).alias(x) for x in LABELS], _n(~F.col("label").isin(LABELS)).alias("other"))


def annotation_progress(view: DataFrame, by: list[str]) -> DataFrame:
    """Of an annotated view: issues, those annotated, reviewed and pending, and the share reviewed in per cent (100 without issues)."""
    issue, status = F.col("label").isin(ISSUES), F.col("annotation.status")
    done = issue & (status == "reviewed")
    out = view.groupBy(*by).agg(_n(issue).alias("issues"), _n(F.col("annotation").isNotNull()).alias("annotated"), _n(done).alias("reviewed"))
    share = F.when(F.col("issues") == 0, 100.0).otherwise(100.0 * F.col("reviewed") / F.col("issues"))
    return out.withColumns({"pending": F.greatest(F.col("issues") - F.col("reviewed"), F.lit(0).cast("long")), "progress_pct": share})


def dataset_summary(progress: DataFrame) -> DataFrame:
    """Of the progress of papers: papers, those started and completed, annotated fields."""
    return progress.agg(F.count("*").alias("papers"), _n(F.col("annotated") > 0).alias("started"), _n(F.col("reviewed") >= F.col("issues")).alias("completed"), F.coalesce(F.sum("annotated"), F.lit(0)).alias("annotated"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """feedback (paper_id, ab_idx, created): how much, from how many papers and records, and the last time."""
    return feedback.agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"), F.count_distinct(F.concat_ws("::", F.col("paper_id").cast("string"), F.col("ab_idx").cast("string"))).alias("records"), F.max("created").alias("last"))


def batch_summary(runs: DataFrame) -> DataFrame:
    """runs (paper_id, status, antibodies) -> one row a status and one, with status `all`, for the batch."""
    sums = [F.count("*").alias("papers"), F.coalesce(F.sum("antibodies"), F.lit(0)).cast("long").alias("antibodies")]
    return runs.groupBy("status").agg(*sums).unionByName(runs.agg(*sums).withColumn("status", F.lit("all")))


def in_subset(papers: DataFrame, subset: str | None, given: str | None = None) -> DataFrame:
    """Papers (paper_id) of a subset by any of its names; `given` names a column whose category wins over the id's."""
    name = text.subset_name(subset)
    kind = text.category(F.col("paper_id"), F.col(given) if given else None)
    return papers if name == "all" else papers.filter(kind == name)


def subset_sizes(papers: DataFrame, given: str | None = None) -> DataFrame:
    """How many papers are in each subset: all, paper, patent."""
    kind = text.category(F.col("paper_id"), F.col(given) if given else None)
    return papers.select(F.explode(F.array(F.lit("all"), kind)).alias("subset")).groupBy("subset").agg(F.count("*").alias("n"))
