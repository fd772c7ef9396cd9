"""Reports of a benchmark: nested JSON, Markdown, and the facts read back from Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of labels and of weights in a report.
MARKS = {"exact": "✅", "partial": "⚠️", "wrong": "❌", "miss": "🔲", "skip": "➖"}
WEIGHT_MARKS = {2.0: "🔴", 1.0: "🟡", 0.5: "🟢"}
FIELD_HEAD = ["| Field | Weight | Ground Truth | Prediction | Score | Weighted | Reason |", "|------|------|---------|---------|------|------|------|"]


def _pick(table: dict, value: Column, default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def short_cell(value: Column, most: int = 50) -> Column:
    """A cell's text: bars escaped, cut after `most` characters."""
    t = F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def result_json(papers: DataFrame, records: DataFrame, fields: DataFrame) -> DataFrame:
    """paper_id, value: a paper's scores with its records and their fields as one JSON text, rounded as reports are.

    papers, records and fields are the tables of scores; a paper's records
    bound a row.
    """
    field = F.struct("field", "weight", "gt", "pred", "score", F.round("weighted_score", 2).alias("weighted_score"), "label")
    per = fields.groupBy("paper_id", "ab_idx").agg(F.array_sort(F.collect_list(field)).alias("fields"), F.sum("score").alias("score_sum"))
    record = F.struct(
        "ab_idx", "matched", F.round(F.col("ratio") * 100, 2).alias("accuracy"), F.col("n_fields").alias("total_fields"), F.round("score_sum", 2).alias("score_sum"),
        F.round("weight_sum", 2).alias("weight_sum"), F.round("weighted_sum", 2).alias("weighted_score_sum"), "fields")
    each = records.join(per, ["paper_id", "ab_idx"]).groupBy("paper_id").agg(F.array_sort(F.collect_list(record)).alias("antibodies"))
    paper = F.struct(
        "paper_id", F.col("ngs").alias("gt_count"), (F.col("ntp") + F.col("nfp")).alias("pred_count"), F.col("ntp").alias("matched"), F.col("nfn").alias("false_negative"), F.col("nfp").alias("false_positive"),
        F.round("penalty", 4).alias("penalty_coeff"), F.round("raw", 2).alias("raw_accuracy"), F.round("accuracy", 2).alias("accuracy"), "antibodies")
    return papers.join(each, "paper_id", "left").select("paper_id", F.to_json(paper).alias("value"))


def write_latest(df: DataFrame, folder: str, stamp: str) -> None:
    """df as text under its own stamp and as `latest`, each a folder of files."""
    for name in (stamp, "latest"):
        df.select("value").write.mode("overwrite").text(f"{folder}/{name}")


def field_lines(fields: DataFrame) -> DataFrame:
    """paper_id, ab_idx, field, value: a line of a record's table for each scored field."""
    weight = F.concat(_pick(WEIGHT_MARKS, F.col("weight"), ""), F.col("weight").cast("string"))
    score = F.concat(_pick(MARKS, F.col("label"), "?"), F.lit(" "), _fixed(F.col("score"), 1))
    cells = F.concat_ws(" | ", "field", weight, short_cell(F.col("gt")), short_cell(F.col("pred")), score, _fixed(F.col("weighted_score"), 1), F.coalesce("reason", F.lit("")))
    return fields.select("paper_id", "ab_idx", "field", F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))


def markdown_report(papers: DataFrame, records: DataFrame, fields: DataFrame) -> DataFrame:
    """paper_id, pos, value: the lines of each paper's part of a report, in order.

    records need a name; lines are rows, so a report of any length is a table.
    """
    n = lambda c: F.col(c).cast("string")
    head = F.array(
        F.concat(F.lit("## "), F.col("paper_id")), F.lit(""), F.concat(F.lit("- **NGS/NTP/NFN/NFP**: "), F.concat_ws(" / ", *map(n, ("ngs", "ntp", "nfn", "nfp")))), F.concat(F.lit("- **Penalty**: "), _fixed(F.col("penalty"), 2)),
        F.concat(F.lit("- **Raw weighted average**: "), _fixed(F.col("raw"), 1)), F.concat(F.lit("- **Final score**: **"), _fixed(F.col("accuracy"), 1), F.lit("**")), F.lit(""))
    top = papers.select("paper_id", F.lit(-1).cast("long").alias("ab_idx"), F.lit(0).alias("part"), F.posexplode(head).alias("k", "value")).select("paper_id", "ab_idx", "part", F.lpad(F.col("k").cast("string"), 3, "0").alias("k"), "value")
    status = F.when(F.col("matched"), "matched").otherwise("unmatched")
    title = F.array(F.concat(F.lit("### "), F.col("name"), F.lit(" "), status, F.lit(" - "), _fixed(F.col("ratio") * 100, 1), F.lit(" pts")), F.lit(""), *map(F.lit, FIELD_HEAD))
    heads = records.select("paper_id", "ab_idx", F.lit(0).alias("part"), F.posexplode(title).alias("k", "value")).select("paper_id", "ab_idx", "part", F.lpad(F.col("k").cast("string"), 3, "0").alias("k"), "value")
    body = field_lines(fields).select("paper_id", "ab_idx", F.lit(1).alias("part"), F.col("field").alias("k"), "value")
    every = top.unionByName(heads).unionByName(body)
    order = Window.partitionBy("paper_id").orderBy("ab_idx", "part", "k")
    return every.select("paper_id", F.row_number().over(order).alias("pos"), "value")


def parse_report(lines: DataFrame) -> DataFrame:
    """Lines of a report (paper_id, pos, value) -> paper_id, record, matched, field, weight, gt, pred, label, score.

    A heading of the third level opens a record; lines of seven cells below it
    are its fields.  Labels are told by their marks, numbers are the first in
    their cell.
    """
    w = Window.partitionBy("paper_id").orderBy("pos")
    title = F.when(F.startswith("value", F.lit("### ")), F.col("value"))
    rows = lines.withColumn("_title", F.last(title, ignorenulls=True).over(w)).filter(F.startswith("value", F.lit("| ")) & F.col("_title").isNotNull())
    cells = F.transform(F.split("value", r"(?<!\\)\|"), lambda c: F.trim(c))
    rows = rows.withColumn("_c", cells).filter((F.size("_c") == 9) & (F.get("_c", F.lit(1)) != "Field"))
    cell = lambda k: F.get("_c", F.lit(k))
    number = lambda k: F.regexp_extract(cell(k), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    label = F.lit("other")
    for name, mark in reversed(list(MARKS.items())):
        label = F.when(F.contains(cell(5), F.lit(mark[0])), name).otherwise(label)
    name = F.regexp_extract("_title", r"^### (.*) (matched|unmatched) - [\d.]+ pts$", 1)
    text = lambda k: F.replace(cell(k), F.lit("\\|"), F.lit("|"))
    return rows.select(
        "paper_id", name.alias("record"), (~F.contains("_title", F.lit(" unmatched - "))).alias("matched"), cell(1).alias("field"), number(2).alias("weight"), text(3).alias("gt"), text(4).alias("pred"),
        label.alias("label"), number(5).alias("score"))


def field_analytics(facts: DataFrame) -> DataFrame:
    """By field: count, mean score, the same over active entries (some value and no skip), values on each side, and both-empty exact ones."""
    has_gt, has_pred = F.trim("gt") != "", F.trim("pred") != ""
    active = (has_gt | has_pred) & (F.col("label") != "skip")
    n = lambda c: F.sum(c.cast("long"))
    return facts.groupBy("field").agg(
        F.count("*").alias("count"), F.avg("score").alias("avg_score"), n(active).alias("active"), F.avg(F.when(active, F.col("score"))).alias("active_avg"), n(has_gt).alias("gt_filled"), n(has_pred).alias("pred_filled"),
        n(~has_gt & ~has_pred & (F.col("label") == "exact")).alias("both_empty_exact"))


def score_level(average: Column) -> Column:
    """strong from 85 points of a hundred on, middle from 75, else weak."""
    return F.when(average >= 85, "strong").when(average >= 75, "middle").otherwise("weak")
