"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import collapse, dealt_join, materialise, narrow_side

PREFIX = 256


def _prefix(text: Column, prefix: int) -> Column:
    return F.xxhash64(F.substring(collapse(text), 1, prefix))


def candidates(docs: DataFrame, text_col: str, prefix: int = PREFIX) -> DataFrame:
    """(_len, _pre) shared by at least two rows: rows elsewhere cannot have an equal.

    Lengths are counted over all rows; prefix hashes only over rows whose
    length others share.  Both aggregate map-side, so a length or a prefix
    that a third of the rows share is one partial count from each task.
    """
    length = F.length(collapse(F.col(text_col)))
    lengths = docs.groupBy(length.alias("_len")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_len")
    lengths = materialise(lengths, "lengths")
    some = docs.select(length.alias("_len"), F.col(text_col).alias("_text")).join(narrow_side(lengths, lengths.count()), "_len", "left_semi")
    keys = some.groupBy("_len", _prefix(F.col("_text"), prefix).alias("_pre")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_len", "_pre")
    return materialise(keys, "prefixes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of whitespace has
    become one space; null counts as empty.  The smallest id of a group stays
    (null ids come last; a group of null ids keeps one of them and has a null
    keep_id).  Rows repeated with one id and one text are told apart: one of
    them is kept.  An empty table gives an empty result.

    The groups form by refinement: only rows under a length and a prefix hash
    that others share enter the grouping by full hash.  The digest is a column
    of the result, so the last pass computes it for each row; the texts
    themselves are never shuffled.
    """
    text = F.col(text_col)
    shared = candidates(docs, text_col, prefix)
    rows = docs.select(F.col(id_col).alias("_id"), F.length(collapse(text)).alias("_len"), _prefix(text, prefix).alias("_pre"), F.sha2(collapse(text), 256).alias("_sha"))
    shared = narrow_side(shared.withColumn("_shared", F.lit(True)), shared.count())
    rows = rows.join(shared, ["_len", "_pre"], "left").select("_id", "_sha", F.coalesce("_shared", F.lit(False)).alias("_shared"), F.monotonically_increasing_id().alias("_row"))
    rows = materialise(rows, "exact")
    first = F.min(F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = rows.filter("_shared").groupBy("_sha").agg(first.alias("_first"), F.count("*").alias("n")).filter("n > 1")
    groups = materialise(groups.select("_sha", F.col("_first.id").alias("_keep"), F.col("_first.row").alias("_keep_row"), "n"), "groups")
    alone = rows.join(narrow_side(groups.select("_sha"), groups.count()), "_sha", "left_anti").select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    several = dealt_join(rows.filter("_shared"), groups, "_sha", groups.select("_sha", "n"), rows.count()).select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_row") == F.col("_keep_row")).alias("kept"), F.col("_sha").alias("text_sha256"))
    return alone.unionByName(several)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The same rows stay as in exact_groups: the smallest id of each group of
    equal texts (nulls last), and of rows that share it one.  Columns of docs
    may have any names; an empty table stays empty.

    Full content is hashed only for rows under a length and a prefix that
    others share.  A row that goes is known by its id and a hash of its text
    as it stands, in a narrow list that is broadcast only while it is counted
    to be small.  Rows that are repeated entirely and stay are thinned to one
    in a second, rare step over just those rows.
    """
    text = F.col(text_col)
    shared = candidates(docs, text_col, prefix)
    read = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select("_id", "_text", F.length(collapse(F.col("_text"))).alias("_len"), _prefix(F.col("_text"), prefix).alias("_pre"))
    some = read.join(narrow_side(shared, shared.count()), ["_len", "_pre"], "left_semi")
    some = materialise(some.select("_id", F.xxhash64("_text").alias("_raw"), F.sha2(collapse(F.col("_text")), 256).alias("_sha")), "exact")
    first = F.min(F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_raw").alias("raw")))
    groups = materialise(some.groupBy("_sha").agg(first.alias("_first"), F.count("*").alias("n")).filter("n > 1"), "groups")
    met = dealt_join(some, groups, "_sha", groups.select("_sha", "n"), some.count())
    stays = F.col("_first.id").eqNullSafe(F.col("_id")) & (F.col("_first.raw") == F.col("_raw"))
    marked = materialise(met.groupBy("_id", "_raw", stays.alias("_stays")).agg(F.count("*").alias("n")), "marked")

    key = [c for c in ("_id", "_raw")]
    inner = {c: f"{c}_of_row" for c in key}
    while set(inner.values()) & set(docs.columns):
        inner = {c: f"{n}_" for c, n in inner.items()}
    keyed = docs.withColumns({inner["_id"]: F.col(id_col), inner["_raw"]: F.xxhash64(text)})
    same = lambda d: F.col(inner["_id"]).eqNullSafe(d["_id"]) & (F.col(inner["_raw"]) == d["_raw"])
    gone, again = marked.filter("NOT _stays").select(*key), marked.filter("_stays AND n > 1").select(*key)
    kept = keyed.join(narrow_side(gone, gone.count()), same(gone), "left_anti")
    repeats = again.count()
    if repeats:
        again = narrow_side(again, repeats)
        once = kept.join(again, same(again), "left_anti")
        kept = once.unionByName(kept.join(again, same(again), "left_semi").dropDuplicates(list(inner.values())))
    return kept.select(*docs.columns)
