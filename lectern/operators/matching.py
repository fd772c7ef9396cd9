"""One-to-one matching of ground truth and predicted records within each paper."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.binding import bound
from lectern.functions.similarity import CONTEXT, pair_parts, with_pair_similarity

FLOOR = 0.5
_PAIRS = "paper_id string, gt_idx long, pred_idx long, sim double"


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost; shortest augmenting paths, O(n^3)."""
    n = len(cost)
    u, v, of = np.zeros(n), np.zeros(n), np.full(n, -1)
    for i in range(n):
        dist, from_row, done = cost[i] - u[i] - v, np.full(n, i), np.zeros(n, bool)
        prior = np.full(n, -1)
        seen_rows = [(i, 0.0)]
        while True:
            open_ = np.where(done, np.inf, dist)
            j = int(open_.argmin())
            reach = float(open_[j])
            done[j] = True
            if of[j] < 0:
                break
            row = int(of[j])
            seen_rows.append((row, reach))
            through = reach + cost[row] - u[row] - v
            better = ~done & (through < dist)
            dist[better], from_row[better], prior[better] = through[better], row, j
        for row, at in seen_rows:
            u[row] += reach - at
        inside = done & (np.arange(n) != j)
        v[inside] -= reach - dist[inside]
        while j >= 0:
            of[j] = from_row[j]
            j = int(prior[j])
    out = np.full(n, -1)
    out[of] = np.arange(n)
    return out


def _evident(table: np.ndarray) -> np.ndarray | None:
    """Column of each row where the best columns of all rows are single and differ, which makes them the one best assignment; else None."""
    to = table.argmax(1)
    if len(table) > table.shape[1] or len(np.unique(to)) < len(to):
        return None
    best = table[np.arange(len(to)), to]
    return to if ((table == best[:, None]).sum(1) == 1).all() else None


def _matched(g: np.ndarray, p: np.ndarray, sim: np.ndarray, optimal: bool) -> list[tuple[int, int, float]]:
    """Pairs (record, prediction, similarity) of one paper, none under the floor."""
    gt, rows = np.unique(g, return_inverse=True)
    pred, columns = np.unique(p, return_inverse=True)
    if not optimal:
        free_g, free_p, out = np.ones(len(gt), bool), np.ones(len(pred), bool), []
        for k in np.lexsort((p, g, -sim)):
            if sim[k] < FLOOR:
                break
            if free_g[rows[k]] and free_p[columns[k]]:
                out.append((g[k], p[k], sim[k]))
                free_g[rows[k]] = free_p[columns[k]] = False
        return out
    table = np.zeros((len(gt), len(pred)))
    table[rows, columns] = sim
    to = _evident(table)
    if to is None and (back := _evident(table.T)) is not None:
        to = np.full(len(gt), len(pred))
        to[back] = np.arange(len(pred))
    if to is None:
        n = max(table.shape)
        cost = np.zeros((n, n))
        cost[: len(gt), : len(pred)] = 1 - table
        to = assignment(cost)[: len(gt)]
    return [(gt[i], pred[j], table[i, j]) for i, j in enumerate(to) if j < len(pred) and table[i, j] >= FLOOR]


def best_pairs(sims: pd.DataFrame, optimal: bool = True) -> list[tuple[int, int, float]]:
    """(gt_idx, pred_idx, sim) pairs of one paper, none under the floor."""
    return _matched(*(sims[c].to_numpy() for c in ("gt_idx", "pred_idx", "sim")), optimal)


def _by_paper(batches: Iterator[pa.RecordBatch], optimal: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of every paper from rows in the order of papers; a paper may lie in several batches."""
    held: list[pa.RecordBatch] = []

    def paired(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        codes = table["paper_id"].combine_chunks().dictionary_encode()
        at = codes.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(at)) + 1
        g, p, sim = (table[c].to_numpy() for c in ("gt_idx", "pred_idx", "sim"))
        out: list[list] = [[], [], [], []]
        for low, high in zip([0, *cuts], [*cuts, len(at)], strict=True):
            for a, b, s in _matched(g[low:high], p[low:high], sim[low:high], optimal):
                for column, value in zip(out, (at[low], a, b, s), strict=True):
                    column.append(value)
        names = codes.dictionary.take(pa.array(out[0], pa.int64()))
        return pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], names=["paper_id", "gt_idx", "pred_idx", "sim"])

    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch["paper_id"][batch.num_rows - 1]
        start = batch.num_rows - 1
        while start and batch["paper_id"][start - 1] == last:
            start -= 1
        if start or (held and held[-1]["paper_id"][held[-1].num_rows - 1] != batch["paper_id"][0]):
            whole = pa.Table.from_batches([*held, batch.slice(0, start)])
            if whole.num_rows:
                yield paired(whole)
            held = []
        held.append(batch.slice(start))
    if held:
        yield paired(pa.Table.from_batches(held))


def match_records(gt: DataFrame, pred: DataFrame, context: tuple[str, ...] | None = None, optimal: bool = True) -> DataFrame:
    """paper_id, gt_idx, pred_idx, sim of matched records; both inputs have paper_id, ab_idx, Antibody_Name.

    Names are compared together with the context fields that both inputs have
    (or those given).  All records of a paper are assigned at once, since a
    pair of equal names can stand in the way of two good pairs.  A paper's
    records, not the corpus, bound a group.
    """
    if context is None:
        context = tuple(f for f in CONTEXT if f in gt.columns and f in pred.columns)
    fields = ("Antibody_Name", *context)
    side = lambda d, idx, mark: bound(d, **pair_parts({f: F.col(f) for f in fields}, mark)).select("paper_id", F.col("ab_idx").alias(idx), *[mark + f for f in fields])
    pairs = side(gt, "gt_idx", "g_").join(side(pred, "pred_idx", "p_"), "paper_id")
    sims = with_pair_similarity(pairs, "g_", "p_", context).select("paper_id", "gt_idx", "pred_idx", "sim")

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_paper(batches, optimal)

    ordered = sims.select(F.col("paper_id").cast("string").alias("paper_id"), F.col("gt_idx").cast("long").alias("gt_idx"), F.col("pred_idx").cast("long").alias("pred_idx"), "sim")
    return ordered.filter("paper_id IS NOT NULL").repartition("paper_id").sortWithinPartitions("paper_id").mapInArrow(assigned, _PAIRS)


def long_pairs(gt: DataFrame, pred: DataFrame, pairs: DataFrame, fields: list[str]) -> DataFrame:
    """One row a ground-truth record and field: paper_id, ab_idx, field, gt, pred, matched."""
    wide = gt.alias("g").join(pairs.select("paper_id", F.col("gt_idx").alias("ab_idx"), "pred_idx"), ["paper_id", "ab_idx"], "left")
    wide = wide.join(pred.select("paper_id", F.col("ab_idx").alias("pred_idx"), *[F.col(f).alias(f"p_{f}") for f in fields]), ["paper_id", "pred_idx"], "left")
    each = F.array(*[F.struct(F.lit(f).alias("field"), text.clean(F.col(f)).alias("gt"), text.clean(F.col(f"p_{f}")).alias("pred")) for f in fields])
    return wide.select("paper_id", "ab_idx", F.col("pred_idx").isNotNull().alias("matched"), F.explode(each).alias("x")).select("paper_id", "ab_idx", "x.*", "matched")


def unmatched(records: DataFrame, pairs: DataFrame, idx: str) -> DataFrame:
    """Records that no pair holds; idx is gt_idx or pred_idx."""
    return records.join(pairs.select("paper_id", F.col(idx).alias("ab_idx")), ["paper_id", "ab_idx"], "left_anti")


def nth_occurrence_join(left: DataFrame, right: DataFrame, by: list[str], order: str) -> DataFrame:
    """The k-th row of each key on the left with the k-th on the right; past the end the last serves again."""
    w = Window.partitionBy(*by).orderBy(order)
    right = right.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    sizes = right.groupBy(*by).agg(F.max("_n").alias("_size"))
    left = left.withColumn("_i", F.row_number().over(w)).join(sizes, by, "left").withColumn("_k", F.least("_i", "_size"))
    right = right.select(*by, "_k", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in (*by, "_k", "_n")])
    return left.join(right, [*by, "_k"], "left").drop("_i", "_k", "_size")
