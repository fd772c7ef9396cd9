"""Balanced label propagation: linked documents gather in one shard, sizes stay even.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialise

ROUNDS = 16
#: Blocks in which rows of a shard are numbered; a row's number is its block's offset plus its place in it.
BLOCKS = 4096
UNIT = float(1 << 30)
#: Share by which a shard may pass its capacity between rounds, and how many rows of a group are numbered side by side:
#: evening the counts moves such runs, so larger ones cut fewer links, and smaller ones keep the rows of a task fewer.
SLACK, TOGETHER = 0.05, 1000


def _chance(*of: Column) -> Column:
    """A number from 0 to 1 that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / F.lit(UNIT)


def _offsets(sizes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Running sum of n before each row, within by; sizes has BLOCKS rows a shard at most."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def propagate(units: DataFrame, capacity: float, rounds: int = ROUNDS) -> DataFrame:
    """units (key, home, n: linked rows of one group that began in shard home, g: rows of the group) with the shard each ends in.

    In each round every group votes for the shard that has room and holds most
    of its rows, and its units that are in shards with fewer of them ask to
    move there; so a group that fills one shard gathers in a second, and so on.
    A shard takes as many rows as its quota (capacity and a little, less the
    linked rows it holds, and as many as ask to leave it); with more asking, a
    share chosen by hash is let in, and who is refused asks again.  Groups ask
    as one and so are let in as one, but for those larger than a shard, whose
    units ask by themselves.  It ends when no unit asks, or after `rounds`.
    Only tables of sums by shard, of one row a shard, are broadcast.
    """
    spark = units.sparkSession
    limit = capacity * (1 + SLACK)
    state = units.withColumn("shard", F.col("home"))
    for turn in range(rounds):
        # the state before a round serves several reads, so each round's is written once
        load = {r["shard"]: r["load"] for r in state.groupBy("shard").agg(F.sum("n").alias("load")).collect()}  # one row a shard
        full = [k for k, n in load.items() if n >= limit]
        at = state.groupBy("key", "shard").agg(F.sum("n").alias("m")).withColumn("rank", F.struct("m", F.xxhash64("key", "shard")))
        best = at.filter(~F.col("shard").isin(full)).groupBy("key").agg(F.max(F.struct("rank", "shard")).alias("best")) if full else at.groupBy("key").agg(F.max(F.struct("rank", "shard")).alias("best"))
        at = at.join(best, "key").select("key", "shard", F.col("best.shard").alias("to"), (F.col("best.rank") > F.col("rank")).alias("asks")).filter("asks")
        asked = state.join(at, ["key", "shard"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        moves = {(r["shard"], r["to"]): r["m"] for r in asked.filter("asks").groupBy("shard", "to").agg(F.sum("n").alias("m")).collect()}  # shards x shards rows
        if not moves:
            break
        quota = []
        for to in {t for _, t in moves}:
            leaving, wanted = sum(m for (a, _), m in moves.items() if a == to), sum(m for (_, t), m in moves.items() if t == to)
            quota.append((to, (limit - load.get(to, 0) + leaving) / wanted))
        quota = spark.createDataFrame(quota, "to int, open double")
        draw = F.when(F.col("g") > F.lit(float(capacity)), _chance(F.col("key"), F.col("home"), F.lit(turn))).otherwise(_chance(F.col("key"), F.lit(turn)))
        moved = asked.join(F.broadcast(quota), "to", "left").select(
            "key", "home", "n", "g", F.when(F.col("asks") & (draw < F.col("open")), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        after = materialise(moved, "shards")
        if turn:
            discard(spark, state)
        state = after
    return state


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Documents with equal texts (null as empty) are linked.  Rows begin in a
    shard drawn by hash of the id, label propagation gathers linked rows under
    capacity quotas, and a last step makes the counts exact: each shard is to
    hold rows/shards, one more in the first few; rows past that number move to
    the shards that are short.  A shard's unlinked rows are numbered last, so
    these move first and cut no link.

    law is `rows`: counts differ by one at most.  slot runs from 0 without
    gaps within each shard; grown_shard is null under this law.  Null ids,
    repeated rows and empty texts are rows like others; an empty table gives
    an empty result.

    Numbering needs no global or per-shard sort: rows are counted by (shard,
    block), the block's offset is a running sum over those few counts, and
    only the rows of one block are sorted together.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("key"),
    ).withColumn("home", F.pmod(F.xxhash64(F.lit("home"), "doc_id", "key"), F.lit(shards)).cast("int"))
    rows = materialise(rows, "rows")
    total = rows.count()
    units = rows.groupBy("key", "home").agg(F.count("*").alias("n"))
    linked = units.groupBy("key").agg(F.sum("n").alias("g")).filter("g > 1")
    units = materialise(units.join(linked, "key"), "units")
    placed = propagate(units, total / shards, rounds)

    # a group is numbered in runs of about TOGETHER rows, so that the step that evens counts cuts few
    run = F.pmod(F.xxhash64("doc_id"), F.ceil(F.coalesce("g", F.lit(1)) / TOGETHER).cast("long"))
    block = F.pmod(F.xxhash64(F.lit("block"), "key", run), F.lit(BLOCKS)).cast("int")
    now = (
        rows.join(placed.select("key", "home", "g", F.col("shard").alias("went")), ["key", "home"], "left")
        .select("doc_id", "size", "text_crc32", "key", F.coalesce("went", "home").alias("shard"), F.col("went").isNull().alias("alone"), block.alias("block"))
    )
    now = materialise(now, "now")
    sizes = now.groupBy("shard", "alone", "block").agg(F.count("*").alias("n"))
    offsets = _offsets(sizes, ["shard"], ["alone", "block"]).drop("n")
    within = Window.partitionBy("shard", "alone", "block").orderBy("key", "doc_id")
    numbered = now.withColumn("_r", F.row_number().over(within)).join(offsets, ["shard", "alone", "block"]).withColumn("place", F.col("_before") + F.col("_r") - 1)

    # One row a shard comes to the driver: what it has, is to have, gives up and lacks.
    have = dict.fromkeys(range(shards), 0) | {r["shard"]: r["have"] for r in sizes.groupBy("shard").agg(F.sum("n").alias("have")).collect()}
    plan, over, lack = [], 0, 0
    for k in range(shards):
        goal = total // shards + (k < total % shards)
        plan.append({"shard": k, "have": have[k], "goal": goal, "over_before": over, "lack_before": lack, "lack": max(0, goal - have[k])})
        over, lack = over + max(0, have[k] - goal), lack + plan[-1]["lack"]
    goal_of = F.element_at(F.create_map(*[F.lit(x) for r in plan for x in (r["shard"], r["goal"])]), F.col("shard"))
    over_of = F.element_at(F.create_map(*[F.lit(x) for r in plan for x in (r["shard"], r["over_before"])]), F.col("shard"))
    turn = over_of + F.col("place") - goal_of  # number of a surplus row over all shards
    to, slot = F.col("shard"), F.col("place")
    for r in plan:
        if r["lack"]:
            here = (F.col("place") >= goal_of) & (turn >= r["lack_before"]) & (turn < r["lack_before"] + r["lack"])
            to, slot = F.when(here, F.lit(r["shard"])).otherwise(to), F.when(here, turn - r["lack_before"] + r["have"]).otherwise(slot)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
