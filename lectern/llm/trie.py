"""Prefix trie of conversations: levels from the root down by grouping, roll-ups from the leaves up by joins.

Texts are read once and leave as digests.  Conversations whose turns are all
equal are one class; a class that is alone below a node leaves the levels, as
the rest of its path is a chain.  So there are as many levels as two different
conversations have first turns in common, however long they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, dealt_join, discard, materialise, shared_folder

#: Conversations that share the first turns of their least one, and how many of these turns at most.
FAMILY, HEAD = 100, 5
#: Ids of a piece of a list of ids, and turns of a block of running sums.
PIECE, BLOCK = 512, 256
LANES = ["l0", "l1", "l2", "l3"]
KEY = ["n", *LANES]
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from one), digest, chars: turns in order, nulls first; of equal turn numbers the one with the lesser digest first.

    The order is that of ranges over all rows, so a conversation of any length
    is dealt over tasks.  Rows without a conv_id go.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = ["conv_id", "turn", "digest"]
    rows = turns.filter("conv_id IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("part", F.shiftright("at", 33)), "trie-turns")
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that a conversation is dealt to
    runs = runs.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "digest", "chars")


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their family's first one: (conv_id, n) and turns (conv_id, depth, digest, chars).

    h = crc32 of the id's decimal text, modulo 6: the first h turns come from
    the conversation whose id ends the hundred (fewer if it has fewer, none if
    it is absent), the others are the own turns after the first h.
    """
    sizes = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "trie-own")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEAD + 1))
    convs = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    firsts = sizes.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    convs = convs.join(firsts, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    convs = materialise(convs.select("conv_id", "base", "own", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "trie-convs")
    total = convs.agg(F.sum("own")).first()[0] or 0
    after = dealt_join(turns, convs.select("conv_id", "h", "taken"), "conv_id", sizes.select("conv_id", F.col("own").alias("n")), total)
    own = after.filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars")
    head = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= HEAD)).withColumnRenamed("conv_id", "base")
    taken = convs.select("conv_id", "base", "taken").join(head, "base").filter("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    return convs.select("conv_id", "n"), materialise(own.unionByName(taken), "trie-rebuilt")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one class as texts of at most PIECE ids, from rows in the order of class and id."""
    names, key, ids, out = [*KEY, "first", "size", "ids"], None, [], []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

    for batch in batches:
        *keys, convs = (batch[c].to_pylist() for c in [*KEY, "conv_id"])
        for *k, c in zip(*keys, convs, strict=True):
            if ids and (k != key or len(ids) == PIECE):
                out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(c)
        if out:
            yield packed()
            out = []
    if ids:
        out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
        yield packed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's least id, size and digest of all its ids, from pieces in the order of class and id, one piece at a time."""
    key, state, least, size = None, None, 0, 0

    def done() -> dict[str, pa.Array]:
        return {"conv_id": least, "n": key[0], "weight": size, "ends": state.hexdigest()}

    for batch in batches:
        *keys, firsts, sizes = (batch[c].to_pylist() for c in [*KEY, "first", "size"])
        out = []
        for *k, first, n, ids in zip(*keys, firsts, sizes, batch["ids"], strict=True):
            if k != key:
                if key is not None:
                    out.append(done())
                key, state, least, size = k, hashlib.sha256(), first, 0
            elif size:
                state.update(b",")
            state.update(ids.as_buffer())
            size += n
        if out:
            yield pa.RecordBatch.from_pylist(out)
    if key is not None:
        yield pa.RecordBatch.from_pylist([done()])


def classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, n, weight, ends of each class of conversations with equal turns: its least id, turns, size and digest of its ids (and the root's edge).

    A conversation's turns are known by four sums of 64 bits over the digests
    and places of its turns.  Ids meet in order by ranges, as pieces of texts;
    a digest reads the pieces of its class one by one, since a hash of a text
    is made from its start to its end.
    """
    sums = turns.groupBy("conv_id").agg(*[F.bit_xor(F.xxhash64("digest", "depth", F.lit(k))).alias(lane) for k, lane in enumerate(LANES)])
    known = convs.join(sums, "conv_id", "left").select("conv_id", "n", *[F.coalesce(lane, F.lit(0)).alias(lane) for lane in LANES])
    longs = ", ".join(f"{c} long" for c in KEY)
    pieces = known.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_pieces, f"{longs}, first long, size long, ids string")
    met = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    found = met.mapInArrow(_hashed, "conv_id long, n long, weight long, ends string")
    # the root's edge is written, since a join by a literal would be one without a key
    return materialise(found.withColumn("edge", F.unhex(F.lit("00"))), "trie-classes")


def _group_by_turn(live: DataFrame) -> DataFrame:
    """A level's nodes from its classes (conv_id, weight, edge, parent, chars): the least id, members and classes of each edge."""
    return live.groupBy("edge").agg(
        F.min("conv_id").alias("node"), F.first("parent").alias("parent"), F.sum("weight").alias("n_convs"), F.count("*").alias("n"), F.first("chars").alias("chars"),
    )


def _suffix_sums(rows: DataFrame) -> DataFrame:
    """rows (conv_id, depth, v, ...) with s, the sum of v from a row's depth on; blocks of depths are summed first, then the rows in each."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("v").alias("b")).select("conv_id", "block", F.coalesce(F.sum("b").over(later), F.lit(0)).alias("later"))
    within = F.sum("v").over(Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", within).join(blocks, ["conv_id", "block"]).withColumn("s", F.col("within") + F.col("later")).drop("block", "later", "within")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row a node of the trie.

    conversations (conv_id, turn, role, text): null roles and texts are empty,
    rows without a conv_id go, repeated rows are repeated turns, further
    columns are ignored.  A node is a distinct sequence of first turns of the
    conversations rebuilt by shared_heads(); (depth, conv_id) names it.  An
    empty table gives an empty result, without a root.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    convs, turns = shared_heads(materialise(numbered_turns(conversations), "trie-numbered"))
    found = classes(convs, turns)
    total = convs.agg(F.sum("n")).first()[0]
    if total is None:
        return spark.createDataFrame([], NODE)
    of_class = materialise(dealt_join(turns, found.select("conv_id"), "conv_id", convs, total).repartition("depth", "conv_id").sortWithinPartitions("depth"), "trie-paths")
    levels, ended, rolled = (shared_folder(spark, f"trie-{x}") for x in ("levels", "ended", "rolled"))

    # down: the classes below each node meet by their next turn
    live = found.select("conv_id", "n", "weight", "ends", "edge", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("chars"))
    depth, last = 0, -1
    while True:
        nodes = _group_by_turn(live)
        nodes.write.parquet(f"{levels}/depth={depth}")
        nodes = spark.read.parquet(f"{levels}/depth={depth}")
        shared = nodes.filter("n > 1")
        count = shared.agg(F.sum("n")).first()[0]
        if not count:
            break
        last = depth
        below = dealt_join(live.select("conv_id", "weight", F.col("n").alias("length"), "ends", "edge"), shared.select("edge", "node"), "edge", shared.select("edge", "n"), count)
        below = materialise(below.select("conv_id", "weight", "length", "ends", "node"), "trie-live")
        below.filter(F.col("length") == depth).select("node", "ends").write.parquet(f"{ended}/depth={depth}")
        if depth:
            discard(spark, live)
        depth += 1
        following = of_class.filter(F.col("depth") == depth).select("conv_id", "digest", "chars")
        edge = F.concat(F.col("digest"), F.unhex(F.lpad(F.hex("node"), 16, "0")))
        live = below.join(following, "conv_id").select("conv_id", F.col("length").alias("n"), "weight", "ends", edge.alias("edge"), F.col("node").alias("parent"), "chars")
        live = materialise(live, "trie-live")
        discard(spark, below)

    every = spark.read.schema("edge binary, node long, parent long, n_convs long, n long, chars long, depth int").parquet(levels)
    # classes alone below a node: the rest of their paths
    alone = every.filter("n = 1").select(F.col("node").alias("conv_id"), F.col("depth").alias("top"), "parent", F.col("n_convs").alias("weight"))
    alone = materialise(alone.join(found.select("conv_id", "n", "ends"), "conv_id"), "trie-alone")
    paths = dealt_join(of_class, alone, "conv_id", convs, total).filter("depth >= top").select("conv_id", "depth", "chars", "top", "parent", "weight", F.col("n").alias("length"), "ends")
    tops = alone.filter("top = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "top", "parent", "weight", F.col("n").alias("length"), "ends")
    paths = materialise(paths.unionByName(tops).withColumn("v", (F.col("weight") - 1) * F.col("chars")), "trie-chains")
    chains = paths.filter("weight = 1").withColumn("s", F.lit(0).cast("long")).unionByName(_suffix_sums(paths.filter("weight > 1")))
    chains = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("s").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"),
    )

    # up: what the children of a node have, and the node's own
    sums = materialise(paths.groupBy("top", "parent").agg(F.countDistinct("conv_id").alias("n_children"), F.sum("v").alias("saved_tokens")), "trie-tops")
    for depth in range(last, -1, -1):
        kids = sums.filter(F.col("top") == depth + 1).select("parent", "n_children", F.col("n_children").alias("n_leaves"), "saved_tokens")
        if depth < last:
            above = spark.read.parquet(f"{rolled}/depth={depth + 1}")
            kids = kids.unionByName(above.select(F.col("parent_conv_id").alias("parent"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens"))
        kids = kids.groupBy("parent").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]).withColumnRenamed("parent", "node")
        here = spark.read.parquet(f"{levels}/depth={depth}").filter("n > 1").join(kids, "node").join(spark.read.parquet(f"{ended}/depth={depth}"), "node", "left")
        here.select(
            F.col("node").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        ).write.parquet(f"{rolled}/depth={depth}")
    if last < 0:
        return chains.select(*_names(NODE))
    above = spark.read.schema("conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, depth int").parquet(rolled)
    return above.withColumn("depth", F.col("depth").cast("long")).select(*_names(NODE)).unionByName(chains.select(*_names(NODE)))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
