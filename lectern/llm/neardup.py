"""Near-dedup by exact Jaccard similarity of word shingles; candidates come from balls around SimHash fingerprints and from bands of MinHash values.

A set is known by 64 bits of a hash of it: among N distinct sets some
N * N / 2^65 pairs share a name (one in 10^9 sets is 0.03 pairs).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import bounded_batches, counted, dealt_join, materialise, materialise_told, narrow_side, salted_join
from lectern.llm.components import components
from lectern.llm.simhash import BITS, ball_links, bit_counts, majority
from lectern.llm.words import give_back, shingle_sets

WIDTH = 5
#: Hundredths of two sets' union that they share.
PERCENT = 80
#: MinHash values of a set, and the bands drawn from them, each of ROWS values: at a similarity of 0.8 two sets share
#: ROWS given values with a chance of 0.17, and none of the bands with one of some 4 in 100,000; at 0.4 a band in 1,500.
VALUES, BANDS, ROWS = 256, 64, 8
#: Standard errors of the estimate from all values by which a pair may miss the similarity before its sets are not compared.
ERRORS = 5.0
#: Bands of each pass of leaders: most near copies are joined by the first few, and need no comparison in the others.
PASSES = [(0, 8), (8, BANDS)]
_RNG = np.random.default_rng(42)
_ODD = _RNG.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, VALUES, np.uint64)
_PICK = np.stack([_RNG.permutation(VALUES)[:ROWS] for _ in range(BANDS)])
_FOLD = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
PRINTED = T.StructType([*SKETCH, T.StructField("fp", T.LongType())])
SET = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.BinaryType())])


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of a set under each of VALUES permutations, mixed."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        h = values[i : i + 1024]
        least = np.minimum(least, (_ODD[:, None] * (h ^ (h >> np.uint64(32))) + _ADD[:, None]).min(1))
    least ^= least >> np.uint64(29)
    least *= np.uint64(0xBF58476D1CE4E5B9)
    return least ^ (least >> np.uint64(32))


def bands(least: np.ndarray) -> np.ndarray:
    """A hash of the minima of each band."""
    folded = (least[_PICK] * _FOLD).sum(1, dtype=np.uint64)
    return (folded ^ (folded >> np.uint64(31))).view(np.int64)


def node_of(values: np.ndarray) -> int:
    """A set's name: 64 bits of a hash of it, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes(), 7)).view(np.int64))


def print_of(values: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles, each counted once, as a signed long; zero for none."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(values), 1 << 16):
        total += bit_counts(values[i : i + (1 << 16)])
    return majority(total, len(values))


def _sketched(text: Column, width: int, prints: bool) -> Column:
    schema = PRINTED if prints else SKETCH

    @F.pandas_udf(schema)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for s in shingle_sets(texts.tolist(), width):  # one set at a time is held
                least = minima(s)
                out.append((node_of(s), len(s), (least & np.uint64(255)).astype(np.uint8).tobytes(), bands(least), *([print_of(s)] if prints else [])))
            yield pd.DataFrame(out, columns=schema.names)
            give_back()

    return of(text)


def _set(text: Column, width: int) -> Column:
    @F.pandas_udf(SET)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([(node_of(s), s.tobytes()) for s in shingle_sets(texts.tolist(), width)], columns=["node", "shingles"])
            give_back()

    return of(text)


def _estimate(a: Column, b: Column) -> Column:
    """Similarity as two sketches tell it, in expectation: the share of equal bytes, less those that chance makes equal."""

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, VALUES) for c in (left, right))
            yield pd.Series(((x == y).mean(1) - 1 / 256) / (1 - 1 / 256))

    return of(a, b)


def _similar(a: Column, b: Column, percent: int) -> Column:
    """Whether two sets share at least so many hundredths of their union, in whole numbers."""

    @F.pandas_udf("boolean")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                out.append(100 * common >= percent * (len(both) - common))
            yield pd.Series(out, dtype="bool")
            give_back()

    return of(a, b)


def _near(pairs: DataFrame, count: int, sketches: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v), `count` rows, whose sets are at least so similar.

    Sketches of 256 bytes meet first and leave the pairs that may be; only
    these pairs' texts are read again, and their sets compared.  A node can
    stand in any share of the pairs, so the joins are salted.
    """
    at = percent / 100
    least = at - ERRORS * (at * (1 - at) / VALUES) ** 0.5

    def both(rows: DataFrame, total: int, of: DataFrame, c: str) -> DataFrame:
        for n in "uv":
            rows = salted_join(rows, of.select(F.col("node").alias(n), F.col(c).alias(f"{c}_{n}")), n, pairs.groupBy(n).agg(F.count("*").alias("n")), total)
        return rows

    met = both(pairs, count, sketches, "sketch")
    able, n_able = counted(met.filter(_estimate(F.col("sketch_u"), F.col("sketch_v")) >= least).select("u", "v"), "near-able")
    if not n_able:
        return able
    pairs = able
    nodes = able.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = _sets_of(docs, sketches.select("node", "least").join(nodes, "node", "left_semi"), width)
    return materialise(both(able, n_able, sets, "shingles").filter(_similar(F.col("shingles_u"), F.col("shingles_v"), percent)).select("u", "v"), "near-links")


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, shingles of nodes (node, least), read again from one row of docs (doc_id, text) that has the node's least id.

    Rows may share an id, so what is read counts only under its own node.
    """
    nodes, n = counted(nodes, "near-wanted")
    ids = nodes.select(F.col("least").alias("_id")).distinct()
    some = docs.join(narrow_side(ids, n), docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    # written before it is joined: the optimizer would move a test of the join's key, and with it the sets, before the choice of rows
    read = materialise(some.select(_set(F.col("text"), width).alias("s")).select("s.*"), "near-read")
    return materialise(read.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")


DELTA = T.StructType([T.StructField("common", T.IntegerType()), T.StructField("delta", T.ArrayType(T.LongType()))])


def _delta(own: Column, pivot: Column) -> Column:
    """How many shingles two sets share, and those that one of them has alone."""

    @F.pandas_udf(DELTA)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                a, b = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                alone = np.setxor1d(a, b, assume_unique=True)
                out.append(((len(a) + len(b) - len(alone)) // 2, alone))
            yield pd.DataFrame(out, columns=["common", "delta"])
            give_back()

    return of(own, pivot)


def _delta_links(groups: DataFrame, count: int, sketches: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) that join all nodes of a group which are similar enough: groups (pivot, node, c), `count` rows, of nodes with their labels.

    Every set is compared with its group's pivot p.  Of what x and v share,
    p's part is common(x) + common(v) - |p| at least, and the rest are
    shingles by which both differ from p.  So a pair needs so many of these
    in common, `need`; if it needs none, both are linked to p.  The other pairs
    share one among the first of their differences, in an order of rising
    frequency, and where they first do, enough must be left behind it.  Pairs
    of one label, or both linked to p, need no comparison.  What many members
    of a group differ by stands last in the order, so a group costs about its
    differences and not its pairs.
    """
    nodes = groups.select("node").unionByName(groups.select(F.col("pivot").alias("node"))).distinct()
    sets = _sets_of(docs, sketches.select("node", "least").join(nodes, "node", "left_semi"), width)
    n = F.length("shingles") / 8
    own = groups.join(sets.select("node", "shingles", n.cast("int").alias("n")), "node")
    sizes = groups.groupBy("pivot").agg(F.count("*").alias("n"))
    pivots = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("base"), n.cast("int").alias("np"))
    met = salted_join(own, pivots, "pivot", sizes, count).withColumn("d", _delta(F.col("shingles"), F.col("base")))
    d = materialise(met.select("pivot", "node", "c", "n", "np", F.col("d.common").alias("m"), F.col("d.delta").alias("delta")), "near-deltas")
    near = F.col("m") * 100 >= percent * (F.col("n") + F.col("np") - F.col("m"))
    d = d.filter("node <> pivot").withColumn("near", near)
    to_pivot = d.filter("near").select(F.least("pivot", "node").alias("u"), F.greatest("pivot", "node").alias("v"))
    whole = 100 + percent
    best = d.groupBy("pivot").agg(F.max(F.col("m") * whole - F.col("n") * percent).alias("best"), F.max((~F.col("near")).cast("int")).alias("open")).filter("open = 1")
    least = F.ceil((F.col("n") * percent - whole * (F.col("m") - F.col("np")) - F.col("best")) / F.lit(float(whole)) - 1e-9)
    d = d.join(best, "pivot").withColumn("first", F.size("delta") - F.greatest(least, F.lit(1)) + 1).filter("first > 0")
    each = d.select("pivot", "node", F.explode("delta").alias("e")).withColumn("key", F.xxhash64("pivot", "e"))
    df, told = materialise_told(each.groupBy("key").agg(F.count("*").alias("n")), "near-frequencies", rows=F.sum(F.when(F.col("n") > 1, F.col("n"))))
    shared = df.filter("n > 1")
    ordered = dealt_join(each.select("key", "pivot", "node"), shared.withColumnRenamed("n", "f"), "key", shared, told["rows"] or 0)
    # what no other member differs by comes first and meets nothing
    ordered = ordered.groupBy("pivot", "node").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("keys"))
    rows = d.join(ordered, ["pivot", "node"]).withColumn("alone", F.size("delta") - F.size("keys"))
    rows = rows.select("node", "c", "n", "np", "m", "near", "first", F.size("delta").alias("all"), "alone", F.posexplode("keys").alias("at", "k")).withColumn("at", F.col("at") + F.col("alone")).filter("at < first")
    rows, n_rows = counted(rows.select("node", "c", "n", "np", "m", "near", (F.col("all") - F.col("at")).alias("left"), F.col("k.key").alias("key")), "near-prefixes")
    probes = rows.filter("NOT near").select("key", *[F.col(x).alias(f"{x}_") for x in ("node", "c", "n", "m", "left")])
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    pairs = salted_join(rows, probes, "key", sizes, n_rows)
    need = F.ceil(percent * (F.col("n") + F.col("n_")) / F.lit(float(whole)) - 1e-9) + F.col("np") - F.col("m") - F.col("m_")
    able = (F.col("c") != F.col("c_")) & (F.col("near") | (F.col("node") < F.col("node_"))) & (F.least("n", "n_") * 100 >= F.greatest("n", "n_") * percent) & (F.least("left", "left_") >= need)
    pairs = pairs.filter(able).select(F.least("node", "node_").alias("u"), F.greatest("node", "node_").alias("v")).distinct()
    pairs, n_pairs = counted(pairs, "near-pairs")
    if not n_pairs:
        return to_pivot
    found = _near(pairs, n_pairs, sketches, docs, width, percent)
    return found.unionByName(to_pivot)


def _ball_pairs(sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes (node, n, fp) whose fingerprints are within two bits and whose sizes allow the similarity.

    Nodes of one fingerprint meet its least node, and the least nodes of two
    fingerprints meet where ball_links() links these; so pairs grow with the
    nodes, and what a pair that fails its check keeps apart is left to the bands.
    """
    prints, told = materialise_told(sketches.groupBy("fp").agg(F.min_by(F.struct("node", "n"), "node").alias("lead"), F.count("*").alias("m")), "near-prints", rows=F.sum(F.when(F.col("m") > 1, F.col("m"))))
    several = prints.filter("m > 1")
    of_one = dealt_join(sketches.select("fp", "node", "n"), several.select("fp", "lead"), "fp", several.select("fp", F.col("m").alias("n")), told["rows"] or 0)
    of_one = of_one.select("lead", F.struct("node", "n").alias("other"))
    links, n = counted(ball_links(prints.select("fp")), "near-balls")
    first = prints.select(F.col("fp").alias("u"), "lead").join(narrow_side(links, n), "u").select("v", "lead")
    of_two = prints.select(F.col("fp").alias("v"), F.col("lead").alias("other")).join(narrow_side(first, n), "v").select("lead", "other")
    able = F.least("lead.n", "other.n") * 100 >= F.greatest("lead.n", "other.n") * percent
    pairs = of_one.unionByName(of_two).filter((F.col("lead.node") != F.col("other.node")) & able)
    return pairs.select(F.least("lead.node", "other.node").alias("u"), F.greatest("lead.node", "other.node").alias("v"))


def near_components(sketches: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """node, component of all nodes that a verified link joins to another: those which share a band and are at least so similar.

    sketches (node, least, n, sketch, bands) has one row a distinct set, docs
    (doc_id, text) the rows they come from.  Where sketches have fingerprints
    (fp) too, nodes in each other's balls are compared first.  In each pass over some bands one
    or two members of a bucket lead: its least node and one that a hash draws.
    They are compared with the members of other components; a bucket of one
    component is done.  After the last pass the members of a bucket that is
    not are compared by their differences from one of them, see _delta_links().
    So a large group of near copies costs about its size, and no pair of a
    bucket stays unknown unless both are in one component already.
    """
    spark = sketches.sparkSession
    named, n_named, left, done = None, 0, [], None
    # what is joined already counts as links to the component's least node
    of_links = lambda links: components(links if named is None else links.unionByName(named.select(F.col("component").alias("u"), F.col("node").alias("v"))))
    label = lambda rows: rows.withColumn("c", F.col("node")) if named is None else rows.join(narrow_side(named, n_named), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    balls = _ball_pairs(sketches, percent) if "fp" in sketches.columns else None
    for low, high in PASSES:
        members = label(sketches.select("node", "n", F.explode(F.slice("bands", low + 1, high - low)).alias("bucket")))
        mixed = members.groupBy("bucket").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high"), F.min("node").alias("head"))
        mixed, told = materialise_told(mixed.filter("low <> high").select("bucket", "m", "head"), "near-mixed", total=F.sum("m"))
        total = told["total"] or 0
        if not total and balls is None:
            continue
        sizes = mixed.select("bucket", F.col("m").alias("n"))
        of_mixed = dealt_join(members, mixed, "bucket", sizes, total)
        draw = F.pmod(F.xxhash64("node", F.lit("lead")), F.lit(1 << 30)) / float(1 << 30)
        of_mixed = materialise(of_mixed.withColumn("leads", (F.col("node") == F.col("head")) | (draw * F.col("m") < 1)), "near-members")
        leaders = of_mixed.filter("leads").select("bucket", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("c").alias("cu"))
        met = salted_join(of_mixed.select("bucket", "node", "n", "c", "leads"), leaders, "bucket", sizes, total).filter("c <> cu AND (NOT leads OR u < node)")
        pairs = met.filter(F.least("n", "nu") * 100 >= F.greatest("n", "nu") * percent).select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v"))
        pairs, balls = (pairs if balls is None else pairs.unionByName(balls)).distinct(), None
        pairs, n_pairs = counted(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), "near-pairs")
        if n_pairs:
            links = _near(pairs, n_pairs, sketches, docs, width, percent)
            done = pairs if done is None else done.unionByName(pairs)
            named, n_named = counted(of_links(links), "near-components")
        left.append(of_mixed.filter("m > 2 AND NOT leads").select("bucket", "node"))
    none = spark.createDataFrame([], "node long, component long")
    if not left:
        return none
    rows = label(reduce(DataFrame.unionByName, left))
    pivots = rows.groupBy("bucket").agg(F.min("c").alias("pivot"), F.max("c").alias("high"), F.count("*").alias("n")).filter("pivot <> high")
    pivots, told = materialise_told(pivots, "near-pivots", total=F.sum("n"))
    total = told["total"]
    if not total:
        return none if named is None else named
    groups, n = counted(dealt_join(rows, pivots.select("bucket", "pivot"), "bucket", pivots.select("bucket", "n"), total).select("pivot", "node", "c").distinct(), "near-groups")
    return of_links(_delta_links(groups, n, sketches, docs, width, percent))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, prints: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the least id reachable over links of at least `percent` hundredths.

    Two texts are linked if the Jaccard similarity of their sets of word
    shingles, computed exactly, reaches it; percent must not be under 80,
    which the bands are made for.  Texts with equal sets, those without words
    too, are one node.  With `prints` the SimHash fingerprints of the sets tell
    the first candidates.  Null ids are never the least unless a component has no
    other.  An empty table gives an empty result.
    """
    if percent < PERCENT:
        raise ValueError(f"the bands find similarities from {PERCENT} % on")
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, n_rows = counted(read.withColumn("s", _sketched(F.col("text"), width, prints)).select("doc_id", "s.*"), "near-sketches")
    more = [F.first("fp").alias("fp")] if prints else []
    nodes = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.count("*").alias("rows"), *more), "near-nodes")
    joined = near_components(nodes, read, width, percent)
    of_node = nodes.select("node", "least").join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    of_node, n_nodes = counted(of_node, "near-named")
    least = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    sizes = nodes.select("node", F.col("rows").alias("n"))
    # a component can hold any share of the nodes, as a node can of the rows
    counts = materialise(of_node.groupBy("component").agg(F.count("*").alias("n")), "near-sizes")
    named = materialise(dealt_join(of_node, least, "component", counts, n_nodes).select("node", "component_id"), "near-least")
    return dealt_join(rows.select("doc_id", "node", F.col("n").cast("long").alias("n_shingles")), named, "node", sizes, n_rows).select("doc_id", "n_shingles", "component_id")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of jaccard_classes over five-word shingles: balls around fingerprints first, bands for what they miss."""
    return jaccard_classes(docs, id_col, text_col, prints=True).select("doc_id", "component_id")


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; texts without words are linked with nothing, equal or not.

    As jaccard_classes otherwise.  A row whose component has no id, or that
    has none and no words, has a null component_id and is kept.
    """
    found = jaccard_classes(docs, id_col, text_col, width, percent)
    found = found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the row with the least id.

    Rows that share an id count as one document: they stay or go together.  A
    component without ids stays whole, as no row of it can be named.
    """
    found = jaccard_components(docs, id_col, text_col)
    gone, n = counted(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    return docs.join(narrow_side(gone, n), docs[id_col] == gone["_gone"], "left_anti")
