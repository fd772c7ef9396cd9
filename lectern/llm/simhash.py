"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, dealt_join, materialise, narrow_side
from lectern.llm.components import components
from lectern.llm.words import give_back

BITS = 64


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of some 64-bit hashes have each bit set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have, as a signed long."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed long.

    A-Z are lower-cased, words are runs without ASCII whitespace, and each
    shingle of `width` words (repeats count; a shorter text is one shingle)
    is hashed by XXH64.  A bit is set if it is set in over half the hashes.
    Null, empty and blank texts have fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), seed)).view(np.int64))
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(starts)
    spans = list(zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True))
    for i in range(0, n, 1 << 16):  # a text of any length needs one block of bits at a time
        h = np.array([digest(line[a:b], seed) for a, b in spans[i : i + (1 << 16)]], np.uint64)
        total += bit_counts(h)
    return majority(total, n)


def _fingerprints(width: int):
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")
            give_back()

    return of


def ball_links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that join all fingerprints at two or fewer differing bits.

    Each fingerprint emits the 65 values within one bit of it; two at distance
    two or less share one.  The distinct fingerprints that share a value lie
    within one bit of it, so a group has 65 members at most and neighbours in
    its order are linked, which leaves the group connected.  The distance of
    each link is verified.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(BITS)])
    variants = prints.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select(before.alias("u"), F.col("fp").alias("v")).filter("u IS NOT NULL").distinct()
    return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    component_id is the least id reachable over links, the row's own
    included; null ids are never the least unless a component has no other.
    Equal fingerprints, the zero of texts without words too, are one node, so
    a group of copies of any size costs one row in the search; repeated rows
    each come back.  An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(width)(F.col(text_col)).alias("fp")), "prints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-prints")
    joined = components(ball_links(prints.select("fp")))
    of_print = prints.join(joined, prints["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of_print = materialise(of_print, "print-components")
    least = of_print.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_print.join(least, "component").select("fp", "component_id")
    return dealt_join(rows, named, "fp", prints.select("fp", "n"), rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of docs that stay: of each component the row with the least id.

    Rows that share an id count as one document: they stay or go together.  A
    component without ids stays whole, as no row of it can be named.
    """
    found = simhash_components(docs, id_col, text_col, width)
    gone = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    return docs.join(narrow_side(gone, gone.count()), docs[id_col] == gone["_gone"], "left_anti")
