"""Blocks, chunks and sections of document texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.binding import bound, let

CHUNKS = "array<struct<chunk_index:int,text:string,char_count:int,block_count:int>>"


def pieces(block: str, limit: int) -> list[str]:
    """A block over the limit as whole lines, packed; a line over it in slices."""
    out, now = [], ""
    for line in block.split("\n"):
        parts = [line[i : i + limit] for i in range(0, len(line), limit)] or [""]
        for part in parts:
            joined = f"{now}\n{part}" if now else part
            if now and (len(joined) > limit or len(line) > limit):
                out.append(now)
                now = part
            else:
                now = joined
    return [p for p in (*out, now) if p.strip()]


def chunk_text(text: str | None, limit: int, mark: str = "\n\n") -> list[tuple[int, str, int, int]]:
    """(index from one, text, characters, blocks): blocks in order, joined by the mark while the limit allows."""
    chunks: list[tuple[str, int]] = []
    now: list[str] = []
    size = 0
    for block in (b.strip() for b in (text or "").split(mark)):
        if not block:
            continue
        if now and (len(block) > limit or size + len(mark) + len(block) > limit):
            chunks.append((mark.join(now), len(now)))
            now, size = [], 0
        if len(block) > limit:
            chunks += [(p, 1) for p in pieces(block, limit)]
        else:
            size += len(block) + (len(mark) if now else 0)
            now.append(block)
    if now:
        chunks.append((mark.join(now), len(now)))
    return [(i, t, len(t), n) for i, (t, n) in enumerate(chunks, 1)]


def chunked(text: Column, limit: int, mark: str = "\n\n") -> Column:
    """Array of chunks; packing carries a running size, so it runs over Arrow batches."""

    @F.pandas_udf(CHUNKS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("chunk_index", "text", "char_count", "block_count")
        for texts in batches:
            yield pd.Series([[dict(zip(names, c, strict=True)) for c in chunk_text(t, limit, mark)] for t in texts], dtype=object)

    return of(text)


def blocks(text: Column, mark: str = "\n") -> Column:
    """Non-blank blocks, trimmed, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), mark), lambda b: F.trim(b)), lambda b: b != "")


def first_occurrences(items: Column) -> Column:
    """Items without later repeats, case aside, in order: pairs of (key, place) sorted once, the first of each key back in its place."""

    def of(pairs: Column) -> Column:
        firsts = F.filter(F.transform(pairs, lambda p, i: F.when((i == 0) | (p["key"] != F.get(pairs, i - 1)["key"]), p["at"])), lambda at: at.isNotNull())
        return F.transform(F.array_sort(firsts), lambda at: F.get(items, at))

    return let(F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at")))), of)


def drop_sections(text: Column, low: str, keep: str) -> Column:
    """Text without the sections whose heading matches `low`, but for lines that match `keep`.

    A section runs from its heading (a line that begins with #) to the next.
    """
    parts = F.split(F.coalesce(text, F.lit("")), r"(?m)(?=^#)")
    bad = lambda p: F.regexp_extract(p, r"^#+\s*([^\n]*)", 1).rlike(low) & ~p.rlike(keep)
    return F.array_join(F.filter(parts, lambda p: ~bad(p)), "")


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k a task before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def islands(rows: DataFrame, by: list[str], order: list[str], inside: Column) -> DataFrame:
    """Runs of consecutive rows inside: key, run number, first and last position, length."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = rows.withColumn("_n", F.row_number().over(w)).withColumn("_in", inside)
    runs = numbered.filter("_in").withColumn("_run", F.col("_n") - F.row_number().over(w))
    return runs.groupBy(*by, "_run").agg(F.min("_n").alias("first"), F.max("_n").alias("last"), F.count("*").alias("length")).drop("_run")


#: Words that make a sentence one about antibodies, those that speak for a name and those that speak against it.
ABOUT = [r"\bantibody\b", r"\bmab\b", r"\bmonoclonal\b", r"\bclone\b", r"\bbnab\b", r"\bigg\b"]
FOR = [
    r"\bisolated\b", r"\bidentified\b", r"\bcharacterized\b", r"\bwe (?:found|identified|isolated|characterized)\b", r"\bpotent\b", r"\bneutraliz", r"\bbind(?:ing)?\b", r"\baffinity\b", r"\bepitope\b",
    r"\bsequence\b", r"\bvh\b", r"\bvl\b", r"\bcdrh3\b",
]
AGAINST = [
    r"\bcontrol\b", r"\bbenchmark\b", r"\bcomparator\b", r"\breference antibody\b", r"\bpreviously described\b", r"\bpreviously published\b", r"\bused as control\b",
    r"\bgermline\b", r"\bmrca\b", r"\bpublic clonotype\b",
]


def _hits(window: Column, patterns: list[str]) -> Column:
    return sum((F.regexp_count(window, F.lit(f"({p})")) for p in patterns), F.lit(0))


def ranked_names(texts: DataFrame, id_col: str, names: str = "names", body: str = "t", most: int = 25) -> DataFrame:
    """id, name, score, rank (priority, deprioritised or neutral) of the first names of each text.

    A name is judged by the first two sentences that hold it, else by the 100
    characters around it: a point for each word that speaks for it, two off
    for each against, one more for a table or supplement; names that nothing
    near calls an antibody are left out.
    """
    low = F.lower(F.coalesce(F.col(body), F.lit("")))
    rows = texts.select(id_col, low.alias("_t"), F.filter(F.transform(F.split(low, r"(?<=[.!?])\s+"), F.trim), lambda x: x != "").alias("_s"), F.explode(F.slice(names, 1, most)).alias("name"))
    rows = bound(rows, _n=F.lower("name")).filter(F.contains("_t", F.col("_n")))
    held = F.array_join(F.slice(F.filter("_s", lambda x: F.contains(x, F.col("_n"))), 1, 2), " ")
    at = F.instr("_t", F.col("_n"))
    near = F.substr("_t", F.greatest(at - 100, F.lit(1)), F.least(at - 1, F.lit(100)) + F.length("_n") + 100)
    rows = bound(rows, _w=F.coalesce(F.nullif(held, F.lit("")), near)).filter(_hits(F.col("_w"), ABOUT) > 0)
    score = _hits(F.col("_w"), FOR) - 2 * _hits(F.col("_w"), AGAINST) + F.when(F.col("_w").rlike("table|supp"), 1).otherwise(0)
    rows = rows.select(id_col, "name", score.alias("score"))
    return rows.withColumn("rank", F.when(F.col("score") >= 1, "priority").when(F.col("score") <= -1, "deprioritised").otherwise("neutral"))
