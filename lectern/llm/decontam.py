"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import bounded_batches, materialise
from lectern.llm.words import give_back

#: Edits allowed in each character of an item: an item of 200 characters may differ by 10.
RATE = 0.05
#: Characters of normalised items searched at once; a larger benchmark is searched in blocks.
BLOCK = 4_000_000
_WORDS = re.compile(r"\w+")
MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("passage", T.StringType())]))


def normal(text: str | None) -> str:
    """Lower case, words alone, one space between them."""
    return " ".join(_WORDS.findall((text or "").lower()))


def edits_allowed(item: str, rate: float = RATE) -> int:
    return int(rate * len(item))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into budget + 1 pieces of near-equal length; `budget` edits leave one whole."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Pattern:
    """An item's bit masks for Myers' bit-parallel distance."""

    def __init__(self, item: str):
        self.m, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def nearest(self, text: str) -> tuple[int, int]:
        """(fewest edits to any substring of text, end of the first such substring)."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        plus, minus, score = full, 0, self.m
        best, end, get = self.m, 0, self.masks.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up, down = (minus | ~(xh | plus)) & full, plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, j
            up, down = up << 1 & full, down << 1 & full
            plus, minus = (down | ~(xv | up)) & full, up & xv
        return best, end


class Matcher:
    """Finds items within their error budget in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.items = [(i, t, edits_allowed(t, rate)) for i, t in items if t]
        self.found = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for offset, piece in pieces(t, budget):
                where.setdefault(piece, []).append((k, offset))
        for piece, at in where.items():
            self.found.add_word(piece, (len(piece), at))
        if where:
            self.found.make_automaton()
        self.patterns: dict[int, Pattern] = {}
        self.reversed: dict[int, Pattern] = {}

    def matches(self, text: str) -> list[tuple[int | None, int, int, str]]:
        """(item id, edits, start, passage) of the best place of each item, places in the normalised text.

        A hit of a piece puts the item's start within its budget of one place;
        hits whose places are near are verified once, in one window.
        """
        if not self.items:
            return []
        places: dict[int, set[int]] = {}
        for end, (size, at) in self.found.iter(text):
            for k, offset in at:
                if not self.items[k][2] and not _whole(text, end + 1 - size, end + 1):
                    continue  # without an error budget an item is one piece, and it must not begin or end inside a word
                places.setdefault(k, set()).add(end + 1 - size - offset)
        out = []
        for k, starts in places.items():
            item_id, item, budget = self.items[k]
            best = None
            for a, b in _runs(sorted(starts), 2 * budget + 1):
                low = max(0, a - budget)
                window = text[low : b + len(item) + budget]
                if k not in self.patterns:
                    self.patterns[k], self.reversed[k] = Pattern(item), Pattern(item[::-1])
                edits, end = self.patterns[k].nearest(window)
                if edits <= budget and (best is None or edits < best[1]):
                    _, back = self.reversed[k].nearest(window[:end][::-1])
                    best = (item_id, edits, low + end - back, window[end - back : end])
                    if not edits:
                        break
            if best:
                out.append(best)
        return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0))


def _whole(text: str, a: int, b: int) -> bool:
    return (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")


_MATCHERS: dict[str, Matcher] = {}


def worker_matcher(items: list[tuple[int | None, str]], rate: float, key: str) -> Matcher:
    """This Python worker's automaton of one broadcast list of items: it is built once, not in each task."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate)
    return _MATCHERS[key]


def _runs(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    a = b = starts[0]
    for s in starts[1:]:
        if s - b > gap or s - a > 50 * gap:
            yield a, b
            a = s
        b = s
    yield a, b


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items, normalised, in lists of at most `limit` characters or one item."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).filter("t IS NOT NULL").distinct().orderBy("id", "t")
    for r in rows.toLocalIterator():
        item = normal(r["t"])
        if block and size + len(item) > limit:
            yield block
            block, size = [], 0
        block.append((r["id"], item))
        size += len(item)
    if block:
        yield block


def found_items(spark, items: list[tuple[int | None, str]], text: Column, rate: float = RATE) -> Column:
    """Array of (item_id, edits, start, passage) of the items in each text; null texts have none."""
    shared, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex  # at most BLOCK characters
    bounded_batches(spark)

    @F.pandas_udf(MATCH)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = worker_matcher(shared.value, rate, key)
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "edits", "start", "passage"), m, strict=True)) for m in matcher.matches(normal(t))] for t in texts], dtype=object)
            give_back()

    return of(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits, start, passage: one row for each item that a document holds.

    Texts and items are lower-cased and reduced to words with single spaces.
    A document holds an item if some substring is within rate x length edits
    of it; its best (first of equals) place is given.  Items without words
    match nothing; items under 1 / rate characters have no budget and match
    as whole words only.  Null and empty texts hold nothing, texts of any
    length are searched whole, an empty table or benchmark gives no rows, and
    other columns play no part.
    Items repeated under other ids and documents repeated come back each; an
    item without an id is searched too and comes back with a null item_id.
    """
    spark, parts = docs.sparkSession, None
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    for items in [*_blocks(benchmark, item_col, item_text, block)] or [[]]:
        hit = rows.select("doc_id", F.explode(found_items(spark, items, F.col("_text"), rate)).alias("m")).select("doc_id", "m.*")
        parts = hit if parts is None else parts.unionByName(hit)
    return parts


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no item, one without an id included, with all their columns.

    Items are held as in contaminated(); rows without a text hold none and
    stay, repeated rows stay or go together, and columns may have any names.
    Of a benchmark of several blocks one is searched at a time: what is left
    is written before the next, so an executor holds one automaton.
    """
    for k, items in enumerate(_blocks(benchmark, item_col, item_text, block)):
        docs = materialise(docs, "decontaminated") if k else docs
        docs = docs.filter(F.size(found_items(docs.sparkSession, items, docs[text_col], rate)) == 0)
    return docs
