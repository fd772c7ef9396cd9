"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

Vocabularies are read, never trained.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches
from lectern.llm.words import coded, give_back, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"  # stands for a space
#: Fixed values of the model file: field and type numbers, and the penalty of a character without a piece.
PIECES, TRAINER, NORMALIZER, UNIGRAM = 1, 2, 3, 1
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PENALTY = 10.0
#: Characters of distinct units whose arcs are held at once, and of texts encoded in one step.
ARCS, STEP = 200_000, 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            at += n
            yield tag >> 3, data[at - n : at]
        else:
            n = 4 if tag & 7 == 5 else 8
            at += n
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", data[at - n : at])[0]


@dataclass
class Vocabulary:
    """Pieces by id with log scores, and the double-array trie over those that a text can hold."""

    pieces: list[bytes]
    kinds: np.ndarray
    scores: np.ndarray
    prefix: bool  # a space goes before the text
    squeeze: bool  # outer spaces go and runs become one
    base: np.ndarray = field(default=None)
    check: np.ndarray = field(default=None)
    leaf: np.ndarray = field(default=None)  # id of the piece that ends at a node, or -1
    unknown: int = 0
    unknown_score: float = 0.0
    bytes_: np.ndarray = field(default=None)  # ids of the 256 byte pieces; empty without byte fallback
    splits: str = " "  # characters at which no piece goes on


def zipf(scores: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Log-probabilities by rank, for a file whose scores are only an order of merges.

    They are whole multiples of 2**-10, so sums are exact in any order.
    """
    rank = np.empty(len(scores))
    order = np.argsort(-scores[normal], kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(len(order)) + 2.7
    rank[:] = ranks.max() if len(ranks) else 1
    rank[normal] = ranks
    return np.round(-np.log(rank * np.sum(1 / ranks)) * 1024) / 1024


def load(data: bytes) -> Vocabulary:
    pieces, scores, kinds, model, prefix, squeeze, fallback = [], [], [], UNIGRAM, True, True, False
    for number, value in _fields(data):
        if number == PIECES:
            own = dict(_fields(value))
            pieces.append(own.get(1, b""))
            scores.append(own.get(2, 0.0))
            kinds.append(own.get(3, NORMAL))
        elif number == TRAINER:
            own = dict(_fields(value))
            model, fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == NORMALIZER:
            own = dict(_fields(value))
            if own.get(2):
                raise ValueError("vocabularies with a table of normalisations aren't supported")
            prefix, squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
    kinds, scores = np.array(kinds), np.array(scores, float)
    # user-defined pieces are ordinary ones here: scored as they stand, never forced
    normal = (kinds == NORMAL) | (kinds == USER)
    if model != UNIGRAM:
        scores = zipf(scores, normal)
    v = Vocabulary(pieces, kinds, scores, prefix, squeeze)
    v.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
    v.unknown_score = float(scores[normal].min()) - PENALTY
    v.bytes_ = np.flatnonzero(kinds == BYTE) if fallback or (kinds == BYTE).sum() == 256 else np.zeros(0, np.int64)
    _trie(v, [(p, i) for i, p in enumerate(pieces) if normal[i] and p])
    inner = "".join(pieces[i].decode("utf-8", "replace") for i in np.flatnonzero(normal) if len(pieces[i].decode("utf-8", "replace")) > 1)
    v.splits = "\n" if "\n" not in inner else ""
    if any(MARK in pieces[i].decode("utf-8", "replace").lstrip(MARK) for i in np.flatnonzero(normal)):
        raise ValueError("a piece with a space inside: texts can't be cut at spaces")
    return v


def _trie(v: Vocabulary, entries: list[tuple[bytes, int]]) -> None:
    """Children of a node are at base[node] + byte, and check names their parent; free places are found first-fit."""
    entries.sort()
    size = 1024 + 4 * sum(len(p) for p, _ in entries)
    base, check, leaf = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    taken = bytearray(size)
    check[0], taken[0] = 0, 1
    free, hint, queue = 257, 257, [(0, 0, len(entries), 0)]  # from here any byte fits
    while queue:
        node, a, b, depth = queue.pop()
        if a < b and len(entries[a][0]) == depth:
            leaf[node] = entries[a][1]
            a += 1
        groups, k = [], a
        while k < b:
            byte, start = entries[k][0][depth], k
            while k < b and entries[k][0][depth] == byte:
                k += 1
            groups.append((byte, start, k))
        if not groups:
            continue
        while taken[free]:
            free += 1
        low = groups[0][0]
        at = (free if len(groups) == 1 else max(free, hint)) - low
        tried = 0
        while any(taken[at + g[0]] for g in groups):
            at, tried = at + 1, tried + 1
        if tried > 64:  # what lies below is nearly full for nodes of several children
            hint = at + low
        base[node] = at
        for byte, start, stop in groups:
            taken[at + byte], check[at + byte] = 1, node
            queue.append((at + byte, start, stop, depth + 1))
    end = int(np.flatnonzero(check >= 0)[-1]) + 257
    v.base, v.check, v.leaf = base[:end], check[:end], leaf[:end]


def viterbi(v: Vocabulary, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best segmentation of each unit, one after another, and the number of ids of each.

    All units go through the trie in step: first every arc (start, end, piece)
    is found by walking from all characters at once, then positions are
    settled from left to right, the n-th of every unit together.  Of equal
    scores the arc with the earlier start wins.
    """
    data = np.frombuffer(b"".join(units), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    first = np.cumsum(sizes) - sizes
    unit = np.repeat(np.arange(len(units)), sizes)
    end_of = (first + sizes)[unit] if len(data) else np.zeros(0, np.int64)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    starts, ends, ids, at, node, here = [], [], [], heads, np.zeros(len(heads), np.int64), heads
    while len(at):  # at: where a walk began; here: the byte it reads next
        nxt = v.base[node] + data[here]
        ok = (v.check[nxt] == node) & (nxt > 0)
        at, node, here = at[ok], nxt[ok], here[ok] + 1
        piece = v.leaf[node]
        hit = piece >= 0
        starts.append(at[hit])
        ends.append(here[hit])
        ids.append(piece[hit])
        on = here < end_of[at]
        at, node, here = at[on], node[on], here[on]
    width = np.append(heads[1:], len(data)) - heads if len(heads) else np.zeros(0, np.int64)
    single = np.zeros(len(data) + 1, bool)
    s, e, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, ids))
    wide = np.zeros(len(data) + 1, np.int64)
    wide[heads] = width
    single[s[e - s == wide[s]]] = True
    bare = heads[~single[heads]]
    s, e, p = np.concatenate([s, bare]), np.concatenate([e, bare + wide[bare]]), np.concatenate([p, np.full(len(bare), v.unknown)])
    cost = np.where(p == v.unknown, v.unknown_score, v.scores[p])
    # position k of unit u is first[u] + u + k, so that each unit has an end of its own
    best = np.full(len(data) + len(units) + 1, -np.inf)
    back, by = np.full(len(best), -1, np.int64), np.full(len(best), -1, np.int64)
    best[first + np.arange(len(units))] = 0
    shift = unit[s] if len(s) else s
    rel = s - first[shift] if len(s) else s
    order = np.argsort(rel, kind="stable")
    rel, s, e, p, cost = rel[order], (s + shift)[order], (e + shift)[order], p[order], cost[order]
    edges = np.flatnonzero(np.diff(rel, prepend=-1, append=-1)) if len(rel) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        to, value = e[a:b], best[s[a:b]] + cost[a:b]
        up = value > best[to]
        to = to[up]
        best[to], back[to], by[to] = value[up], s[a:b][up], p[a:b][up]
    # walk back from all ends at once; each step is one id of every unit not yet at its start
    walk, where = first + sizes + np.arange(len(units)), np.arange(len(units))
    found, owner = [], []
    live = sizes > 0
    walk, where = walk[live], where[live]
    lo = first + np.arange(len(units))
    while len(walk):
        piece, prior = by[walk], back[walk]
        if (piece == v.unknown).any() and len(v.bytes_):
            for w, q, u, i in zip(walk.tolist(), prior.tolist(), where.tolist(), piece.tolist(), strict=True):
                got = v.bytes_[data[q - u : w - u]][::-1].tolist() if i == v.unknown else [i]
                found += got
                owner += [u] * len(got)
        else:
            found += piece.tolist()
            owner += where.tolist()
        on = prior > lo[where]
        walk, where = prior[on], where[on]
    owner, found = np.array(owner, np.int64), np.array(found, np.int64)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(units)) if len(units) else np.zeros(0, np.int64)
    ids = found[order]
    if len(ids):  # each unit's ids were found last first
        stop = np.cumsum(counts)
        ids = ids[(np.repeat(stop - 1 + stop - counts, counts)) - np.arange(len(ids))]
    return ids.astype(np.int32), counts


class Encoder:
    """Encodes texts; keeps the ids of units it has met, `limit` ids at most."""

    def __init__(self, v: Vocabulary, limit: int = 600_000):
        self.v, self.limit = v, limit
        # a unit is spaces and the run that follows them, or one character at which no piece goes on
        cut = re.escape(v.splits)
        self.unit = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|[{cut}]" if cut else ""))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.count, self.ids, self.kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def normal(self, text: str | None) -> str:
        text = text or ""
        if self.v.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.v.prefix and text else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        units, codes, sizes = coded([self.unit.findall(self.normal(t)) for t in texts])
        if self.kept > self.limit or len(self.place) > self.limit // 8:
            self.clear()
        fresh = [u for u in units if u not in self.place]
        if fresh:
            found = [viterbi(self.v, [u.encode("utf-8", "surrogatepass") for u in fresh[part]]) for part in slices(fresh, ARCS)]
            ids, count = (np.concatenate(x) for x in zip(*found, strict=True))
            start = self.kept + np.cumsum(count) - count
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.start, self.count, self.ids = np.concatenate([self.start, start]), np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
            self.kept = len(self.ids)
        at = np.fromiter((self.place[u] for u in units), np.int64, len(units))[codes] if units else np.zeros(0, np.int64)
        n = self.count[at]
        stop = np.cumsum(n)
        flat = self.ids[np.repeat(self.start[at] - (stop - n), n) + np.arange(int(n.sum()))] if len(at) else np.zeros(0, np.int32)
        bounds = np.append(0, stop)[np.append(0, np.cumsum(sizes))]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(v: Vocabulary, key: str) -> Encoder:
    """This Python worker's encoder of one broadcast vocabulary: what it has met serves the next tasks too."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(v)
    return _ENCODERS[key]


class Decoder:
    """Ids -> text: byte pieces become bytes, marks become spaces, the leading space that encoding put there goes."""

    def __init__(self, v: Vocabulary):
        self.v = v
        plain = [p.replace(MARK.encode(), b" ") for p in v.pieces]
        for i, b in zip(v.bytes_.tolist(), range(256), strict=False):
            plain[i] = bytes([b])
        for i in np.flatnonzero(v.kinds == CONTROL):
            plain[i] = b""
        plain[v.unknown] = " ⁇ ".encode()
        self.plain = plain

    def decode(self, ids) -> str:
        get = self.plain.__getitem__
        text = b"".join(map(get, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.prefix and text.startswith(" ") else text


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Read on the driver; the arrays, bounded by the vocabulary, are broadcast."""
    with open(path, "rb") as f:
        return load(f.read())


def _encoded(shared, key: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        enc, dec, is_byte = worker_encoder(v, key), Decoder(v), v.kinds == BYTE
        for batch in batches:
            for part in slices(batch.column(1).to_pylist(), STEP):
                rows = batch.slice(part.start, part.stop - part.start)
                texts = rows.column(1).to_pylist()
                ids = enc.encode(texts)
                same = [dec.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
                count = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                owner = np.repeat(np.arange(len(ids)), count)
                fallback = np.bincount(owner[is_byte[flat]], minlength=len(ids))
                listed = pa.ListArray.from_arrays(np.append(0, np.cumsum(count)).astype(np.int32), flat)
                yield pa.RecordBatch.from_arrays([rows.column(0), listed, pa.array(count), pa.array(fallback), pa.array(same)], ["doc_id", "ids", "n_tokens", "n_bytes", "round_trip"])
            give_back()

    return of


def decoded(spark, v: Vocabulary, ids: Column) -> Column:
    """Text of an array of ids; null gives null, ids outside the vocabulary fail."""
    shared = spark.sparkContext.broadcast(v)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dec = Decoder(shared.value)
        for rows in batches:
            yield pd.Series([None if r is None else dec.decode(r) for r in rows], dtype=object)

    return of(ids)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes, round_trip for every row.

    Whole texts are encoded; null and empty texts have no ids.  A character
    that no piece covers becomes its UTF-8 bytes.  Texts that hold the
    space mark itself come back with spaces and have round_trip false.  Of
    segmentations with equal scores the one whose last piece begins earlier
    wins.  Repeated rows and rows without an id each come back, an empty
    table gives no rows, and other columns play no part.
    """
    bounded_batches(docs.sparkSession)
    v = read_vocabulary(path)
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(v)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(shared, uuid.uuid4().hex), f"doc_id {kind}, ids array<int>, n_tokens bigint, n_bytes bigint, round_trip boolean")
