"""Language-model scoring by a weighted backoff automaton over smoothed n-grams of up to three words.

The automaton has a root, a state for each word and each pair of words that
training texts go on from, and one for the start of a text.  From state h an
arc on w weighs log10 p(w | h) where training has the n-gram hw and leads to
the longest state that ends it; otherwise the failure arc, which weighs log10
of the share that smoothing set aside at h, leads to the state of h without
its first word, and from there the token is read again.  The root has an arc
for every token.  Smoothing is hierarchical Dirichlet: p(w | h) is (count of
hw + strength x p(w | shorter h)) / (count of h + strength), and the root's
probabilities are the add-one ones of base_score.

The automaton is as large as the corpus, so it is never in one place.  Texts
are read in chunks.  A chunk asks about each distinct n-gram of its texts, in
packed rows for the buckets into which the n-grams' hashes fall, and tells how
often its training texts hold it.  A bucket adds these up and answers; no
bucket depends on a context, so a frequent word or context is one entry of
each chunk.  A chunk with its answers builds the part of the automaton that
its texts traverse, and all its texts go through it in step, from left to right.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, fold, input_bytes, materialise
from lectern.llm.words import coded, hashes, mix

#: Characters of text in a chunk (a text is never cut), bytes of input for each bucket.
CHUNK, BUCKET_BYTES = 6_000_000, 4_000_000
#: Pseudo-counts that the shorter context's probabilities get after one word and after two.
STRENGTH = (20.0, 4.0)
#: Tokens of a long text that are read in one go; the state after two tokens depends on them alone, so the next part begins by reading these.
PART = 2048
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_SENT = "chunk string, bucket long, blob binary"
_KEPT = "chunk string, blob binary, bucket long, tokens long, types long"


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as bytes; those of more than a few items are compressed."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], np.int64).tobytes()
    body = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return b"z" + zstandard.ZstdCompressor(level=level).compress(body) if len(body) > 256 else b"r" + body


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[:1] == b"z" else bytes(blob[1:])
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(data, chr(kind), size, at))
        at += out[-1].nbytes
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes that hold them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def planes(rising: np.ndarray) -> list[np.ndarray]:
    """Rising hashes as the steps between them, split by byte: high bytes, nearly all alike, compress away."""
    steps = np.diff(rising, prepend=np.uint64(0))
    return [np.ascontiguousarray(steps.view(np.uint8)[k::8]) for k in range(8)]


def risen(parts: list[np.ndarray]) -> np.ndarray:
    steps = np.zeros(len(parts[0]), np.uint64)
    for k, p in enumerate(parts):
        steps |= p.astype(np.uint64) << np.uint64(8 * k)
    return np.cumsum(steps, dtype=np.uint64)


class Grams:
    """The distinct n-grams of some texts of coded words, by length, and which of them ends at each token."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, words: int):
        """codes: of each token, the last of a text its end; words: how many codes there are, the last two being end and start."""
        self.codes, self.sizes, self.words = codes, sizes, words
        self.first = np.cumsum(sizes) - sizes
        start = words - 1
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[self.first] = start
        self.pair, self.pair_at = np.unique(before * words + codes, return_inverse=True)
        self.deep = np.ones(len(codes), bool)  # tokens with a trigram: all but a text's first
        self.deep[self.first] = False
        where = np.flatnonzero(self.deep)
        self.triple, at = np.unique(self.pair_at[where - 1] * words + codes[where], return_inverse=True)
        self.triple_at = np.full(len(codes), -1)
        self.triple_at[where] = at

    def counts(self, learn: np.ndarray, of_text: np.ndarray) -> list[np.ndarray]:
        """How often the tokens to learn from hold each word, pair and triple; the start counts once a text."""
        ones = np.bincount(self.codes[learn], minlength=self.words)
        ones[-1] = of_text.sum()
        deep = self.triple_at[learn & self.deep]
        return [ones, np.bincount(self.pair_at[learn], minlength=len(self.pair)), np.bincount(deep, minlength=len(self.triple))]

    def keys(self, word: np.ndarray, bits: int) -> list[np.ndarray]:
        """A hash of `bits` bits for each n-gram of each length."""
        a, b = np.divmod(self.pair, self.words)
        two = mix(word[a], word[b])
        p, c = np.divmod(self.triple, self.words)
        three = mix(two[p] ^ np.uint64(0x5851F42D4C957F2D), word[c])
        cut = np.uint64(64 - bits)
        return [mix(word, np.full(len(word), 0x1F0A5E, np.uint64)) >> cut, two >> cut, three >> cut]


def _asked(keys: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order in which n-grams are asked about, the buckets that get any, and where each one's part begins and ends.

    Buckets are ranges of hashes, so the order is that of the hashes.
    """
    order = np.argsort(keys, kind="stable")
    width = -(-(1 << bits) // buckets)
    to = (keys[order] // np.uint64(width)).astype(np.int64)
    cut = np.flatnonzero(np.diff(to, prepend=-1, append=-1)) if len(to) else np.zeros(1, np.int64)
    return order, to[cut[:-1]], cut


def _chunk(name: str, number: int, ids: list, train: list, texts: list, buckets: int, bits: int) -> Iterator[tuple]:
    """A chunk's rows: what it asks of each bucket, and its texts as codes in a row of its own (bucket -1 - number)."""
    lines = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    words, codes, sizes = coded(lines)
    del lines
    n = len(words)
    common = np.argsort(-np.bincount(codes, minlength=n), kind="stable")  # frequent words get small codes
    rank = np.empty(n, np.int64)
    rank[common] = np.arange(n)
    words, codes = [words[k] for k in common.tolist()], rank[codes]
    full = np.full(len(codes) + len(sizes), n, np.int64)
    inner = np.ones(len(full), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    full[inner] = codes
    sizes = sizes + 1
    word = np.append(hashes(words), np.array([END, START]))
    spelled = np.frombuffer(b" ".join(words), np.uint8)
    del words
    grams = Grams(full, sizes, n + 2)
    counts = grams.counts(np.repeat(np.array(train, bool), sizes), np.array(train, bool))
    per: dict[int, list] = {}
    for level, (key, count) in enumerate(zip(grams.keys(word, bits), counts, strict=True)):
        order, to, cut = _asked(key, buckets, bits)
        for b, low, high in zip(to.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = order[low:high]
            per.setdefault(b, [(), (), ()])[level] = (*planes(key[own]), narrow(count[own]))
    for b, levels in per.items():
        yield name, b, pack(np.array([bool(x) for x in levels]), *[a for x in levels for a in x])
    missing = np.array([i is None for i in ids], bool)
    whole = np.array([0 if m else int(i) for i, m in zip(ids, missing, strict=True)], np.int64)
    high = narrow(full >> 8)
    yield name, -1 - number, pack(whole, missing, np.array(train, bool), narrow(sizes), (full & 255).astype(np.uint8), high, spelled, level=6)


def _sent(buckets: int, bits: int, chunk: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        ids, train, texts, size = [], [], [], 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame(_chunk(f"{task}-{made}", task * 1_000_003 + made, ids, train, texts, buckets, bits), columns=["chunk", "bucket", "blob"])

        for batch in batches:
            for i, t, text in zip(batch["doc_id"], batch["train"], batch["text"], strict=True):
                ids.append(i)
                train.append(t)
                texts.append(text)
                size += len(text) if text else 0
                if size >= chunk:
                    yield rows()
                    ids, train, texts, size, made = [], [], [], 0, made + 1
        if ids:
            yield rows()

    return of


def _read(blob: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of each length in a row for a bucket."""
    has, *arrays = unpack(blob)
    out, at = [], 0
    for h in has.tolist():
        out.append((risen(arrays[at : at + 8]), arrays[at + 8].astype(np.int64)) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        at += 9 * h
    return out


def _answered(bits: int):
    start = int(mix(np.array([START]), np.array([0x1F0A5E], np.uint64))[0] >> np.uint64(64 - bits))

    def of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """One bucket: the total count of every n-gram, told to each chunk in the order in which it asked."""
        if key[0] < 0:  # a chunk's texts pass through
            return group[["chunk", "blob"]].assign(bucket=-1, tokens=0, types=0)
        asked = [_read(b) for b in group["blob"]]
        told: list[list] = [[] for _ in asked]
        tokens = types = 0
        for level in range(3):
            keys, counts = (np.concatenate([a[level][k] for a in asked]) for k in (0, 1))
            distinct, which = np.unique(keys, return_inverse=True)
            total = np.bincount(which, counts, len(distinct)).astype(np.int64)
            if not level:
                real = distinct != start
                tokens, types = int(total[real].sum()), int((total[real] > 0).sum())
            at = 0
            for mine, a in zip(told, asked, strict=True):
                mine.append(narrow(total[which[at : at + len(a[level][0])]]))
                at += len(a[level][0])
        out = [(name, pack(*t), key[0], 0, 0) for name, t in zip(group["chunk"], told, strict=True)]
        return pd.DataFrame([*out, (None, None, key[0], tokens, types)], columns=["chunk", "blob", "bucket", "tokens", "types"])

    return of


class Automaton:
    """States, arcs and failure arcs of the n-grams in one set of texts; a state is (depth, number): root, word, pair."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, types: int, strength: tuple[float, float] = STRENGTH):
        one, two, three = (c.astype(np.float64) for c in counts)
        self.words, self.pair, self.triple = grams.words, grams.pair, grams.triple
        first, second = np.divmod(grams.pair, grams.words)
        self.suffix = second  # the failure arc of a pair leads to its second word's state
        root = (one + 1) / (tokens + types + 1)
        pair = (two + strength[0] * root[second]) / (one[first] + strength[0])
        before, _ = np.divmod(grams.triple, grams.words)
        self.to = np.zeros(len(grams.triple), np.int64)  # the arc of a triple leads to the pair of its last two words
        self.to[grams.triple_at[grams.deep]] = grams.pair_at[grams.deep]
        triple = (three + strength[1] * pair[self.to]) / (two[before] + strength[1])
        self.known = (one > 0, two > 0, three > 0)
        self.arc = tuple(map(np.log10, (root, pair, triple)))
        self.fail = (None, np.log10(strength[0] / (one + strength[0])), np.log10(strength[1] / (two + strength[1])))

    def step(self, depth: np.ndarray, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Reads one token of each text: the depths and states after it and the weights of the arcs taken."""
        weight, depth, state = np.zeros(len(token)), depth.copy(), state.copy()
        next_depth, next_state = np.zeros_like(depth), np.zeros_like(state)
        at = np.flatnonzero(depth == 2)
        if len(at):
            arc, found = _lookup(self.triple, state[at] * self.words + token[at], self.known[2])
            hit, miss, arc = at[found], at[~found], arc[found]
            weight[hit] += self.arc[2][arc]
            next_depth[hit], next_state[hit], depth[hit] = 2, self.to[arc], -1
            weight[miss] += self.fail[2][state[miss]]
            depth[miss], state[miss] = 1, self.suffix[state[miss]]
        at = np.flatnonzero(depth == 1)
        if len(at):
            arc, found = _lookup(self.pair, state[at] * self.words + token[at], self.known[1])
            hit, miss, arc = at[found], at[~found], arc[found]
            weight[hit] += self.arc[1][arc]
            next_depth[hit], next_state[hit], depth[hit] = 2, arc, -1
            weight[miss] += self.fail[1][state[miss]]
            depth[miss] = 0
        at = np.flatnonzero(depth == 0)
        weight[at] += self.arc[0][token[at]]
        word = self.known[0][token[at]]
        next_depth[at[word]], next_state[at[word]] = 1, token[at[word]]
        return next_depth, next_state, weight

    def scores(self, codes: np.ndarray, sizes: np.ndarray, part: int = PART) -> np.ndarray:
        """log10 probability of each text; all go from left to right in step, long ones in parts that begin with the two tokens before them."""
        start = self.words - 1
        first = np.cumsum(sizes) - sizes
        parts = -(-sizes // part)
        text = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        low = first[text] + nth * part
        length = np.minimum(part, sizes[text] - nth * part)
        order = np.argsort(-length, kind="stable")
        low, length, text, nth = low[order], length[order], text[order], nth[order]
        opened = (nth == 0) & bool(self.known[0][start])
        depth, state = opened.astype(np.int64), np.where(opened, start, 0)
        later = np.flatnonzero(nth > 0)
        for back in (2, 1):
            if len(later):
                depth[later], state[later], _ = self.step(depth[later], state[later], codes[low[later] - back])
        total = np.zeros(len(low))
        for k, live in enumerate(np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right").tolist()):
            depth, state, weight = self.step(depth[:live], state[:live], codes[low[:live] + k])
            total[:live] += weight
        return np.bincount(text, total, len(sizes))


def _lookup(keys: np.ndarray, wanted: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) & known[at] if len(keys) else np.zeros(len(wanted), bool)


def _scorer(tokens: int, types: int, buckets: int, bits: int, strength: tuple[float, float]):
    def of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        home = group["bucket"] < 0
        ids, missing, train, sizes, low, high, spelled = unpack(group["blob"][home].iloc[0])
        word = np.append(hashes(spelled.tobytes().split(b" ") if len(spelled) else []), np.array([END, START]))
        codes, sizes = high.astype(np.int64) << 8 | low, sizes.astype(np.int64)
        grams = Grams(codes, sizes, len(word))
        told = {b: unpack(blob) for b, blob in zip(group["bucket"][~home], group["blob"][~home], strict=True)}
        counts = []
        for level, keys in enumerate(grams.keys(word, bits)):
            count = np.zeros(len(keys), np.int64)
            order, to, cut = _asked(keys, buckets, bits)
            for b, a, z in zip(to.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                count[order[a:z]] = told[b][level]
            counts.append(count)
        automaton = Automaton(grams, counts, tokens, types, strength)
        first = np.cumsum(sizes) - sizes
        summed = lambda x: np.add.reduceat(x, first) if len(first) else x
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(ids.copy(), missing.copy()), "held_out": ~train, "n_tokens": sizes,
            "n_known": summed((counts[0][codes] > 0).astype(np.int64)), "base_score": summed(automaton.arc[0][codes]), "score": automaton.scores(codes, sizes),
        })

    return of


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, chunk: int = CHUNK, bucket_bytes: int = BUCKET_BYTES, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Trains on every row whose id's crc32 modulo `folds` is not `held` (null
    ids train).  A null or empty text is its end alone; texts of any length
    are read whole.  Repeated rows count and come back each; without training
    rows every token has the weight 1 / 1.  An empty table gives no rows.

    The number of buckets follows the input's size, so a bucket's share of
    the n-grams stays of bounded size; a chunk sends rows only to buckets for
    which it has an n-gram, so there are never more rows than n-grams.  Hashes
    grow with the input, so that four n-grams in a million have another's,
    whatever the size (up to 64 bits, the limit from 64 TB on).
    """
    size = input_bytes(docs)
    buckets = max(16, math.ceil(size / bucket_bytes))
    bits = min(64, max(46, 18 + math.ceil(math.log2(size + 1))))
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), (fold(F.col(id_col), folds) != held).alias("train"), F.col(text_col).alias("text"))
    kept = rows.mapInPandas(_sent(buckets, bits, chunk), _SENT).groupBy("bucket").applyInPandas(_answered(bits), _KEPT)
    kept = materialise(kept, "automaton")
    total = kept.filter("chunk IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types")]).first()
    scorer = _scorer(total["tokens"], total["types"], buckets, bits, strength)
    scored = kept.filter("chunk IS NOT NULL").select("chunk", "bucket", "blob").groupBy("chunk").applyInPandas(scorer, _SCORED)
    return scored.withColumn("train_tokens", F.lit(total["tokens"]).cast("long"))
