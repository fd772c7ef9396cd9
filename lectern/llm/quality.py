"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, bounded_sample, fold, materialise, narrow_side
from lectern.llm.words import Remembered, coded, give_back, hashes, mix, slices

#: Labelled rows of each class that a fit may use, those least by a hash of the id.
SAMPLE = 3000
BUCKETS = 1 << 18
EPOCHS = 4
#: A row's values sum to this, so a text's length does not count; the value of the bias.
SCALE, BIAS = 16.0, 0.2
_RUNS = re.compile(r"(.)\1+", re.S)


class _Kinds(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[code]


_KINDS = _Kinds()


def shape(word: str) -> str:
    """A word's outline: letters as A or a, digits as 9, marks as they are, runs as one."""
    if word.islower() and word.isalpha():
        return "a"
    return _RUNS.sub(r"\1", word.translate(_KINDS))


def _word_hashes(words: list[str]) -> np.ndarray:
    lower = hashes([w.lower().encode("utf-8", "surrogatepass") for w in words], 1)
    return np.stack([lower, hashes([shape(w).encode("utf-8", "surrogatepass") for w in words], 2)], 1)


def grams(texts: list[str | None], buckets: int = BUCKETS, seen: Remembered | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of each text in any order: row, bucket; and the number of each row.

    The n-grams are words, pairs of words, outlines and pairs of outlines; a
    word that repeats the one before has an outline of its own.
    """
    words, codes, sizes = coded([(t or "").split() for t in texts])
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    both = (seen or Remembered()).get(words, _word_hashes)
    word_h, shape_h = both[:, 0], both[:, 1]
    row = np.repeat(np.arange(len(texts)), sizes)
    w, s = word_h[codes], shape_h[codes]
    joined = row[1:] == row[:-1]
    s[1:][joined & (codes[1:] == codes[:-1])] = hashes([b"again"], 3)[0]
    a = np.flatnonzero(joined)
    bucket = np.concatenate([w, s, mix(w[a], w[a + 1]), mix(s[a], s[a + 1])]) % np.uint64(buckets)
    return np.concatenate([row, row, row[a], row[a]]), bucket.astype(np.int64), 4 * sizes - 2 * (sizes > 0)


class Ftrl:
    """Follow-the-regularised-leader logistic regression: two sums a bucket, the last one for the bias."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Weights as the leader has them: zero where the gradients' sum stays within l1."""
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int, importance: float) -> None:
        """One row: distinct buckets and their values, its label, and what its class weighs."""
        i, x = np.append(i, len(self.z) - 1), np.append(x, BIAS)
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x * importance
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g * g


def score(texts: list[str | None], weights: np.ndarray, bias: float, seen: Remembered | None = None) -> np.ndarray:
    row, bucket, total = grams(texts, len(weights), seen)
    dot = np.bincount(row, weights[bucket], len(texts)) * SCALE / np.maximum(total, 1)
    return 1 / (1 + np.exp(-np.clip(dot + bias, -35, 35)))


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices(batch["text"]):
            row, bucket, total = grams(list(batch["text"][part]))
            key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
            row, bucket = np.divmod(key, BUCKETS)
            cut = np.searchsorted(row, np.arange(1, part.stop - part.start))
            value = (count * SCALE / total[row]).astype(np.float32)
            packed = lambda a: [x.tobytes() for x in np.split(a, cut)]
            yield pd.DataFrame({"y": batch["y"][part].to_numpy(), "i": packed(bucket.astype(np.int32)), "x": packed(value)})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights from at most `sample` labelled rows of each class; whole texts are read.

    Rows held out (crc32 of the id modulo 4 is 2), ids or labels that are null
    and labels other than 0 and 1 are left out.  Executors turn the sampled
    texts to sparse vectors and write them; learning reads them in a stream,
    in another order in each epoch, and only the model's sums, of one size
    whatever the texts, come to the driver.  An id with both labels, or with
    several texts, counts with each.  Without labelled rows the weights are
    zero and every score is one half.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(fold(F.col("id"), 4) != 2)
    known = materialise(bounded_sample(known, "y", "id", sample), "labelled")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(narrow_side(known, 2 * sample), "id")
    rows = materialise(texts.select("text", "y").mapInPandas(_vectors, "y int, i binary, x binary"), "vectors")
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row a class
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    if not size:
        return np.zeros(BUCKETS, np.float32), 0.0
    importance = {y: sum(size.values()) / (2 * c) for y, c in size.items()}
    for epoch in range(EPOCHS):
        shuffled = rows.coalesce(1).sortWithinPartitions(F.xxhash64("i", "x", F.lit(epoch)), "y")
        after = shuffled.mapInPandas(_epoch(docs.sparkSession.sparkContext.broadcast((z, n)), importance), "z binary, n binary").first()
        z, n = np.frombuffer(after["z"]), np.frombuffer(after["n"])
    w = Ftrl(z, n).weights()
    return w[:BUCKETS].astype(np.float32), float(w[BUCKETS] * BIAS)


def _epoch(shared, importance: dict[int, float]):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, n = shared.value
        model = Ftrl(z.copy(), n.copy())
        for batch in batches:
            for y, i, x in zip(batch["y"], batch["i"], batch["x"], strict=True):
                model.learn(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), y, importance[y])
        yield pd.DataFrame({"z": [model.z.tobytes()], "n": [model.n.tobytes()]})

    return of


def quality_score(spark, model: tuple[np.ndarray, float], text: Column) -> Column:
    """Column of scores from 0 to 1; null and empty texts get the bias alone."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats, whatever the corpus

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (weights, bias), seen = shared.value, Remembered()
        for texts in batches:
            parts = [score(list(texts[part]), weights, bias, seen) for part in slices(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
            give_back()

    return scored(text)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    predicted is 1 from the threshold on.  Null and empty texts score the
    bias alone; texts of any length are read whole.  Rows without an id (not
    held out) and repeated rows each come back, an empty table gives no rows,
    and other columns play no part; without labels all score one half.
    """
    model = fit(docs, labels, id_col, text_col, label_col, sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), 4) == 2).alias("held_out"), quality_score(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns, whatever their names.

    Scores are those of quality_scores: rows with a null or empty text stay or
    go by the bias, repeated rows stay or go together, an empty table stays
    empty.  Without a labelled row to learn from nothing tells rows apart, and
    all stay.
    """
    model = fit(docs, labels, id_col, text_col, sample=sample)
    if not (model[0].any() or model[1]):
        return docs
    return docs.filter(quality_score(docs.sparkSession, model, docs[text_col]) >= threshold)
