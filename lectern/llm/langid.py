"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import bounded_batches, bounded_sample, fold, materialise, narrow_side
from lectern.llm.words import Remembered, coded, slices

#: Labelled texts of each language that a fit may use, those least by a hash of the id.
SAMPLE = 1500
#: Of these one in CALIBRATE, by another hash of the id, is kept from the counts and sets rejection limits and the heat of scores.
CALIBRATE = 5
ORDER = 4
#: Share of a language's calibrating texts whose cross-entropy its rejection limit exceeds, and the bits that are added to it.
ACCEPT, MARGIN = 0.999, 0.25
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x100000001B3)


@dataclass
class Model:
    """Sorted hashes of every n-gram of every language and a row of log10 probabilities and backoffs for each.

    An n-gram that any language has seen has a row of its probability under
    each (interpolated, or backed off where that language has not seen it); a
    context's row has the weights that scale the next shorter n-gram.
    """

    langs: list[str]
    key: list[np.ndarray]  # by order: sorted hashes
    logp: list[np.ndarray]  # by order: (n, langs)
    back: list[np.ndarray]  # by order of the context, 1 to ORDER - 1: (n, langs)
    floor: np.ndarray  # log10 probability of an unseen character
    limit: np.ndarray  # cross-entropy beyond which a language's best guess is rejected
    heat: float = 1.0


def _letters(word: str) -> list[str]:
    return _LETTERS.findall(word.lower())


def _rolled(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each character; orders 1 to `order`."""
    out, h = [], np.zeros(len(chars), np.uint64)
    c = chars.astype(np.uint64) + np.uint64(1)
    for n in range(order):
        shifted = np.zeros_like(c)
        shifted[n:] = c[: len(c) - n]
        h = (h ^ (shifted + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) * _BASE
        h ^= h >> np.uint64(29)
        out.append(h.copy())
    return out


def gram_counts(words: Counter, order: int = ORDER) -> Counter:
    """N-grams of counted words: of `order` characters, and the shorter ones with which a word begins.

    A word is read with a mark on either side, so contexts do not pass from
    one word to the next.
    """
    found: Counter = Counter()
    for word, times in words.items():
        w = f" {word} "
        for end in range(1, len(w)):
            found[w[max(0, end - order + 1) : end + 1]] += times
    return found


def train(counts: dict[str, Counter], order: int = ORDER) -> Model:
    """N-grams and how often each occurs, by language -> interpolated Kneser-Ney models.

    The longest n-grams, and those at the beginning of a word, count
    occurrences, shorter ones the number of distinct characters seen before
    them; one discount a level is estimated from counts of one and two.
    """
    langs = sorted(counts)
    prob: list[dict[str, dict[str, float]]] = [{} for _ in range(order + 1)]
    backs: list[dict[str, dict[str, float]]] = [{} for _ in range(order + 1)]
    floor = np.zeros(len(langs))
    for li, lang in enumerate(langs):
        level: list[dict[str, float]] = [defaultdict(float) for _ in range(order + 1)]
        for gram, times in counts[lang].items():
            level[len(gram)][gram] += times
        for n in range(order, 1, -1):  # continuation counts; n-grams that begin at the mark have counts of their own
            for gram in level[n]:
                level[n - 1][gram[1:]] += 1
        alphabet = len(level[1]) + 1
        total1 = sum(level[1].values()) + alphabet
        lower = {g: (c + 1) / total1 for g, c in level[1].items()}
        floor[li] = np.log10(1 / total1)
        prob[1][lang] = lower
        for n in range(2, order + 1):
            once, twice = (sum(1 for c in level[n].values() if c == k) for k in (1, 2))
            d = once / (once + 2 * twice) if once and twice else 0.5
            total, kinds = defaultdict(float), defaultdict(int)
            for g, c in level[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            scale = {h: d * kinds[h] / total[h] for h in total}
            prob[n][lang] = {g: max(c - d, 0) / total[g[:-1]] + scale[g[:-1]] * _lower(prob, backs, lang, g[1:], 10 ** floor[li]) for g, c in level[n].items()}
            backs[n - 1][lang] = scale
    model = Model(langs, [], [], [], floor, np.full(len(langs), np.inf))
    for n in range(1, order + 1):
        key, table = _packed(prob[n], langs, n)
        model.key.append(key)
        model.logp.append(table)
    for n in range(1, order):
        key, table = _packed(backs[n], langs, n)
        at = np.searchsorted(model.key[n - 1], key)
        missing = np.setdiff1d(key, model.key[n - 1])
        if len(missing):  # contexts that are no n-gram themselves: the opening mark
            keys = np.union1d(model.key[n - 1], missing)
            logp = np.full((len(keys), len(langs)), np.nan, np.float32)
            logp[np.searchsorted(keys, model.key[n - 1])] = model.logp[n - 1]
            model.key[n - 1], model.logp[n - 1] = keys, logp
            at = np.searchsorted(keys, key)
        back = np.zeros((len(model.key[n - 1]), len(langs)), np.float32)
        back[at] = np.nan_to_num(table, nan=0.0)
        model.back.append(back)
    for n, grams in enumerate([sorted(set().union(*p.values())) for p in prob[1:]], 1):  # what a language lacks it backs off to
        codes = np.array([[ord(c) for c in g] for g in grams], np.int64).reshape(len(grams), n).ravel()
        hashed = _rolled(codes, n)
        at = np.searchsorted(model.key[n - 1], hashed[n - 1][n - 1 :: n])
        table = model.logp[n - 1]
        if n == 1:
            table[:] = np.where(np.isnan(table), model.floor, table)
            continue
        known, context = _find(model.key[n - 2], hashed[n - 2][n - 2 :: n])
        suffix = np.searchsorted(model.key[n - 2], _rolled(codes.reshape(-1, n)[:, 1:].ravel(), n - 1)[n - 2][n - 2 :: n - 1])
        shorter = np.where(known[:, None], model.back[n - 2][context], 0) + model.logp[n - 2][suffix]
        table[at] = np.where(np.isnan(table[at]), shorter, table[at])
    return model


def _lower(prob, backs, lang: str, gram: str, floor: float) -> float:
    """Probability of gram's last character after the rest, from the levels done so far."""
    scale = 1.0
    while gram:
        if (p := prob[len(gram)][lang].get(gram)) is not None:
            return scale * p
        scale *= backs[len(gram) - 1].get(lang, {}).get(gram[:-1], 1.0) if len(gram) > 1 else 1.0
        gram = gram[1:]
    return scale * floor


def _packed(by_lang: dict[str, dict[str, float]], langs: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    grams = sorted(set().union(*by_lang.values())) if by_lang else []
    codes = np.array([[ord(c) for c in g] for g in grams], np.int64).reshape(len(grams), n)
    key = _rolled(codes.ravel(), n)[n - 1][n - 1 :: n] if grams else np.zeros(0, np.uint64)
    table = np.full((len(grams), len(langs)), np.nan, np.float32)
    place = {g: i for i, g in enumerate(grams)}
    for li, lang in enumerate(langs):
        d = by_lang.get(lang, {})
        if d:
            table[[place[g] for g in d], li] = np.log10(np.fromiter(d.values(), float, len(d)))
    order = np.argsort(key)
    return key[order], table[order]


def word_scores(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each word under each language, and the number of characters scored (the closing mark too).

    All words are scored together: for each character the longest known
    n-gram is looked up in the sorted hashes, shorter ones only for those
    characters that lack it, scaled by the context's backoff.
    """
    langs = len(model.langs)
    text = " " + "  ".join(words) + " "
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    deep = np.arange(len(chars)) - start  # characters before this one in its word
    grams = _rolled(chars, len(model.key))
    out = np.zeros((len(chars), langs), np.float32)
    todo = np.flatnonzero(deep > 0)
    for n in range(len(model.key), 0, -1):
        use = deep[todo] >= n - 1
        rows = todo[use]
        hit, at = _find(model.key[n - 1], grams[n - 1][rows])
        out[rows[hit]] += model.logp[n - 1][at[hit]]
        missed = rows[~hit]
        if n > 1:
            known, at = _find(model.key[n - 2], grams[n - 2][missed - 1])
            out[missed[known]] += model.back[n - 2][at[known]]
        else:
            out[missed] += model.floor
        use[use] = hit
        todo = todo[~use]
    word = np.repeat(np.arange(len(words)), sizes)
    return np.stack([np.bincount(word, out[:, k], len(words)) for k in range(langs)], 1), sizes - 1


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)), at


def _token_scores(model: Model, tokens: list[str]) -> np.ndarray:
    """A row for each token: the log10 probability of its words under each language, and their characters."""
    words, codes, sizes = coded([_letters(t) for t in tokens])
    out = np.zeros((len(tokens), len(model.langs) + 1))
    if words:
        p, n = word_scores(model, words)
        owner = np.repeat(np.arange(len(tokens)), sizes)
        for k in range(p.shape[1]):
            out[:, k] = np.bincount(owner, p[codes, k], len(tokens))
        out[:, -1] = np.bincount(owner, n[codes], len(tokens))
    return out


def entropies(model: Model, texts: list[str | None], seen: Remembered | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in bits a character under each language, and the characters it is a mean over (0: no letter)."""
    tokens, codes, sizes = coded([(t or "").split() for t in texts])
    if not tokens:
        return np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    scored = (seen or Remembered()).get(tokens, lambda new: _token_scores(model, new))
    token_p, token_n = scored[:, :-1], scored[:, -1]
    row = np.repeat(np.arange(len(texts)), sizes)
    total = np.stack([np.bincount(row, token_p[codes, k], len(texts)) for k in range(token_p.shape[1])], 1)
    chars = np.bincount(row, token_n[codes], len(texts)).astype(np.int64)
    return -total / np.log10(2) / np.maximum(chars, 1)[:, None], chars


def predict(model: Model, texts: list[str | None], seen: Remembered | None = None) -> pd.DataFrame:
    """Lowest cross-entropy wins; the score is its share among languages after calibration."""
    if not model.langs:
        return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "bits": 0.0, "rejected": True})
    bits, chars = entropies(model, texts, seen)
    best = bits.argmin(1)
    low = bits[np.arange(len(texts)), best]
    share = 1 / np.exp2(-(bits - low[:, None]) * model.heat).sum(1)
    blank = chars == 0
    lang = np.where(blank, "und", np.array(model.langs, object)[best])
    return pd.DataFrame({"lang_pred": lang, "score": np.where(blank, 0.0, share), "bits": np.where(blank, 0.0, low), "rejected": blank | (low > model.limit[best])})


def calibrate(model: Model, bits: np.ndarray, chars: np.ndarray, langs: list[str]) -> Model:
    """Limits of rejection from each language's own texts, and the heat that makes scores likeliest, on texts that the counts did not see.

    bits and chars: cross-entropies and characters of the texts, langs: the
    languages they are in.  A language without such a text rejects nothing.
    """
    own = np.array([model.langs.index(x) for x in langs], np.int64)
    seen = chars > 0
    for k in range(len(model.langs)):
        mine = bits[(own == k) & seen, k]
        if len(mine):
            model.limit[k] = float(np.quantile(mine, ACCEPT)) + MARGIN
    if seen.any():
        gap = bits[seen] - bits[seen].min(1)[:, None]
        true = gap[np.arange(len(gap)), own[seen]]
        heats = np.array([0.5, 1, 2, 4, 8, 16, 32])
        loss = [np.mean(true * h + np.log2(np.exp2(-gap * h).sum(1))) for h in heats]
        model.heat = float(heats[int(np.argmin(loss))])
    return model


def _counted(order: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                found = gram_counts(Counter(x for t in part["text"] for w in (t or "").split() for x in _letters(w)), order)
                yield pd.DataFrame({"lang": lang, "gram": list(found), "n": list(found.values())})

    return of


def _measured(shared):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch["text"]):
                bits, chars = entropies(shared.value, list(batch["text"][part]))
                yield pd.DataFrame({"lang": batch["lang"][part].to_numpy(), "bits": list(bits), "chars": chars})

    return of


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, order: int = ORDER) -> Model:
    """Models from at most `sample` whole texts a language.

    Rows held out (crc32 of the id modulo 4 is 2) and rows without text,
    language or id are left out.  One sampled text in CALIBRATE is not
    counted; it helps to set limits and heat.  N-grams are counted and
    summed by Spark; their sums, which the sample bounds, and a few numbers of
    each calibrating text come to the driver, no texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(fold(F.col("id"), 4) != 2)
    chosen = materialise(bounded_sample(known.select("id", "lang"), "lang", "id", sample), "sample")
    texts = known.join(narrow_side(chosen, chosen.count()), ["id", "lang"])
    texts = materialise(texts.select("lang", "text", (F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0).alias("aside")), "sample-texts")
    counted = texts.filter("NOT aside").select("lang", "text").mapInPandas(_counted(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in counted.toLocalIterator():
        counts[r["lang"]][r["gram"]] = r["n"]
    model = train(counts, order)
    if not model.langs:
        return model
    aside = texts.filter(F.col("aside") & F.col("lang").isin(model.langs)).select("lang", "text")
    rows = aside.mapInPandas(_measured(spark.sparkContext.broadcast(model)), "lang string, bits array<double>, chars long").collect()
    if not rows:
        return model
    return calibrate(model, np.array([r["bits"] for r in rows]), np.array([r["chars"] for r in rows]), [r["lang"] for r in rows])


def language(spark, model: Model, text: Column) -> Column:
    """Struct of lang_pred, score, bits and rejected."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample, whatever the corpus
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    @F.pandas_udf(kind)
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = Remembered()
        for texts in batches:
            yield pd.concat([predict(shared.value, list(texts[part]), seen) for part in slices(texts)] or [predict(shared.value, [])])

    return named(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, rejected for every row.

    lang_pred is a learned language, `und` where the text is null or has no
    letter (or nothing could be learned); rejected marks texts whose
    cross-entropy passes the limit calibrated for that language.  Ties go to
    the language that sorts first; repeated rows and rows without an id each
    come back (these are not held out), an empty table gives no rows, texts of
    any length are read whole, and other columns play no part.
    """
    model = fit(docs, id_col, text_col, lang_col, sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), 4) == 2).alias("held_out"), language(docs.sparkSession, model, F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", "p.*")
