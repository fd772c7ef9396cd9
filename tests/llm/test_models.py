"""Language identification, language-model scoring, quality, SimHash, decontamination and SentencePiece against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lectern.llm import decontam, langid, lm, quality, sentencepiece, simhash
from lectern.llm.components import components
from lectern.llm.lm import lm_scores

EDGE = [(1, None), (2, ""), (3, "  \n"), (4, "A b\x0bC  a"), (5, "a B c a"), (5, "a B c a"), (None, "a b"), (6, "é 🙂 日本 \x00 z"), (7, "word " * 3000), (8, "x" * 50000)]


def docs(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, "en", "x", 0.5, "k") for i, t in rows], "doc_id long, text string, lang string, fp string, score double, ids string")


def kneser_ney(counts, order, word):
    level = [Counter() for _ in range(order + 1)]
    for w, times in counts.items():
        s = f" {w} "
        for e in range(1, len(s)):
            k = min(order, e + 1)
            level[k][s[e - k + 1 : e + 1]] += times
    for n in range(order, 1, -1):
        for g in list(level[n]):
            level[n - 1][g[1:]] += 1
    size = len(level[1]) + 1
    total = sum(level[1].values()) + size

    def p(g):
        if len(g) == 1:
            return (level[1][g] + 1) / total if g in level[1] else 1 / total
        own = level[len(g)]
        once, twice = (sum(c == k for c in own.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        left, kinds = sum(c for h, c in own.items() if h[:-1] == g[:-1]), sum(1 for h in own if h[:-1] == g[:-1])
        return p(g[1:]) if not left else (max(own[g] - d, 0) if g in own else 0) / left + d * kinds / left * p(g[1:])

    s = f" {word} "
    return sum(math.log10(p(s[max(0, e - order + 1) : e + 1])) for e in range(1, len(s)))


def test_character_models_match_brute_force():
    rng = random.Random(0)
    counts = {lang: Counter({"".join(rng.choice("abcde"[: 3 + i]) for _ in range(rng.randint(1, 6))): rng.randint(1, 3) for _ in range(30)}) for i, lang in enumerate("xy")}
    model = langid.train({k: langid.gram_counts(c, 3) for k, c in counts.items()}, 3)
    words = ["ab", "abcde", "eee", "zz", "a", "cadeb"]
    want = [[kneser_ney(counts[k], 3, w) for k in "xy"] for w in words]
    np.testing.assert_allclose(langid.word_scores(model, words)[0], want, atol=1e-5)


def test_languages_of_edge_cases_and_held_out_rows(spark):
    words = {"en": ["the", "house", "and", "water"], "de": ["das", "haus", "und", "wasser"]}
    rows = [(i, " ".join(words[k][(i * 7 + j) % 4] for j in range(20)), k) for i in range(60) for k in [("en", "de")[i % 2]]]
    edge = [(1000 + k, t, "de") for k, (_, t) in enumerate(EDGE)] + [(2000, "wasser haus " * 50000, "de"), (2000, "wasser haus " * 50000, "de")]
    df = spark.createDataFrame([(*r, "l", 0.5) for r in [*rows, *edge, (100, None, "en"), (101, "12 !?", "de"), (102, "das Wasser", None), (None, "the", "en")]], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(df).collect()
    assert len(got) == 64 + len(edge)
    assert {r.lang_pred for r in got if r.doc_id == 2000} == {"de"} and {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert all(r.lang_pred in ("en", "de") for r in got if r.doc_id in (1003, 1004, 1008))
    by = {r.doc_id: r for r in got}
    assert by[100].lang_pred == by[101].lang_pred == "und" and by[102].lang_pred == "de"
    assert all(by[i].lang_pred == k for i, _, k in rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {r.lang_pred for r in langid.identify(df.filter("lang = 'zz'")).collect()} == set()
    assert {r.lang_pred for r in langid.identify(docs(spark).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def tokens(t):
    return (t or "").encode().lower().split()


def brute_scores(rows, strength):
    """Each text's tokens one after the other, with counts of whole n-grams in dictionaries."""
    texts = [(i, [*tokens(t), "END"]) for i, t in rows]
    trains = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    count = Counter()
    for i, t in texts:
        if trains(i):
            line = ["START", *t]
            count.update(tuple(line[a : a + n]) for n in (1, 2, 3) for a in range(len(line) - n + 1))
    own = {g[0]: c for g, c in count.items() if len(g) == 1 and g != ("START",)}
    n, v = sum(own.values()), len(own)

    def p(h, w):
        if not h:
            return (own.get(w, 0) + 1) / (n + v + 1)
        s = strength[len(h) - 1]
        return (count[(*h, w)] + s * p(h[1:], w)) / (count[h] + s)

    out = []
    for i, t in texts:
        line = ["START", *t]
        base = sum(math.log10(p((), w)) for w in t)
        score = sum(math.log10(p(tuple(line[max(0, k - 2) : k]), line[k])) for k in range(1, len(line)))
        out.append((str(i), not trains(i), len(t), sum(own.get(w, 0) > 0 for w in t), n, round(base, 4), round(score, 4)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [10, 8_000_000])
def test_automaton_matches_brute_force(spark, chunk):
    rng = random.Random(3)
    rows = [*EDGE, *[(100 + i, " ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for i in range(40)]]
    got = lm_scores(docs(spark, rows), chunk=chunk, strength=(3.0, 2.0)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == brute_scores(rows, (3.0, 2.0))


def test_traversal_carries_states_over_failure_arcs():
    rng = random.Random(4)
    lines = [[rng.randrange(5) for _ in range(rng.randint(1, 40))] for _ in range(30)]
    codes, sizes = np.array([c for x in lines for c in [*x, 5]]), np.array([len(x) + 1 for x in lines])
    grams = lm.Grams(codes, sizes, 7)
    learn = np.repeat(np.arange(30) % 3 > 0, sizes)
    counts = grams.counts(learn, np.arange(30) % 3 > 0)
    automaton = lm.Automaton(grams, counts, int(learn.sum()), len(set(codes[learn])))
    whole = automaton.scores(codes, sizes)
    np.testing.assert_allclose(automaton.scores(codes, sizes, part=3), whole)  # parts of long texts begin in the state they would have
    depth, state, taken = np.array([1]), np.array([6]), []
    for c in codes[: sizes[0]]:
        depth, state, w = automaton.step(depth, state, np.array([c]))
        taken.append(w[0])
        assert depth[0] == 0 or automaton.known[depth[0] - 1][state[0]]
    assert math.isclose(sum(taken), whole[0])


def test_hashes_survive_packing():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 62, 5000, np.uint64) * np.uint64(3))
    np.testing.assert_array_equal(lm.risen(lm.planes(keys)), keys)
    for n in (0, 3, 5000):
        np.testing.assert_array_equal(lm.unpack(lm.pack(keys[:n], lm.narrow(keys[:n] % np.uint64(300))))[0], keys[:n])


def test_repeated_documents_score_above_single_ones(spark):
    rng = random.Random(8)
    make = lambda: " ".join(f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(120))
    once, twice = [make() for _ in range(40)], [make() for _ in range(20)]
    rows = [t for t in [*enumerate(once), *((1000 + 2 * i + k, t) for i, t in enumerate(twice) for k in (0, 1))] if zlib.crc32(str(t[0]).encode()) % 7 != 2]
    got = {r.doc_id: r.score / r.n_tokens for r in lm_scores(docs(spark, rows)).collect()}
    pairs = Counter(t for _, t in rows)
    single, double = (sorted(got[i] for i, t in rows if pairs[t] == k) for k in (1, 2))
    assert sum(x > single[int(0.9 * len(single))] for x in double) >= 0.9 * len(double)


def test_automaton_of_nothing(spark):
    assert lm_scores(docs(spark, [])).count() == 0


def test_calibration_takes_texts_that_were_not_counted():
    model = langid.train({"a": langid.gram_counts(Counter({"abab": 9, "ba": 3})), "b": langid.gram_counts(Counter({"cdcd": 9, "dc": 3}))})
    bits, chars = np.array([[1.0, 5.0], [2.0, 6.0], [5.0, 1.5], [0.0, 0.0]]), np.array([10, 20, 30, 0])
    langid.calibrate(model, bits, chars, ["a", "a", "b", "b"])
    np.testing.assert_allclose(model.limit, [np.quantile([1.0, 2.0], langid.ACCEPT) + langid.MARGIN, 1.5 + langid.MARGIN])
    heats = [0.5, 1, 2, 4, 8, 16, 32]
    loss = lambda h: -sum(math.log2(2 ** (-h * b[k]) / sum(2 ** (-h * x) for x in b)) for b, k in (((1, 5), 0), ((2, 6), 0), ((5, 1.5), 1)))
    assert math.isclose(loss(model.heat), min(map(loss, heats)), abs_tol=1e-6)
    far = langid.predict(model, ["zzz qqq", "abab ba", None, "42"])
    assert list(far["rejected"]) == [True, False, True, True] and far["bits"][0] > max(model.limit) and far["bits"][1] < 1
    assert list(far["lang_pred"])[1:] == ["a", "und", "und"]


def test_samples_hold_the_least_hashes_and_no_more_than_asked(spark):
    from lectern.llm.common import bounded_sample

    keys = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(3000)] + [(7, "a")] * 500, "id long, by string")
    got = Counter((r.by, r.id) for r in bounded_sample(keys, "by", "id", 200).collect())
    assert set(got.values()) == {1} and all(i % 10 == 0 for by, i in got if by == "b")
    n = Counter(by for by, _ in got)
    assert 150 <= n["a"] <= 200 and 150 <= n["b"] <= 200
    few = bounded_sample(keys.filter("by = 'b'"), "by", "id", 1000)
    assert few.count() == 300  # no more than asked for: all of them
    assert bounded_sample(keys.limit(0), "by", "id", 5).count() == 0


def brute_ftrl(rows, importance, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-3):
    z, n = defaultdict(float), defaultdict(float)
    w = lambda i: 0.0 if abs(z[i]) <= l1 else ((l1 if z[i] > 0 else -l1) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for x, y in rows:
        x = {**x, "bias": quality.BIAS}
        now = {i: w(i) for i in x}
        p = 1 / (1 + math.exp(-sum(now[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v * importance[y]
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * now[i]
            n[i] += g * g
    return {i: w(i) for i in z}


def test_regularised_leader_and_dot_product_by_hand():
    rng = random.Random(6)
    rows = [({i: rng.random() * 3 for i in rng.sample(range(12), 4)}, rng.randrange(2)) for _ in range(200)]
    importance = {0: 0.8, 1: 1.3}
    model = quality.Ftrl(np.zeros(13), np.zeros(13))
    for x, y in rows:
        model.learn(np.array(list(x)), np.array(list(x.values())), y, importance[y])
    want = brute_ftrl(rows, importance)
    np.testing.assert_allclose(model.weights(), [want.get(i, 0.0) for i in [*range(12), "bias"]], rtol=1e-9, atol=1e-12)
    texts = ["one two two THREE", "", None, "Two 2!"]
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    row, bucket, total = quality.grams(texts)
    for k, got in enumerate(quality.score(texts, weights, 0.25)):
        dot = sum(float(weights[b]) for r, b in zip(row, bucket) if r == k) * quality.SCALE / max(1, total[k])
        assert math.isclose(got, 1 / (1 + math.exp(-dot - 0.25)), rel_tol=1e-6)


def test_quality_learns_and_keeps_every_row(spark):
    clean = [(i, f"the quick brown fox number {i} went over a lazy dog and slept") for i in range(80)]
    junk = [(100 + i, f"BUY!! NOW!! $$$ {i}%%% ### WIN!! *** &&&") for i in range(80)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk] + [(5, None, 0), (None, 1, 0), (6, 1, 1), (999, 7, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, [*clean, *junk, *EDGE])
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == 160 + len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert all(by[i] == 1 for i, _ in clean if i > 8) and all(by[i] == 0 for i, _ in junk)
    kept = quality.quality_filter(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i, _ in clean if i > 8}
    assert {r.score for r in quality.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(df.limit(0), labels).count() == 0


def brute_print(t, width=3):
    w = tokens(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                group[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    return sorted((str(k), f"{p:016x}", str(min((x for x in least[find(i)] if x is not None), default=None))) for i, ((k, _), p) in enumerate(zip(rows, prints)))


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randint(0, 99)}" for _ in range(400)).split()
    rows = list(EDGE)
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
        rows.append((100 + i, " ".join(w)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_components(docs(spark, rows)).collect()) == brute_components(rows)
    out = simhash.simhash_dedup(docs(spark, rows))
    assert out.columns == docs(spark).columns
    assert {r.doc_id for r in out.collect() if r.doc_id} == {int(c) for k, _, c in brute_components(rows) if c != "None" and c == k}
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_balls_meet_at_every_distance_up_to_two(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(40)}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(prints) for _ in range(3)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = components(simhash.ball_links(spark.createDataFrame(signed, "fp long"))).collect()
    group = defaultdict(set)
    for r in links:
        group[r.component].add(r.node % (1 << 64))
    of = {n: frozenset(g) for g in group.values() for n in g}
    for p in prints:
        for q in prints:
            if p != q and (p ^ q).bit_count() <= 2:
                assert q in of[p]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != t)))
        row = now
    return min(row)


def test_bit_parallel_distance_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        assert decontam.Pattern(item).nearest(text)[0] == edits(item, text)


def test_contaminated_matches_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(12))) for i in range(6)] + [(6, None), (7, "--"), (None, "abc"), (8, "abcd")]
    rows = [*EDGE, (300, "ABCD, and more"), (301, "xabcd abcdx")]
    for k in range(40):
        s = list(decontam.normal(items[k % 6][1]))
        for _ in range(k // 6):
            s[rng.randrange(len(s))] = rng.choice("xyz")
        rows.append((200 + k, f"Some WORDS, {''.join(s).upper()}! and more"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, x in items:
            x = decontam.normal(x)
            if i is not None and x and (e := edits(x, decontam.normal(t))) <= decontam.edits_allowed(x):
                if decontam.edits_allowed(x) or f" {x} " in f" {decontam.normal(t)} ":
                    want.add((d, i, e))
    got = decontam.contaminated(docs(spark, rows), bench)
    assert {(r.doc_id, r.item_id, r.edits) for r in got.collect()} == want
    assert {(r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(docs(spark, rows), bench, block=70).collect()} == want
    clean = decontam.decontaminate(docs(spark, rows), bench)
    assert clean.columns == docs(spark).columns
    assert Counter(str(r.doc_id) for r in clean.collect()) == Counter(str(d) for d, _ in rows if d not in {x[0] for x in want})
    assert decontam.contaminated(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0


def brute_pieces(v, text):
    """Best pieces of a text by trying all ends of all pieces, the unknown one for a character that no piece is."""
    known = {v.pieces[i].decode(): i for i in range(len(v.pieces)) if v.kinds[i] in (sentencepiece.NORMAL, sentencepiece.USER) and v.pieces[i]}
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 24), end):
            part = text[start:end]
            if part in known:
                step, ids = v.scores[known[part]], [known[part]]
            elif end - start == 1:
                step, ids = v.unknown_score, v.bytes_[list(part.encode())].tolist() if len(v.bytes_) else [v.unknown]
            else:
                continue
            if best[end] is None or best[start][0] + step > best[end][0]:
                best[end] = (best[start][0] + step, best[start][1] + ids)
    return best[-1][1]


def test_encoding_is_the_best_segmentation():
    v = sentencepiece.read_vocabulary()
    rng = random.Random(11)
    texts = ["", "a", "the house", "naïve 🙂 日本", "\x00\t\n", "aaaaaaaaaa"] + ["".join(rng.choice(" abcdeéñ🙂日theing\n.") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    enc, dec = sentencepiece.Encoder(v), sentencepiece.Decoder(v)
    for t, ids in zip(texts, enc.encode(texts)):
        assert list(ids) == brute_pieces(v, enc.normal(t))
        assert dec.decode(ids) == t


def test_encoding_equals_the_public_library_and_decodes(spark):
    library = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    v = sentencepiece.read_vocabulary()
    with open(sentencepiece.VOCABULARY, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece, score in zip(proto.pieces, v.scores):
        piece.score = float(score)
        piece.type = 1 if piece.type == 4 else piece.type
    oracle = library.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(2)
    texts = ["Hello world", "  two  spaces ", "日本語 🙂🙂 tabs\t\tand\nnew\n\nlines", "", " ", "naïve café — “x”", "a" * 50, "x▁y"]
    texts += ["".join(rng.choice(" abcdeéñ🙂日の\n.") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    enc, dec = sentencepiece.Encoder(v), sentencepiece.Decoder(v)
    got = enc.encode(texts)
    for t, ids in zip(texts, got):
        assert list(ids) == oracle.encode(t)
        assert dec.decode(ids) == oracle.decode(ids.tolist())
        assert dec.decode(ids) == t or "▁" in t
    rows = sentencepiece.tokenised(docs(spark)).collect()
    assert Counter(str(r.doc_id) for r in rows) == Counter(str(i) for i, _ in EDGE) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert sentencepiece.tokenised(docs(spark, [])).count() == 0
