"""Near-dedup by word shingles against brute force, and the pipeline's stage on copies that fingerprints miss."""

import random
import re

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import neardup, queries, words

SCHEMA = "doc_id long, text string"


def brute_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets, group = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                group[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((str(k), str(least.get(find(i)))) for i, (k, _) in enumerate(rows))


def copies(n, edits, seed, first=0):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    out = [(first, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for _ in range(edits(i)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
        out.append((first + i, " ".join(w)))
    return out


def test_components_match_brute_force(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (None, "one two"), (None, "alone here"), (4, "another text with the same id as four has")]
    for seed in range(2):
        rows += copies(12, lambda i: i, seed, 100 * (seed + 1))
    got = neardup.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == brute_components(rows)
    assert neardup.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_group_in_rounds_of_leaders(spark):
    rows = copies(60, lambda i: 1 + i % 4, 7)
    want = brute_components(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = neardup.jaccard_dedup(df)
    assert kept.columns == df.columns and {str(r.doc_id) for r in kept.collect()} == {k for k, c in want if k == c}


def test_stage_drops_copies_of_similarity_over_0_8(spark, sf):
    rows = [x for seed in range(8) for x in copies(2, lambda i: 5, 20 + seed, 10 * seed)]
    assert all(0.8 <= len(brute_set(a) & brute_set(b)) / len(brute_set(a) | brute_set(b)) < 0.9 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    kept = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, SCHEMA), sf)
    assert {r.doc_id for r in kept.collect()} == {10 * k for k in range(8)}


def brute_minhash(rows):
    """doc_id, size of the set, component, kept: two-word shingles, every pair of rows with words."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    least = [k for k, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    low = min((x for x in (least[i], least[j]) if x is not None), default=None)
                    changed |= least[i] != low or least[j] != low
                    least[i] = least[j] = low
    return sorted(str((k, len(s), c, k == c)) for (k, _), s, c in zip(rows, sets, least))


def test_minhash_components_match_brute_force(spark):
    rows = [(1, None), (2, ""), (3, "\x0b "), (4, "Solo"), (5, "solo"), (6, "Ärger ärger"), (7, "ärger ärger"), (8, "a b"), (9, "b a"), (None, "a B"), (None, None), (10, "a b"), (11, "x y x y x"), (11, "y x y x y x y")]
    rng = random.Random(3)
    for k in range(40):  # short texts around the limit, and a group in which most pairs are under it
        w = [f"w{rng.randrange(4)}" for _ in range(rng.randrange(3, 9))]
        rows += [(100 + 3 * k, " ".join(w)), (101 + 3 * k, " ".join([*w, "end"])), (102 + 3 * k, " ".join(["start", *w]))]
    for seed in range(3):
        rows += copies(14, lambda i: 3 * i, 40 + seed, 1000 * (seed + 1))
    rows += copies(40, lambda i: 22, 99, 9000)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("n", F.lit(1))
    got = neardup.minhash_components(df)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_minhash(rows)
    assert neardup.minhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_of_long_texts_are_read_in_pieces():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (3, 900, 0, 2, 5000)] + [None, "x" * 5000, "\t\r a"]
    whole, pieces = list(words.word_hashes(texts)), list(words.word_hashes(texts, limit=50))
    assert [len(h) for h in whole] == [len((t or "").split()) for t in texts]
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    assert [len(s) for s in words.shingle_sets(["a b a b", "a", "", "a b"], 2)] == [2, 1, 0, 1]


def test_groups_around_the_limit_are_told_by_their_differences(spark, monkeypatch):
    """One pass over two bands alone: nearly every link has to come from differences from a pivot."""
    monkeypatch.setattr(neardup, "PASSES", [(0, 24)])
    rng = random.Random(12)
    rows = []
    for g in range(3):
        base = [f"w{rng.randrange(40)}" for _ in range(60)]
        for i in range(50):
            w = list(base)
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(40 if g else 4000)}"
            rows.append((1000 * g + i, " ".join(w)))
    got = neardup.minhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_minhash(rows) and 10 < len({r.component_id for r in got}) < 140


def test_minhash_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = queries.op12_minhash(spark, sf)
    columns = sorted(df.columns)
    want = con.sql(queries.OP12_SQL)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.select(*columns).fetchall())
