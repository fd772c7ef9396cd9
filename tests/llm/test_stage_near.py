"""The pipeline's near-dedup begins with fingerprints, and asks no query for a count that a write can tell."""

import gc
import weakref

import corpus_pipeline
from lectern.llm import common, neardup, words
from tests.llm.test_neardup import SCHEMA, brute_components, brute_set, copies


def _bits(a, b):
    x, y = (neardup.print_of(next(words.shingle_sets([t], neardup.WIDTH))) for t in (a, b))
    return ((x ^ y) & (2**64 - 1)).bit_count()


def test_fingerprints_alone_join_what_is_within_two_bits(spark, sf, monkeypatch):
    rows = [x for seed in range(12) for x in copies(2, lambda i: 1, 40 + seed, 10 * seed)]
    near = {b[0] for a, b in zip(rows[::2], rows[1::2]) if _bits(a[1], b[1]) <= 2}
    far = [b[0] for a, b in zip(rows[::2], rows[1::2]) if b[0] not in near]
    assert near and far
    rows += [(500, "a b c d e f"), (501, "A b c d e f"), (502, ""), (503, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, sf).collect()}
    assert sorted(map(str, whole)) == sorted(k for k, c in brute_components(rows) if k == c)
    monkeypatch.setattr(neardup, "PASSES", [(0, 0)])
    found = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, sf).collect()}
    assert found == whole | set(far)


def test_links_of_fingerprints_are_verified(spark):
    sets = spark.createDataFrame([(1, 100, 0), (2, 100, 3), (3, 90, 0), (4, 10, 1), (5, 100, 7 << 40), (6, 100, 15 << 40), (7, 100, 255)], "node long, n int, fp long")
    got = {tuple(r) for r in neardup._ball_pairs(sets, 80).collect()}
    assert got == {(1, 3), (1, 2), (5, 6)}  # 4 has a tenth of the size
    texts = [(1, "a b c d e"), (2, "a b c d e f"), (3, "k l m n o p q")]
    kept = neardup.jaccard_dedup(spark.createDataFrame(texts, SCHEMA)).collect()
    assert len(brute_set(texts[0][1]) & brute_set(texts[1][1])) == 1 and {r.doc_id for r in kept} == {1, 2, 3}


def test_tables_are_counted_as_they_are_written(spark, sf, monkeypatch):
    docs = spark.createDataFrame(copies(30, lambda i: 1 + i % 4, 9), SCHEMA)

    def asked(self):
        raise AssertionError("a query only to count")

    monkeypatch.setattr(type(docs), "count", asked)
    kept = corpus_pipeline.dedup_near(spark, docs, sf)
    monkeypatch.undo()
    assert kept.count() >= 1


def test_driver_drops_what_steps_left_behind(spark):
    class Node:
        pass

    gone = Node()
    gone.itself, told = gone, weakref.ref(gone)
    del gone
    gc.disable()  # so that only the writes collect
    try:
        for _ in range(common.COLLECT):
            common.materialise(spark.range(1), "few")
    finally:
        gc.enable()
    assert told() is None
