"""Edges: retries, limits, caches and the annotation store, all offline."""

import pytest
from pyspark.sql import functions as F

from lectern.sources import connectors


def test_retries_only_what_may_pass():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("connection reset")
        return "ok"

    assert connectors.with_retries(flaky, sleep=waits.append) == "ok" and waits == [5.0, 10.0]
    with pytest.raises(ValueError):
        connectors.with_retries(lambda: (_ for _ in ()).throw(ValueError("bad request")), sleep=waits.append)
    assert [connectors.backoff(k) for k in range(6)] == [5, 10, 20, 40, 60, 60]


def test_limiter_slides():
    now = [0.0]
    limit = connectors.Limiter(2, 60, lambda: now[0])
    assert [limit.acquire(), limit.acquire()] == [0, 0]
    now[0] = 10
    assert limit.acquire() == 50
    now[0] = 61
    assert limit.acquire() == 0


def test_replies_come_from_the_cache_first(spark):
    asked = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("b", "p2"), ("c", None)], "k string, prompt string")
    cache = spark.createDataFrame([("a", "known")], "k string, reply string")
    got = sorted((r.k, r.reply) for r in connectors.cached_replies(asked, cache, ["k"], "prompt").collect() if r.k != "c")
    assert got == [("a", "known"), ("b", connectors.mock_reply("p2")), ("b", connectors.mock_reply("p2"))]
    assert asked.select(connectors.replies(F.col("prompt"))).count() == 4


def test_store_upserts(tmp_path):
    store = connectors.Store(str(tmp_path / "s.db"))
    store.annotate("p", 0, "KD", "exact", "reviewed", "t1")
    store.annotate("p", 0, "KD", "wrong", "reviewed", "t2")
    assert store.rows("annotations") == [("p", 0, "KD", "wrong", "reviewed", "t1", "t2")]
    with pytest.raises(ValueError):
        store.annotate("p", 1, "KD", "", "reviewed", "t3")
    store.give_feedback("p", 0, "looks off", "t4")
    assert store.summary() == (1, 1, 1)
