"""The trie of conversations against a walk over all prefixes on one machine."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from lectern.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x for *_, x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = 100 * int(c / 100)  # c - c % 100, with SQL's remainder
        made[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)

    def total(k):
        leaves, saved = (0 if k in children else 1), (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
        for x in children.get(k, []):
            a, b = total(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(made[c]) == len(k)))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])), *total(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("depth", F.lit(7)).repartition(parts)
    got = trie.prefix_trie(df)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in [*rng.sample(range(400), 60), -7, -100, -103]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é𝄞"])))
    check(spark, rows)


def test_copies_null_turns_and_turnless_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 4)
    monkeypatch.setattr(trie, "BLOCK", 3)
    same = [(t, "user", f"turn {t}") for t in range(12)]
    rows = [(c, *t) for c in range(1000, 1030) for t in same]  # one class and its heads: most conversations
    rows += [(c, *t) for c in range(5000, 5900, 100) for t in same[:3]]  # copies that end above the others
    rows += [(c, *t) for c in (7101, 7102, 7103) for t in same[:2]]  # without a first one: turnless if their head is long
    rows += [(8000, None, "user", "null first"), (8000, 0, None, None), (8001, 0, "user", ""), (8001, None, "user", "x")]
    rows += [(None, 0, "user", "nobody")]
    check(spark, rows)


def test_one_conversation_and_none(spark):
    check(spark, [(3, 0, "user", "alone")])
    check(spark, [(200, 0, "user", "alone"), (200, 1, "user", "two")])
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)).count() == 0


def test_a_long_conversation_is_dealt_over_tasks(spark):
    rows = [(100, t, "user", f"{t % 7}") for t in range(900)] + [(c, t, "user", "z" * (t % 3)) for c in range(120, 140) for t in range(4)]
    rows += [(200, t, "user", f"{t % 7}") for t in range(900)]  # an equal one: a chain with savings
    check_rows = spark.createDataFrame(rows, SCHEMA)
    got = {(r.depth, r.conv_id): r for r in trie.prefix_trie(check_rows).collect()}
    long_one = [r for (d, c), r in got.items() if c == 100 and r.n_convs == 2 and d > 5]
    assert len(long_one) == 895 and got[900, 100].saved_tokens == 1 and got[899, 100].saved_tokens == 2 and got[6, 100].saved_tokens == 895
    assert got[900, 100].ends_sha256 == hashlib.sha256(b"100,200").hexdigest()


def test_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    df = queries.op11_conversation_trie(spark, sf)
    columns = sorted(df.columns)
    want = con.sql(queries.OP11_SQL)
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)
