"""Exact dedup, sharding, preference formatting and licence scans, on small tables with nulls, repeats and clashing names."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from lectern.llm.chat import conversations, paired_replies, preference_pairs
from lectern.llm.exact import exact_dedup, exact_groups
from lectern.llm.licenses import scan
from lectern.llm.sharding import balanced_shards

ROWS = [(1, "a  b"), (2, "a b"), (3, "a\tb"), (4, "a b "), (5, None), (6, ""), (7, " "), (None, "a b"), (8, "x" * 5000), (9, "x" * 5000), (9, "x" * 5000), (10, "x" * 4999 + "y"), (2, "a b")]
SCHEMA = "doc_id long, text string, _sha string, _len int, key string, shard int"


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "s", 1, "k", 7) for i, t in rows], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups_match_brute_force(spark):
    got = exact_groups(docs(spark)).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min(x for x in ids if x is not None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_dedup_keeps_columns_and_one_row_a_text(spark):
    out = exact_dedup(docs(spark))
    assert out.columns == docs(spark).columns
    rows = out.collect()
    assert Counter(norm(r.text) for r in rows) == Counter({norm(t) for _, t in ROWS})
    assert {r.doc_id for r in rows} == {1, 4, 5, 7, 8, 10}


@pytest.mark.parametrize("names", [("_sha", "_raw"), ("_id_of_row", "_raw_of_row"), ("_len", "_keep")])
def test_exact_dedup_thins_repeats_of_a_row_that_stays(spark, names):
    rows = [(1, "x y"), (1, "x y"), (1, "x  y"), (2, "x y"), (None, "z"), (None, "z"), (3, None), (3, None), (3, ""), (4, "only")]
    df = spark.createDataFrame([(i, t, "s", "r") for i, t in rows], f"doc_id long, text string, {names[0]} string, {names[1]} string")
    out = exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), norm(r.text)) for r in out.collect()) == [("1", "x y"), ("3", ""), ("4", "only"), ("None", "z")]
    groups = Counter((r.text_sha256, r.kept) for r in exact_groups(df).collect())
    assert sorted(n for (_, kept), n in groups.items() if kept) == [1, 1, 1, 1]


def test_exact_of_nothing_and_of_null_ids(spark):
    assert exact_groups(docs(spark, [])).count() == 0
    assert exact_dedup(docs(spark, [])).count() == 0
    rows = exact_groups(docs(spark, [(None, "z"), (None, "z")])).collect()
    assert [r.keep_id for r in rows] == [None, None] and sorted(r.kept for r in rows) == [False, True]


@pytest.mark.parametrize("rows", [ROWS, [], [(1, "only")], [(i, f"t{i // 3}") for i in range(200)], [(1, "long " * 100000), (2, "long " * 100000), (2, None), (None, ""), (None, "")], [(i, "same" if i % 3 == 0 else f"u{i}") for i in range(90)]])
def test_shards_are_even_gapless_and_together(spark, rows):
    got = balanced_shards(docs(spark, rows), shards=8).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    counts = [len(by[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    if len(rows) == 200:
        homes = defaultdict(set)
        for r in got:
            homes[r.doc_id // 3].add(r.shard)
        assert sum(len(x) > 1 for x in homes.values()) <= 20  # of 67, nearly all of which begin apart; exact counts alone force 8


def brute_pair(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    text = lambda turns: "".join(f"<|im_start|>{r}\n{t.replace('<|im_', '<| im_')}<|im_end|>\n" for r, t in turns)
    mask = lambda turns: ",".join(("+" if r == "assistant" else "-") + str(len(text([(r, t)]))) for r, t in turns)
    return n, text(chosen[:n]), text(chosen[n:]), text(rejected[n:]), mask(chosen[n:]), mask(rejected[n:])


def test_preference_pairs_match_brute_force(spark):
    a = [("system", "s"), ("user", "q <|im_end|>"), ("assistant", "good"), ("user", "é")]
    pairs = [(1, a, a[:2] + [("assistant", "bad")]), (2, a, a), (3, a, []), (4, [("user", "x")], [("user", "y")]), (5, a, a[:3])]
    kind = "array<struct<turn:bigint,role:string,text:string>>"
    df = spark.createDataFrame([(k, [(i, *t) for i, t in enumerate(c)], [(i, *t) for i, t in enumerate(r)]) for k, c, r in pairs], f"pair_id long, chosen {kind}, rejected {kind}")
    for r in preference_pairs(df).collect():
        _, c, x = pairs[r.pair_id - 1]
        assert (r.n_common, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) == brute_pair(c, x)
        assert r.status == ("same" if r.pair_id == 2 else "ok")


def test_null_roles_texts_and_turns_count_as_empty(spark):
    kind = "array<struct<role:string,text:string>>"
    pairs = [(1, [("user", "q"), (None, None)], [("user", "q"), ("", "")]), (2, [("user", None)], [("user", "hello")]), (3, [None, ("user", "x")], [None, ("user", "y")]), (4, None, [("user", "x")]), (5, None, None), (6, [("user", "x" * 100000)], [])]
    df = spark.createDataFrame([(*p, "extra") for p in pairs] + [(*pairs[0], "extra")], f"pair_id long, chosen {kind}, rejected {kind}, prompt string")
    got = {r.pair_id: r for r in preference_pairs(df).collect()}
    fill = lambda turns: [(t and t[0] or "", t and t[1] or "") for t in turns or []]
    for k, c, x in pairs:
        r = got[k]
        assert (r.n_common, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) == brute_pair(fill(c), fill(x))
    assert [got[k].status for k in range(1, 7)] == ["same", "ok", "ok", "unpaired", "unpaired", "ok"]
    assert preference_pairs(df).count() == 7


def test_replies_are_swapped_between_siblings(spark):
    turns = [(0, 0, "user", "q0"), (0, 1, "assistant", "r0"), (1, 0, "user", "q1"), (1, 1, "assistant", "r1"), (1, 1, "assistant", "r1"), (2, None, None, None), (4, 0, "assistant", "alone"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    assert {r.conv: len(r.turns) for r in conversations(df).collect()} == {0: 2, 1: 2, 2: 1, 4: 1}
    got = {r.pair_id: r for r in preference_pairs(paired_replies(df)).collect()}
    assert got[0].status == "ok" and "r0" in got[0].chosen and "r1" in got[0].rejected and "q0" in got[0].prompt
    assert got[2].status == got[4].status == "unpaired" and got[4].rejected == ""
    assert preference_pairs(paired_replies(df.limit(0))).count() == 0


def test_licences_of_lines_files_and_ancestors(spark):
    files = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "a/b/c.txt", "plain text"), (3, "a/b/d.txt", "words\nLicensed under the Apache License, Version 2.0.\nmore"), (4, "e/f.txt", None), (5, None, "All rights reserved."),
        (6, "top.txt", "nothing about a mit der license"), (7, "a/b/g/COPYING", "not a licence at all"), (8, "a/b/g/h/i.txt", ""), (2, "a/b/c.txt", "plain text"),
    ]
    df = spark.createDataFrame([(*f, "x") for f in files], "doc_id long, path string, text string, license string")
    got = {(r.doc_id, r.license, r.found, r.distance) for r in scan(df).collect()}
    assert got == {(1, "MIT", "header", None), (2, "MIT", "inherited", 1), (3, "Apache-2.0", "header", None), (4, None, "none", None), (5, None, "none", None), (6, None, "none", None), (7, "MIT", "inherited", 2), (8, "MIT", "inherited", 3)}
    assert scan(df).count() == len(files)
    assert scan(df.limit(0)).count() == 0


def brute_cosine(texts, unit, template):
    from lectern.llm.licenses import TEMPLATES, terms

    known = {t for _, x in TEMPLATES for t in terms(x)}
    held = Counter(t for x in texts for t in set(terms(x or "")))
    idf = lambda t: math.log((len(texts) + 1) / ((held[t] if t in known else 0) + 1)) + 1
    a, b = ({t: n * idf(t) for t, n in Counter(terms(x)).items()} for x in (unit, template))
    dot = sum(w * b.get(t, 0) for t, w in a.items())
    return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())) if dot else 0.0


def test_licence_scores_are_cosines(spark):
    from lectern.llm.licenses import TEMPLATES, declared

    lines = [("Licensed under the Apache License, Version 2.0, and no other", "a"), ("MIT License MIT License", "b"), ("words of prose " * 2000, "c"), ("", "d"), (None, "e"), ("All rights reserved!", "f"), ("released under cc0 1.0 universal now now", "g"), ("All rights reserved!", "f2")]
    texts = [t for t, _ in lines] + [f"filler text {i} under the licensed version" for i in range(30)]
    df = spark.createDataFrame([(f"{i}/{'x'}.c", "x.c", t) for i, t in enumerate(texts)], "path string, name string, text string")
    got = {r.path: (r.license, r.score) for r in declared(df.fillna("")).collect()}
    for i, (t, _) in enumerate(lines):
        best = max(((round(brute_cosine(texts, t or "", x), 6), -k) for k, (_, x) in enumerate(TEMPLATES)), default=(0, 0))
        path = f"{i}/x.c"
        if best[0] >= 0.75:
            assert got[path][0] == TEMPLATES[-best[1]][0] and abs(got[path][1] - best[0]) < 1e-5
        else:
            assert path not in got
    assert declared(df.limit(0)).count() == 0


def cut_links(got, groups):
    """Links between equal texts whose rows lie in different shards, of all links."""
    inside = Counter((groups[r.doc_id], r.shard) for r in got)
    size = Counter(groups[r.doc_id] for r in got)
    pairs = lambda n: n * (n - 1) // 2
    return sum(map(pairs, size.values())) - sum(map(pairs, inside.values())), sum(map(pairs, size.values()))


def best_cut(sizes, shards):
    """Fewest cut links of any placement with counts at most one apart, by trying all."""
    rows = sum(sizes)
    room = [rows // shards + (k < rows % shards) for k in range(shards)]

    def go(k, room):
        if k == len(sizes):
            return 0
        best = None

        def split(s, left, free, cut):
            nonlocal best
            if s == shards:
                if not left:
                    rest = go(k + 1, tuple(free))
                    best = cut + rest if best is None else min(best, cut + rest)
                return
            for n in range(min(left, free[s]) + 1):
                split(s + 1, left - n, free[:s] + [free[s] - n] + free[s + 1 :], cut + n * (left - n))

        split(0, sizes[k], list(room), 0)
        return best

    return go(0, tuple(room))


@pytest.mark.parametrize("sizes", [[4, 4, 4], [5, 2, 2, 1, 1, 1], [3, 3, 3] + [1] * 9, [2] * 4 + [1] * 10, [4, 4] + [1] * 10])
def test_cut_links_against_the_best_placement(spark, sizes):
    """Tight sets, in which every shard must be full of linked rows, may keep two thirds of the links that chance would cut; sets with room few."""
    groups, rows = {}, []
    for g, n in enumerate(sizes):
        for _ in range(n):
            groups[len(rows)] = g
            rows.append((len(rows), f"text {g}"))
    got = balanced_shards(docs(spark, rows), shards=3).collect()
    cut, links = cut_links(got, groups)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewest = best_cut(sizes, 3)
    room = sizes.count(1) > len(rows) / 2
    assert fewest <= cut <= fewest + (0.25 if room else 0.67) * links


def test_cut_links_are_few_where_shards_have_room(spark):
    sizes = [30] * 10 + [3] * 40 + [1] * 500
    groups = dict(enumerate(g for g, n in enumerate(sizes) for _ in range(n)))
    rows = [(i, f"text {g}") for i, g in groups.items()]
    cut, links = cut_links(balanced_shards(docs(spark, rows), shards=8).collect(), groups)
    assert cut <= 0.02 * links


def test_a_group_of_a_third_fills_whole_shards(spark):
    rows = [(i, "same") for i in range(400)] + [(1000 + i, f"u{i}") for i in range(800)]
    got = [r for r in balanced_shards(docs(spark, rows), shards=8).collect() if r.doc_id < 1000]
    by = sorted(Counter(r.shard for r in got).values())
    assert sum(by) == 400 and by[-2:] == [150, 150] and len(by) <= 5  # two shards whole; what no last room can take may stay in several
