"""Repair by chunks and the cache of replies: cases by hand, interrupted and repeated runs."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import repair
from lectern.sources import replies

HEAD = "Table 3: SPR results for mutant antibodies\n\n<table><tr><td>Fen</td><td>Fe(Fe)</td></tr><tr><td>WT</td><td>5.48</td></tr><tr><td>A28V/151T</td><td>8.08</td></tr></table>"


def judge(spark, cases):
    """cases: (chunk, reply or None, error) -> rows in order."""
    chunks = spark.createDataFrame([("p", i, c) for i, (c, *_) in enumerate(cases)], "paper_id string, chunk_index int, chunk string")
    answers = spark.createDataFrame([("p", i, r, e) for i, (_, r, e) in enumerate(cases)], "paper_id string, chunk_index int, reply string, error string")
    return repair.judged_repairs(chunks, answers).orderBy("chunk_index").collect()


def told(text, **more):
    return json.dumps({"repaired_text": text, "changed": True} | more)


def test_each_guard(spark):
    new_head = HEAD.replace("<td>Fen</td><td>Fe(Fe)</td>", "<th>Variant</th><th>K<sub>D</sub>&nbsp;(nM)</th>")
    cases = [
        ("SPR results\nfor mutants WT 1.45", told("SPR results for mutants WT 1.45"), None),
        ("WT 1.45", told("WT 145"), None),
        (HEAD, told(new_head, notes="headers"), None),
        (HEAD, told(new_head.replace("A28V/151T", "A28V/I51T")), None),
        (HEAD, told(new_head.replace("Variant", "Fancy")), None),
        (HEAD, told(new_head.replace("for mutant antibodies", "of 3 antibodies")), None),
        ("a b c", None, "Timeout"),
        ("a b c", "no json here", None),
        ("a b c", json.dumps({"changed": True}), None),
        ("a b c", json.dumps({"repaired_text": 12}), None),
        ("a b c", told("  \n"), None),
        (" a b c", told("a b c "), None),
        ("a b c", told("a b c " + "d " * 1100), None),
        ("word " * 200, told("word " * 90), None),
        ("word " * 60, told("word " * 9), None),
        ("```x", "```json\n" + told("```y") + "\n```", None),
        ("QVQLVQSGAEV here", told("QVQLVQSGAEL here"), None),
        ("SEQ ID NO: 7 is", told("SEQ  ID NO:7 is", notes="spaces"), None),
    ]
    got = judge(spark, cases)
    want = [
        ("new", "chunk_repaired"), ("old!", "protected_tokens_changed_keep_original"), ("new", "headers"), ("old!", "protected_tokens_changed_keep_original"), ("old!", "protected_tokens_changed_keep_original"), ("old!", "protected_tokens_changed_keep_original"),
        ("old?", "llm_repair_failed_keep_original"), ("old", "payload_not_dict_keep_original"), ("old", "missing_repaired_text_keep_original"), ("old", "missing_repaired_text_keep_original"), ("old", "empty_repaired_text_keep_original"), ("old", "no_change"),
        ("old", "expanded_too_much_keep_original"), ("old", "shrunk_too_much_keep_original"), ("new", "chunk_repaired"), ("new", "chunk_repaired"), ("old!", "protected_tokens_changed_keep_original"), ("old!", "protected_tokens_changed_keep_original"),
    ]
    for i, (r, (kind, note), (chunk, reply, _)) in enumerate(zip(got, want, cases)):
        assert (r.changed, r.rejected, r.failed, r.note) == (kind == "new", kind == "old!", kind == "old?", note), (i, r)
        assert (r.repaired == chunk) == (kind != "new"), i
    assert got[2].repaired == new_head and got[15].repaired == "```y"


def test_chunks_are_put_together_in_their_places(spark):
    text = "\n\n".join(f"block {i} " + "x" * 30 for i in range(40))
    papers = spark.createDataFrame([("p", text), ("short", "tiny"), ("none", None), ("silent", text)], "paper_id string, text string")
    chunks = repair.repair_chunks(papers, 100)
    answers = chunks.filter("paper_id = 'p' AND chunk_index % 2 = 0").select("paper_id", "chunk_index", F.to_json(F.struct(F.upper("chunk").alias("repaired_text"), F.lit(True).alias("changed"))).alias("reply"), F.lit(None).cast("string").alias("error"))
    out = {r.paper_id: r for r in repair.repaired_texts(papers, repair.judged_repairs(chunks, answers), 100).collect()}
    assert out["p"].repaired_text.lower() == text and out["p"].changed_chunks == 10 and out["p"].failed_chunks == 10 and out["p"].used_repaired_text
    assert out["silent"].repaired_text == text and not out["silent"].used_repaired_text and out["silent"].failed_chunks == 20
    assert (out["short"].repaired_text, out["short"].reason, out["none"].repaired_text) == ("tiny", "below_threshold", None)


def test_a_second_run_asks_nothing(spark, tmp_path):
    path, log = f"file://{tmp_path}/cache", tmp_path / "log"
    log.mkdir()

    def call(prompt):
        (log / f"{prompt}-{len(list(log.iterdir()))}").touch()
        if prompt.startswith("bad"):
            raise ValueError("no")
        return prompt.upper()

    asked = spark.createDataFrame([("a", "one"), ("b", "two"), ("b2", "bad"), ("a", "one"), ("n", None)], "key string, prompt string")
    for version, calls in ((1, 3), (2, 4), (3, 5), (4, 5)):  # only what failed is asked again, three times in all
        rows = replies.ask(asked, path, version, call).collect()
        assert sorted((r.key, r.reply, r.error) for r in rows if r.reply or r.error) == [("a", "ONE", None)] * 2 + [("b", "TWO", None), ("b2", None, "ValueError: no")]
        assert len(list(log.iterdir())) == calls and len(rows) == 5


def test_versions_compaction_and_broken_writes(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    row = lambda *r: spark.createDataFrame([r], "key string, version long, reply string, error string, tries int")
    assert replies.read_replies(spark, path).count() == 0
    replies.write_replies(row("a", 2, "new", None, 1), path)
    replies.write_replies(row("a", 1, "old", None, 1), path)
    replies.write_replies(row("a", 2, "new", None, 1), path)
    replies.write_replies(row("b", 1, None, "x", 2), path)
    (tmp_path / "cache" / "gen=9" / "bucket=1").mkdir(parents=True)  # no _SUCCESS: never read
    want = [("a", 2, "new", None, 1), ("b", 1, None, "x", 2)]
    assert sorted(tuple(r) for r in replies.read_replies(spark, path).collect()) == want
    number = replies.compact_replies(spark, path, drop=False)
    assert replies._generations(spark, path) == [number] and sorted(tuple(r) for r in replies.read_replies(spark, path).collect()) == want
    replies.write_replies(row("b", 2, "late", None, 3), path)
    assert replies.compact_replies(spark, path) and {r.key: r.reply for r in replies.read_replies(spark, path).collect()} == {"a": "new", "b": "late"}
    assert len([p for p in (tmp_path / "cache").iterdir() if p.name.startswith("gen=")]) == 1


@pytest.mark.parametrize("a,b", [(("x", None), ("x", "")), (("ab", "c"), ("a", "bc")), (("a", "b"), ("b", "a"))])
def test_keys_tell_parts_apart(spark, a, b):
    df = spark.createDataFrame([a, b], "x string, y string")
    assert len({r[0] for r in df.select(replies.reply_key(F.col("x"), F.col("y"))).collect()}) == 2
