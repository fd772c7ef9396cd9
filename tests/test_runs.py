"""Records without a model, prompts, nested spans and image triage: edges that the tables don't have."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import heuristic, trace, triage
from lectern.sources import replies

SPAN = "paper_id string, id int, kind string, name string, status string, start long, end long, tokens long"


def test_innermost_spans_match_brute_force(spark):
    rng = random.Random(4)
    inner, outer = ([(rng.choice("pq"), i + k, *(lambda a, n: (a, a + n))(rng.randrange(5000), rng.choice([0, 1, 7, 300, 2500]))) for i in range(150)] for k in (0, 1000))
    schema = "p string, id int, start long, end long"
    got = {(r.p, r.id): r.o for r in trace.enclosing(spark.createDataFrame(inner, schema), spark.createDataFrame(outer, schema), "p", "o").collect()}
    for p, i, s, e in inner:
        around = [(-a, b, o) for q, o, a, b in outer if q == p and a <= s and b >= e]
        assert got[p, i] == (min(around)[2] if around else None)
    assert len(got) == 150


def test_a_paper_without_phases(spark):
    rows = [("p", 1, "tool", "t", "success", 5, 9, None), ("p", 2, "agent", "a", "error", 0, 10, None)]
    r = trace.paper_table(spark.createDataFrame(rows, SPAN)).collect()
    assert [tuple(x) for x in r] == [("p", None, 0, 0, 1, 1, 1, 1, 4, 0)]
    assert trace.paper_table(spark.createDataFrame([], SPAN)).count() == 0


def test_prompts_keep_braces_and_say_what_was_cut(spark):
    schema = "paper_id string, text string, reduced string, hints string, focus struct<paper_focus_text:string,paper_type:array<string>,primary_evidence_sources:array<string>,entity_risks:array<string>,sequence_focus:array<string>,split_policy:string>, image_hints string, corrections string"
    rows = [("p", "x" * 12, None, "{PAPER_ID}", None, None, None), (None, None, "short", None, None, "see", "fix")]
    got = heuristic.document_prompts(spark.createDataFrame(rows, schema), "{PAPER_ID}|{REGEX_HINTS}|{DOCUMENT_TEXT}", 10).collect()
    assert (got[0].prompt, got[0].cut) == ("p|{PAPER_ID}|" + "x" * 10 + heuristic.CUT, True)
    assert (got[1].prompt, got[1].cut) == (heuristic.REDUCED + "unknown||short\n\nsee" + heuristic.CORRECTIONS + "fix", False)


def test_sections_are_packed_by_priority(spark):
    rows = [("a", 3, 1, "third"), ("a", 1, 2, "first"), ("a", 2, 3, "y" * 50), ("a", 4, 4, "z"), ("b", 1, 1, "w" * 99), ("c", 1, 1, " "), ("d", 1, 1, None)]
    got = {r.k: tuple(r)[1:] for r in heuristic.packed_sections(spark.createDataFrame(rows, "k string, pos int, priority int, text string"), "k", 30).collect()}
    assert got == {"a": ("first\n\nthird", 2, 2), "b": ("", 0, 1)}


def test_records_of_tables_and_of_names(spark):
    table = "<table><tr><th>Clone</th><th>CDRH3</th><th>EC50</th></tr><tr><td>A1</td><td>CARW</td><td>2</td></tr><tr><td>a1</td><td>no</td><td></td></tr></table>"
    rows = [("p1", "/x/My Paper/full.md", table + " by ELISA"), ("p2", None, "clones 12-A3 and 12-A3 and 99-B1"), ("p3", "/x/p3/a.md", None), ("p4", "", "nothing here")]
    got = {}
    for r in heuristic.heuristic_records(spark.createDataFrame(rows, "paper_id string, path string, text string")).collect():
        assert len(r.record) == 23
        got.setdefault(r.paper_id, []).append((r.idx, r.from_table, *(r.record[f] for f in ("Antibody_Name", "CDRH3_Sequence", "Binding_EC50", "Experiment", "Reference_Source"))))
    assert got["p1"] == [(0, True, "A1", "CARW", "2", "ELISA", "My Paper")]
    assert sorted(got["p2"]) == [(0, False, "12-A3", "", "", "", "p2"), (1, False, "99-B1", "", "", "", "p2")] and set(got) == {"p1", "p2"}


def test_triage_without_targets_images_or_answers(spark):
    image = "paper_id string, pos int, image string, parts array<string>, alt string, context string, category string, pixels array<int>"
    target, known = "paper_id string, name string, missing_fields array<string>", "paper_id string, image string"
    frame = spark.createDataFrame
    some = [("p", i, f"i{i}", None, None, None, None, [20000]) for i in range(45)] + [("q", 0, "i0", [], None, "Ab1 sequence", None, [5]), ("r", 0, "x", ["y"], "", "", "", None)]
    got = triage.relevant_images(frame(some, image), frame([("p", "Ab1", ["vh_sequence_aa"]), ("q", "Ab1", ["vh_sequence_aa"]), ("r", None, None)], target), frame([("p", "i44"), ("r", "y")], known), 40, 30)
    rows = {(r.paper_id, r.image): (r.score, r.category) for r in got.collect()}
    assert sum(p == "p" for p, _ in rows) == 30 and ("q", "i0") not in rows and ("p", "i44") not in rows
    assert rows["r", "x"][1] == "SEQUENCE_DATA" and rows["r", "x"][0] == 40 + 12
    none = frame([], "paper_id string, image string, reply string")
    assert [(r.paper_id, r.category) for r in triage.triaged_images(got, none).collect()] == [("r", "SEQUENCE_DATA")]
    assert triage.relevant_images(frame([], image), frame([], target), frame([], known)).count() == 0


@pytest.mark.parametrize("told,more,want", [("abc", "def", "abcdef"), ("x 12345678", "12345678 y", "x 12345678 y"), ("1234567", "1234567", "12345671234567"), ("", "a", "a"), (None, "a", None), ("a", None, "a")])
def test_continuations(told, more, want):
    assert replies.joined_reply(told, more) == want


def test_replies_that_stay_cut_off(spark, tmp_path):
    def call(prompt):
        return json.dumps({"k": 1}) if prompt == "whole" else "" if "empty" in prompt and "\n" in prompt else '{"a": ['

    asked = spark.createDataFrame([("w", "whole"), ("e", "empty"), ("l", "long"), ("n", None)], "key string, prompt string")
    got = {r.key: (r.reply, r.rounds, r.whole) for r in replies.resumed(asked, f"file://{tmp_path}/c", 1, call, 2).collect()}
    assert got == {"w": ('{"k": 1}', 0, True), "e": ('{"a": [', 0, False), "l": ('{"a": [' * 3, 2, False), "n": (None, 0, False)}
    assert replies.read_replies(spark, f"file://{tmp_path}/c").filter(F.col("reply").isNotNull()).count() == 6
