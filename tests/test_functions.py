"""Functions and operators that SQL can't express, against brute force and by property."""

import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import judge, jsontext, sequences, similarity, text, units
from lectern.operators import blocks, matching, merge, tables, trace
from lectern.sources import files
from lectern.streaming import traces


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_assignment_is_the_cheapest():
    rng = np.random.default_rng(4)
    for n in range(1, 7):
        for _ in range(20):
            cost = rng.integers(0, 10, (n, n)) / 10
            got = matching.assignment(cost)
            assert sorted(got) == list(range(n))
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert abs(cost[np.arange(n), got].sum() - best) < 1e-9


def test_pairs_keep_to_the_floor_and_greedy_takes_the_best():
    sims = pd.DataFrame([(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.8), (1, 1, 0.1)], columns=["gt_idx", "pred_idx", "sim"])
    assert sorted((int(a), int(b)) for a, b, _ in matching.best_pairs(sims)) == [(0, 1), (1, 0)]
    assert [(int(a), int(b)) for a, b, _ in matching.best_pairs(sims, optimal=False)] == [(0, 0)]


def test_batches_of_papers_give_what_single_papers_give():
    rng = np.random.default_rng(9)
    frames = [pd.DataFrame([(f"P{k:03}", g, p, round(rng.random(), 1 if k % 2 else 6)) for g in range(rng.integers(1, 6)) for p in range(rng.integers(1, 6))], columns=["paper_id", "gt_idx", "pred_idx", "sim"]) for k in range(60)]
    whole = pa.Table.from_pandas(pd.concat(frames), preserve_index=False)
    for size in (1, 7, 64, 10_000):
        for optimal in (True, False):
            got = [tuple(r.values()) for b in matching._by_paper(iter(whole.to_batches(max_chunksize=size)), optimal) for r in b.to_pylist()]
            assert got == [(f["paper_id"][0], *x) for f in frames for x in matching.best_pairs(f, optimal)]
    for f in frames[:40]:  # the short way has the total of the long one
        table = f.pivot(index="gt_idx", columns="pred_idx", values="sim").fillna(0).to_numpy()
        n = max(table.shape)
        cost = np.zeros((n, n))
        cost[: table.shape[0], : table.shape[1]] = 1 - table
        to = matching.assignment(cost)
        best = sum(table[i, j] for i, j in enumerate(to[: len(table)]) if j < table.shape[1] and table[i, j] >= 0.5)
        evident = matching._evident(table)
        if evident is not None:
            assert abs(sum(v for v in table[np.arange(len(table)), evident] if v >= 0.5) - best) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(3, 20))
def test_chunks_keep_order_and_limit(body, limit):
    chunks = blocks.chunk_text(body, limit, "\n\n")
    assert all(len(t) == n <= limit for _, t, n, _ in chunks)
    assert [i for i, *_ in chunks] == list(range(1, len(chunks) + 1))
    assert "".join("".join(t.split()) for _, t, _, _ in chunks) == "".join(body.split())


def test_grids_fill_spans():
    t = "<table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><td>1</td><td>&lt;2</td></tr></table>"
    assert tables.html_tables(t) == [[["A", "B", "B"], ["A", "1", "<2"]]]
    assert tables.pipe_tables("| a | b |\n|---|:-:|\n| 1 | 2 |\nx\n| alone |") == [[["a", "b"], ["1", "2"]]]
    assert tables.header_names(["Clone", "Antigen", "KD (nM)", "", "Clone 2"]) == ["mAb", "Target", "KD", "col_3", "Clone 2"]


def test_json_is_salvaged():
    assert jsontext.salvage('say {"a": 1} and {"b": [2]}') == '{"b":[2]}'
    assert jsontext.salvage('```json\n{"a": {"b": 1}}\n```') == '{"a":{"b":1}}'
    assert jsontext.salvage("none") is None and jsontext.salvage(None) is None
    assert jsontext.closed('{"a": [1, 2, {"b": "x') == '{"a":[1,2,{"b":"x"}]}'
    assert jsontext.closed('text [1, {"k": 2}, ') == '[1,{"k":2}]'


def test_character_diff_rebuilds_both_sides():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        runs = similarity.character_diff(a, b)
        assert "".join(r for r, left, _ in runs if left) == a and "".join(r for r, _, right in runs if right) == b
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        assert sum(len(r) for r, left, right in runs if left and right) == table[0][0]
    long = "".join(rng.choice("acgt") for _ in range(6000))
    assert similarity.character_diff(long, long[:3000] + "X" + long[3001:]) in ([(long[:3000], True, True), (long[3000], True, False), ("X", False, True), (long[3001:], True, True)],)
    assert similarity.edit_preview("ACDE", "ACFE") == ["replace@3:D>F"]


def test_quantities(spark):
    rows = [("Binding_Kinetics_KD", "KD = 6.91 nM", 6.91), ("Binding_Kinetics_KD", "45pM", 0.045), ("Binding_Kinetics_KD", "1.74 x 10^(-9) M", 1.74), ("Binding_Kinetics_KD", "1.2 × 10⁻⁹ M", 1.2),
            ("Binding_Kinetics_kon", "2.5e5", 250000.0), ("Binding_Kinetics_KD", "3 ± 1 nM", None), ("Binding_Kinetics_KD", "1-2 and 3", None), ("Thermal_Stability_Tm", "65.3 °C", 65.3), ("Thermal_Stability_Tm", "5", None), ("Binding_EC50", None, None)]
    df = spark.createDataFrame(rows, "f string, t string, want double")
    for r in df.select("t", "want", units.quantity(F.col("f"), F.col("t")).alias("got")).collect():
        assert (r.got is None) == (r.want is None) and (r.want is None or abs(r.got - r.want) < 1e-9 * abs(r.want) + 1e-12), r


def test_empty_markers_and_names(spark):
    df = spark.createDataFrame([(None,), ("N/A (no light chain)",), ("not  specified",), ("see text",), ("未报道",), (" - ",)], "v string")
    assert [r[0] for r in df.select(text.is_empty(F.col("v"))).collect()] == [True, True, True, False, True, True]
    names = spark.createDataFrame([("L9", "L9K"), ("mAb-1", "MAB 1"), ("abc", "xabcx"), ("", "a"), ("abcd", "abxd")], "a string, b string")
    assert [r[0] for r in names.select(similarity.name_similarity(F.col("a"), F.col("b"))).collect()] == [0.85, 1.0, 0.95, 0.0, 0.75]


def test_sequences(spark):
    heavy = "EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAKDRGYYFDYWGQGTLVTVSS"
    df = spark.createDataFrame([(heavy,)], "s string")
    r = df.select(sequences.loop_of(F.col("s")), sequences.region_length(F.col("s"), "H"), sequences.full_region(F.col("s"), 160), sequences.variable_domain(F.concat(F.lit("MKT"), "s", F.lit("ASTK")), "H")).first()
    assert tuple(r) == ("CAKDRGYYFDYW", "pass", True, heavy)
    checks = df.select(sequences.checks({"H3": F.lit("CAKW"), "VH": F.col("s")}).alias("c")).first().c
    assert {c.check: c.status for c in checks} == {"H3_residues": "pass", "H3_length": "warn", "H3_start": "pass", "H3_end": "pass", "VH_residues": "pass", "VH_length": "pass"}
    assert values(spark, judge.rule_label(F.col("f"), F.col("a"), F.col("b")), [("Epitope", "x", "y")], "f string, a string, b string") == [None]


def test_merge_prefers_priority_and_first(spark):
    region = "A" * 90
    rows = [("p", "Ab-1", "vh_sequence_aa", region, "table", 1), ("p", "ab 1", "vh_sequence_aa", "C" * 90, "api", 2), ("p", "Ab1", "KD", "1 nM", "text", 1), ("p", "Ab1", "KD", "2 nM", "api", 2), ("p", "Ab1", "EC50", " ", "api", 2), ("p", "Ab1", "vl_sequence_aa", "short", "api", 3)]
    got = merge.merge_fields(spark.createDataFrame(rows, "paper_id string, name string, field string, value string, source string, seq int")).collect()
    assert {(r.field, r.value, r.source) for r in got} == {("vh_sequence_aa", "C" * 90, "api"), ("KD", "1 nM", "text")}


def test_peaks_by_key_and_in_all(spark):
    rng = random.Random(8)
    rows = [(k % 3, float(s), float(s + rng.randint(1, 9000))) for k in range(60) for s in [rng.randint(0, 20000)]]
    spans = spark.createDataFrame(rows, "key int, start double, end double")
    peak = lambda xs: max(sum(s <= t <= e for _, s, e in xs) for _, t, _ in xs)
    assert trace.peak_concurrency(spans).first().peak == peak(rows)
    assert {r.key: r.peak for r in trace.peak_concurrency(spans, ["key"]).collect()} == {k: peak([r for r in rows if r[0] == k]) for k in range(3)}


def test_upsert_keeps_creation(spark):
    schema = "k int, v string, at int, made int"
    old, new = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], schema), spark.createDataFrame([(1, "c", 2, 2), (3, "d", 2, 2)], schema)
    assert {tuple(r) for r in trace.upsert(old, new, ["k"], ["at"], "made").collect()} == {(1, "c", 2, 1), (2, "b", 1, 1), (3, "d", 2, 2)}


def test_files_are_read_and_written(spark, tmp_path):
    for name, body in (("p1/vlm/images_ocr_merged.md", "one"), ("p1/p1.md", "x"), ("p2/p2.md", "two")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    docs = files.read_documents(spark, str(tmp_path))
    assert {(r.paper_id, r.text) for r in docs.collect()} == {("vlm", "one"), ("p1", "x"), ("p2", "two")}
    assert {r.paper for r in files.choose_markdown(docs).collect()} == {"p1", "p2"}
    lines = [r.value for r in files.markdown_table(spark.createDataFrame([(2, "b|c"), (1, None)], "k int, v string"), ["k", "v"], ["k"]).collect()]
    assert lines == ["| k | v |", "| --- | --- |", "| 1 |  |", r"| 2 | b\|c |"]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("start", "a", "x", "2024-01-01 00:00:00"), ("end", "a", "x", "2024-01-01 00:05:00"), ("start", "b", "y", "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "event string, span_id string, name string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).parquet(str(source))
    q = traces.paired_stream(stream).writeStream.format("memory").queryName("paired").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert [r.span_id for r in spark.table("paired").collect()] == ["a"]
    q = traces.upsert_stream(stream, str(tmp_path / "t"), ["name"], ["ts"], str(tmp_path / "c2"))
    q.awaitTermination(60)
    assert {(r.name, r.event) for r in spark.read.parquet(str(tmp_path / "t/v0")).collect()} == {("x", "end"), ("y", "start")}


def test_pair_similarity_without_shared_context_is_that_of_the_names(spark):
    context = ("Target_Name", "Experiment")
    rows = [
        ("CR3022", "CR3022", None, None, None, None, 1.0),
        ("CR3022-long", "CR3022", None, None, None, None, 0.95),
        ("CR3022-long", "CR3022", "spike", None, None, "ELISA", 0.95),
        ("CR3022-long", "CR3022", "spike", "spike", None, None, 0.8 * 0.95 + 0.2),
        ("CR3022", "CR3022", "spike", "spike", "ELISA", "SPR", 0.98 + 0.02 * 0.75),
        ("abcd", "abxd", None, None, None, None, 0.75),
        ("abcd", "abxd", "spike", "spike", None, None, 0.85 * 0.75 + 0.15),
    ]
    names = ["l_n", "r_n", "l_t", "r_t", "l_e", "r_e", "want"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n == 'want' else 'string'}" for n in names))
    parts = {side + f: c for side in "lr" for f, c in similarity.pair_parts({"Antibody_Name": F.col(f"{side}_n"), "Target_Name": F.col(f"{side}_t"), "Experiment": F.col(f"{side}_e")}, "").items()}
    got = similarity.with_pair_similarity(df.select("*", *[c.alias(n) for n, c in parts.items()]), "l", "r", context).select("sim", "want").collect()
    assert [round(r["sim"], 9) for r in got] == [round(r["want"], 9) for r in got]
