"""Plans and costs that larger tables turn on."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from lectern.functions import sequences
from lectern.operators import evidence, papers
from lectern.plans import repairs
from lectern.sources import workbooks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_evidence_is_joined_by_a_shuffle_however_small_its_files(spark, tmp_path):
    """Texts are rendered from narrow rows, so the files say little of the size of a side."""
    spark.range(100).select(F.col("id").cast("string").alias("k")).write.parquet(str(tmp_path / "k"))
    k = spark.read.parquet(str(tmp_path / "k"))
    field = F.lit("Structure").alias("field")
    own = k.select(F.col("k").alias("paper_id"), F.lit("a").alias("name"), field, F.repeat("k", F.lit(3)).alias("value"))
    found = papers.matched_sources(own, own.withColumns({"source": F.lit("api"), "seq": F.lit(1)}))
    assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)
    assert found.filter("source = 'api'").count() == 100


def test_a_line_of_an_alignment_costs_its_length(spark):
    rng = random.Random(5)
    lines = ["...WO-....", "", "-", ".", "a.b-c", "QQQQQQQQQQQQQQQQ", *["".join(rng.choice("..-AC0 ") for _ in range(rng.randrange(1, 30))) for _ in range(40)]]
    ref = "acdEFGHI-KLMN.PQ"

    def written_out(line):
        line = "".join(line.split()).upper().translate(str.maketrans("0O1", "QQI"))
        return "".join((ref.upper()[i : i + 1] if c == "." else "" if c == "-" else c) for i, c in enumerate(line)) + ref.upper()[len(line) :]

    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", sequences.from_alignment(F.lit(ref), F.col("x")).alias("s"))
    assert [r.s for r in df.collect()] == [written_out(x) for x in lines]
    long = spark.createDataFrame([("ACDEFGHIKL" * 4000,)], "r string").select(sequences.from_alignment(F.col("r"), F.concat(F.repeat(F.lit("."), F.lit(39_999)), F.lit("W"))).alias("s"))
    began = time.time()
    assert long.first().s == ("ACDEFGHIKL" * 4000)[:-1] + "W"
    assert time.time() - began < 10


def test_starts_of_a_long_chain_cost_its_length(spark):
    rng = random.Random(7)
    pieces = [*sequences.STARTS["H"], *sequences.STARTS["L"], "QL", "LQL", "A", "GGG", "VTQ"]
    texts = ["", "A", "QLQLQLQ", *["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(60)]]

    def places(s, chain, within):
        return [i + 1 for i in range(len(s)) if any(s[i : min(len(s), within)].startswith(m) for m in sequences.STARTS[chain])]

    found = [sequences._start_places(F.col("s"), "H", 140).alias("h"), sequences._start_places(F.col("s"), "L").alias("l")]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", *found).collect()
    assert [(r.h, r.l) for r in got] == [(places(t, "H", 140), places(t, "L", len(t))) for t in texts]
    one = spark.createDataFrame([("A" * 50_000 + "DIQMTQ",)], "s string").select(sequences._start_places(F.col("s"), "L").alias("l"))
    began = time.time()
    assert one.first().l == [50_001]
    assert time.time() - began < 5


def test_an_antibody_of_many_batches_is_merged_as_one(spark):
    """Evidence streams by in order: no table of its own for each antibody, and batches may end within one."""
    heavy = "EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAKDRGYYFDYWGQGTLVTVSS"
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(3)}", rng.choice(["Ab1", "ab1 ", "Ab2", "Ab3"]), i, heavy[rng.randrange(9) :], rng.choice(sorted(evidence.PRIORITY)), f"{i} nM", f"at {i}", "", False, "IgG1") for i in range(120)]
    schema = "paper_id string, name string, seq int, vh_sequence_aa string, source string, Binding_Kinetics_KD string, pointer string, context string, pdb boolean, isotype string"
    own = spark.createDataFrame([("p0", "Ab1", "1 pM"), ("p9", "Ab9", "2 pM")], "paper_id string, name string, Binding_Kinetics_KD string")
    merged = lambda: evidence.merge_evidence(own, spark.createDataFrame(rows, schema))
    whole = sorted(map(tuple, merged().collect()), key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, merged().collect()), key=repr) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    value = {(r[0], r[1], r[3]): r[4] for r in whole if r[7] == "value"}
    first = {}
    for paper, name, seq, *_ in rows:
        first.setdefault((paper, name.strip().lower()), f"{seq} nM")
    assert {k[:2]: v for k, v in value.items() if k[2] == "Binding_Kinetics_KD"} == first | {("p0", "ab1"): "1 pM", ("p9", "ab9"): "2 pM"}
    assert "FlatMapGroups" not in plan(merged()) and "MapInArrow" in plan(merged())


def test_a_sheet_of_many_columns_costs_their_number(spark):
    many = 12_000
    columns = [{"k": k, "sheet": f"s{k % 2}", "values": [f"Ab{k}" if k % 5 else " ", *["x"] * 6]} for k in range(many)]
    began = time.time()
    (book,) = repairs._books(iter([pd.DataFrame({"n": [1], "columns": [columns]})]))
    took = time.time() - began
    files = spark.createDataFrame([(book["path"][0], bytearray(book["content"][0]))], "path string, content binary")
    found = workbooks.workbook_records(workbooks.workbook_cells(files), ("path", "sheet"))
    got = sorted((r.sheet, r.ab_idx, r.record["Antibody_Name"]) for r in found.collect())
    assert got == sorted((s, i, f"Ab{k}") for s, start in (("s0", 0), ("s1", 1)) for i, k in enumerate(k for k in range(start, many, 2) if k % 5))
    assert took < 4 and "collect_list" not in plan(found)
