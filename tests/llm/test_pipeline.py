"""The pipeline against brute force, stage by stage, on plain and on odd tables."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from lectern.llm import decontam, queries, sentencepiece
from lectern.llm.common import fold, shared_dir
from tests.llm.test_models import edits
from tests.llm.test_neardup import brute_components

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def stages(spark, docs, sf, names=None):
    """Rows that each stage gives, each read by the next."""
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        if names is None or name in names:
            after = stage(spark, docs, sf)
            if name != "encoding":
                assert after.columns == docs.columns
                docs = spark.createDataFrame(kept.setdefault(name, after.collect()), docs.schema)
            else:
                kept[name] = after.collect()
    return kept


def brute_exact(rows):
    least = {}
    for i, t in rows:
        key = SPACE.sub(" ", t or "")
        if key not in least or (i is not None and (least[key] is None or i < least[key])):
            least[key] = i
    return sorted(map(str, least.values()))


def test_stages_agree_with_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages(spark, docs, sf)
    rows = {name: [(r.doc_id, r.text) for r in found] for name, found in kept.items() if name != "encoding"}
    # quality: the labels that it could not see
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = {r.doc_id: r.quality for r in labels.filter(fold(labels["doc_id"], 4) == 2).collect() if r.quality is not None}
    stays = {i for i, _ in rows["quality"]}
    right = [(i in stays) == bool(q) for i, q in held.items()]
    assert len(right) >= 5 and sum(right) >= 0.9 * len(right)
    assert sorted(str(i) for i, _ in rows["exact_dedup"]) == brute_exact(rows["quality"])
    assert sorted(str(i) for i, _ in rows["near_dedup"]) == sorted(k for k, c in brute_components(rows["exact_dedup"]) if k == c)
    bench = [decontam.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text]
    holds = lambda t: any(b in t if len(b) < 20 else near(b, t) for b in bench)

    def near(b, t):
        k = decontam.edits_allowed(b)
        return any(b[len(b) * i // (k + 1) : len(b) * (i + 1) // (k + 1)] in t for i in range(k + 1)) and edits(b, t) <= k

    clean = {i for i, t in rows["near_dedup"] if not holds(decontam.normal(t))}
    assert {i for i, _ in rows["decontamination"]} == clean
    decode = sentencepiece.Decoder(sentencepiece.read_vocabulary()).decode
    texts = dict(rows["quality"])
    assert {r.doc_id: decode(r.ids) for r in kept["encoding"]} == {i: texts[i] for i in clean}


def test_run_is_the_stages_and_leaves_no_intermediate_tables(spark, sf):
    shared = Path(shared_dir(spark).removeprefix("file:")) / "lectern"
    before = set(shared.iterdir()) if shared.exists() else set()
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert len(set(shared.iterdir()) - before) == 1
    want = {r.doc_id: list(r.ids) for r in stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)["encoding"]}
    assert got == want


ODD = [(1, None), (2, ""), (3, "  "), (None, "a text without an id"), (None, "a text without an id"), (4, "a repeated row of some words"), (4, "a repeated row of some words"), (5, "long " * 30000), (6, "z" * 200000), (7, "a text without an id")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows_and_clashing_names(spark, sf, tmp_path, rows):
    schema = "doc_id long, text string, _sha string, node string, fp long, keep_id long, ids string, y int, u string, id long"
    docs = spark.createDataFrame([(i, t, "s", "n", 1, 2, "k", 0, "u", 9) for i, t in rows], schema)
    for table, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{table}.parquet")
    kept = stages(spark, docs, str(tmp_path))
    got = {name: [(r.doc_id, r.text) for r in found] for name, found in kept.items() if name != "encoding"}
    assert sorted(map(str, got["quality"])) == sorted(map(str, rows))  # nothing to learn from: all stay
    assert sorted(str(i) for i, _ in got["exact_dedup"]) == brute_exact(rows)
    assert sorted(map(str, got["decontamination"])) == sorted(map(str, got["near_dedup"]))
    assert len(kept["encoding"]) == len(got["decontamination"]) and all(r.round_trip for r in kept["encoding"])


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
