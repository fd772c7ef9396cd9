"""Matching, evidence, scanners, tables and replies on the cases that their rules turn on."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import scan, sequences, similarity, units, validate
from lectern.operators import blocks, evidence, images, matching, papers, records, scoring, skeleton, tables
from lectern.sources import reports

HEAVY = "EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAKDRGYYFDYWGQGTLVTVSS"
LIGHT = "DIQMTQSPSSLSASVGDRVTITCRASQSISSYLNWYQQKPGKAPKLLIYAASSLQSGVPSRFSGSGSGTDFTLTISSLQPEDFATYYCQQSYSTPLTFGQGTKVEIK"
PAIR = "paper_id string, ab_idx long, Antibody_Name string, Target_Name string, Antibody_Type string, Experiment string, Structure string, Reference_Source string"


def rows_of(spark, names, schema=PAIR):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[""] * (width - len(r))) for r in names], schema)


def matched(spark, gt, pred):
    found = matching.match_records(rows_of(spark, [("p", i, *r) for i, r in enumerate(gt)]), rows_of(spark, [("p", i, *r) for i, r in enumerate(pred)]))
    return {(r.gt_idx, r.pred_idx) for r in found.collect()}


def test_equal_names_give_way_to_two_good_pairs(spark):
    assert matched(spark, [("ab",), ("abcdef",)], [("ab",), ("abxyzq",)]) == {(0, 1), (1, 0)}


def test_context_parts_equal_names_and_variants(spark):
    gt = [("EV35-2", "MPXV A35 clade IIb", "IgG"), ("EV35-2", "VACV A33", "IgG")]
    assert matched(spark, gt, [("EV35-2", "VACV A33", "IgG"), ("EV35-2", "MPXV A35", "IgG")]) == {(0, 1), (1, 0)}
    gt = [("L9", "PfCSP", "mAbs", "ITC,BLI,ELISA", "7RQP"), ("F10", "PfCSP", "mAbs", "ITC,BLI,ELISA")]
    pred = [("L9", "PfCSP", "IgG", "Flow Cytometry, ELISA, ITC, BLI", "7RQP"), ("F10", "PfCSP", "IgG", "Flow Cytometry, ELISA, ITC, BLI"), ("L9K", "PfCSP", "", "BLI,ELISA"), ("F10K", "PfCSP", "", "BLI,ELISA")]
    assert matched(spark, gt, pred) == {(0, 0), (1, 1)}
    assert matched(spark, [], [("X",)]) == set()


def brute_sim(a, b):
    from difflib import SequenceMatcher

    n = lambda s: (s or "").lower().strip().replace(" ", "").replace("-", "").replace("–", "").replace("_", "")
    g, p = n(a[0]), n(b[0])
    if not g or not p:
        name = 0.0
    elif g == p:
        name = 1.0
    elif not any(c in x for x in (a[0].strip(), b[0].strip()) for c in " -_–/") and max(g, p, key=len).startswith(min(g, p, key=len)) and 0 < abs(len(g) - len(p)) <= 2:
        name = 0.85
    else:
        name = 0.95 if g in p or p in g else SequenceMatcher(None, g, p).ratio()
    key = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    total = weight = 0
    for k, (f, w) in enumerate(similarity.CONTEXT.items(), 1):
        x, y = key(a[k]), key(b[k])
        if not x or not y:
            continue
        if x == y or x in y or y in x:
            s = 1.0 if x == y else 0.9
        elif f == "Experiment":
            u, v = ({key(t) for t in z.replace(";", ",").split(",") if key(t)} for z in (a[k], b[k]))
            s = len(u & v) / len(u | v)
        else:
            s = SequenceMatcher(None, x, y).ratio()
        total, weight = total + s * w, weight + w
    if not weight:
        return name
    c = total / weight
    return min(1, 0.98 + 0.02 * c) if g == p else min(1, 0.8 * name + 0.2 * c) if name >= 0.95 else 0.85 * name + 0.15 * c


def test_matching_is_the_best_of_all_assignments(spark):
    rng = random.Random(3)
    pick = lambda *xs: rng.choice(xs)
    make = lambda: (pick("L9", "L9K", "F10", "mAb-1", "MAB 1", "ab12", "ab1", "zzq", ""), pick("CD4", "CD40", "spike", ""), pick("IgG", "mAb", ""), pick("SPR, BLI", "BLI; ELISA", ""), pick("7ABC", ""), pick("Smith 2020", "Kim 2019", ""))
    sides = {k: ([make() for _ in range(rng.randint(1, 4))], [make() for _ in range(rng.randint(1, 4))]) for k in range(12)}
    gt = rows_of(spark, [(str(k), i, *r) for k, (a, _) in sides.items() for i, r in enumerate(a)])
    pred = rows_of(spark, [(str(k), i, *r) for k, (_, b) in sides.items() for i, r in enumerate(b)])
    found = {}
    for r in matching.match_records(gt, pred).collect():
        found.setdefault(r.paper_id, []).append((r.gt_idx, r.pred_idx, r.sim))
    for k, (a, b) in sides.items():
        sims = [[brute_sim(x, y) for y in b] for x in a]
        n = max(len(a), len(b))
        total = lambda order: sum(sims[i][j] for i, j in enumerate(order[: len(a)]) if j < len(b))
        best = max(map(total, itertools.permutations(range(n))))
        got = found.get(str(k), [])
        assert all(abs(s - sims[i][j]) < 1e-9 and s >= 0.5 for i, j, s in got)
        used_g, used_p = {i for i, *_ in got}, {j for _, j, _ in got}
        rest = [[sims[i][j] for j in range(len(b)) if j not in used_p] for i in range(len(a)) if i not in used_g]
        left = sum(sorted((max(r, default=0) for r in rest), reverse=True)[: len(b) - len(used_p)]) if rest else 0
        assert sum(s for *_, s in got) <= best + 1e-9 and sum(s for *_, s in got) + left >= best - 1e-9


def test_papers_without_ground_truth_or_output_do_not_count(spark):
    records_ = spark.createDataFrame([("a", 0, True, 1.0), ("b", 0, False, 0.0)], "paper_id string, ab_idx int, matched boolean, ratio double")
    extra = spark.createDataFrame([("x", 3)], "paper_id string, nfp long")
    per = scoring.score_papers(records_, extra, spark.createDataFrame([("a",), ("b",), ("empty",)], "paper_id string"))
    assert {r.paper_id: r.accuracy for r in per.collect()} == {"a": 100.0, "b": 0.0, "empty": 0.0}
    pred = spark.createDataFrame([("a", 0, "n", None), ("b", 0, " ", "x"), ("empty", 0, "", "y")], "paper_id string, ab_idx int, Antibody_Name string, field_sources string")
    out = scoring.papers_with_output(pred)
    assert {r.paper_id for r in out.collect()} == {"a"}
    total = scoring.score_benchmark(per, out).first()
    assert (total.papers, total.papers_without_output, total.accuracy, total.ab_precision) == (1, 2, 100.0, 1.0)


def record(**given):
    base = {"source": "table_extract", "priority": 1, "pdb": False, "text": False, "discovered": False, "derived": "", "vh": "", "wrong_chain": set(), "whole": {"vh_sequence_aa", "vl_sequence_aa"}}
    kind = given.get("source", "table_extract")
    return base | {"priority": evidence.PRIORITY.get(kind, 0), "discovered": kind in ("sequence_image", "ocr_text_sequence"), "text": kind == "ocr_text_sequence"} | given


@pytest.mark.parametrize("case, want", [
    (("vh_sequence_aa", "", "", "V", record(), True), ("write", "V")),
    (("vh_sequence_aa", "A", "", "V", record(whole=set()), True), ("keep", "A")),
    (("vh_sequence_aa", "A", "", "V", record(wrong_chain={"vh_sequence_aa"}), True), ("skip_chain_mismatch", "A")),
    (("vh_sequence_aa", "V", "table_extract", "V", record(source="api_fetch"), True), ("refresh", "V")),
    (("vh_sequence_aa", "V", "api_fetch", "V", record(), True), ("keep", "V")),
    (("vh_sequence_aa", "A", "api_fetch", "V", record(source="sequence_image"), True), ("keep_existing_higher_priority", "A")),
    (("vh_sequence_aa", "A", "table_extract", "V", record(source="api_fetch", pdb=True), True), ("replace_with_pdb_authoritative", "V")),
    (("vh_sequence_aa", "A", "table_extract", "V", record(source="sequence_image"), True), ("replace_with_higher_priority_sequence", "V")),
    (("vh_sequence_aa", "A", "figure_or_image", "V", record(source="ocr_text_sequence"), True), ("write", "V")),
    (("vh_sequence_aa", "A", "table_extract", "V", record(), True), ("keep", "A")),
    (("vh_sequence_aa", "A", "", "V", record(), True), ("replace_with_higher_priority_sequence", "V")),
    (("vh_sequence_aa", "A", "api_fetch", "V", record(source="api_fetch"), True), ("replace_with_authoritative", "V")),
    (("Binding_Kinetics_KD", "1 nM", "", "2 nM", record(source="api_fetch"), True), ("keep", "1 nM")),
    (("Binding_EC50", "1 nM", "", "2 nM", record(), False), ("write", "2 nM")),
    (("Structure", "7ABC", "", "7ABC", record(), True), ("refresh", "7ABC")),
    (("CDRH3_Sequence", "CARW", "", "", record(), True), ("keep", "CARW")),
    (("CDRH3_Sequence", "ARDY", "", "CARDYW", record(), True), ("write", "CARDYW")),
    (("CDRH3_Sequence", "CARDYW", "", "ARDY", record(), True), ("keep", "CARDYW")),
    (("CDRH3_Sequence", "CXXW", "", "CYYW", record(source="api_fetch", derived="CARW", vh="..CARW.."), True), ("replace_with_authoritative", "CARW")),
    (("CDRH3_Sequence", "CXXW", "", "CYYW", record(derived="CARW", vh="..CARW.."), True), ("write", "CARW")),
    (("CDRH3_Sequence", "CXXW", "paper_text", "CYYW", record(derived="CARW", vh="..CARW.."), True), ("keep", "CXXW")),
    (("CDRH3_Sequence", "", "", "", record(derived="CARW", vh="..CARW.."), True), ("write", "CARW")),
])
def test_merge_decisions(case, want):
    assert evidence.decide(*case) == want


def test_evidence_fills_opens_and_refuses(spark):
    own = spark.createDataFrame([("p", "Ab1", "", "1 nM", {"vh_sequence_aa": ""}), ("p", "Ab2", "", "", None)], "paper_id string, name string, vh_sequence_aa string, Binding_Kinetics_KD string, sources map<string,string>")
    schema = "paper_id string, name string, seq int, vh_sequence_aa string, vl_sequence_aa string, CDRH3_Sequence string, Binding_Kinetics_KD string, source string, pointer string, context string, pdb boolean, isotype string"
    given = [
        ("p", "ab1", 1, HEAVY, "", "", "9 nM", "sequence_image", "img1.png", "", False, ""), ("p", "Ab2 ", 2, LIGHT, "", "", "", "table_extract", "", "", False, ""),
        ("p", "new", 3, HEAVY, "", "", "", "sequence_image", "img2.png", "", None, ""), ("p", "cited", 4, HEAVY, "", "", "", "sequence_image", "", "previously described antibodies", False, ""),
        ("p", "bare", 5, "", "", "CAR", "1 nM", "table_extract", "", "", False, ""), ("p", "iso", 6, "", "", "CARDYW", "", "table_extract", "", "", False, "IgG1"), (None, "", 7, "", "", "", "", "", "", "", False, ""),
    ]
    got = evidence.merge_evidence(own, spark.createDataFrame(given, schema)).collect()
    value = {(r.name_key, r.field): (r.value, r.source) for r in got if r.action == "value"}
    assert value["ab1", "vh_sequence_aa"] == (HEAVY, "sequence_image") and value["ab1", "Binding_Kinetics_KD"][0] == "1 nM"
    assert value["ab1", "CDRH3_Sequence"][0] == "CAKDRGYYFDYW"
    assert ("ab2", "vh_sequence_aa") not in value and ("ab2", "vh_sequence_aa", "skip_chain_mismatch") in {(r.name_key, r.field, r.action) for r in got}
    assert {r.name_key for r in got if r.created} == {"new", "iso"} and not {"cited", "bare"} & {r.name_key for r in got}
    assert evidence.merge_evidence(own.limit(0), spark.createDataFrame([], schema)).count() == 0


def test_reagent_numbers_are_no_accessions(spark):
    far = "x" * 130
    t = f"GenBank MN123456 {far} catalog no. AB12345 {far} (Acme Inc., X54321) {far} PB100001 {far} AAA12345"
    hits = spark.createDataFrame([(t,), (None,)], "t string").select(scan.accession_hits(F.col("t"))).collect()
    assert [(h.id, h.kind, h.reagent) for h in hits[0][0]] == [("MN123456", "nucleotide", False), ("AB12345", "nucleotide", True), ("X54321", "nucleotide", True), ("PB100001", "nucleotide", True), ("AAA12345", "protein", False)]
    assert hits[1][0] == []
    names = "clone 4G2 and 315-H10, tixagevimab, COVID, IGHV1-2, CDRH3, DENV1-treated, ABC123456, mAb CR3022"
    assert spark.range(1).select(scan.antibody_names(F.lit(names))).first()[0] == ["315-H10", "4G2", "CR3022", "DENV1", "tixagevimab"]


def test_table_edges_and_headers():
    assert tables.pipe_tables("|| x |\n| a ||\n") == [[["", "x"], ["a", ""]]] or tables.pipe_tables("|| x |\n| a ||\n") == [[["", "x"], ["a"]]]
    assert tables.header_names(["Clone", "V region identity", "Identity (%)"]) == ["mAb", "VH_identity_pct", "VL_identity_pct"]


def test_fragments_end_at_other_rows(spark):
    p = "<td>EVQLVESGGG</td><td>LVQPGGSLRL</td><td>SCAASGFTFS</td><td>SYAMSWVRQA</td>"
    row = lambda head: f"<tr><td>{head}</td><td>1</td>{p}</tr>"
    t = "<table><tr><th>Antibody</th><th>SEQ ID</th></tr>" + row("A1 (VH)") + row("") + row("A1 heavy") + row("B2 (light)") + row("") + "<tr><td>note</td></tr>" + row("") + "</table>"
    got = tables.fragment_records(tables.table_cells(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t"), "k").collect()
    assert {(r.name, r.chain, len(r.sequence)) for r in got} == {("A1", "VH", 120), ("B2", "VL", 80)}


def test_replies_of_all_shapes(spark):
    one = '{"Antibody_Name": "A", "Experiment": "western blot, SPR", "Binding_Kinetics_KD": {"value": "", "pointer": "Table 1", "action": "Script Extract"}, "Mechanism_of_Action": [{"MoA_Type": {"value": "blocks"}, "Quantitative_Metric": {"metric_name": "IC50", "metric_value": "3"}}], "Experiment_value": [{"assay": "EC50", "value": "7 nM"}], "vh_sequence_aa": "%s", "_x": 1}' % HEAVY.lower()
    shapes = [f'{{"p": {{"antibodies": [{one}]}}}}', f'{{"antibodies": [{one}]}}', f"[{one}]", f'{{"q": {{"antibodies": [{one}]}}}}', one, "no json", None, "3"]
    rows = skeleton.reply_records(spark.createDataFrame([("p", s, i) for i, s in enumerate(shapes)], "paper_id string, reply string, i int")).collect()
    assert len(rows) == 5
    for r in rows:
        assert r.record == {"Antibody_Name": "A", "Experiment": "SPR", "Binding_Kinetics_KD": "", "Mechanism_of_Action": "blocks", "Quantitative_Metric": "IC50 = 3", "Binding_EC50": "7 nM", "vh_sequence_aa": HEAVY}
        assert "Table 1" in r.hints["Binding_Kinetics_KD"]


def test_pages_stop_and_fuller_records_stay(spark):
    page = lambda p, n, more, **f: ("x", p, more, n, {"Antibody_Name": f"a{n}", **f})
    rows = [page(1, 0, True), page(1, 1, True), page(2, 0, True, Binding_EC50="1"), page(2, 2, True), page(3, 1, True), page(4, 9, True)]
    got = skeleton.one_list(spark.createDataFrame(rows, "paper_id string, page int, has_more boolean, ab_idx int, record map<string,string>"), 10).collect()
    assert {r.identity: len(r.record) for r in got} == {"a0": 2, "a1": 1, "a2": 1}


def test_sequences_by_motif(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert get(sequences.variable_domain(lit("MKT" + HEAVY + "ASTKG"), "H")) == HEAVY and get(sequences.variable_domain(lit("MK" + LIGHT + "RTVA"), "L")) == LIGHT
    both = get(sequences.single_chain_domains(lit(HEAVY + "GGGGSGGGGSGGGGS" + LIGHT)))
    assert (both.heavy, both.light) == (HEAVY, LIGHT)
    assert get(sequences.loop_of(lit(HEAVY))) == "CAKDRGYYFDYW" and get(sequences.loop_core(lit(HEAVY))) == "AKDRGYYFDY"
    assert get(sequences.untangled(lit("CAKDRGYYFDYQQSYSTPLT"), lit(HEAVY))) == "CAKDRGYYFDY" and get(sequences.untangled(lit("CAKDRGYYFDYW"), lit(HEAVY))) == "CAKDRGYYFDYW"
    assert get(sequences.chain_of(lit(LIGHT))) == "light" and get(sequences.chain_of(lit("ACD"))) == "unknown"
    assert get(sequences.variable_domain(lit(""), "H")) == "" and get(sequences.loop_of(lit(None).cast("string"))) == ""
    r = get(sequences.conflict_report(lit("ACD"), lit(HEAVY)))
    assert r.replace and r.verdict == "different"


def test_reports_are_read_back(spark):
    fields = spark.createDataFrame([("p", 0, "Structure", "a|b", "x" * 60, "partial", 0.5, 1.0, 0.5, "why")], "paper_id string, ab_idx long, field string, gt string, pred string, label string, score double, weight double, weighted_score double, reason string")
    per = spark.createDataFrame([("p", 0, "L9 unmatched", True, 0.5)], "paper_id string, ab_idx long, name string, matched boolean, ratio double")
    paper = spark.createDataFrame([("p", 1, 1, 0, 0, 50.0, 1.0, 50.0)], "paper_id string, ngs long, ntp long, nfn long, nfp long, raw double, penalty double, accuracy double")
    r = reports.parse_report(reports.markdown_report(paper, per, fields)).first()
    assert (r.record, r.matched, r.field, r.weight, r.gt, r.pred, r.label, r.score) == ("L9 unmatched", True, "Structure", 1.0, "a|b", "x" * 50 + "...", "partial", 0.5)


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([(None, None)], "k int, t string")
    t = F.col("t")
    for c in (scan.bundle(t), scan.hint_text(scan.bundle(t)), validate.assay_list(t), sequences.single_chain_domains(t), units.quantity(F.lit("Binding_EC50"), t), papers.plausible_accessions(t), images.without_supplements(t, ["x"]), papers.front_matter(t), records.target_list(t)):
        none.select(c).collect()
    assert tables.fragment_records(tables.table_cells(none, "k", "t"), "k").count() == 0
    assert images.alignment_records(none.select("k", t.alias("block"), t.alias("context")), ["k"]).count() == 0
    assert blocks.ranked_names(none.select("k", "t", F.array().cast("array<string>").alias("names")), "k").count() == 0
    assert spark.range(1).select(blocks.first_occurrences(F.array(F.lit("b"), F.lit("A"), F.lit("a"), F.lit("B"), F.lit("c")))).first()[0] == ["b", "A", "c"]
