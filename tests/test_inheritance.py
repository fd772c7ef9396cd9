"""Chains of variants: the cases of a paper by hand, and random families against a walk through names."""

import random

from pyspark.sql import functions as F

from lectern.operators import inheritance, papers

HEAVY = "QVQLVQSGAEVKKPGASVKVSCKASGYTFTSYYMHWVRQAPGQGLEWMGIINSSGGSTSYAQKFQGRVTMTRDTSTSTVYMELSSLRSEDTAVYYCARPPRNYYDRSGYYQRAEYFQHWGQGTLVTVSS"
LIGHT = "DIQMTQSPSSLSASVGDRVTITCQASQDISNYLNWYQQRPGKAPKLLIYDASNLETGVPSRFSGSGSGTDFTFTISSLQPEDIATYYCQQYDNPPLTFGGGTKLEIK"
SCHEMA = "paper_id string, idx int, name string, vh_sequence_aa string, vl_sequence_aa string, CDRH3_Sequence string"


def taken(spark, rows, body):
    got = inheritance.inherited_chains(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("p", body)], "paper_id string, text string"))
    return {(r.name, r.field): (r.value, r.from_antibody, r.origin, r.evidence) for r in got.collect()}


def test_a_chimera_keeps_both_chains_of_its_parent(spark):
    body = "Supplementary Fig. 3. The VRC01 FR3-03 chimeric antibody retained the same light chain as WT. Its heavy chain was unchanged relative to the wild-type VRC01 framework."
    got = taken(spark, [("p", 0, "VRC01", HEAVY, LIGHT, "CARPP"), ("p", 1, "VRC01 FR3-03", "", "n/a", "")], body)
    assert got["VRC01 FR3-03", "vl_sequence_aa"] == (LIGHT, "VRC01", "vrc01", "The VRC01 FR3-03 chimeric antibody retained the same light chain as WT.")
    assert got["VRC01 FR3-03", "vh_sequence_aa"][0] == HEAVY and got["VRC01 FR3-03", "CDRH3_Sequence"][0].startswith("C") and len(got) == 3


def test_variants_of_variants_and_wrong_chains(spark):
    body = "The light chain of Ab7-H2 is identical to the parent Ab7.\nAb7-H2-LS retained the light chain of Ab7-H2; Ab7-H2-LS-x9 shared the vl of Ab7-H2-LS. The heavy chain of Ab7-H2 is the same as in Ab7."
    rows = [("p", 0, "Ab7", LIGHT, LIGHT, ""), ("p", 1, "Ab7-H2", "", "", ""), ("p", 2, "Ab7-H2-LS", "", "", "x"), ("p", 3, "Ab7-H2-LS-x9", HEAVY, "", ""), ("p", 4, None, "", "", ""), ("p", 5, "Ab7-H2", "", LIGHT[1:], "")]
    got = taken(spark, rows, body)
    # the heavy field of Ab7 holds a light chain, and the best record of Ab7-H2 has a chain of its own
    assert {k: v[:3] for k, v in got.items()} == {
        ("Ab7-H2", "vl_sequence_aa"): (LIGHT, "Ab7", "ab7"), ("Ab7-H2-LS", "vl_sequence_aa"): (LIGHT[1:], "Ab7-H2", "ab7-h2"), ("Ab7-H2-LS-x9", "vl_sequence_aa"): (LIGHT[1:], "Ab7-H2-LS", "ab7-h2"),
    }
    assert taken(spark, rows[:4], "The heavy chain is identical.") == {} and taken(spark, [], body) == {} and taken(spark, rows[:4], None) == {}


def test_candidates_by_rank(spark):
    names = ["Ab7", "Ab7 wild-type", "Ab7-H2", "xAb7", "Ab 7 D54G", "b7", "Z Ab7 FR1-2", "AB7"]
    df = spark.createDataFrame([("p", n) for n in names], "paper_id string, name string")
    got = {(r.child, r.parent): r["rank"] for r in inheritance.candidate_parents(df).collect()}
    key = lambda n: "".join(c for c in n.lower() if c.isalnum())
    bare = {"Ab7 wild-type": "ab7", "Ab 7 D54G": "ab7", "Z Ab7 FR1-2": "zab7"}
    want = {}
    for c in names:
        for p in names:
            b = bare.get(c, key(c))
            if p != c and len(key(p)) < len(key(c)):
                rank = 3 if b == key(p) else 2 if key(c).startswith(key(p)) or key(c).endswith(key(p)) else 1 if b.startswith(key(p)) or b.endswith(key(p)) else 0
                if rank:
                    want[c, p] = rank
    assert got == want and got["Z Ab7 FR1-2", "Ab7"] == 1


def test_random_families_match_a_walk_by_length(spark):
    rng = random.Random(11)
    rows, texts = [], []
    for p in range(12):
        names = ["Ab7"]
        while len(names) < 9:
            names.append(rng.choice(names) + rng.choice(["-H2", "-LS", " x9", "-v3"]))
        names = sorted(set(names))
        says = [(c, q, f) for c in names for q in names if c != q and rng.random() < 0.25 for f in ("heavy", "light") if rng.random() < 0.7]
        rows += [(f"p{p}", i, n, HEAVY[i:] if rng.random() < 0.3 else "", LIGHT[i:] if rng.random() < 0.3 else "", "x") for i, n in enumerate(names)]
        texts.append((f"p{p}", " ".join(f"{c} retained the {f} chain as in {q}." for c, q, f in says)))
    r = spark.createDataFrame(rows, SCHEMA)
    got = {(x.paper_id, x.name, x.field): (x.value, x.from_antibody) for x in inheritance.inherited_chains(r, spark.createDataFrame(texts, "paper_id string, text string")).collect()}
    ranks = {(x.paper_id, x.child, x.parent): (x["rank"], x["size"]) for x in inheritance.candidate_parents(r).collect()}
    clause = {(p, f): [c for c in t.split(". ") if f" {f} " in c] for p, t in texts for f in ("heavy", "light")}
    want = {}
    for p, _ in texts:
        have = {(n, f): v for q, _, n, h, li, _ in rows if q == p for f, v in (("vh_sequence_aa", h), ("vl_sequence_aa", li)) if v}
        for c in sorted({n for q, _, n, *_ in rows if q == p}, key=lambda n: len(papers_key(n))):
            for q in sorted((b for (x, a, b) in ranks if x == p and a == c), key=lambda b: (-ranks[p, c, b][0], -ranks[p, c, b][1], b)):
                some = [f for f, w in (("vh_sequence_aa", "heavy"), ("vl_sequence_aa", "light")) if (c, f) not in have and (q, f) in have and any(about(x, c, q) for x in clause[p, w])]
                if some:
                    for f in some:
                        want[p, c, f] = (have[q, f], q)
                    have |= {(c, f): have[q, f] for f in some}
                    break
    assert got == want and len(want) > 20


def papers_key(n):
    return "".join(c for c in n.lower() if c.isalnum())


def about(clause, child, parent):
    key, low = papers_key(clause), clause.lower()
    extra = [t for t in child.lower().replace("-", " ").split() if t not in parent.lower().replace("-", " ").split() and len(t) >= 2]
    return papers_key(parent) in key and (papers_key(child) in key or papers_key(parent) in key or any(t in low for t in extra))


def test_clauses_keep_their_order(spark):
    df = spark.createDataFrame([("One. Two;  three\n\nTwo;\tfour: x",)], "t string")
    assert df.select(papers.clauses(F.col("t"))).first()[0] == ["One.", "Two;", "three", "four:", "x"]
