"""Flat files against a parser of lines, locations against a recursive reading."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import accessions
from lectern.sources import flatfiles

HEAVY = "QVQLVQSGAEVKKPGASVKVSCKASGYTFTSYYMHWVRQAPGQGLEWMGIINSSGGSTSYAQKFQGRVTMTRDTSTSTVYMELSSLRSEDTAVYYCARPPRNYYDRSGYYQRAEYFQHWGQGTLVTVSS"
RECORD = f"""LOCUS       MT599835                 390 bp    mRNA    linear   PRI 01-JAN-2020
DEFINITION  Homo sapiens isolate COVA1-16 anti-SARS-CoV-2 monoclonal antibody
            heavy chain variable region mRNA, partial cds.
ACCESSION   MT599835 MT599836
VERSION     MT599835.2
KEYWORDS    .
SOURCE      Homo sapiens (human)
  ORGANISM  Homo sapiens
            Eukaryota; Metazoa.
FEATURES             Location/Qualifiers
     source          1..390
                     /organism="Homo sapiens"
     CDS             join(<1..12,complement(order(20..25,
                     30..>36)))
                     /codon_start=1
                     /pseudo
                     /product="immunoglobulin heavy chain
                     variable region"
                     /note="says ""so"" and
                     /not a qualifier"
                     /note="second"
                     /protein_id="QKX1.1"
                     /translation="{HEAVY[:50]}
                     {HEAVY[50:]}"
ORIGIN
        1 acgtacgtac ggttaaccgg ttaaccggtt
       31 ccggttaacc
"""


def test_a_record(spark):
    df = spark.createDataFrame([(RECORD,), (RECORD.replace("\n", "\r\n"),), ("",), (None,), ("\n",)], "value string")
    rows = flatfiles.parse_records(df).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    r = rows[0]
    assert (r.accession, r.record_id, r.molecule, r.organism) == ("MT599835", "MT599835.2", "nucleotide", "Homo sapiens")
    assert r.description == "Homo sapiens isolate COVA1-16 anti-SARS-CoV-2 monoclonal antibody heavy chain variable region mRNA, partial cds"
    assert r.sequence == "acgtacgtacggttaaccggttaaccggttccggttaacc"
    assert [f.key for f in r.features] == ["source", "CDS"]
    cds = r.features[1]
    assert cds.location == "join(<1..12,complement(order(20..25,30..>36)))"
    assert [tuple(q) for q in cds.qualifiers] == [
        ("codon_start", "1"), ("pseudo", ""), ("product", "immunoglobulin heavy chain variable region"), ("note", 'says "so" and /not a qualifier'), ("note", "second"), ("protein_id", "QKX1.1"), ("translation", HEAVY),
    ]
    f = flatfiles.coding_features(flatfiles.parse_records(df)).first()
    assert (f.chain, f.is_variable, f.note, f.translation) == ("heavy", True, 'says "so" and /not a qualifier second', HEAVY)
    assert f.location == "order{[<0:12](+), [29:>36](-), [19:25](-)}"
    assert flatfiles.chain_infos(flatfiles.coding_features(flatfiles.parse_records(df)), "VH").count() == 1
    assert flatfiles.chain_infos(flatfiles.coding_features(flatfiles.parse_records(df)), "VL").count() == 0


def test_protein_records_are_told_by_length(spark):
    def record(name, n, what):
        return f"LOCUS       {name}            {n} aa            linear   PRI 01-JAN-2020\nDEFINITION  {what}.\nACCESSION   {name}\nORIGIN\n        1 " + "qvqlvqsgae" * (n // 10) + "q" * (n % 10) + "\n"

    rows = [(record("AAA00001", 120, "some protein"),), (record("AAA00002", 90, "some protein"),), (record("AAA00003", 200, "some protein"),), (record("AAA00004", 120, "antibody kappa light chain variable region"),)]
    got = {r.accession: (r.chain, len(r.translation), r.is_variable) for r in flatfiles.coding_features(flatfiles.parse_records(spark.createDataFrame(rows, "value string"))).collect()}
    assert got == {"AAA00001": ("heavy", 120, False), "AAA00002": ("light", 90, False), "AAA00003": ("unknown", 200, False), "AAA00004": ("light", 120, True)}


def test_files_are_cut_at_records(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.gb").write_text("".join(RECORD.replace("MT599835", f"MT{100000 + 10 * k + i}") + "//\n" for i in range(4)) + "\n")
    got = flatfiles.parse_records(flatfiles.read_flat_files(spark, str(tmp_path)))
    assert sorted(r.accession for r in got.select("accession").collect()) == sorted(f"MT{100000 + 10 * k + i}" for k in range(3) for i in range(4))


def reading(location):
    """Spans by recursion: (start, stop, strand) in reading order."""
    location = re.sub(r"\s", "", location)
    if m := re.fullmatch(r"complement\((.*)\)", location):
        return [(a, b, -s) for a, b, s in reversed(reading(m[1]))]
    if m := re.fullmatch(r"(?:join|order)\((.*)\)", location):
        parts, depth = [""], 0
        for c in m[1]:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append("")
            else:
                parts[-1] += c
        return [x for p in parts for x in reading(p)]
    ends = re.findall(r"\d+", location)
    return [(int(ends[0]), int(ends[-1]), 1)]


def test_nested_locations_and_spliced_letters(spark):
    rng = random.Random(8)
    letters = "".join(rng.choice("acgtn") for _ in range(300))

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            a = rng.randrange(1, 250)
            return rng.choice([f"{a}..{a + rng.randrange(40)}", f"<{a}..{a + 9}", f"{a}..>{a + 9}", f"{a}"])
        return rng.choice([lambda: f"complement({made(depth - 1)})", lambda: f"join({','.join(made(depth - 1) for _ in range(rng.randrange(1, 4)))})", lambda: f"order({made(depth - 1)},{made(depth - 1)})"])()

    locations = [made(3) for _ in range(200)] + ["", "J00194.1:5..9", "complement(1..5"]
    df = spark.createDataFrame([(i, x, letters) for i, x in enumerate(locations)], "i int, location string, letters string")
    rows = df.select("i", flatfiles.spans(F.col("location")).alias("s"), flatfiles.spliced(F.col("letters"), F.col("location")).alias("cut")).orderBy("i").collect()
    turn = str.maketrans("acgtn", "tgcan")
    for r, x in zip(rows[:200], locations):
        want = reading(x)
        assert [(s.start, s.stop, s.strand) for s in r.s] == want, x
        assert r.cut == "".join(letters[a - 1 : b] if s > 0 else letters[a - 1 : b][::-1].translate(turn) for a, b, s in want)
    assert rows[200].s == [] and rows[200].cut == "" and (rows[201].s[0].ref, rows[201].cut) == ("J00194.1", "") and rows[202].s[0].strand == -1


AB = "paper_id string, idx int, name string, hints map<string,struct<pointer:string,quote:string,value:string>>"
LIGHT = "DIQLTQSPSSLSASVGDRVTITCQASQDISNYLNWYQQRPGKAPKLLIYDASNLETGVPSRFSGSGSGTDFTFTISSLQPEDIATYYCQQYDNPPLTFGGGTKLEIK"
OTHER = HEAVY.replace("PPRNYYDRSGYYQRAEYFQH", "TRDASRDDRAWRLDP")


def backfill(spark, antibodies, found):
    """found: (accession, description, product, sequence) in the order of requests, all of paper p."""
    records = spark.createDataFrame([(a, f"{a}.1", d) for a, d, *_ in found], "accession string, record_id string, description string")
    rows = [(a, f"{a}.1", 0, p, "", "", s) for a, _, p, s in found if s]
    f = spark.createDataFrame(rows, "accession string, record_id string, pos int, product string, gene string, note string, translation string")
    f = f.withColumn("chain", flatfiles.sequences.record_chain(F.col("product"))).withColumn("is_variable", F.contains("product", F.lit("variable region")))
    asked = spark.createDataFrame([("p", i, a) for i, (a, *_) in enumerate(found)], "paper_id string, pos long, accession string")
    made = accessions.fetched_records(asked, accessions.record_summaries(records, f))
    return {r.name: (r.vh, r.vl, r.loop, r.ids) for r in accessions.backfilled(spark.createDataFrame(antibodies, AB), made).collect()}


def hint(pointer, quote="", value=""):
    return (pointer, quote, value)


def heavy(name=""):
    return f"Homo sapiens isolate {name} immunoglobulin heavy chain variable region mRNA"


def light(name=""):
    return f"Homo sapiens isolate {name} immunoglobulin kappa light chain variable region mRNA"


def test_records_that_name_the_antibody_come_before_hints(spark):
    hints = {"vh_sequence_aa": hint("GenBank MK749212", "Heavy chain sequences GenBank MK_749197 to MK_749219"), "vl_sequence_aa": hint("GenBank MK749234", "Light chain sequences GenBank MK_749220 to MK_749241")}
    found = [("MK749212", heavy("X63-71O-HC"), heavy(), HEAVY), ("MK749207", heavy("X63-71J2a-HC"), heavy(), OTHER), ("MK749234", light("X63-71L-KC"), light(), LIGHT), ("MK749232", light("X63-71J2a-KC"), light(), LIGHT[1:])]
    got = backfill(spark, [("p", 0, "X63-71J2a", hints), ("p", 1, "Q9", hints), ("p", 2, "  ", hints)], found)
    assert got["X63-71J2a"][:2] == (OTHER, LIGHT[1:]) and got["X63-71J2a"][3] == "MK749207,MK749232"
    assert got["Q9"][:2] == (HEAVY, LIGHT) and got["Q9"][3] == "MK749212,MK749234" and len(got) == 2


def test_two_ends_of_a_range_fill_nothing_and_one_does(spark):
    ranged = {"vh_sequence_aa": hint("GenBank MK_749197 to MK_749219"), "vl_sequence_aa": hint("GenBank MK_749220 to MK_749241")}
    found = [("MK749197", heavy("other"), heavy(), HEAVY), ("MK749220", light("a"), light(), LIGHT), ("MK749241", light("b"), light(), LIGHT[1:])]
    got = backfill(spark, [("p", 0, "Q9", ranged), ("p", 1, "Z8", {})], found)
    assert got == {"Q9": (HEAVY, "", got["Q9"][2], "MK749197")}


def test_a_single_record_serves_a_single_antibody_without_hints(spark):
    found = [("MK749197", heavy("other"), heavy(), HEAVY), ("MK749300", "a cellular kinase", "kinase", "")]
    assert backfill(spark, [("p", 0, "Q9", {})], found)["Q9"][3] == "MK749197"
    assert backfill(spark, [("p", 0, "Q9", {"vh_sequence_aa": hint("see supplement")})], found) == {}
    assert backfill(spark, [("p", 0, "Q9", {}), ("p", 1, "Z8", {})], found) == {}
    assert backfill(spark, [("p", 0, "Q9", {"CDRH3_Sequence": hint("GenBank MK749197")})], found)["Q9"][::3] == (HEAVY, "MK749197")
    assert backfill(spark, [("p", 0, "Q9", None)], [("MK749300", "a cellular kinase", "kinase", "")]) == {}


@pytest.mark.parametrize("name,text,score", [("COVA1-16", "isolate COVA1-16 anti", 4), ("COVA1-16", "isolate cova116HC", 3), ("PC-71J2a", "x71j2aHC", 2), ("A-1", "a clone 1", 0), ("", "x", 0), (r"a\Eb", "x", 0), (None, None, 0)])
def test_names_in_texts(spark, name, text, score):
    df = spark.createDataFrame([(name, text)], "n string, t string").withColumn("f", accessions.name_forms(F.col("n")))
    assert df.select(accessions.name_match(F.col("t"), F.col("f"))).first()[0] == score


def test_ranges_are_asked_for_as_rows(spark):
    hints = {"vh_sequence_aa": hint("GenBank MK_749197 to MK_749201"), "vl_sequence_aa": hint("GenBank MK749234")}
    papers = spark.createDataFrame([("p", "Sequences are in GenBank (accession MK749234).")], "paper_id string, text string")
    rows = accessions.requested_accessions(papers, spark.createDataFrame([("p", 0, "Q9", hints), ("p", 1, "Z8", hints)], AB)).orderBy("pos").collect()
    assert [r.accession for r in rows] == ["MK749234", "MK749197", "MK749201", "MK749198", "MK749199", "MK749200"]
    df = spark.createDataFrame([("MK1", "MN3"), ("AB00008", "AB00011"), ("AB00001", "AB99999"), ("AB00009", "AB00001")], "a string, b string")
    assert [r[0] for r in df.select(accessions.range_members(F.col("a"), F.col("b"))).collect()] == [["MK1", "MN3"], ["AB00008", "AB00009", "AB00010", "AB00011"], ["AB00001", "AB99999"], ["AB00009", "AB00001"]]
