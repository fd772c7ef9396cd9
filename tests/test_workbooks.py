"""Workbooks: written and read back, odd files as other programs write them, records and citations."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.sources import workbooks


def read(content):
    return [(s, r, c, v) for s, _, r, c, v in workbooks.cells(content)]


def test_round_trip():
    sheets = {"One & <two>": {(0, 0): "a", (0, 27): "  spaced ", (5, 1): 3.5, (6, 0): 7.0, (2, 2): True}, "Empty": {}, "Last": {(0, 0): "a", (1, 0): 'q"<&>'}}
    want = [("One & <two>", 0, 0, "a"), ("One & <two>", 0, 27, "  spaced "), ("One & <two>", 2, 2, "TRUE"), ("One & <two>", 5, 1, "3.5"), ("One & <two>", 6, 0, "7"), ("Last", 0, 0, "a"), ("Last", 1, 0, 'q"<&>')]
    assert read(workbooks.workbook(sheets)) == want
    assert [workbooks.place(workbooks.reference(r, c)) for r, c in ((0, 0), (9, 25), (9, 26), (0, 701), (99, 702))] == [(0, 0), (9, 25), (9, 26), (0, 701), (99, 702)]


def test_other_programs(tmp_path):
    """Inline texts, runs, phonetic hints, errors, formulas, cells without references, absolute targets."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="B" sheetId="9" r:id="x2"/><sheet name="A" sheetId="1" r:id="x1"/><sheet name="gone" sheetId="3" r:id="x3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x1" Target="/xl/worksheets/a.xml"/><Relationship Id="x2" Target="worksheets/b.xml"/><Relationship Id="x3" Target="chartsheets/c.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>in</t></is></c><c><v>1.50</v></c></row><row r="4"><c t="s"><v>0</v></c><c r="D4" t="str"><f>A1</f><v>sum</v></c><c t="e"><v>#N/A</v></c><c><f>1+1</f></c><c t="s"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
    assert read(out.getvalue()) == [("B", 0, 0, "in"), ("B", 0, 1, "1.50"), ("B", 3, 0, "rich"), ("B", 3, 3, "sum"), ("B", 3, 4, "#N/A")]


def test_files_and_records(spark, tmp_path):
    sheet = {(0, 0): "Field", (1, 0): "Antibody_Name", (2, 0): "Target_Name", (3, 0): "Target_Name", (4, 0): "Other", (1, 1): "A1", (1, 2): "nan", (1, 3): "A3", (2, 1): "spike", (3, 1): "late", (3, 3): "late too", (4, 1): "x", (0, 1): "heading"}
    for k in range(3):
        (tmp_path / f"b{k}.xlsx").write_bytes(workbooks.workbook({f"P{k}": sheet, "none": {}}))
    (tmp_path / "readme.txt").write_text("x")
    r = workbooks.workbook_records(workbooks.read_workbooks(spark, str(tmp_path)))
    got = sorted((x.sheet, x.ab_idx, x.record["Antibody_Name"], x.record["Target_Name"], len(x.record)) for x in r.collect())
    assert got == sorted((f"P{k}", i, n, t, 23) for k in range(3) for i, n, t in ((0, "A1", "spike"), (1, "A3", "")))
    bad = spark.createDataFrame([("x.xlsx", bytearray(b"text")), ("y", None)], "path string, content binary")
    with pytest.raises(Exception, match="x.xlsx: no workbook"):
        workbooks.workbook_cells(bad).count()
    assert workbooks.workbook_cells(bad.filter("path = 'y'")).count() == 0


@pytest.mark.parametrize("text,want", [
    ("(Smith J. Kim et al.) Nat Med 1999 doi: 10.1/x", "Kim et al. Nat Med, 1999"), ("(van Kim et al.) Nat Med 1999; doi: 10.1234/x.", "Kim et al. Nat Med, 1999. DOI: 10.1234/x"), ("Lee et al. 2001", "Lee et al. Lee, 2001"),
    ("  no year et al. here", "no year et al. here"), (None, ""), ("Wu et al, J. Virol. 2010 (in press)", "Wu et al. Wu J. Virol, 2010"),
])
def test_citations(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(workbooks.citation(F.col("t"))).first()[0] == want
