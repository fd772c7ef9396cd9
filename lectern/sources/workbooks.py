"""Office Open XML workbooks as cells: read from zipped XML in Arrow batches, written likewise, without a library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.binding import let

CELLS = "path string, sheet string, sheet_no int, row_no int, col_no int, cell string"
#: Namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Fields of a record in order, other labels that sheets have for them, and texts that say nothing.
FIELD_ORDER = [
    "Antibody_Name", "Antibody_Type", "Antibody_Isotype", "source", "Target_Name", "Target_Type", "Cross_Reactivity", "Epitope", "Experiment", "Binding_Kinetics_KD", "Binding_Kinetics_kon", "Binding_Kinetics_koff", "Binding_EC50",
    "Mechanism_of_Action", "Quantitative_Metric", "Structure", "CDRH3_Sequence", "vh_sequence_aa", "vl_sequence_aa", "Thermal_Stability_Tm", "In_Vivo_Half_Life", "In_Vivo_Efficacy", "Reference_Source",
]
ALIASES = {"Anitbody_Isotype": "Antibody_Isotype", "Mechanism_of_Action_Type": "Mechanism_of_Action", "Reference Source": "Reference_Source"}
NOTHING = ["", "nan", "none", "null"]
_REF = re.compile(r"([A-Z]+)(\d+)")


def place(ref: str) -> tuple[int, int]:
    """Row and column of a cell's reference, from zero: B3 is (2, 1)."""
    letters, digits = _REF.match(ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def reference(row: int, col: int) -> str:
    letters, col = "", col + 1
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


def _texts(node: ElementTree.Element) -> str:
    """All text of a string item, its runs joined; phonetic hints are no text."""
    return "".join(t.text or "" for r in node if r.tag != f"{MAIN}rPh" for t in r.iter(f"{MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    names = [n for n in book.namelist() if n.lower().endswith("sharedstrings.xml")]
    out = []
    for name in names[:1]:
        with book.open(name) as file:
            for _, node in ElementTree.iterparse(file):
                if node.tag == f"{MAIN}si":
                    out.append(_texts(node))
                    node.clear()
    return out


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and parts of the sheets in the order of the workbook."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    full = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t))
    return [(s.get("name"), full(parts[s.get(REL)])) for s in root.iter(f"{MAIN}sheet") if s.get(REL) in parts]


def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{MAIN}is")
        return None if inline is None else _texts(inline)
    if v is None or v.text is None:
        return None
    if kind == "s":
        at = int(v.text)
        return strings[at] if at < len(strings) else None
    if kind == "b":
        return "TRUE" if v.text == "1" else "FALSE"
    if kind == "n" and re.fullmatch(r"-?\d+\.0+", v.text):
        return v.text.partition(".")[0]
    return v.text


def cells(content: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """(sheet, its number, row, column, text) of every filled cell, sheet by sheet as the XML streams by.

    A cell without a reference stands after the one before it.  Formulas give
    their last value, errors their name, numbers their text (whole ones
    without decimals).
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _shared(book)
        for number, (sheet, part) in enumerate(_sheets(book)):
            if part not in book.namelist():
                continue
            row, col = -1, -1
            with book.open(part) as file:
                for event, node in ElementTree.iterparse(file, ("start", "end")):
                    if event == "start" and node.tag == f"{MAIN}row":
                        row, col = (int(node.get("r")) - 1 if node.get("r") else row + 1), -1
                    elif event == "end" and node.tag == f"{MAIN}c":
                        row, col = place(node.get("r")) if node.get("r") else (row, col + 1)
                        value = _value(node, strings)
                        if value is not None and value != "":
                            yield sheet, number, row, col, value
                    elif event == "end" and node.tag == f"{MAIN}row":
                        node.clear()


def workbook_cells(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """files (path, content) -> path, sheet, sheet_no, row_no, col_no, cell (from zero); a file that is no workbook fails with its path, a null gives nothing.

    A workbook is held by one task, whose cells leave it in batches.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "sheet", "sheet_no", "row_no", "col_no", "cell"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if content is None:
                    continue
                rows = []
                try:
                    for cell in cells(content):
                        rows.append((path, *cell))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    raise ValueError(f"{path}: no workbook ({e})") from e
                yield pd.DataFrame(rows, columns=names)

    return files.selectExpr(f"{path_col} AS path", f"{content_col} AS content").mapInPandas(of, CELLS)


def read_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """Cells of every workbook below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return workbook_cells(files)


def workbook(sheets: dict[str, dict[tuple[int, int], str | float | bool]]) -> bytes:
    """A workbook's bytes from cells by (row, column); texts are shared strings."""
    strings: dict[str, int] = {}

    def cell(row: int, col: int, value: str | float | bool) -> str:
        ref = reference(row, col)
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int | float):
            return f'<c r="{ref}"><v>{value}</v></c>'
        return f'<c r="{ref}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'

    space = MAIN[1:-1]
    parts = []
    for content in sheets.values():
        by_row: dict[int, list[str]] = {}
        for (row, col), value in sorted(content.items()):
            by_row.setdefault(row, []).append(cell(row, col, value))
        body = "".join(f'<row r="{row + 1}">{"".join(found)}</row>' for row, found in by_row.items())
        parts.append(f'<worksheet xmlns="{space}"><sheetData>{body}</sheetData></worksheet>')
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{rels}<Relationship Id="rIdS" Type="{office}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        for i, part in enumerate(parts, 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", part)
        items = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{space}" count="{len(strings)}" uniqueCount="{len(strings)}">{items}</sst>')
    return out.getvalue()


def citation(value: Column) -> Column:
    """`Author et al. Journal, Year` and the DOI where a text has author, year and journal; else the text, trimmed."""
    t = F.trim(F.coalesce(value, F.lit("")))
    inside = F.element_at(F.split(F.trim(F.regexp_extract(t, r"(?i)\(([A-Za-z][A-Za-z'`\- ]+?)\s+et al\.?\)", 1)), r"\s+"), -1)
    author = F.when(inside != "", inside).otherwise(F.regexp_extract(t, r"\b([A-Z][A-Za-z'`\-]+)\s+et al\.?\b", 1))
    year = F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1)
    doi = F.regexp_replace(F.regexp_extract(t, r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1), r"[.,;)]+$", "")
    rest = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), r"(?im)doi\s*:?[^\n]*\z", " ")
    rest = F.when(year != "", F.replace(rest, year, F.lit(" "))).otherwise(rest)
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(rest, r"(?i)\bet al\.?\b", " "), "[^A-Za-z0-9. ]+", " "), r"\s+"), lambda w: w != "")

    def told(w: Column) -> Column:
        at = F.array_position(F.transform(w, F.lower), "et")
        journal = F.regexp_replace(F.array_join(F.slice(F.when(at > 0, F.slice(w, at.cast("int") + 2, F.size(w))).otherwise(w), 1, 4), " "), r"^[ ,.]+|[ ,.]+$", "")
        return F.when((author != "") & (year != "") & (journal != ""), F.concat(author, F.lit(" et al. "), journal, F.lit(", "), year, F.when(doi != "", F.concat(F.lit(". DOI: "), doi)).otherwise("")))

    return F.coalesce(let(words, told), t)


def workbook_records(found: DataFrame, by: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """Cells of workbooks (sheet, row_no, col_no, cell and what else `by` names) -> by, ab_idx, record: a record a column.

    The first row is a heading and column 0 names the fields, known labels
    alone; of a repeated label the first row counts.  A record has all fields,
    empty where the sheet says nothing, and its reference as a citation;
    columns without a name are no records, and the others are counted from
    zero.  A sheet's columns, 16,384 at most, are numbered in one task.
    """
    value = F.trim(F.coalesce("cell", F.lit("")))
    clean = F.when(F.lower(value).isin(NOTHING), "").otherwise(value)
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    body = found.filter("row_no > 0")
    labels = body.filter("col_no = 0").select(*by, "row_no", F.coalesce(F.try_element_at(names, clean), clean).alias("field")).filter(F.col("field").isin(FIELD_ORDER))
    labels = labels.groupBy(*by, "field").agg(F.min("row_no").alias("row_no"))
    cells_of = body.filter("col_no > 0").select(*by, "row_no", "col_no", clean.alias("value")).join(labels, [*by, "row_no"])
    column = cells_of.groupBy(*by, "col_no").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("value"))), F.lit("")).alias(f"_{i}") for i, f in enumerate(FIELD_ORDER)]).filter("_0 <> ''")
    shown = [citation(F.col(f"_{i}")) if f == "Reference_Source" else F.col(f"_{i}") for i, f in enumerate(FIELD_ORDER)]
    record = F.map_from_arrays(F.array(*map(F.lit, FIELD_ORDER)), F.array(*shown))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("col_no")) - 1
    return column.withColumn("ab_idx", rank).select(*by, "ab_idx", record.alias("record"))
