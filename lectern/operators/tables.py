"""Tables in document texts: HTML grids with spans, pipe tables, and records by meaning of the header."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.binding import bound

#: Words in a header by which a column is known, in order of trial.
HEADERS = [
    ("mAb", ["mab", "antibody", "clone", "name"]),
    ("VDJ_Heavy", ["vdj heavy", "vdj_heavy", "v(d)j heavy", "heavy chain v", "vh/dh/jh"]),
    ("VJ_Light", ["vj light", "vj_light", "v(j) light", "light chain v", "vk/jk", "vl/jl"]),
    ("CDRH3", ["cdrh3", "cdr-h3", "cdr h3", "hcdr3", "heavy cdr3"]),
    ("CDRL3", ["cdrl3", "cdr-l3", "cdr l3", "lcdr3", "light cdr3", "cdr-k3"]),
    ("VH_identity_pct", ["vh identity", "vh_identity", "v region identity", "vh v region"]),
    ("VL_identity_pct", ["vl identity", "vl_identity", "vk identity", "vl v region"]),
    ("VH_sequence", ["vh sequence", "heavy chain sequence", "vh_aa", "vh_seq"]),
    ("VL_sequence", ["vl sequence", "light chain sequence", "vl_aa", "vl_seq", "vk sequence"]),
    ("Isotype", ["isotype", "subclass", "igg"]),
    ("Target", ["target", "antigen", "specificity"]),
    ("KD", ["kd", "affinity"]),
    ("EC50", ["ec50"]),
    ("IC50", ["ic50"]),
]
CELLS = "table_no int, row_no int, col_no int, cell string"
_RULE = re.compile(r"^\|?[\s:]*-+[\s:]*(\|[\s:]*-+[\s:]*)*\|?$")


class _Cells(HTMLParser):
    """Collects, for each table, its rows of (text, rowspan, colspan)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[list]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            span = {k: int(v) if (v or "").isdigit() else 1 for k, v in attrs}
            self.cell = ["", max(1, span.get("rowspan", 1)), max(1, span.get("colspan", 1))]
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0] += data


def grid(rows: list[list[list]]) -> list[list[str]]:
    """Rows of (text, rowspan, colspan) -> rows of texts; a cell that spans stands in each place it covers."""
    held: dict[tuple[int, int], str] = {}
    out = []
    for r, row in enumerate(rows):
        line, c, cells = [], 0, iter(row)
        while True:
            if (r, c) in held:
                line.append(held[r, c])
                c += 1
                continue
            if (cell := next(cells, None)) is None:
                break
            text, down, right = cell[0].strip(), cell[1], cell[2]
            for k in range(right):
                line.append(text)
                for d in range(1, down):
                    held[r + d, c + k] = text
            c += right
        if line:
            out.append(line)
    return out


def html_tables(text: str | None) -> list[list[list[str]]]:
    if "<table" not in (text or "").lower():
        return []
    parser = _Cells()
    parser.feed(text)
    parser.close()
    return [g for g in map(grid, parser.tables) if g]


def pipe_tables(text: str | None) -> list[list[list[str]]]:
    """Runs of two or more lines that begin with a pipe; rule lines are left out."""
    out, now = [], []
    for line in [*(text or "").split("\n"), ""]:
        line = line.strip()
        if line.startswith("|"):
            if not _RULE.match(line):
                cells = [c.strip() for c in line.split("|")][1:]  # the bar at the beginning parts nothing
                now.append(cells[:-1] if cells and not cells[-1] else cells)
        else:
            if len(now) > 1:
                out.append(now)
            now = []
    return out


def header_names(header: list[str]) -> list[str]:
    """What each column means: the first unused meaning whose word the header holds, else the header, else its number.

    Of columns about identity the second is the light chain's, unless another
    column already is.
    """
    used: set[str] = set()
    out = []
    for i, h in enumerate(header):
        low = h.lower().strip()
        name = next((n for n, words in HEADERS if n not in used and any(w in low for w in words)), None)
        used.add(name or "")
        out.append(name or h.strip() or f"col_{i}")
    about = [i for i, h in enumerate(header) if "identity" in h.lower() or "v region" in h.lower()]
    if "VL_identity_pct" not in used and len(about) > 1:
        out[about[1]] = "VL_identity_pct"
    return out


def table_cells(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cells of all tables in long form: id, table_no, row_no, col_no, cell."""
    kind = dict(docs.dtypes)[id_col]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (i, t, r, c, cell)
                for i, text in zip(batch[id_col], batch[text_col], strict=True)
                for t, table in enumerate(html_tables(text) + pipe_tables(text), 1)
                for r, row in enumerate(table)
                for c, cell in enumerate(row)
            ]
            yield pd.DataFrame(rows, columns=[id_col, "table_no", "row_no", "col_no", "cell"])

    some = docs.filter(F.contains(F.lower(text_col), F.lit("<table")) | F.contains(F.col(text_col), F.lit("|")))
    return some.select(id_col, text_col).mapInPandas(cells, f"{id_col} {kind}, {CELLS}")


def table_rows(cells: DataFrame, id_col: str) -> DataFrame:
    """Cells -> one array a row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda x: x["cell"])
    return cells.groupBy(id_col, "table_no", "row_no").agg(ordered.alias("cells"))


def table_records(cells: DataFrame, id_col: str) -> DataFrame:
    """Cells -> one map a row below the header, by meaning; of columns that mean the same the last counts."""

    def meanings(headers: pd.Series) -> pd.Series:
        return headers.map(lambda h: header_names(list(h)))

    named = F.pandas_udf(meanings, "array<string>")
    rows = table_rows(cells, id_col)
    heads = rows.filter("row_no = 0").select(id_col, "table_no", named("cells").alias("names"))
    joined = rows.filter("row_no > 0").join(heads, [id_col, "table_no"])
    pairs = F.filter(F.arrays_zip("names", "cells"), lambda p: p["names"].isNotNull() & p["cells"].isNotNull())
    entries = F.transform(pairs, lambda p: F.struct(p["names"].alias("key"), p["cells"].alias("value")))
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
    return joined.select(id_col, "table_no", "row_no", last.alias("record"))


#: Words of which a header of a table of antibodies has two, and how a row names a chain.
ANTIBODY_WORDS = ["mab", "antibody", "cdr", "cdrh3", "cdrl3", "hcdr3", "lcdr3", "vh", "vl", "vdj", "heavy", "light", "germline", "identity", "sequence", "clone", "v region", "isotype", "neutrali", "seq id"]
CHAIN_LABELS = [r"(?i)^(.+?)\s*\(\s*(VH|VL|heavy|light)\s*\)$", r"(?i)^(.+?)\s+(VH|VL|heavy|light)$"]


def antibody_header(header: Column) -> Column:
    """Whether a header (an array of cells) is that of a table of antibodies."""
    low = F.lower(F.array_join(header, " "))
    return F.size(F.filter(F.array(*map(F.lit, ANTIBODY_WORDS)), lambda w: F.contains(low, w))) >= 2


def antibody_records(cells: DataFrame, id_col: str) -> DataFrame:
    """table_records of the tables whose header speaks of antibodies."""
    heads = table_rows(cells.filter("row_no = 0"), id_col).filter(antibody_header(F.col("cells"))).select(id_col, "table_no")
    return table_records(cells.join(heads, [id_col, "table_no"], "left_semi"), id_col)


def fragment_records(cells: DataFrame, id_col: str, least: int = 80) -> DataFrame:
    """Sequences that a table has in pieces: id, table_no, name, chain (VH or VL), sequence.

    A row of at least three cells from the third on, most of them pieces of a
    sequence, begins a run if its first cell names an antibody and a chain and
    continues one if not; a run ends at a label of another name or chain and
    at any other row.  Its cells are joined row by row, and kept from `least`
    residues on.  Only tables whose header names antibodies and SEQ IDs, with
    both kinds of row, are read.  Runs are found by window functions within a
    table, so a table's rows bound a task's.
    """
    rows = table_rows(cells, id_col)
    low = F.lower(F.array_join("cells", " "))
    heads = rows.filter("row_no = 0").filter(F.contains(low, F.lit("seq id")) & F.contains(low, F.lit("antibody"))).select(id_col, "table_no")
    clean = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))
    pieces = F.filter(F.slice("cells", 3, F.greatest(F.size("cells"), F.lit(1))), lambda c: F.trim(c) != "")
    share = lambda c: F.length(F.regexp_replace(clean(c), "[^ACDEFGHIKLMNPQRSTVWY]", "")) / F.length(clean(c))
    good = F.size(F.filter(pieces, lambda c: (F.length(clean(c)) >= 4) & (share(c) >= 0.8)))
    label = F.trim(F.regexp_replace(F.coalesce(F.get("cells", F.lit(0)), F.lit("")), r"\s+", " "))
    part = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(label, p, k), F.lit("")) for p in CHAIN_LABELS])
    chain = F.when(F.lower(part(2)).isin("vh", "heavy"), "VH").when(part(2).isNotNull(), "VL")
    body = rows.filter("row_no > 0").join(heads, [id_col, "table_no"], "left_semi")
    body = bound(body, _piece=(F.size(pieces) >= 3) & (good >= 0.6 * F.size(pieces)), _name=F.trim(part(1)), _chain=chain, _text=F.array_join(F.transform(pieces, clean), ""))
    w = Window.partitionBy(id_col, "table_no").orderBy("row_no")
    body = body.withColumn("_stretch", F.sum((~F.col("_piece")).cast("int")).over(w)).filter("_piece")
    in_stretch = Window.partitionBy(id_col, "table_no", "_stretch").orderBy("row_no")
    key = F.when(F.col("_name").isNotNull() & F.col("_chain").isNotNull(), F.struct("_name", "_chain"))
    body = body.withColumn("_key", F.last(key, ignorenulls=True).over(in_stretch)).filter("_key IS NOT NULL")
    turn = (~F.col("_key").eqNullSafe(F.lag("_key").over(in_stretch))).cast("int")
    body = body.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(in_stretch))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_text"))), lambda x: x["_text"]), "")
    runs = body.groupBy(id_col, "table_no", "_stretch", "_run", "_key").agg(joined.alias("sequence"))
    return runs.filter(F.length("sequence") >= least).select(id_col, "table_no", F.col("_key._name").alias("name"), F.col("_key._chain").alias("chain"), "sequence")
