"""Records of a paper without a model, and the prompts that a model would get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import scan
from lectern.functions.binding import bound
from lectern.operators import tables
from lectern.operators.papers import METHODS
from lectern.sources.workbooks import FIELD_ORDER

#: What a text's words say of a whole paper's records, in order of trial: target, cross-reactivity (all patterns), mechanism.
TARGETS = [(r"(?i)MPXV A35 \(Clade IIb\)", "MPXV A35 (Clade IIb)"), (r"(?i)EV35-\d+\s*\+\s*A35", "MPXV A35")]
TARGET_TYPE = "Viral protein"
CROSS = (["(?i)cross-reactive", "(?i)VACV(?:A33)?"], "VACV A33")
MECHANISMS = [("(?i)cross-reactive", "Cross-reactive binding"), ("(?i)complement-dependent", "Complement-dependent activity")]
#: Constant regions and what they say of type and isotype; columns of a table and their fields; tables of structures.
CONSTANTS = [("IGHG1", "Monoclonal IgG1", "Human IgG1"), ("IGHA", "Monoclonal IgA", "Human IgA"), ("IGHM", "Monoclonal IgM", "Human IgM")]
COLUMNS = {"KD": "Binding_Kinetics_KD", "EC50": "Binding_EC50", "IC50": "Quantitative_Metric"}
STRUCTURES, STRUCTURE_ROW, COMPLEX, STRUCTURE_TEXT = "Data collection", "pdb code", r"(?i)(EV\d+-\d+)\s*\+\s*A35", "A35 complex (PDB: "
#: Characters of a document in a prompt, what marks a cut one, and what stands before and after the template.
MOST_CHARS, CUT = 200_000, "\n\n[... truncated ...]"
REDUCED = "[Context Reduction]: The document body below was pre-filtered to preserve results, figures, tables, supplementary mentions, sequence cues, IDs, and image evidence.\n\n"
CORRECTIONS = "\n\n[修正要求 - 请根据以下反馈修正你的输出]:\n"
NO_FOCUS = "No paper-specific focus analysis available. Use default extraction policy."


def _inferred(body: Column) -> Column:
    """Target, target type, cross-reactivity, mechanism and experiment of a whole paper."""
    target = F.lit("")
    for pattern, value in reversed(TARGETS):
        target = F.when(body.rlike(pattern), value).otherwise(target)
    cross = F.when(body.rlike(CROSS[0][0]) & body.rlike(CROSS[0][1]), CROSS[1]).otherwise("")
    told = lambda pairs, mark: F.array_join(F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(v)) for p, v in pairs])), mark)
    methods = [(pattern, name) for name, pattern in METHODS]
    return F.struct(target.alias("Target_Name"), F.when(target != "", TARGET_TYPE).otherwise("").alias("Target_Type"), cross.alias("Cross_Reactivity"), told(MECHANISMS, "; ").alias("Mechanism_of_Action"), told(methods, ", ").alias("Experiment"))


def structure_codes(cells: DataFrame, id_col: str) -> DataFrame:
    """id, name, structure: codes of the structures that a table of data collection gives to antibodies; of several the last."""
    of = cells.select(id_col, "table_no", "row_no", "col_no", F.trim("cell").alias("cell"))
    heads = of.filter("row_no = 0 AND col_no = 0").filter(F.col("cell") == STRUCTURES).select(id_col, "table_no")
    names = of.filter("row_no = 0 AND col_no > 0").withColumn("name", F.regexp_extract("cell", COMPLEX, 1)).filter("name <> ''").join(heads, [id_col, "table_no"], "left_semi").select(id_col, "table_no", "col_no", "name")
    row = of.filter("row_no > 0 AND col_no = 0").filter(F.lower("cell") == STRUCTURE_ROW).groupBy(id_col, "table_no").agg(F.min("row_no").alias("row_no"))
    codes = of.join(row, [id_col, "table_no", "row_no"]).filter("cell <> ''").select(id_col, "table_no", "col_no", "cell")
    both = names.join(codes, [id_col, "table_no", "col_no"])
    return both.groupBy(id_col, "name").agg(F.max_by("cell", F.struct("table_no", "col_no")).alias("c")).select(id_col, "name", F.concat(F.lit(STRUCTURE_TEXT), "c", F.lit(")")).alias("structure"))


def heuristic_records(papers: DataFrame) -> DataFrame:
    """papers (paper_id, path, text) -> paper_id, idx, from_table, record: all fields of each antibody that tables name, else of each name in the text.

    Rows of tables of antibodies give names (the first row of a name counts,
    case aside), loops, types and metrics; what the whole text says of target,
    assays and mechanism stands in each of them, and a structure where a table
    of structures has the name.  Their reference is the paper's folder, or its
    id.  Without such a row, the names that patterns find become empty
    records.  Papers without either give no row.
    """
    p = papers.select("paper_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    folder = F.trim(F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit("")))
    p = bound(p, told=_inferred(F.col("text")), title=F.when((folder != "") & (F.lower(folder) != F.lower("paper_id")), folder).otherwise(F.col("paper_id")))
    cells = tables.table_cells(p, "paper_id", "text")
    get = lambda k: F.trim(F.coalesce(F.try_element_at("record", F.lit(k)), F.lit("")))
    # a meaning is given to known columns only, so the column of constant regions is found by its heading
    heads = cells.filter("row_no = 0").filter(F.lower(F.trim("cell")) == "constant region genes").groupBy("paper_id", "table_no").agg(F.min("col_no").alias("col_no"))
    constant = cells.join(heads, ["paper_id", "table_no", "col_no"]).select("paper_id", "table_no", "row_no", F.upper(F.trim("cell")).alias("_genes"))
    rows = tables.antibody_records(cells, "paper_id").withColumn("name", get("mAb")).filter("name <> ''").join(constant, ["paper_id", "table_no", "row_no"], "left")
    rows = rows.groupBy("paper_id", F.lower("name").alias("_low")).agg(F.min_by(F.struct("name", "record", "_genes", "table_no", "row_no"), F.struct("table_no", "row_no")).alias("r")).select("paper_id", "r.*")
    rows = rows.join(structure_codes(cells, "paper_id"), ["paper_id", "name"], "left").join(p.select("paper_id", "told", "title"), "paper_id")
    kind = lambda i: F.coalesce(*[F.when(F.contains("_genes", F.lit(c[0])), c[i]) for c in CONSTANTS], F.lit(""))
    of_table = {
        "Antibody_Name": F.col("name"), "Antibody_Type": kind(1), "Antibody_Isotype": kind(2), "source": F.when(kind(1) != "", "human").otherwise(""), "CDRH3_Sequence": get("CDRH3"), "Structure": F.coalesce("structure", F.lit("")), "Reference_Source": F.col("title"),
        **{field: get(column) for column, field in COLUMNS.items()}, **{f: F.col(f"told.{f}") for f in ("Target_Name", "Target_Type", "Cross_Reactivity", "Mechanism_of_Action", "Experiment")},
    }
    filled = lambda known: F.map_from_arrays(F.array(*map(F.lit, FIELD_ORDER)), F.array(*[F.coalesce(known[f], F.lit("")) if f in known else F.lit("") for f in FIELD_ORDER]))
    w = Window.partitionBy("paper_id").orderBy("table_no", "row_no")
    first = rows.select("paper_id", (F.row_number().over(w) - 1).alias("idx"), F.lit(True).alias("from_table"), filled(of_table).alias("record"))
    rest = p.join(first.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", F.posexplode(scan.antibody_names(F.col("text"))).alias("_at", "name"))
    rest = rest.groupBy("paper_id", F.lower("name").alias("_low")).agg(F.min(F.struct("_at", "name")).alias("n"))
    rest = rest.select("paper_id", (F.row_number().over(Window.partitionBy("paper_id").orderBy("n._at")) - 1).alias("idx"), F.lit(False).alias("from_table"), filled({"Antibody_Name": F.col("n.name"), "Reference_Source": F.col("paper_id")}).alias("record"))
    return first.unionByName(rest)


def focus_text(focus: Column) -> Column:
    """A paper's focus (text, or lists by name and a policy) as lines of a prompt."""
    lists = [(k, F.coalesce(focus[k], F.array().cast("array<string>"))) for k in ("paper_type", "primary_evidence_sources", "entity_risks", "sequence_focus")]
    lines = [F.when(F.size(v) > 0, F.concat(F.lit(f"- {k}: "), F.array_join(v, "; "))) for k, v in lists]
    policy = F.when(F.coalesce(focus["split_policy"], F.lit("")) != "", F.concat(F.lit("- split_policy: "), focus["split_policy"]))
    whole = F.trim(F.coalesce(focus["paper_focus_text"], F.lit("")))
    return F.coalesce(F.nullif(whole, F.lit("")), F.nullif(F.concat_ws("\n", *lines, policy), F.lit("")), F.lit(NO_FOCUS))


def document_prompts(papers: DataFrame, template: str, most: int = MOST_CHARS) -> DataFrame:
    """papers (paper_id, text, reduced, hints, focus, image_hints, corrections) -> paper_id, prompt, cut: one prompt a paper.

    The reduced text stands for the whole where there is one; a text over
    `most` characters is cut there and says so.  The template's {names} are
    filled in once, so braces in texts stay as they are.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    used = blank("reduced") != ""
    body = F.when(used, F.col("reduced")).otherwise(blank("text"))
    cut = F.length(body) > most
    values = {"REGEX_HINTS": blank("hints"), "PAPER_ID": F.coalesce("paper_id", F.lit("unknown")), "PAPER_FOCUS_ANALYSIS": focus_text(F.col("focus")), "DOCUMENT_TEXT": F.when(cut, F.concat(F.substring(body, 1, most), F.lit(CUT))).otherwise(body)}
    parts, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        parts += [F.lit(before), values[name]]
    after = [F.when(blank(c) != "", F.concat(F.lit(mark), F.col(c))).otherwise("") for c, mark in (("image_hints", "\n\n"), ("corrections", CORRECTIONS))]
    return papers.select("paper_id", F.concat(F.when(used, REDUCED).otherwise(""), *parts, F.lit(rest), *after).alias("prompt"), cut.alias("cut"))


def packed_sections(sections: DataFrame, by: str, budget: int, mark: str = "\n\n") -> DataFrame:
    """sections (by, pos, priority, text) -> by, text, kept, dropped: those that fit a budget of characters, in their places.

    Sections are taken by priority (least first), then place, while their
    running size with marks between them stays within the budget; what comes
    after the first that does not fit is dropped too.  A key's sections are
    parts of one prompt and end in one row.
    """
    w = Window.partitionBy(by).orderBy("priority", "pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("text") + len(mark)
    rows = sections.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_in", F.sum(size).over(w) - len(mark) <= budget)
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("pos", "text")))), lambda x: x["text"])
    return rows.groupBy(by).agg(F.array_join(kept, mark).alias("text"), F.sum(F.col("_in").cast("long")).alias("kept"), F.sum((~F.col("_in")).cast("long")).alias("dropped"))
