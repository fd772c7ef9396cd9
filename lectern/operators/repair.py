"""Repair of texts from character recognition, chunk by chunk: a reply counts only where it leaves protected tokens alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.binding import bound
from lectern.functions.jsontext import json_object
from lectern.functions.text import plain
from lectern.operators.blocks import chunked

#: Tokens that a repair must not change (identifiers, anything with a digit, sequences), and the headers that it may write.
PROTECTED_IDS = r"(?i)(\bSEQ\s*ID\s*(?:NO\.?|NUMBER)?\s*[:#]?\s*\d+\b|\b[0-9][A-Za-z0-9]{3}\b|\b[A-Z]{1,4}[_ -]?\d{3,9}(?:\.\d+)?\b|\b(?:PDB|GenBank|NCBI)\b)"
PROTECTED_DIGITS = r"(\b\S*\d\S*\b)"
PROTECTED_SEQUENCES = r"(\b[ACDEFGHIKLMNPQRSTVWY]{8,}\b|\b[ACGTU]{8,}\b)"
HEADERS = [
    "", "variant", "variants", "mutant", "mutants", "fab", "species", "molecule", "kd", "kdnm", "ka1", "ka11ms", "kd1", "kd11s", "kd1nm", "ka2", "ka21ms", "kd2", "kd21s", "kd2nm", "lowaffinityka1", "lowaffinitykd1", "lowaffinitykd1nm",
    "highaffinityka2", "highaffinitykd2", "highaffinitykd2nm", "ic50pm", "ic90pm", "t12days", "t12betahours",
]
SPELLED = [("β", "beta"), ("μ", "u"), ("µ", "u"), ("κ", "kappa"), ("α", "alpha"), ("γ", "gamma"), ("½", "1/2")]
#: Growth and shrinkage that a repair may have, and the size from which shrinkage counts.
GROWTH, MORE, SHRINK, COUNTS_FROM = 1.5, 2000, 0.5, 500
TABLE = r"(?is)(<table\b.*?</table>)"
CHUNK_CHARS, LEAST_CHARS = 12_000, 2_000
PAYLOAD = "struct<repaired_text:string,changed:string,notes:string>"


def repair_chunks(papers: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """papers (paper_id, text) -> paper_id, chunk_index, n_chunks, chunk."""
    c = papers.select("paper_id", F.explode(chunked(F.col("text"), limit)).alias("c"), F.size(chunked(F.col("text"), limit)).alias("n_chunks"))
    return c.select("paper_id", F.col("c.chunk_index").alias("chunk_index"), "n_chunks", F.col("c.text").alias("chunk"))


def protected_tokens(body: Column) -> Column:
    """All protected tokens of a text, sorted; a token counts once for each kind that it is of."""
    found = lambda p: F.regexp_extract_all(body, F.lit(p), F.lit(1))
    ids = F.transform(found(PROTECTED_IDS), lambda t: F.regexp_replace(F.upper(t), r"\s+", ""))
    return F.array_sort(F.concat(ids, found(PROTECTED_DIGITS), found(PROTECTED_SEQUENCES)))


def table_cells(body: Column) -> Column:
    """Tables of a text as rows of cells, without markup, entities resolved and with single spaces; tables without rows are none."""
    cell = lambda c: plain(F.regexp_replace(F.regexp_replace(c, r"(?is)^<t[dh]\b[^>]*>", ""), r"(?s)<[^>]*>", ""))
    row = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)(<t[dh]\b[^>]*>.*?)(?=</t[dh]\s*>)"), F.lit(1)), cell)
    rows = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?is)(<tr\b[^>]*>.*?)(?=</tr\s*>)"), F.lit(1)), row)
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(TABLE), F.lit(1)), rows), lambda t: F.size(t) > 0)


def header_label(cell: Column) -> Column:
    out = F.lower(F.trim(plain(cell)))
    for sign, word in SPELLED:
        out = F.replace(out, F.lit(sign), F.lit(word))
    return F.regexp_replace(out, "[^a-z0-9]+", "")


def header_repair(tables: Column, repaired: Column, outside: Column, repaired_outside: Column) -> Column:
    """Whether tables (see table_cells) differ in their first rows alone, where the new cells are among HEADERS; the texts outside must agree."""

    def same(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        shape = F.transform(a, lambda r: F.size(r)) == F.transform(b, lambda r: F.size(r))
        body = F.slice(a, F.lit(2), F.size(a)) == F.slice(b, F.lit(2), F.size(b))
        listed = F.forall(F.get(b, F.lit(0)), lambda c: header_label(c).isin(HEADERS))
        return shape & body & ((F.get(a, F.lit(0)) == F.get(b, F.lit(0))) | listed)

    pairs = F.zip_with(tables, repaired, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return (F.size(tables) > 0) & (F.size(tables) == F.size(repaired)) & (outside == repaired_outside) & F.coalesce(F.forall(pairs, same), F.lit(False))


def judged_repairs(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks (paper_id, chunk_index, chunk, ...) with answers (paper_id, chunk_index, reply, error): repaired, changed, rejected, failed, note.

    The original stays where the call failed or nothing of use came back,
    where the reply is empty, says the same, has grown or shrunk too much, or
    changes a protected token; but tables may get known headers.
    """
    c = chunks.join(answers.select("paper_id", "chunk_index", "reply", "error"), ["paper_id", "chunk_index"], "left")
    c = bound(c, _json=json_object(F.col("reply")))
    c = bound(c, _p=F.from_json("_json", PAYLOAD), _is_text=F.coalesce(F.get_json_object("_json", "$.repaired_text"), F.lit("")) != "")
    # only a JSON string counts as a text
    quoted = F.schema_of_variant(F.try_variant_get(F.try_parse_json("_json"), "$.repaired_text", "variant")) == "STRING"
    c = bound(c, _text=F.when(F.coalesce(quoted, F.lit(False)), F.col("_p.repaired_text")), _notes=F.coalesce(F.col("_p.notes"), F.lit("")))
    whole = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    c = bound(c, _new=whole(F.col("_text")), _old=whole(F.col("chunk")))
    new, old, n = F.col("_new"), F.col("_old"), F.length("chunk")
    note = lambda word: F.when(F.col("_notes") != "", F.col("_notes")).otherwise(word)
    c = bound(
        c,
        _kept=F.when(F.col("error").isNotNull() | F.col("reply").isNull(), "llm_repair_failed_keep_original").when(F.col("_json").isNull(), "payload_not_dict_keep_original").when(F.col("_text").isNull(), "missing_repaired_text_keep_original")
        .when(new == "", "empty_repaired_text_keep_original").when(new == old, note("no_change")).when(F.length(new) > F.greatest(n * GROWTH, n + MORE), note("expanded_too_much_keep_original"))
        .when((n >= COUNTS_FROM) & (F.length(new) < F.floor(n * SHRINK)), note("shrunk_too_much_keep_original")),
    )
    open_ = F.col("_kept").isNull()
    c = bound(c, _same=F.when(open_, protected_tokens(new) == protected_tokens(F.col("chunk"))))
    outside = lambda t: plain(F.regexp_replace(t, TABLE, " "))
    c = bound(c, _header=F.when(open_ & ~F.col("_same"), header_repair(table_cells(F.col("chunk")), table_cells(new), outside(F.col("chunk")), outside(new))))
    changed, rejected = F.coalesce(F.col("_same") | F.col("_header"), F.lit(False)), F.coalesce(open_ & ~F.col("_same") & ~F.col("_header"), F.lit(False))
    told = F.coalesce("_kept", F.when(F.col("_same"), note("chunk_repaired")).when(F.col("_header"), note("table_header_whitelist_repair")).otherwise("protected_tokens_changed_keep_original"))
    return c.select(*chunks.columns, F.when(changed, new).otherwise(F.col("chunk")).alias("repaired"), changed.alias("changed"), rejected.alias("rejected"), F.coalesce(F.col("_kept") == "llm_repair_failed_keep_original", F.lit(False)).alias("failed"), told.alias("note"))


def repaired_texts(papers: DataFrame, judged: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """papers (paper_id, text) with repaired_text and what was done: chunks in their places, joined by blank lines.

    Papers under `least` characters, and those of which nothing is left, keep
    their text.  A paper's chunks are joined in one row, as its text is one.
    """
    trimmed = F.regexp_replace("repaired", r"(?U)^\s+|\s+$", "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", trimmed.alias("t")))), lambda x: x["t"]), "\n\n")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(f"{c}_chunks")
    done = judged.groupBy("paper_id").agg(joined.alias("_text"), F.count("*").alias("total_chunks"), count("changed"), count("rejected"), count("failed"))
    out = papers.join(done, "paper_id", "left")
    long_enough = F.coalesce(F.length("text"), F.lit(0)) >= least
    whole = F.regexp_replace(F.coalesce("_text", F.lit("")), r"(?U)^\s+|\s+$", "")
    final = F.when(long_enough & (whole != ""), whole).otherwise(F.col("text"))
    zero = lambda c: F.when(long_enough, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).alias(c)
    return out.select(*papers.columns, final.alias("repaired_text"), F.coalesce(final != F.col("text"), F.lit(False)).alias("used_repaired_text"), F.when(long_enough, "").otherwise("below_threshold").alias("reason"), *map(zero, ("total_chunks", "changed_chunks", "rejected_chunks", "failed_chunks")))
