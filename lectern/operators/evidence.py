"""Evidence written into records: which value a field takes, and where it came from.

What a decision needs of a sequence (is it whole, which chain is it, which loop
does it derive) is computed as columns; the decisions themselves follow one
another within an antibody, so they run over its evidence in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import sequences, text
from lectern.functions.binding import bound
from lectern.operators import records as R

#: Priority of each kind of source.
PRIORITY = {"ocr_text_sequence": 1, "figure_or_image": 1, "table_extract": 1, "sequence_image": 2, "api_fetch": 3}
#: Fields that evidence may fill, the sequences among them, and sources whose loop a guess from a region does not replace.
FIELDS = [
    "CDRH3_Sequence", "Binding_Kinetics_KD", "Binding_EC50", "Binding_Kinetics_kon", "Binding_Kinetics_koff", "Thermal_Stability_Tm", "vh_sequence_aa", "vl_sequence_aa",
    "Quantitative_Metric", "In_Vivo_Efficacy", "Structure",
]
REGIONS = ("vh_sequence_aa", "vl_sequence_aa")
EXPLICIT = ("paper_text", "table", "ocr_text_sequence")
PLACE = r"(?i)\b((?:Supplementary\s+(?:Figure|Table)|Extended\s+Data\s+Figure|Figure|Fig\.?|Table|Page)\s*[A-Za-z0-9.\-]+)"
MERGED = "paper_id string, name_key string, name string, field string, value string, source string, pointer string, action string, created boolean"


def paper_location(value: Column) -> Column:
    """The figure, table or page that a text names first."""
    return F.trim(F.regexp_extract(F.coalesce(value, F.lit("")), PLACE, 1))


def source_type(from_text: Column, api_ids: Column, from_image: Column, image: Column) -> Column:
    """Kind of source of a piece of evidence, in order of trial."""
    return (
        F.when(from_text, "ocr_text_sequence").when(text.has_output(api_ids), "api_fetch").when(from_image, "sequence_image")
        .when(text.has_output(image), "figure_or_image").otherwise("table_extract")
    )


#: How a source is called before its pointer.
LABELS = {"api_fetch": "API Fetch", "ocr_text_sequence": "OCR text sequence", "sequence_image": "Sequence image", "figure_or_image": "Figure/image"}


def source_entry(kind: Column, pointer: Column, context: Column, image: Column, api_ids: Column, api_kind: Column) -> Column:
    """Provenance of a value: source_type, source_label, pointer, paper_location, source_image, source_context; blanks are null."""
    given = F.when(text.has_output(api_ids), F.concat(F.coalesce(F.nullif(F.upper(text.clean(api_kind)), F.lit("")), F.lit("API")), F.lit(" "), text.clean(api_ids)))
    at = F.coalesce(F.nullif(text.clean(pointer), F.lit("")), given, F.nullif(text.clean(image), F.lit("")), F.nullif(paper_location(context), F.lit("")))
    name = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in LABELS.items()])
    label = F.when(name.isNotNull(), F.concat_ws(": ", name, at)).otherwise(F.coalesce(at, F.nullif(paper_location(context), F.lit(""))))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        kind.alias("source_type"), some(label).alias("source_label"), at.alias("pointer"), F.coalesce(some(paper_location(at)), some(paper_location(context))).alias("paper_location"),
        some(text.clean(image)).alias("source_image"), some(F.substring(text.clean(context), 1, 600)).alias("source_context"))


def decide(field: str, now: str, now_source: str, value: str, r: dict, fill_only: bool) -> tuple[str, str]:
    """(action, value) of one field: write, refresh (the same value, its source renewed), keep, or why it is refused.

    r: of the record, source, priority, pdb, text, discovered, derived (the
    loop of its region), vh (its region), wrong_chain (fields whose value
    begins like the other chain), whole (fields that hold a whole region).
    """
    api = r["source"] == "api_fetch"
    if field == "CDRH3_Sequence" and r["derived"] and (api or (now and now not in r["vh"]) or not value):
        value = r["derived"]
    if not value:
        return "keep", now
    if field in REGIONS:
        if field not in r["whole"]:
            return "keep", now
        if field in r["wrong_chain"]:
            return "skip_chain_mismatch", now
    if not (fill_only and now):
        return ("write" if value != now else "refresh"), value
    held = PRIORITY.get(now_source, 0)
    if field in REGIONS:
        if value == now:
            return ("refresh" if r["priority"] > held or not held else "keep"), now
        if r["priority"] < held:
            return "keep_existing_higher_priority", now
    if value == now:
        return "refresh", now
    if r["pdb"] and field in (*REGIONS, "CDRH3_Sequence"):
        return "replace_with_pdb_authoritative", value
    if field == "CDRH3_Sequence":
        if api:
            return "replace_with_authoritative", value
        corrects = bool(r["derived"]) and now not in r["vh"] and value == r["derived"]
        if corrects and now_source in EXPLICIT:
            return "keep", now
        return ("write", value) if corrects or (len(value) > len(now) and now in value) else ("keep", now)
    if field not in REGIONS:
        return "keep", now
    if r["discovered"] and r["priority"] > held:
        return "replace_with_higher_priority_sequence", value
    if r["text"]:
        return "write", value
    if api:
        return "replace_with_authoritative", value
    return ("replace_with_higher_priority_sequence", value) if r["priority"] > held else ("keep", now)


class _Antibody:
    """One antibody: its own record, if there is one, then its evidence in order."""

    def __init__(self, key: tuple) -> None:
        self.key, self.name, self.created, self.open = key, None, False, False
        self.state, self.sources = dict.fromkeys(FIELDS, ""), dict.fromkeys(FIELDS, ("", ""))

    def record(self, r: dict) -> None:
        self.name, self.open = r["name"], True
        self.state = {f: r[f] or "" for f in FIELDS}
        self.sources |= {x["f"]: (x["s"] or "", "") for x in r["sources"] or []}

    def evidence(self, r: dict) -> Iterator[tuple]:
        """The decisions worth a note."""
        if not self.open:
            if not r["may_create"]:
                return
            self.open, self.created, self.name = True, True, r["name"]
        state, sources = self.state, self.sources
        fill_only = any(state[f] for f in ("CDRH3_Sequence", "vh_sequence_aa", "vl_sequence_aa", "Binding_Kinetics_KD"))
        for f in FIELDS:
            if not r[f] and not (f == "CDRH3_Sequence" and r["derived"]):
                continue
            action, value = decide(f, state[f], sources[f][0], r[f] or "", r, fill_only)
            if action == "keep":
                continue
            if not action.startswith(("skip", "keep")):
                sources[f] = (r["source"], r["pointer"] or "")
            if action not in ("write", "refresh"):
                yield (*self.key, self.name, f, value, *sources[f], action, self.created)
            state[f] = value

    def values(self) -> Iterator[tuple]:
        return ((*self.key, self.name, f, v, *self.sources[f], "value", self.created) for f, v in self.state.items() if v and self.open)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, those of an antibody one after another; a batch may end within one, so only its state is held."""
    schema = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.string()) for c in MERGED.split(", ")])
    to_batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
    one: _Antibody | None = None
    for batch in batches:
        names, out = batch.schema.names, []
        for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            r = dict(zip(names, values, strict=True))
            key = (r["paper_id"], r["name_key"])
            if one is None or one.key != key:
                if one is not None:
                    out += one.values()
                one = _Antibody(key)
            if r["kind"] == 0:
                one.record(r)
            else:
                out += one.evidence(r)
        if out:
            yield to_batch(out)
    if one is not None and (out := list(one.values())):
        yield to_batch(out)


def merge_evidence(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Values of every antibody's fields once its evidence is merged, and the decisions worth a note.

    records: paper_id, name, FIELDS, and sources (map of field to source
    type); evidence: paper_id, name, seq, FIELDS, source, pointer, context,
    pdb, isotype.  Result: a row a field with action `value`, and one for each
    replacement or refusal.  Evidence for a name without a record opens one
    (created) if it may: not about cited work, and a sequence together with a
    sequence image, a quantity or an isotype.  An antibody's rows follow one
    another in one task, which holds a batch of them and the state of one.
    """
    fields = lambda d: [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in d.columns else F.lit("").alias(f) for f in FIELDS]
    key = text.folded(F.col("name"))
    e = evidence.select("paper_id", key.alias("name_key"), "name", "seq", "source", "pointer", "context", "pdb", "isotype", *fields(evidence)).filter("name_key <> ''")
    region = {f: F.when(sequences.full_region(F.col(f), 160), sequences.letters(F.col(f))).otherwise(F.trim(f)) for f in REGIONS}
    e = e.withColumns({**region, "CDRH3_Sequence": sequences.letters(F.col("CDRH3_Sequence"))})
    e = bound(e, _h=sequences.full_region(F.col("vh_sequence_aa"), 160), _l=sequences.full_region(F.col("vl_sequence_aa"), 160), _hc=sequences.chain_of(F.col("vh_sequence_aa")), _lc=sequences.chain_of(F.col("vl_sequence_aa")))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (k, v)]), F.col("source")), F.lit(0))
    found = F.col("source").isin("sequence_image", "ocr_text_sequence")
    some = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(f)) for c, f in pairs]), lambda x: x.isNotNull())
    quantity = F.concat_ws("", *[F.trim(f) for f in FIELDS if f in R.EVIDENCE and f not in ("In_Vivo_Efficacy", "Structure")])
    has = F.col("_h") | F.col("_l") | (F.length("CDRH3_Sequence") >= 5)
    e = e.select(
        "paper_id", "name_key", "name", F.lit(1).alias("kind"), "seq", *FIELDS, "source", "pointer", rank.alias("priority"), F.coalesce("pdb", F.lit(False)).alias("pdb"), (F.col("source") == "ocr_text_sequence").alias("text"),
        found.alias("discovered"), F.when(F.col("_hc") != "light", sequences.loop_of(F.col("vh_sequence_aa"))).otherwise("").alias("derived"), F.col("vh_sequence_aa").alias("vh"),
        some((F.col("_h"), "vh_sequence_aa"), (F.col("_l"), "vl_sequence_aa")).alias("whole"), some((F.col("_hc") == "light", "vh_sequence_aa"), (F.col("_lc") == "heavy", "vl_sequence_aa")).alias("wrong_chain"),
        (~R.cited(F.col("context"), F.col("pointer")) & has & (found | (quantity != "") | text.has_output(F.col("isotype")))).alias("may_create"), F.lit(None).cast("array<struct<f:string,s:string>>").alias("sources"))
    sources = F.transform(F.map_entries("sources"), lambda x: F.struct(x["key"].alias("f"), x["value"].alias("s"))) if "sources" in records.columns else F.lit(None).cast("array<struct<f:string,s:string>>")
    r = records.select("paper_id", key.alias("name_key"), "name", *fields(records), sources.alias("sources")).filter("name_key <> ''")
    r = r.groupBy("paper_id", "name_key").agg(*[F.first(c).alias(c) for c in ("name", *FIELDS, "sources")])  # of several records of a name the first is written into
    blank = {c: F.lit(None).cast(dict(e.dtypes)[c]) for c in e.columns if c not in r.columns}
    r = r.withColumns(blank | {"kind": F.lit(0), "seq": F.lit(-1).cast(dict(e.dtypes)["seq"])})
    rows = e.unionByName(r.select(*e.columns)).repartition("paper_id", "name_key")
    return rows.sortWithinPartitions("paper_id", "name_key", "kind", F.asc_nulls_last("seq")).mapInArrow(_merged, MERGED)
