"""Replies of a model as records: their shape, their fields, and pages of them as one list."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import sequences, text, validate
from lectern.operators import records as R

RECORDS = "array<struct<idx:int,record:map<string,string>,hints:map<string,string>>>"
#: Old names of fields, those that are dropped, and what a value tells of where it is from.
OLD_NAMES = {"Affinity_nM": "Binding_Kinetics_KD", "External_Database_ID": "Structure"}
DROPPED = ("PK_source", "VH_Germline", "VL_Germline")
HINTS = ("value", "pointer", "action", "quote", "germline", "confidence")
POINTERS = ("Script Extract", "API Fetch")
#: Which measurement an assay's name means, in order of trial.
ASSAY_FIELDS = [(("kd", "dissociation"), "Binding_Kinetics_KD"), (("ec50",), "Binding_EC50"), (("kon", "ka"), "Binding_Kinetics_kon"), (("koff",), "Binding_Kinetics_koff")]
KEY_FIELDS = ["Antibody_Name", "Target_Name", "Antibody_Type", "Experiment", "Structure"]


def record_list(reply: object, paper_id: str) -> list[dict]:
    """The records of a reply in any of its shapes: by paper, bare, a list, under another paper's id, or one record."""
    if isinstance(reply, list):
        found = reply
    elif not isinstance(reply, dict):
        found = []
    elif isinstance(reply.get(paper_id), dict):
        found = reply[paper_id].get("antibodies")
    elif "antibodies" in reply:
        found = reply["antibodies"]
    else:
        other = next((v for v in reply.values() if isinstance(v, dict) and "antibodies" in v), None)
        found = other["antibodies"] if other else [reply]
    return [r for r in found or [] if isinstance(r, dict)]


def _value(v: object) -> object:
    """What a field's object says: its value, or its quote unless it only points elsewhere."""
    if not isinstance(v, dict):
        return v
    if v.get("value") or "quote" not in v or v.get("action") in POINTERS:
        return v.get("value", "")
    return v["quote"] or ""


def _mechanisms(items: list) -> tuple[str, str]:
    kinds = [_value(x.get("MoA_Type")) for x in items if isinstance(x, dict)]
    metrics = [x["Quantitative_Metric"] for x in items if isinstance(x, dict) and isinstance(x.get("Quantitative_Metric"), dict)]
    told = [f"{m['metric_name']} = {m['metric_value']}" if m.get("metric_name") else str(m["metric_value"]) for m in metrics if m.get("metric_value")]
    return "; ".join(str(k) for k in kinds if k), "; ".join(told)


def _measured(assay: str) -> str:
    return next((f for words, f in ASSAY_FIELDS if any(w in assay for w in words)), "Binding_Kinetics_KD")


def repaired(record: dict) -> tuple[dict, dict]:
    """(fields as text, hints as JSON) of a record: old names, lists of measurements and objects give way to plain fields."""
    rest, out, hints = dict(record), {}, {}
    given = []
    old = rest.pop("Experiment_value", None)
    if isinstance(old, str) and old:
        given.append(("Binding_Kinetics_KD", old))
    for m in old if isinstance(old, list) else []:
        if isinstance(m, dict) and m.get("value"):
            given.append((_measured(str(m.get("assay") or "").lower()), m["value"]))
    given += [(new, _value(rest.pop(name))) for name, new in OLD_NAMES.items() if name in rest]
    for name in DROPPED:
        rest.pop(name, None)
    if isinstance(rest.get("Mechanism_of_Action"), list):
        rest["Mechanism_of_Action"], metrics = _mechanisms(rest["Mechanism_of_Action"])
        given.append(("Quantitative_Metric", metrics))
    for k, v in rest.items():
        if k.startswith("_"):
            continue
        if isinstance(v, dict):
            hints[k] = json.dumps({m: v[m] for m in HINTS if v.get(m) not in (None, "")}, ensure_ascii=False, separators=(",", ":"))
        v = _value(v)
        out[k] = "" if v is None else "; ".join(str(x) for x in v) if isinstance(v, list) else str(v)
    for k, v in given:
        if v and not out.get(k):
            out[k] = str(v)
    return out, {k: h for k, h in hints.items() if h != "{}"}


def _records(reply: str | None, paper: str | None) -> list[dict]:
    try:
        body = json.loads(reply or "null")
    except ValueError:
        return []
    found = [repaired(r) for r in record_list(body, paper or "")]
    return [{"idx": i, "record": fields, "hints": hints} for i, (fields, hints) in enumerate(found)]


def reply_records(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies (paper_id, reply) -> paper_id, ab_idx, record, hints: one row a record, its fields as text.

    A reply of another shape, or none that parses, has no records.  Sequences
    that are not whole, experiments beside the point and references in other
    forms are put right: see tidy().
    """

    @F.pandas_udf(RECORDS)
    def of(bodies: pd.Series, papers: pd.Series) -> pd.Series:
        return pd.Series([_records(b, p) for b, p in zip(bodies, papers, strict=True)], dtype=object)

    rows = replies.select("paper_id", F.explode(of(F.col(reply), F.col("paper_id"))).alias("r"))
    return rows.select("paper_id", F.col("r.idx").alias("ab_idx"), tidy(F.col("r.record")).alias("record"), F.col("r.hints").alias("hints"))


def tidy(record: Column) -> Column:
    """A record (map) with its sequences, experiment and reference in canonical form; what is no sequence is blank."""
    loop = lambda v: F.when(R.without_sequence(v), "").otherwise(sequences.loop_or_blank(v))
    region = lambda v: F.when(R.without_sequence(v), "").otherwise(sequences.region_or_blank(v))
    fixed = F.transform_values(record, lambda k, v: (
        F.when(k == "CDRH3_Sequence", loop(v)).when(k.isin("vh_sequence_aa", "vl_sequence_aa"), region(v)).when(k == "Experiment", validate.assay_list(v))
        .when(k == "Reference_Source", text.reference(v)).otherwise(v)
    ))
    return fixed


def identity(record: Column) -> Column:
    """What makes two records of a paper the same: the name, and target, type, experiment and structure where any is filled."""
    parts = [F.trim(F.regexp_replace(text.folded(F.try_element_at(record, F.lit(f))), r"\s+", " ")) for f in KEY_FIELDS]
    rest = F.concat_ws("", *parts[1:])
    return F.when(rest != "", F.concat_ws("|", *parts)).otherwise(parts[0])


def one_list(pages: DataFrame, most_pages: int) -> DataFrame:
    """pages (paper_id, page, has_more, ab_idx, record) -> the paper's records, of equal identities the fuller (else the earlier) one.

    Pages count up to the limit, to one that says it was the last, and to one
    without a record that is new; what is new is known from the first page of
    each identity, so no page waits for the one before.
    """
    rows = pages.withColumn("_id", identity(F.col("record"))).filter((F.col("page") <= most_pages) & (F.col("_id") != ""))
    first = rows.groupBy("paper_id", "_id").agg(F.min("page").alias("page"))
    fresh = first.groupBy("paper_id", "page").agg(F.count("*").alias("new"))
    told = pages.filter(F.col("page") <= most_pages).groupBy("paper_id", "page").agg(F.max(F.coalesce("has_more", F.lit(False)).cast("int")).alias("more"))
    stop = told.join(fresh, ["paper_id", "page"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    last = stop.groupBy("paper_id").agg(F.min(F.when((F.col("more") == 0) | (F.col("new") == 0), F.col("page"))).alias("last"))
    kept = rows.join(last, "paper_id").filter(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    filled = F.size(F.filter(F.map_values("record"), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""))
    best = F.min_by(F.struct("page", "ab_idx", "record"), F.struct(-filled, F.col("page"), F.col("ab_idx")))
    place = F.min(F.struct("page", "ab_idx"))
    return kept.groupBy("paper_id", "_id").agg(best.alias("b"), place.alias("at")).select("paper_id", F.col("_id").alias("identity"), "at", "b.record")
