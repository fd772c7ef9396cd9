"""Merging evidence: sources by priority, provenance of each field, values shared within a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import sequences, text, units
from lectern.functions.binding import bound
from lectern.operators.records import structure_fits, target_key

#: Priority of a source; a later kind of evidence outranks an earlier one.
PRIORITY = {"text": 1, "figure": 1, "table": 1, "sequence_image": 2, "api": 3}


def priority(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (k, v)])
    return F.coalesce(F.element_at(table, source), F.lit(0))


def merge_fields(evidence: DataFrame) -> DataFrame:
    """evidence (paper_id, name, field, value, source, seq) -> one value a field, with where it came from.

    Blank values never win.  Regions of variable domains must be whole and go
    to the source of highest priority; every other field keeps the first value
    seen, whatever the source; conflict tells whether values differed.  One
    aggregation by (paper, name, field): a record with any number of pieces of
    evidence combines map-side.
    """
    region = F.col("field").isin("vh_sequence_aa", "vl_sequence_aa")
    rows = bound(evidence, _value=F.col("value"), _key=text.name_key(F.col("name")))
    rows = bound(rows, _letters=F.when(region, sequences.letters(F.col("_value"))), _low=text.folded(F.col("_value")))
    whole = sequences.standard(F.col("_letters")) & F.length("_letters").between(80, 160)
    rows = rows.filter((F.col("_low") != "") & (~region | whole))
    rank = F.when(region, priority(F.col("source"))).otherwise(F.lit(0))
    best = F.max_by(F.struct("name", F.col("_value").alias("value"), "source"), F.struct(rank, -F.col("seq")))
    return rows.groupBy("paper_id", F.col("_key").alias("name_key"), "field").agg(best.alias("b"), F.count("*").alias("n_evidence"), (F.min("_low") != F.max("_low")).alias("conflict")).select(
        "paper_id", "name_key", "b.name", "field", "b.value", "b.source", "n_evidence", "conflict")


def consensus(values: Column) -> Column:
    """The one value that all non-blank values are, case aside; else empty. For use in an aggregation."""
    filled = F.nullif(text.clean(values), F.lit(""))
    return F.when(F.count_distinct(F.lower(filled)) == 1, F.min(filled)).otherwise("")


def longest_by_name(records: DataFrame, by: list[str], fields: list[str], valid=text.has_output) -> DataFrame:
    """The longest valid value of each field within a key; of equal lengths the one that sorts first."""
    pick = lambda f: F.min_by(F.when(valid(F.col(f)), F.col(f)), F.when(valid(F.col(f)), F.struct(-F.length(F.col(f)), F.col(f))))
    return records.groupBy(*by).agg(*[F.coalesce(pick(f), F.lit("")).alias(f) for f in fields])


def fill_within_name(records: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Blank fields take the longest value that a record of the same key has."""
    best = longest_by_name(records.select(*by, *fields), by, fields).select(*by, *[F.col(f).alias(f"_{f}") for f in fields])
    out = records.join(best, by, "left")
    return out.withColumns({f: F.when(text.has_output(F.col(f)), F.col(f)).otherwise(F.coalesce(f"_{f}", F.lit(""))) for f in fields}).drop(*[f"_{f}" for f in fields])


def duplicate_values(records: DataFrame, fields: list[str], name: str) -> DataFrame:
    """field, sequence, n, name: a row a record for values that several share, once upper-cased and freed of spaces.

    A value's records stay rows: one that a third of all share is gathered nowhere.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.regexp_replace(F.upper(F.coalesce(F.col(f), F.lit(""))), r"\s+", "").alias("sequence")) for f in fields])
    rows = records.select(F.col(name).alias("name"), F.explode(each).alias("x")).select("name", "x.*").filter("sequence <> ''")
    several = rows.groupBy("field", "sequence").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(several, ["field", "sequence"]).select("field", "sequence", "n", "name")


def chain_lookup(wanted: DataFrame, chains: DataFrame) -> DataFrame:
    """wanted (name HxLy, heavy, light and maybe vh, vl) with the longest sequence of each id from chains (chain_id, sequence, seq); filled ones stay."""
    best = chains.filter(text.has_output(F.col("sequence"))).groupBy("chain_id").agg(F.max_by("sequence", F.struct(F.length("sequence"), -F.col("seq"))).alias("s"))
    heavy, light = best.select(F.col("chain_id").alias("heavy"), F.col("s").alias("_vh")), best.select(F.col("chain_id").alias("light"), F.col("s").alias("_vl"))
    out = wanted.join(heavy, "heavy", "left").join(light, "light", "left")
    own = lambda c: F.when(text.has_output(F.col(c)), F.col(c)) if c in wanted.columns else F.lit(None)
    return out.withColumns({"vh": F.coalesce(own("vh"), "_vh"), "vl": F.coalesce(own("vl"), "_vl")}).drop("_vh", "_vl")


def nearest_bonus(distance: Column) -> Column:
    """Bonus of an image by its distance to the nearest image with evidence."""
    return F.when(distance == 0, 12).when(distance == 1, 22).when(distance == 2, 10).otherwise(0)


def nearest_evidence(images: DataFrame, reach: int = 2) -> DataFrame:
    """images (doc_id, pos, evidence) with the distance to the nearest evidence within reach: an equi-join on positions, not a band scan."""
    offsets = F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1)]))
    around = images.filter("evidence").select("doc_id", offsets.alias("d"), "pos").select("doc_id", (F.col("pos") + F.col("d")).alias("pos"), F.abs("d").alias("d"))
    near = around.groupBy("doc_id", "pos").agg(F.min("d").alias("distance"))
    return images.join(near, ["doc_id", "pos"], "left").withColumn("bonus", nearest_bonus(F.col("distance")))


#: What tells two profiles of one antibody apart.
PROFILE = ["Binding_Kinetics_KD", "Binding_Kinetics_kon", "Binding_Kinetics_koff", "Binding_EC50", "Quantitative_Metric", "Thermal_Stability_Tm"]


def expand_targets(records: DataFrame, evidence: DataFrame, cleared: tuple[str, ...] = (*PROFILE, "In_Vivo_Efficacy")) -> DataFrame:
    """records (paper_id, name, Target_Name, ...) with one record a target for antibodies whose evidence has several.

    evidence (paper_id, name, Target_Name, fields, seq): an antibody is split
    only if its evidence names two targets or more and its filled profiles
    (metrics, blanks and case aside) are two or more, all with a target.  Each
    target's record is the one that is there, or a copy of the first without
    its metrics and without a structure of another complex; then what the
    target's evidence says, field by field the first that is filled, is
    written into it.
    """
    fields = [c for c in evidence.columns if c in records.columns and c not in ("paper_id", "name", "Target_Name")]
    key, target = text.folded(F.col("name")).alias("_k"), target_key(F.col("Target_Name")).alias("_c")
    signature = F.concat_ws("|", *[units.metric_key(F.col(c)) for c in PROFILE if c in evidence.columns])
    said = evidence.select("paper_id", key, target, "Target_Name", "seq", *fields, signature.alias("_sig")).filter("_k <> ''")
    filled = F.regexp_replace("_sig", r"\|", "") != ""
    able = said.groupBy("paper_id", "_k").agg(
        F.count_distinct(F.when(F.col("_c") != "", F.col("_c"))).alias("targets"), F.count_distinct(F.when(filled, F.struct("_c", "_sig"))).alias("profiles"),
        F.count_distinct(F.when(filled, F.col("_c"))).alias("profiled"), F.max(F.when(filled & (F.col("_c") == ""), 1).otherwise(0)).alias("nameless"))
    able = able.filter("targets > 1 AND profiles > 1 AND profiled > 1 AND nameless = 0").select("paper_id", "_k")
    first = lambda c: F.min_by(F.when(text.has_output(F.col(c)), F.col(c)), F.when(text.has_output(F.col(c)), F.col("seq"))).alias(f"_n_{c}")
    wanted = said.filter(filled).join(able, ["paper_id", "_k"]).groupBy("paper_id", "_k", "_c").agg(F.min_by("Target_Name", "seq").alias("_n_Target_Name"), *map(first, fields))

    rows = records.withColumns({"_k": text.folded(F.col("name")), "_c": target_key(F.col("Target_Name")), "_i": F.monotonically_increasing_id()})
    own = rows.join(wanted, ["paper_id", "_k", "_c"], "left")
    base = rows.filter("_k <> ''").groupBy("paper_id", "_k").agg(F.min_by(F.struct(*records.columns), "_i").alias("_b"))
    new = wanted.join(rows.select("paper_id", "_k", "_c"), ["paper_id", "_k", "_c"], "left_anti").join(base, ["paper_id", "_k"])
    new = new.select(*[F.col(f"_b.{c}").alias(c) for c in records.columns], *[f"_n_{c}" for c in ("Target_Name", *fields)])
    blank = {c: F.lit("") for c in cleared if c in records.columns}
    if "Structure" in records.columns:
        blank["Structure"] = F.when(structure_fits(F.col("Structure"), F.col("_n_Target_Name")), F.col("Structure")).otherwise("")
    new = new.withColumns(blank)
    told = [F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in ("Target_Name", *fields) else F.col(c) for c in records.columns]
    return own.select(*told).unionByName(new.select(*told))
