"""Checks of records and annotations as arrays of (check, status), and canonical forms of free-text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text

#: Methods that read out binding, in order, and families of methods that do not.
ASSAYS = [
    (r"\bflow cytometry\b|\bfacs\b", "Flow Cytometry"), (r"\belisa\b", "ELISA"), (r"\bitc\b|isothermal titration calorimetry", "ITC"), (r"\bbli\b|biolayer interferometry", "BLI"),
    (r"\bspr\b|surface plasmon resonance", "SPR"), (r"microneutralization", "Microneutralization assay"), (r"neutralization", "Neutralization assay"), (r"\bbeacon\b", "Beacon"), (r"\bilsda\b", "ILSDA"),
]
NOT_ASSAYS = [
    (r"western blot|\bwb\b", "Western blot"), (r"x-ray|xray|cryo-?em|crystallography", "crystallography"), (r"sequencing", "sequencing"), (r"sorting|gating|expression qc", "sorting/gating"),
    (r"challenge|mouse model|in vivo", "challenge/in vivo model"), (r"immunoprecipitation|lc-?ms|mass spectrometry", "immunoprecipitation/LC-MS"),
]
#: Types that say enough, and those that say too little.
SPECIFIC_TYPES = ["igg1", "igg2", "igg3", "igg4", "igm", "iga", "vhh", "nanobody", "scfv", "fab", "bispecific"]
VAGUE_TYPES = ["单克隆抗体", "中和抗体", "monoclonal antibody"]
#: Fields that a record must have, and those it should fill.
REQUIRED = ["Antibody_Name", "Antibody_Type", "Target_Name", "Experiment", "CDRH3_Sequence", "vh_sequence_aa", "vl_sequence_aa", "Reference_Source"]
RECOMMENDED = ["Binding_Kinetics_KD", "Mechanism_of_Action", "source"]
#: Labels that need a look, and what an annotation of each says unless it is told otherwise.
ISSUES = ["wrong", "miss", "partial"]
ERROR_TYPES = {"wrong": "value_mismatch", "miss": "missing_prediction", "partial": "incomplete_value"}


def _found(value: Column, patterns: list[tuple[str, str]]) -> Column:
    low = F.lower(value)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(name)) for p, name in patterns]), lambda x: x.isNotNull())


def assay_list(value: Column) -> Column:
    """The methods that patterns find, in their order; where there is none, the list without methods beside the point."""
    found = _found(text.clean(value), ASSAYS)
    items = F.filter(F.transform(F.split(text.clean(value), text.LIST_BREAK), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).rlike("|".join(p for p, _ in NOT_ASSAYS)))
    return F.array_join(F.when(F.size(found) > 0, found).otherwise(items), ", ")


def _check(name: str, status: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), status.alias("status"))


def _kept(checks: list[Column]) -> Column:
    return F.filter(F.array(*checks), lambda c: c["status"].isNotNull())


def germline_checks(heavy: Column, light: Column) -> Column:
    """Identity of both genes (under 80 % warns, none at all warns) and whether a gene stands on the wrong chain's side (fails)."""
    out = []
    for name, gene, wrong in (("VH_germline", heavy, r"^(IG)?[KL]V"), ("VL_germline", light, r"^(IG)?HV|^VH")):
        g = text.clean(gene)
        share = F.regexp_extract(g, r"(\d+\.?\d*)\s*%", 1).try_cast("double")
        v_gene = F.regexp_extract(g, r"((?:IG)?[HKL]?V\d+-\d+)", 1)
        out += [
            _check(f"{name}_identity", F.when(share.isNotNull(), F.when(share < 80, "warn").otherwise("pass"))),
            _check(f"{name}_chain_mismatch", F.when(v_gene.rlike(wrong), "fail")),
            _check(f"{name}_identity_present", F.when(g != "", F.when(share.isNotNull(), "pass").otherwise("warn"))),
        ]
    return _kept(out)


def type_check(kind: Column) -> Column:
    """warn for a type that names no class or format, null otherwise."""
    low = text.folded(kind)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.when(has(VAGUE_TYPES) & ~has(SPECIFIC_TYPES), "warn")


def experiment_check(value: Column) -> Column:
    """The families of methods beside the point that an experiment names."""
    return _found(text.clean(value), NOT_ASSAYS)


def field_checks(record: Column) -> Column:
    """Checks of a record (map): required fields that it lacks warn, recommended ones without a value are noted."""
    missing = [_check(f"missing_field:{f}", F.when(~F.map_contains_key(record, F.lit(f)), "warn")) for f in REQUIRED]
    empty = [_check(f"missing_recommended:{f}", F.when(text.clean(F.try_element_at(record, F.lit(f))).isin("", "N/A", "null", "None"), "info")) for f in RECOMMENDED]
    return _kept(missing + empty)


def renamed_checks(record: Column, names: dict[str, str]) -> Column:
    """A warning for each field that goes by an old name; names: old to new."""
    return _kept([_check(f"field_name:{old}>{new}", F.when(F.map_contains_key(record, F.lit(old)), "warn")) for old, new in names.items()])


def first_of(record: Column, keys: list[str]) -> Column:
    """Value of the first key that a record (map) has, blank or not; null if it has none."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(record, F.lit(k)), F.try_element_at(record, F.lit(k))).otherwise(out)
    return out


def review(statuses: Column, tries: Column, most: int = 2) -> Column:
    """accept, retry while a check fails and tries are left, else give_up."""
    failed = F.array_contains(statuses, "fail")
    return F.when(~failed, "accept").when(tries < most, "retry").otherwise("give_up")


def annotation_defaults(label: Column, weight: Column) -> Column:
    """What an annotation says before anyone has edited it: status, final_label, error_types, severity."""
    issue = label.isin(ISSUES)
    kinds = F.create_map(*[F.lit(x) for k, v in ERROR_TYPES.items() for x in (k, v)])
    return F.struct(
        F.when(issue, "reviewed").otherwise("ignored").alias("status"), label.alias("final_label"), F.when(issue, F.array(F.element_at(kinds, label))).otherwise(F.array().cast("array<string>")).alias("error_types"),
        F.when(issue & (weight >= 2.5), "high").when(issue, "medium").otherwise("low").alias("severity"))


def needs_review(label: Column, status: Column) -> Column:
    return label.isin(ISSUES) & (status.isNull() | (status == "pending"))


def payload_problem(status: Column, final_label: Column, error_types: Column) -> Column:
    """Why an annotation can't be taken, null if it can."""
    return F.when((status == "reviewed") & (text.clean(final_label) == ""), "final_label is required").when((final_label == "exact") & (F.size(F.coalesce(error_types, F.array().cast("array<string>"))) > 0), "error_types must be empty")


def settled_payload(status: Column, final_label: Column, original_label: Column, error_types: Column) -> Column:
    """final_label and error_types as they are stored: repeats go, and an ignored issue keeps its label and no types."""
    ignored = status == "ignored"
    return F.struct(
        F.when(ignored & (text.clean(final_label) == ""), original_label).otherwise(final_label).alias("final_label"),
        F.when(ignored, F.array().cast("array<string>")).otherwise(F.array_distinct(error_types)).alias("error_types"))
