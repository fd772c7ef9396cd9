"""Rules that decide a field's label without a model: sequences, methods, types, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.binding import let

SEQUENCE_FIELDS = ["CDRH3_Sequence", "vh_sequence_aa", "vl_sequence_aa"]
RESIDUES = "ACDEFGHIKLMNPQRSTVWYX"
#: Methods by pattern, those that read out binding directly, and those beside the point.
METHODS = [
    (r"\bflow cytometry\b|\bfacs\b", "flowcytometry"), (r"\belisa\b", "elisa"), (r"\bitc\b|isothermal titration calorimetry", "itc"),
    (r"\bbli\b|biolayer interferometry", "bli"), (r"\bspr\b|surface plasmon resonance", "spr"), (r"microneutralization", "microneutralizationassay"),
    (r"neutralization", "neutralizationassay"), (r"\bbeacon\b", "beacon"), (r"\bilsda\b", "ilsda"), (r"western blot|\bwb\b", "westernblot"),
    (r"x-ray|xray|crystallography", "xraycrystallography"), (r"cryo-?em|cryo electron microscopy", "cryoem"), (r"sorting", "sorting"), (r"gating", "gating"),
    (r"sequencing", "sequencing"), (r"challenge", "challenge"), (r"mouse model|in vivo", "mousemodel"), (r"lc-?ms|mass spectrometry", "lcms"),
    (r"immunoprecipitation", "immunoprecipitation"), (r"gliding assay|trail-gliding assay", "glidingassay"),
]
DIRECT = [
    "elisa", "itc", "spr", "bli", "flowcytometry", "facs", "neutralizationassay", "microneutralizationassay", "pseudovirusneutralization",
    "livevirusneutralization", "beacon", "biolayerinterferometry", "surfaceplasmonresonance", "ilsda",
]
PERIPHERAL = [
    "westernblot", "wb", "xray", "xraycrystallography", "cryoem", "cryoelectronmicroscopy", "crystallography", "sequencing", "vdjsequencing", "bcellsorting", "sorting",
    "gating", "expressionqc", "mousemodel", "invivomousemodel", "challenge", "mosquitobitechallenge", "lcms", "massspectrometry", "immunoprecipitation",
    "trailglidingassay", "glidingassay",
]
TYPES = [
    (r"\bbispecific\b", "bispecific"), (r"\bvhh\b|nanobody", "vhh"), (r"\bscfv\b", "scfv"), (r"\bfab\b", "fab"), (r"\biga\b", "iga"), (r"\bigm\b", "igm"),
    (r"\bige\b", "ige"), (r"\bigd\b", "igd"), (r"\bigg(?:[1-4])?\b", "igg"), (r"monoclonal antibody|\bmab\b", "mab"),
]


def _tags(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(tag)) for p, tag in patterns]), lambda x: x.isNotNull())


def methods(value: Column) -> Column:
    """Methods that patterns find, else the items of the list."""
    found = _tags(T.folded(value), METHODS)
    return F.when(F.size(found) > 0, found).otherwise(T.list_tokens(value))


def type_tags(value: Column) -> Column:
    return _tags(T.folded(value), TYPES)


def looks_like_residues(value: Column) -> Column:
    """Eight residues at least, with gaps and dots and nothing else."""
    return F.upper(F.regexp_replace(value, r"\s+", "")).rlike(f"^[-.]*([{RESIDUES}][-.]*){{8,}}$")


def residues(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z]", "")


def parts(field: Column, value: Column) -> Column:
    """What the rules compare of a value, each part only for the fields that use it."""
    reference = F.struct(T.doi(value).alias("doi"), T.year(value).alias("year"), T.first_author(value).alias("author"), T.journal(value).alias("journal"))
    sequence = F.struct(residues(value).alias("letters"), looks_like_residues(value).alias("real"), T.folded(value).isin(T.EMPTY_SEQUENCE).alias("none"))
    return F.struct(
        F.when(field.isin(SEQUENCE_FIELDS), sequence).alias("sequence"), F.when(field == "Experiment", methods(value)).alias("methods"),
        F.when(field == "Antibody_Type", type_tags(value)).alias("tags"), F.when(field == "Reference_Source", reference).alias("reference"))


def _sequences(a: Column, b: Column) -> Column:
    x, y = a["letters"], b["letters"]
    longest = F.greatest(F.length(x), F.length(y), F.lit(1))
    compared = F.when((x == y) | F.contains(x, y) | F.contains(y, x), "exact").when(F.levenshtein(x, y) / longest <= 0.10, "partial").otherwise("wrong")
    return F.when(a["none"] & b["none"], "exact").when(a["none"] | b["none"], "wrong").when(a["real"] & b["real"], compared)


def _methods(a: Column, b: Column) -> Column:
    missing, extra, shared = F.size(F.array_except(a, b)), F.array_except(b, a), F.size(F.array_intersect(a, b))
    beside, direct = F.size(F.array_intersect(extra, F.array(*map(F.lit, PERIPHERAL)))), F.size(F.array_intersect(extra, F.array(*map(F.lit, DIRECT))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), (
        F.when((missing == 0) & (F.size(extra) == 0), "exact").when((missing == 0) & (beside > 0), "partial")
        .when((missing == 0) & (direct == F.size(extra)), "exact").when(shared > 0, "partial").otherwise("wrong")
    ))


def _types(a: Column, b: Column) -> Column:
    only = lambda x, allowed: F.size(F.array_except(x, F.array(*map(F.lit, allowed)))) == 0
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.when(F.arrays_overlap(a, b) | (only(a, ["mab"]) & only(b, ["mab", "igg"])), "exact").otherwise("wrong"))


def _references(a: Column, b: Column) -> Column:
    two = (a["doi"] != "") & (b["doi"] != "")
    same = (a["author"] != "") & (a["author"] == b["author"]) & (a["year"] != "") & (a["year"] == b["year"])
    near = (a["journal"] != "") & (b["journal"] != "") & (F.contains(a["journal"], b["journal"]) | F.contains(b["journal"], a["journal"]))
    return F.when(two & (a["doi"] == b["doi"]), "exact").when(same, F.when(two, "partial").when(near | (a["doi"] != "") | (b["doi"] != ""), "exact").otherwise("partial"))


def label_of_parts(field: Column, a: Column, b: Column) -> Column:
    """The label by rule from two values' parts, null where only a model could tell."""
    return (
        F.when(field.isin(SEQUENCE_FIELDS), _sequences(a["sequence"], b["sequence"]))
        .when(field == "Experiment", _methods(a["methods"], b["methods"]))
        .when(field == "Antibody_Type", _types(a["tags"], b["tags"]))
        .when(field == "Reference_Source", _references(a["reference"], b["reference"]))
    )


def rule_label(field: Column, gt: Column, pred: Column) -> Column:
    """The label by rule, null where only a model could tell; each value's parts are computed once."""
    both = F.struct(parts(field, T.clean(gt)).alias("a"), parts(field, T.clean(pred)).alias("b"))
    return let(both, lambda x: label_of_parts(field, x["a"], x["b"]))


def sequence_label(gt: Column, pred: Column) -> Column:
    """exact for equal or contained, partial within a tenth of edits, else wrong; null where text is no sequence."""
    return rule_label(F.lit(SEQUENCE_FIELDS[0]), gt, pred)


def method_label(gt: Column, pred: Column) -> Column:
    """Missing, shared and extra methods: extra ones beside the point make a whole list partial, direct ones do not."""
    return rule_label(F.lit("Experiment"), gt, pred)


def type_label(gt: Column, pred: Column) -> Column:
    """Any shared tag is exact; a plain mAb accepts an IgG, an IgG does not accept a plain mAb."""
    return rule_label(F.lit("Antibody_Type"), gt, pred)


def reference_label(gt: Column, pred: Column) -> Column:
    """Null unless the DOIs agree or author and year do."""
    return rule_label(F.lit("Reference_Source"), gt, pred)


def label_score(label: Column) -> Column:
    return F.when(label == "exact", 1.0).when(label == "partial", 0.5).otherwise(0.0)
