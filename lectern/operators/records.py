"""Filters, expansions and joins of extracted records."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import sequences, text
from lectern.functions.binding import let
from lectern.operators.blocks import top_k

#: Generic types that an isotype makes precise, and the classes they become.
GENERIC_TYPE = ["mab", "monoclonal antibody"]
CLASSES = ["IgG", "IgA", "IgM", "IgD", "IgE"]
GERMLINE_NAME = r"(?i)^IG[HKL]V\d|^V[HKL]\d+-\d+"
CHILD_NAME = r"(?i).+-[HL]\d+$"
COMPONENT_NAME = r"(?i).*/KJ\d+$"
ANCESTRAL = r"(?i)mrca|ancestor|germline|reversion"
CHAIN_SWAP = r"[a-z0-9]+h[a-z0-9]+[kl]$"
#: Fields that count one point each as evidence, where filled.
EVIDENCE = [
    "Binding_Kinetics_KD", "Binding_Kinetics_kon", "Binding_Kinetics_koff", "Binding_EC50", "Quantitative_Metric", "Thermal_Stability_Tm", "In_Vivo_Efficacy",
    "Structure", "Target_Name", "Experiment",
]
#: Order of labels on the issue list.
LABEL_ORDER = {"wrong": 0, "miss": 1, "partial": 2}


def auxiliary_name(name: Column) -> Column:
    """Names of germline genes, chain children and joining components: no records of their own."""
    n = text.clean(name)
    return n.rlike(GERMLINE_NAME) | n.rlike(CHILD_NAME) | n.rlike(COMPONENT_NAME)


def precise_type(kind: Column, isotype: Column) -> Column:
    """A generic type becomes the class found in the isotype."""
    found = F.coalesce(*[F.when(F.contains(F.lower(F.coalesce(isotype, F.lit(""))), F.lit(c.lower())), F.lit(c)) for c in CLASSES])
    return F.when(text.folded(kind).isin(GENERIC_TYPE) & found.isNotNull(), found).otherwise(kind)


#: Words that tell a failed candidate and a control from its target or mechanism.
FAILED = ["failed", "unsuccessful", "not recovered", "amplification failed", "could not be"]
CONTROL = ["previously tested", "used as control", "control antibody", "non-neutralizing", "reference antibody"]
#: Phrases by which evidence is about cited work.
CITED = [
    r"\bcontrol mabs?\b", r"\bcontrol abs?\b", r"\bcontrol antibodies\b", r"\bused as control\b", r"\bpreviously described\b", r"\bpreviously published\b", r"\bpublished previously\b",
    r"\bother representative .* antibodies\b", r"\bpublic clonotypes?\b", r"\bpublic mabs?\b", r"\binfected patients and vaccinees\b", r"\bclonotyping\b", r"\bjunctional sequence analysis\b",
    r"\bparallel lineage\b", r"\binferred germline\b", r"\bigl mabs?\b", r"\bgroup [12] rbd bnabs?\b",
]


def construct(name: Column, kind: Column) -> Column:
    """Ancestors, germline reversions, chimeras and chain swaps."""
    bare = F.regexp_replace(text.folded(name), r"[\s\-_]+", "")
    return bare.rlike(ANCESTRAL) | F.contains(text.folded(kind), F.lit("chimeric")) | bare.rlike(CHAIN_SWAP)


def _says(words: list[str], *where: Column) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: reduce(lambda x, y: x | y, [F.contains(text.folded(c), w) for c in where]))


def non_core(record: dict[str, Column]) -> Column:
    """Whether a record is no antibody of the paper's own, from its fields.

    A failed candidate without any sequence, a control without sequence and
    affinity, or a construct.
    """
    get = lambda f: record.get(f, F.lit(""))
    sequence = reduce(lambda x, y: x | y, [~text.clean(get(f)).isin("", "N/A", "null") for f in ("CDRH3_Sequence", "vh_sequence_aa", "vl_sequence_aa")])
    about = (get("Target_Name"), get("Mechanism_of_Action"))
    failed, control = _says(FAILED, *about) & ~sequence, _says(CONTROL, *about) & ~sequence & ~text.has_output(get("Binding_Kinetics_KD"))
    return failed | control | construct(get("Antibody_Name"), get("Antibody_Type"))


def cited(*context: Column) -> Column:
    """Whether evidence is about cited work, controls or clonotypes, by its context and image names."""
    low = F.lower(F.concat_ws(" ", *context))
    return low.rlike("|".join(CITED))


def without_sequence(value: Column) -> Column:
    """Whether a sequence field says in words that there is none, or where it stands."""
    raw = text.folded(value)
    marker = raw.isin("n/a", "na", "none", "null", "unknown", "not provided", "not reported", "not available", "not found", "missing")
    return marker | raw.rlike(r"\b(?:not provided|not reported|not available|not found|missing|unknown)\b") | (F.contains(raw, F.lit("sequence")) & raw.rlike(r"\b(?:text|images?|figures?|tables?|paper|document)\b"))


def export_counts(records: DataFrame, by: list[str], name: str) -> DataFrame:
    """How many records of each key an export keeps, and how many auxiliary names it drops."""
    aux = auxiliary_name(F.col(name)).cast("int")
    return records.groupBy(*by).agg(F.sum(1 - aux).cast("long").alias("kept"), F.sum(aux).cast("long").alias("dropped"))


def without_internal(record: Column) -> Column:
    """A map without the keys that begin with an underscore."""
    return F.map_filter(record, lambda k, v: ~F.startswith(k, F.lit("_")))


def public_json(record: Column) -> Column:
    """JSON text without keys that begin with an underscore, at any depth; text that is no JSON gives null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _public(t))

    return of(record)


def _public(body: str) -> str | None:
    keep = lambda pairs: {k: v for k, v in pairs if not k.startswith("_")}
    try:
        return json.dumps(json.loads(body, object_pairs_hook=keep), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


def may_create(reference_only: Column, from_image: Column, region: Column, loop: Column, quantity: Column, isotype: Column) -> Column:
    """Whether evidence may add a record: not from cited work, and a sequence with an image, a quantity or an isotype."""
    has = sequences.full_region(region) | (F.length(sequences.letters(loop)) >= 5)
    return ~reference_only & has & (from_image | text.has_output(quantity) | text.has_output(isotype))


def evidence_score(fields: dict[str, Column]) -> Column:
    """Whole variable regions 5 each, a loop 3, each other field of evidence 1, where filled."""
    points = [F.when(sequences.full_region(fields[f]), 5).otherwise(0) for f in ("vh_sequence_aa", "vl_sequence_aa") if f in fields]
    points += [F.when(sequences.letters(fields["CDRH3_Sequence"]) != "", 3).otherwise(0)] if "CDRH3_Sequence" in fields else []
    points += [F.when(text.has_output(fields[f]), 1).otherwise(0) for f in EVIDENCE if f in fields]
    return sum(points, F.lit(0))


def filled_fields(fields: list[Column]) -> Column:
    return sum((text.has_output(c).cast("int") for c in fields), F.lit(0))


def target_key(label: Column) -> Column:
    """Letters and digits of a target, one space between them."""
    return F.trim(F.regexp_replace(text.folded(label), "[^a-z0-9]+", " "))


def target_label(label: Column) -> Column:
    """Whether a label looks like a target: words and a number, or a spike or its binding domain."""
    key = target_key(label)
    return (key != "") & (key.rlike(r"\b[a-z]+\s*[a-z]*\s*\d+\b") | F.contains(key, F.lit("spike")) | F.contains(key, F.lit("rbd")))


def target_list(labels: Column) -> Column:
    """(label, key) of the targets written with ; or |, of equal keys the first."""
    parts = F.filter(F.transform(F.split(text.clean(labels), r"\s*[;|]\s*"), lambda t: F.struct(F.trim(t).alias("label"), target_key(t).alias("key"))), lambda t: t["label"] != "")
    return let(parts, lambda p: F.filter(F.transform(p, lambda t, i: F.when(~F.exists(F.slice(p, F.lit(1), i), lambda o: o["key"] == t["key"]), t)), lambda t: t.isNotNull()))


#: Markers of a structure that belong to one target's complex.
COMPLEX_MARKERS = ["a35", "a33"]


def structure_fits(structure: Column, target: Column) -> Column:
    """A structure that names a marker fits only a target that names it too."""
    s, t = text.folded(structure), text.folded(target)
    wrong = F.exists(F.array(*map(F.lit, COMPLEX_MARKERS)), lambda m: F.contains(s, m) & ~F.contains(t, m))
    return (s == "") | (t == "") | ~wrong


def cross_reactive(records: DataFrame, target: str = "Target_Name", reactive: str = "Cross_Reactivity", metrics: tuple[str, ...] = (), structure: str | None = None, by: tuple[str, ...] = ("paper_id",)) -> DataFrame:
    """Each new target that a record cross-reacts with as a record of its own, metrics cleared; originals stay.

    The new record's own cross-reactivity is the old target, and a structure
    of the old target's complex goes.  Labels that are no targets and targets
    that the name already has in its paper make no record; of two records with
    the same name and new target one does.
    """
    key = text.folded(F.col("name"))
    found = F.filter(target_list(F.col(reactive)), lambda t: target_label(t["label"]))
    wanted = records.filter((key != "") & text.has_output(F.col(reactive))).withColumn("_t", F.explode(found)).withColumns({"_k": key, "_c": F.col("_t.key")})
    known = records.select(*by, key.alias("_k"), target_key(F.col(target)).alias("_c")).distinct()
    new = wanted.join(known, [*by, "_k", "_c"], "left_anti").dropDuplicates([*by, "_k", "_c"])
    cleared = {reactive: F.col(target), **{m: F.lit("") for m in metrics}}
    if structure:
        cleared[structure] = F.when(structure_fits(F.col(structure), F.col("_t.label")), F.col(structure)).otherwise("")
    new = new.withColumns(cleared).withColumn(target, F.col("_t.label"))
    return records.unionByName(new.select(*records.columns))


def corroborated(sequence: Column, body: Column, sizes: tuple[int, ...] = (18, 15, 12, 10, 8)) -> Column:
    """Whether the text holds any window of the sequence: windows of each size, half a size apart."""
    s, b = sequences.letters(sequence), F.regexp_replace(F.upper(body), r"\s+", "")

    def held(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1)), F.lit(n // 2))
        return (F.length(s) >= n) & F.exists(starts, lambda i: F.contains(b, F.substr(s, i, F.lit(n))))

    return reduce(lambda x, y: x | y, map(held, sizes))


def same_tokens(a: Column, b: Column, pattern: str) -> Column:
    """Whether both texts hold the same protected tokens equally often."""
    found = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))
    return found(a) == found(b)


def name_like_tokens(body: Column) -> Column:
    """How many distinct tokens of three characters and more have both a letter and a digit."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"([A-Za-z0-9-]{3,})"), F.lit(1))
    return F.size(F.array_distinct(F.filter(found, lambda t: t.rlike("[A-Za-z]") & t.rlike("[0-9]"))))


def issue_order(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in LABEL_ORDER.items() for x in (k, v)])
    return F.coalesce(F.element_at(table, label), F.lit(len(LABEL_ORDER)))


def review_state(issues: Column, reviewed: Column, touched: Column) -> Column:
    return F.when(reviewed >= issues, "completed").when(touched > 0, "started").otherwise("pending")


def score_band(accuracy: Column) -> Column:
    return F.when(accuracy >= 70, "high").when(accuracy >= 40, "middle").otherwise("low")


def capped(rows: DataFrame, by: list[str], score: Column, position: str, k: int) -> DataFrame:
    """The k best by score, earlier ones first among equals, in their original order (by key and position)."""
    return top_k(rows, by, [score.desc(), F.asc(position)], k).sort(*by, position)


def zipped_by_position(labels: DataFrame, lines: DataFrame, by: str, reach: int = 30) -> DataFrame:
    """Orphan labels (by, pos, label) with the sequence lines (by, pos, line) that follow them, in order.

    The k-th label of a run takes the k-th line after the run, if that lies
    within reach and before the next run; one line serves one label.
    """
    # Spark 4.1 takes a union of two sides dealt alike to be dealt so itself, and then loses rows of windows above; one side is dealt otherwise
    lines = lines.repartition(F.hash(by))
    both = labels.select(by, "pos", F.lit(0).alias("kind"), F.col("label").alias("v")).unionByName(lines.select(by, "pos", F.lit(1).alias("kind"), F.col("line").alias("v")))
    w = Window.partitionBy(by).orderBy("pos", "kind")
    turn = F.when((F.col("kind") == 0) & (F.coalesce(F.lag("kind").over(w), F.lit(1)) == 1), 1).otherwise(0)
    runs = both.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(w))
    runs = runs.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_run", "kind").orderBy("pos")))
    a = runs.filter("kind = 0").select(by, "_run", "_k", F.col("pos").alias("label_pos"), F.col("v").alias("label"))
    b = runs.filter("kind = 1").select(by, "_run", "_k", F.col("pos").alias("line_pos"), F.col("v").alias("line"))
    return a.join(b, [by, "_run", "_k"]).filter(F.col("line_pos") - F.col("label_pos") <= reach).drop("_run", "_k")
