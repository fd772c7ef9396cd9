"""Joins and roll-ups of a paper's evidence: database records, image targets, chunks, name lists, experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import scan, sequences, text, validate
from lectern.functions.binding import bound, let
from lectern.operators.repair import HEADERS, header_label

#: Words near an accession that rule it out as a sequence's, those that support it, and those of an antibody's record.
REJECT = ["catalog", "cat.", "cat#", "cat no", "kit", "ge healthcare", "thermo", "invitrogen", "sigma", "abcam", "bio-rad", "biolegend", "reagent"]
SUPPORT = ["genbank", "accession", "ncbi", "entrez", "sequence", "cdrh3", "variable region", "heavy chain", "light chain", "vh", "vl", "cds", "translation", "mrna", "immunoglobulin", "antibody", "fab", "scfv", "nanobody"]
OF_ANTIBODY = ["antibody", "immunoglobulin", "variable region", "heavy chain", "light chain", "fab", "scfv", "nanobody", "vhh"]
#: Lengths at which a feature is likely a chain's variable region.
LIKELY = {"heavy": (95, 140), "light": (90, 130)}
#: Categories of images, and the fields whose gaps each group of categories fills.
CATEGORIES = ["SEQUENCE_DATA", "KINETICS_DATA", "QUANTITATIVE_TABLE", "EFFICACY_DATA"]
GAPS = [
    (["CDRH3_Sequence", "vh_sequence_aa", "vl_sequence_aa"], ["SEQUENCE_DATA"], []), (["Binding_Kinetics_KD", "Binding_Kinetics_kon", "Binding_Kinetics_koff", "Binding_EC50", "Quantitative_Metric", "Thermal_Stability_Tm"], ["KINETICS_DATA", "QUANTITATIVE_TABLE"], []),
    (["In_Vivo_Efficacy"], ["EFFICACY_DATA"], ["QUANTITATIVE_TABLE"]),
]
#: Assays and how a text speaks of them, and words of a panel of measurements.
METHODS = [("ELISA", r"(?i)\bELISA\b|enzyme-linked immunosorbent"), ("BLI", r"(?i)\bBLI\b|biolayer interferometry"), ("SPR", r"(?i)\bSPR\b|surface plasmon resonance"), ("Beacon", r"(?i)\bBeacon\b")]
PANEL = r"(?i)virus-only|binding|time\s*\(seconds\)|a35|a33"
#: How a window speaks of each chain, of identity and of a reference.
CHAIN_WORDS = {"vh_sequence_aa": ["heavy chain", "vh", "heavy-chain"], "vl_sequence_aa": ["light chain", "vl", "light-chain", "kappa chain", "lambda chain"]}
IDENTITY_WORDS = ["identical", "same", "unchanged", "retain", "retained", "shared"]
REFERENCE_WORDS = ["wt", "wild type", "wild-type", "parent", "template", "original"]


def _any(value: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(value, w))


def plausible_accessions(hint: Column, around: int = 80) -> Column:
    """Accessions of a hint that may be a sequence's: id, kind; the nearest words decide, those against first.

    Without any such word a hint counts only if it is the accession itself.
    """

    def of(x: Column) -> Column:
        ends = F.transform(x["hits"], lambda _, i: F.aggregate(F.slice(x["between"], F.lit(1), i + 1), F.lit(0), lambda n, p: n + F.length(p)) + F.aggregate(F.slice(x["hits"], F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p)))
        near = lambda h, i: F.lower(F.substr(x["t"], F.greatest(F.get(ends, i) - around, F.lit(0)) + 1, F.least(F.get(ends, i), F.lit(around)) + F.length(h) + around))
        bare = F.upper(F.regexp_replace(x["t"], r"\s+", ""))
        ok = lambda h, i: ~_any(near(h, i), REJECT) & (_any(near(h, i), SUPPORT) | (bare == scan.accession(h)))
        found = F.transform(x["hits"], lambda h, i: F.when(ok(h, i), F.struct(scan.accession(h).alias("id"), scan.accession_kind(scan.accession(h)).alias("kind"))))
        return F.array_distinct(F.filter(found, lambda f: f.isNotNull() & (f["kind"] != "other")))

    t = F.coalesce(hint, F.lit(""))
    return let(F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(scan.ACCESSION), F.lit(1)).alias("hits"), F.split(t, scan.ACCESSION).alias("between")), of)


def accession_range(hint: Column, found: Column) -> Column:
    """Whether several accessions of a hint are the ends of a range."""
    return (F.size(found) > 1) & F.lower(hint).rlike(r"\bto\b|\bthrough\b|\bthru\b|\.\.\.|…|[-–—]")


def best_features(features: DataFrame) -> DataFrame:
    """features (accession, product, gene, note, translation) -> accession, chain, sequence: the best feature of each chain.

    Named variable regions first, then those of a likely length, then the
    longer, then the one that sorts first.
    """
    rows = features.withColumn("chain", sequences.record_chain(F.col("product"), F.col("gene"), F.col("note"))).filter("chain <> 'unknown'").withColumn("sequence", sequences.letters(F.col("translation"))).filter("sequence <> ''")
    named = F.lower(F.concat_ws(" ", "product", "gene", "note")).rlike("variable region|variable domain|v-region|v region")
    n = F.length("sequence")
    likely = F.when(F.col("chain") == "heavy", n.between(*LIKELY["heavy"])).otherwise(n.between(*LIKELY["light"]))
    return rows.groupBy("accession", "chain").agg(F.min_by("sequence", F.struct(-named.cast("int"), -likely.cast("int"), -n, "sequence")).alias("sequence"))


def usable_fetch(regions: Column, description: Column) -> Column:
    """Whether a database record can fill an antibody's gaps: it has a variable region or speaks of antibodies."""
    return (F.size(regions) > 0) | _any(F.lower(F.coalesce(description, F.lit(""))), OF_ANTIBODY)


def sequence_records(wanted: DataFrame, best: DataFrame) -> DataFrame:
    """wanted (paper_id, name, chain, rank, accession) -> paper_id, name, vh, vl, loop, ids: from the first accession of each chain that has it.

    The loop is what the heavy region derives.
    """
    domain = F.when(F.col("chain") == "heavy", sequences.variable_domain(F.col("sequence"), "H")).otherwise(sequences.variable_domain(F.col("sequence"), "L"))
    usable = best.select("accession", "chain", domain.alias("domain")).filter("domain <> ''")
    first = wanted.join(usable, ["accession", "chain"]).groupBy("paper_id", "name", "chain").agg(F.min_by(F.struct("accession", "domain"), F.struct("rank", "accession")).alias("b"))
    side = lambda c, f: F.max(F.when(F.col("chain") == c, F.col(f"b.{f}")))
    both = first.groupBy("paper_id", "name").agg(
        F.coalesce(side("heavy", "domain"), F.lit("")).alias("vh"), F.coalesce(side("light", "domain"), F.lit("")).alias("vl"), F.array_join(F.array_sort(F.collect_set("b.accession")), ",").alias("ids"))
    return both.withColumn("loop", sequences.loop_of(F.col("vh")))


def name_score(context: Column, name: Column, aliases: Column) -> Column:
    """4 for the name as a word of a context, 3 inside once both are normalised, 2 for an alias as a word, else 0."""
    word = lambda n: F.regexp_like(F.lower(context), F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.lower(n), F.lit(r"\E([^a-z0-9]|$)")))
    inside = (text.alnum_key(name) != "") & F.contains(text.alnum_key(context), text.alnum_key(name))
    alias = F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: (F.length(F.trim(a)) >= 3) & word(F.trim(a)))
    return F.when((text.clean(name) != "") & word(name), 4).when(inside, 3).when(alias, 2).otherwise(0)


def structure_matches(antibodies: DataFrame, structures: DataFrame) -> DataFrame:
    """antibodies (paper_id, name, structure, hint) with the best of the paper's fetched structures (paper_id, code, title, heavy, light).

    Candidates are the codes in the structure text and its hint and those
    whose title names the antibody; with one structure and one antibody that
    pair.  By name score, then chains, then length; in a paper of several
    antibodies a candidate needs its name or its code to be given.  Codes meet
    structures by an equi-join within a paper.
    """
    codes = lambda c: F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(F.col(c), F.lit(""))), F.lit(scan.STRUCTURE_ID), F.lit(1)))
    a = antibodies.filter(text.has_output(F.col("name"))).select("paper_id", "name", codes("structure").alias("_own"), codes("hint").alias("_hint"), F.count("*").over(Window.partitionBy("paper_id")).alias("_n"))
    domain = lambda c, k: sequences.variable_domain(F.col(c), k)
    s = bound(structures, vh=domain("heavy", "H"), vl=domain("light", "L")).withColumn("_m", F.count("*").over(Window.partitionBy("paper_id")))
    p = a.join(s, "paper_id").withColumn("_score", name_score(F.concat_ws(" ", "title", "code"), F.col("name"), F.array().cast("array<string>")))
    given, hinted = F.array_contains("_own", F.col("code")), F.array_contains("_hint", F.col("code"))
    able = (given | hinted | (F.col("_score") > 0) | ((F.col("_n") == 1) & (F.col("_m") == 1))) & ((F.col("_n") == 1) | (F.col("_score") > 0) | given)
    chains = (F.col("vh") != "").cast("int") + (F.col("vl") != "").cast("int")
    order = F.struct(-F.col("_score"), -chains, -(F.length("vh") + F.length("vl")), F.col("code"))
    return p.filter(able).groupBy("paper_id", "name").agg(F.min_by(F.struct("code", "vh", "vl"), order).alias("b")).select("paper_id", "name", "b.code", "b.vh", "b.vl", sequences.loop_of(F.col("b.vh")).alias("loop"))


def preferred(first: DataFrame, second: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Records of both sides by key; each field from the first where that is filled, else from the second."""
    pick = lambda f: F.coalesce(F.nullif(text.clean(F.col(f"_a.{f}")), F.lit("")), F.nullif(text.clean(F.col(f"_b.{f}")), F.lit("")), F.lit("")).alias(f)
    a, b = (d.select(*by, F.struct(*fields).alias(n)) for d, n in ((first, "_a"), (second, "_b")))
    return a.join(b, by, "full").select(*by, *map(pick, fields))


def matched_sources(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """records (paper_id, name, field, value) with the first evidence (…, value, source, seq) that says the same: source or null.

    Sequences are compared by letters; a loop also equals the one that the
    evidence's region derives, with or without its C; other fields as text.
    """
    key = lambda d: F.when(d["field"].isin(*sequence_fields()), sequences.letters(d["value"])).otherwise(text.clean(d["value"]))
    own = records.withColumn("_v", key(records)).filter("_v <> ''")
    said = evidence.withColumn("_v", key(evidence)).filter("_v <> ''")
    core = sequences.loop_core(F.col("value"))
    derived = evidence.filter("field = 'vh_sequence_aa'").select("paper_id", "name", F.lit("CDRH3_Sequence").alias("field"), "source", "seq", F.explode(let(core, lambda c: F.array(c, F.concat(F.lit("C"), c)))).alias("_v")).filter("length(_v) > 1")
    every = said.select("paper_id", "name", "field", "source", "seq", "_v").unionByName(derived)
    first = every.groupBy("paper_id", "name", "field", "_v").agg(F.min_by("source", "seq").alias("source"))
    # texts grow on their way here, so the size of the files would have this side broadcast
    return own.join(first.hint("merge"), ["paper_id", "name", "field", "_v"], "left").drop("_v")


def sequence_fields() -> tuple[str, ...]:
    return ("CDRH3_Sequence", "vh_sequence_aa", "vl_sequence_aa")


def combined_targets(targets: DataFrame) -> DataFrame:
    """targets (paper_id, name, missing_fields, validation_only) -> one row a name: all its gaps, and whether all were for validation."""
    rows = targets.filter(text.has_output(F.col("name"))).select("paper_id", text.folded(F.col("name")).alias("name_key"), F.trim("name").alias("name"), F.explode_outer("missing_fields").alias("f"), "validation_only")
    return rows.groupBy("paper_id", "name_key").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("f")).alias("missing_fields"), F.min(F.coalesce("validation_only", F.lit(False)).cast("int")).cast("boolean").alias("validation_only"))


def gap_categories(missing: Column, sequences_always: bool = False) -> Column:
    """Categories of images that can fill gaps: those of each group with a gap, all where every group or none has one."""
    wants = [F.arrays_overlap(missing, F.array(*map(F.lit, fields))) | F.lit(sequences_always and k == 0) for k, (fields, *_) in enumerate(GAPS)]
    count = sum((w.cast("int") for w in wants), F.lit(0))
    none = F.array().cast("array<string>")
    main = F.flatten(F.array(*[F.when(w, F.array(*map(F.lit, cats))).otherwise(none) for w, (_, cats, _) in zip(wants, GAPS, strict=True)]))
    alone = F.when(wants[2] & (count == 1), F.array(*map(F.lit, GAPS[2][2]))).otherwise(none)
    return F.when((count == 0) | (count == len(GAPS)), F.array(*map(F.lit, CATEGORIES))).otherwise(F.array_sort(F.array_distinct(F.concat(main, alone))))


def known_records(records: DataFrame, names: DataFrame) -> DataFrame:
    """records (paper_id, name, efficacy, context) of known names (paper_id, name); an efficacy needs the name in its context.

    In a paper without known names every name counts; a record without a name stays.
    """
    keyed = records.withColumn("_k", text.folded(F.col("name")))
    n = names.select("paper_id", text.folded(F.col("name")).alias("_k")).filter("_k <> ''").distinct()
    some = n.select("paper_id").distinct().withColumn("_some", F.lit(True))
    marked = keyed.join(n.withColumn("_known", F.lit(True)), ["paper_id", "_k"], "left").join(some, "paper_id", "left")
    ok = (F.col("_k") == "") | F.col("_some").isNull() | F.col("_known")
    told = ~text.has_output(F.col("efficacy")) | (F.col("_k") == "") | F.contains(F.lower(F.coalesce("context", F.lit(""))), F.col("_k"))
    return marked.filter(F.coalesce(ok, F.lit(False)) & told).select(*records.columns)


def large_enough(pixels: Column, least: int = 10_000) -> Column:
    """Whether a group of images is large enough together; where a size is unknown it is kept."""
    return F.exists(pixels, lambda p: p.isNull()) | (F.aggregate(pixels, F.lit(0).cast("long"), lambda n, p: n + F.coalesce(p, F.lit(0))) >= least)


def gap_fill_runs(targets: Column, records: Column, has_images: Column) -> Column:
    return (targets > 0) & (records > 0) & has_images


def reduced(chunks: DataFrame, originals: DataFrame) -> DataFrame:
    """chunks (paper_id, chunk_index, filtered_text, error) and originals (paper_id, text) -> the reduced text and its counts.

    Without anything kept the original stands; a paper's chunks bound a row.
    """
    kept = F.trim(F.coalesce("filtered_text", F.lit("")))
    rows = chunks.select("paper_id", "chunk_index", kept.alias("_t"), text.has_output(F.col("error")).alias("_e"))
    n = lambda c: F.sum(c.cast("long"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.struct("chunk_index", "_t")))), lambda x: x["_t"]), "\n\n")
    per = rows.groupBy("paper_id").agg(joined.alias("_r"), n(F.col("_t") != "").alias("kept"), n(F.col("_t") == "").alias("dropped"), n(F.col("_e")).alias("failed"))
    out = originals.join(per, "paper_id").withColumn("reduced_text", F.when(F.trim("_r") != "", F.trim("_r")).otherwise(F.trim("text")))
    share = F.round(F.length("reduced_text") / F.greatest(F.length("text"), F.lit(1)), 3)
    return out.select("paper_id", "reduced_text", "kept", "dropped", "failed", share.alias("ratio"), (F.length("reduced_text") < F.length("text")).alias("used"))


def keep_longest(records: DataFrame, by: list[str], fields: list[str], context: str, order: str) -> DataFrame:
    """One record a key: the longest value of each field, and the last context."""
    pick = lambda f: F.coalesce(F.min_by(F.when(text.has_output(F.col(f)), F.col(f)), F.when(text.has_output(F.col(f)), F.struct(-F.length(F.col(f)), F.col(order)))), F.lit("")).alias(f)
    return records.groupBy(*by).agg(*map(pick, fields), F.max_by(context, order).alias(context))


def pattern_counts(body: Column, families: dict[str, list[str]]) -> Column:
    """Matches of each family of patterns in a text, case aside."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.struct(*[sum((F.regexp_count(low, F.lit(f"({p})")) for p in patterns), F.lit(0)).alias(name) for name, patterns in families.items()])


def focus_flags(counts: Column, least: dict[str, tuple[int, str]]) -> Column:
    """Flags of the families that reach their number; hard from three flags on."""
    flags = F.filter(F.array(*[F.when(counts[name] >= n, F.lit(flag)) for name, (n, flag) in least.items()]), lambda x: x.isNotNull())
    return F.struct(flags.alias("flags"), (F.size(flags) >= 3).alias("hard"))


def missing_names(expected: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """expected (by, name) that observed (by, name) lacks, case aside: what is asked for again."""
    key = lambda d: d.withColumn("_k", text.folded(F.col("name"))).filter("_k <> ''")
    return key(expected).join(key(observed).select(*by, "_k"), [*by, "_k"], "left_anti").drop("_k")


def last_events(events: DataFrame, by: list[str], order: str, k: int = 50) -> DataFrame:
    """The last k events of each key that are no ends of spans, in order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return events.filter(~F.col("event").isin("start", "end")).withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def union_tracks(tracks: list[DataFrame], by: list[str]) -> DataFrame:
    """Records of several tracks in the order of the tracks, of equal keys (case aside) the first."""
    rows = None
    for k, t in enumerate(tracks):
        t = t.withColumns({"_track": F.lit(k), "_at": F.monotonically_increasing_id()})
        rows = t if rows is None else rows.unionByName(t)
    keys = [text.folded(F.col(c)).alias(f"_k{i}") for i, c in enumerate(by)]
    columns = [c for c in rows.columns if c not in ("_track", "_at")]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("_track", "_at")).alias("r"))
    return first.select("r.*")


def assays_in(body: Column) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(body, F.lit("")).rlike(p), F.lit(m)) for m, p in METHODS]), lambda x: x.isNotNull())


def refined_experiment(experiment: Column, body: Column, has_kinetics: Column, has_target: Column, has_panel: Column) -> Column:
    """An experiment that names no binding assay, from the paper: BLI for kinetics, the assays of its text, ELISA for a target and a panel."""
    known = F.array_distinct(F.concat(F.when(has_kinetics, F.array(F.lit("BLI"))).otherwise(F.array().cast("array<string>")), assays_in(body)))
    more = has_target & has_panel & ~F.array_contains(known, "ELISA")
    told = F.array_join(F.when(more, F.array_append(known, F.lit("ELISA"))).otherwise(known), ",")
    return F.when(F.size(assays_in(experiment)) > 0, experiment).otherwise(told)


def plain_key(value: Column) -> Column:
    """Lower-case letters and digits of ASCII."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")


def clauses(body: Column) -> Column:
    """A text's clauses in order, each once: lines, cut after full stops, semicolons and colons, with single spaces."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.filter(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, r"(?<=[.;:])\s+"), F.trim))), lambda x: x != ""))


def states_identity(clause: Column, key: Column, child: Column, parent: Column) -> Column:
    """Whether a clause (key: its letters and digits) that calls a chain identical speaks of this child and parent.

    It names one of them or the variant's part of the child's name, and the
    parent or a word for the original.
    """
    low = F.lower(clause)
    tokens = lambda n: F.filter(F.split(F.lower(n), "[^a-z0-9]+"), lambda t: t != "")
    extra = F.filter(F.array_except(tokens(child), tokens(parent)), lambda t: (F.length(t) >= 2) & ~t.isin("wt", "wild", "type"))
    c, p = plain_key(child), plain_key(parent)
    about_parent = (p != "") & F.contains(key, p)
    about = ((c != "") & F.contains(key, c)) | about_parent | F.exists(extra, lambda t: F.contains(low, t))
    return about & (about_parent | _any(low, REFERENCE_WORDS))


def chain_evidence(body: Column, child: Column, parent: Column, field: str) -> Column:
    """The first clause of a text that says that a child's chain is its parent's; empty if none does."""
    says = lambda w: _any(F.lower(w), CHAIN_WORDS[field]) & _any(F.lower(w), IDENTITY_WORDS) & states_identity(w, plain_key(w), child, parent)
    return F.coalesce(F.get(F.filter(clauses(body), says), F.lit(0)), F.lit(""))


def merged_names(first: Column, second: Column, most: int) -> Column:
    """Items of both lists without repeats (case aside), in order, at most so many."""
    both = F.filter(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))), lambda x: F.trim(x) != "")
    return let(both, lambda b: F.slice(F.filter(F.transform(b, lambda x, i: F.when(~F.exists(F.slice(b, F.lit(1), i), lambda o: F.lower(F.trim(o)) == F.lower(F.trim(x))), F.trim(x))), lambda x: x.isNotNull()), 1, most))


def appended(entries: Column, entry: Column) -> Column:
    """A list of notes with one more, unless it is there."""
    return F.when(entry.isNull() | F.array_contains(entries, entry), entries).otherwise(F.array_append(entries, entry))


def sequence_rows(records: DataFrame) -> DataFrame:
    """Records of sequences with a name and at least one sequence, in canonical letters."""
    fields = [f for f in sequence_fields() if f in records.columns]
    clean = records.withColumns({f: sequences.letters(sequences.one_letter(F.col(f))) for f in fields} | {"name": F.trim("name")})
    return clean.filter(text.has_output(F.col("name")) & (F.concat_ws("", *fields) != ""))


def hydrated(records: DataFrame) -> DataFrame:
    """Blank regions filled from hints (vh_hint, vl_hint) that hold a whole one, and a blank loop from the heavy region."""
    fill = lambda f, h: F.when(text.has_output(F.col(f)), F.col(f)).when(sequences.full_region(F.col(h), 160), sequences.letters(F.col(h))).otherwise("")
    out = records.withColumns({"vh_sequence_aa": fill("vh_sequence_aa", "vh_hint"), "vl_sequence_aa": fill("vl_sequence_aa", "vl_hint")})
    return out.withColumn("CDRH3_Sequence", F.when(text.has_output(F.col("CDRH3_Sequence")), F.col("CDRH3_Sequence")).otherwise(sequences.loop_of(F.col("vh_sequence_aa"))))


def verified(value: Column, answer: Column) -> Column:
    """A region after a second reading: the answer if it is 80 residues or more and differs, else the value; and whether it changed."""
    a = sequences.letters(answer)
    changes = (F.length(a) >= 80) & (a != sequences.letters(value))
    return F.struct(F.when(changes, a).otherwise(value).alias("value"), changes.alias("changed"))


def merged_outputs(files: DataFrame) -> DataFrame:
    """files (batch, path, text, ok) -> batch, merged, done, failed: the texts of those that worked, each under its stem, in order of the paths."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    part = F.when(F.col("ok"), F.struct("path", F.concat(F.lit("# "), stem, F.lit("\n\n"), F.trim("text")).alias("t")))
    n = lambda c: F.sum(c.cast("long"))
    return files.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n---\n\n").alias("merged"), n(F.col("ok")).alias("done"), n(~F.col("ok")).alias("failed"))


def result_views(files: DataFrame, root: str) -> DataFrame:
    """files (path) below a folder of reports -> id, title, results, predictions: a view for each run's latest results.

    A view is named by its folder below the root.  The run's predictions lie
    beside it, or beside the folder `benchmark` that holds it; null if there
    are none.  Results and predictions meet by the run's folder.
    """
    below = files.filter(F.startswith("path", F.lit(root.rstrip("/") + "/")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    views = below.filter(F.endswith("path", F.lit("/eval_result_latest.json"))).select(F.col("path").alias("results"), folder.alias("_folder"), F.when(F.endswith(folder, F.lit("/benchmark")), F.regexp_replace(folder, "/benchmark$", "")).otherwise(folder).alias("_run"))
    told = below.filter(F.endswith("path", F.lit("/agent/benchmark_predictions.json"))).select(F.col("path").alias("predictions"), F.regexp_replace("path", "/agent/[^/]*$", "").alias("_run"))
    out = views.join(told, "_run", "left")
    return out.select(F.coalesce(F.nullif(F.substr("_folder", F.lit(len(root.rstrip("/")) + 2)), F.lit("")), F.lit(".")).alias("id"), F.regexp_extract("_folder", "([^/]*)$", 1).alias("title"), "results", "predictions")


def loaded(papers: DataFrame) -> DataFrame:
    """papers (pos, paper_id, record_pos, name) with default ids `paper-i` and names `Antibody n`, counted from one."""
    return papers.withColumns({
        "paper_id": F.coalesce(F.nullif(text.clean(F.col("paper_id")), F.lit("")), F.concat(F.lit("paper-"), (F.col("pos") + 1).cast("string"))),
        "name": F.coalesce(F.nullif(text.clean(F.col("name")), F.lit("")), F.concat(F.lit("Antibody "), (F.col("record_pos") + 1).cast("string"))),
    })


def front_matter(body: Column) -> Column:
    """Keys and values at the head of a prompt file, between two rules."""
    head = F.regexp_extract(F.coalesce(body, F.lit("")), r"(?s)^---\s*\n(.*?)\n---", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"""^["']|["']$""", "").alias("value"))))


def allowed_header(original: DataFrame, candidate: DataFrame, by: str, words: list[str] = HEADERS) -> DataFrame:
    """by, ok: whether repaired tables (by, table_no, row_no, cells) differ from the originals in their headers alone.

    The same tables, rows and widths, equal bodies (spaces and entities aside),
    and the label of every cell of a header that changed among the words that
    headers may have.
    """
    norm = lambda c: F.transform(c, text.plain)
    o = original.select(by, "table_no", "row_no", norm("cells").alias("a"))
    c = candidate.select(by, "table_no", "row_no", norm("cells").alias("b"))
    both = o.join(c, [by, "table_no", "row_no"], "full")
    listed = F.forall("b", lambda x: header_label(x).isin(words))
    same = F.col("a").eqNullSafe(F.col("b"))
    ok = F.when(F.col("a").isNull() | F.col("b").isNull(), False).when(same, True).otherwise((F.col("row_no") == 0) & (F.size("a") == F.size("b")) & listed)
    return both.groupBy(by).agg(F.min(ok.cast("int")).cast("boolean").alias("ok"))


def checked_record(record: Column, names: dict[str, str]) -> Column:
    """All checks of a record's fields, type and experiment, one array."""
    get = lambda f: F.try_element_at(record, F.lit(f))
    own = F.filter(F.array(
        F.struct(F.lit("antibody_type_specificity").alias("check"), validate.type_check(get("Antibody_Type")).alias("status")),
        F.struct(F.lit("experiment_scope").alias("check"), F.when(F.size(validate.experiment_check(get("Experiment"))) > 0, "warn").alias("status")),
    ), lambda c: c["status"].isNotNull())
    return F.concat(validate.field_checks(record), validate.renamed_checks(record, names), own)
