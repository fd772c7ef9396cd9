"""Sequence databases' flat files: records over many lines, features with nested locations, qualifiers over several lines.

Everything is an expression over a record's text, so a scan of many files is
cut at records by the reader and never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import scan, sequences
from lectern.functions.binding import bound, let

#: Fixed values of the format: a record's end, and the columns where a feature's key and its qualifiers begin.
RECORD_END, KEY_AT, QUALIFIER_AT = "\n//", 5, 21
_QUALIFIER = r'(?m)^ {21}/(\w+(?:="(?:[^"]|"")*"|=[^\n"]*(?:\n {21}(?!/)[^\n"]*)*)?)'
_TOKEN = r"(\w+\(|\)|[^(),]+)"
SPAN = "struct<ref:string,start:long,stop:long,open_start:boolean,open_stop:boolean,strand:int>"
#: Lengths at which a protein of unknown kind is taken for a chain: fixed values, the first that holds.
PROTEIN_CHAINS = [("heavy", 95, 140), ("light", 85, 130)]
COMPLEMENT = ("acgtmrwsykvhdbn", "tgcakywsrmbdhvn")


def read_flat_files(spark: SparkSession, path: str) -> DataFrame:
    """value: the text of every record below path; large files are split between records, gzip files aren't."""
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", RECORD_END).text(path)
    return lines.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")


def _field(record: Column, name: str) -> Column:
    """A field's lines up to the next field, one space for each break."""
    return F.trim(F.regexp_replace(F.regexp_extract(record, rf"(?m)^ {{0,3}}{name}\b([^\n]*(?:\n {{4,}}[^\n]*)*)", 1), r"\s+", " "))


def spans(location: Column) -> Column:
    """The spans of a location in reading order: ref, start, stop (from one), open ends, strand.

    join and order list their spans; complement turns the strand of what it
    holds and reverses its order, at any depth.  A bare number is a span of
    one, a^b the place between two (start a, stop b), a.b an uncertain end
    (its outer number), < and > ends that lie beyond.
    """

    def span(token: Column, turned: Column) -> Column:
        place = F.regexp_replace(token, r"^[^:]*:", "")
        ref = F.when(F.contains(token, F.lit(":")), F.regexp_extract(token, r"^([^:]*):", 1))
        first, last = F.regexp_extract(place, r"^[<>]?(\d+)", 1), F.regexp_extract(place, r"(\d+)$", 1)
        return F.struct(
            ref.alias("ref"), F.try_to_number(first, F.lit("9" * 18)).cast("long").alias("start"), F.try_to_number(last, F.lit("9" * 18)).cast("long").alias("stop"),
            F.startswith(place, F.lit("<")).alias("open_start"), F.contains(place, F.lit(">")).alias("open_stop"), F.when(turned, F.lit(-1)).otherwise(F.lit(1)).alias("strand"),
        ).cast(SPAN)

    def step(state: Column, token: Column) -> Column:
        frames, out = state["frames"], state["out"]
        top = F.get(frames, F.size(frames) - 1)
        turned = F.aggregate(frames, F.lit(False), lambda on, f: on != f["turns"])
        opened = F.struct(F.concat(frames, F.array(F.struct((token == "complement(").alias("turns"), F.size(out).alias("at")))).alias("frames"), out.alias("out"))
        back = F.when(F.coalesce(top["turns"], F.lit(False)), F.concat(F.slice(out, F.lit(1), top["at"]), F.reverse(F.slice(out, top["at"] + 1, F.size(out))))).otherwise(out)
        closed = F.struct(F.slice(frames, F.lit(1), F.greatest(F.size(frames) - 1, F.lit(0))).alias("frames"), back.alias("out"))
        added = F.struct(frames.alias("frames"), F.concat(out, F.array(span(token, turned))).alias("out"))
        return F.when(F.endswith(token, F.lit("(")), opened).when(token == ")", closed).otherwise(added)

    tokens = F.regexp_extract_all(F.regexp_replace(F.coalesce(location, F.lit("")), r"\s+", ""), F.lit(_TOKEN), F.lit(1))
    start = F.struct(F.array().cast("array<struct<turns:boolean,at:int>>").alias("frames"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(tokens, start, step, lambda s: s["out"])


def location_text(location: Column) -> Column:
    """A location as [start:stop](strand) with starts from zero; several in braces after join or order."""

    def one(s: Column) -> Column:
        ends = F.concat(F.when(s["open_start"], "<").otherwise(""), (s["start"] - 1).cast("string"), F.lit(":"), F.when(s["open_stop"], ">").otherwise(""), s["stop"].cast("string"))
        return F.concat(F.coalesce(s["ref"], F.lit("")), F.lit("["), ends, F.lit("]("), F.when(s["strand"] < 0, "-").otherwise("+"), F.lit(")"))

    kind = F.when(F.contains(location, F.lit("order(")), "order").otherwise("join")
    return let(F.transform(spans(location), one), lambda x: F.when(F.size(x) > 1, F.concat(kind, F.lit("{"), F.array_join(x, ", "), F.lit("}"))).otherwise(F.coalesce(F.get(x, F.lit(0)), F.lit(""))))


def _qualifiers(feature: Column) -> Column:
    """(name, value) in order; quotes and breaks are taken out, a doubled quote is one, a translation has no breaks."""

    def of(q: Column) -> Column:
        name, raw = F.regexp_extract(q, r"^(\w+)", 1), F.regexp_replace(q, r"^\w+=?", "")
        bare = F.regexp_replace(F.regexp_replace(raw, r'^"|"$', ""), '""', '"')
        return F.struct(name.alias("name"), F.when(name == "translation", F.regexp_replace(bare, r"\s+", "")).otherwise(F.trim(F.regexp_replace(bare, r"\s*\n\s*", " "))).alias("value"))

    return F.transform(F.regexp_extract_all(feature, F.lit(_QUALIFIER), F.lit(1)), of)


def parse_records(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """Record texts -> accession, record_id, molecule, description, organism, sequence, features (key, location, qualifiers).

    The accession is the first of its line, without version; record_id has the
    version.  Texts without a LOCUS line (an empty one, a null) give no row,
    fields that are missing are empty.
    """
    t = F.regexp_replace(F.col(text_col), r"\r\n?", "\n")
    rows = bound(raw.filter(F.col(text_col).rlike(r"(?m)^LOCUS\b")).select(F.regexp_replace(t, r"\A\s*\n", "").alias("_t")), _head=F.regexp_extract("_t", r"(?s)\A(.*?)(?=\nFEATURES|\nORIGIN|\z)", 1))
    table = F.regexp_extract("_t", r"(?m)^FEATURES[^\n]*((?:\n [^\n]*)*)", 1)
    blocks = F.filter(F.split(table, rf"\n {{{KEY_AT}}}(?=\S)"), lambda b: F.trim(b) != "")
    where = lambda b: F.regexp_replace(F.regexp_extract(b, rf"(?s)^\S+(.*?)(?=\n {{{QUALIFIER_AT}}}/|\z)", 1), r"\s+", "")
    features = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"^(\S+)", 1).alias("key"), where(b).alias("location"), _qualifiers(b).alias("qualifiers")))
    letters = F.regexp_replace(F.regexp_extract("_t", r"(?s)\nORIGIN[^\n]*\n(.*)\z", 1), r"[\s\d/]+", "")
    head = F.col("_head")
    accession = F.regexp_extract(_field(head, "ACCESSION"), r"^(\S+)", 1)
    version = F.regexp_extract(_field(head, "VERSION"), r"^(\S+)", 1)
    protein = F.regexp_extract(head, r"(?m)^LOCUS\s+\S+\s+\d+\s+(bp|aa)", 1) == "aa"
    return rows.select(
        scan.accession(accession).alias("accession"), F.when(version != "", version).otherwise(accession).alias("record_id"), F.when(protein, "protein").otherwise("nucleotide").alias("molecule"),
        F.regexp_replace(_field(head, "DEFINITION"), r"\.$", "").alias("description"), F.regexp_extract(head, r"(?m)^ {2}ORGANISM +([^\n]*)", 1).alias("organism"), letters.alias("sequence"), features.alias("features"),
    )


def qualifier(feature: Column, name: str) -> Column:
    """The first value of a feature's qualifier, empty if it has none."""
    return F.trim(F.coalesce(F.get(F.filter(feature["qualifiers"], lambda q: q["name"] == name), F.lit(0))["value"], F.lit("")))


def all_qualifiers(feature: Column, name: str) -> Column:
    return F.array_join(F.transform(F.filter(feature["qualifiers"], lambda q: q["name"] == name), lambda q: q["value"]), " ")


def spliced(sequence: Column, location: Column) -> Column:
    """The letters of a location in reading order, those of the other strand as their complement; other records' spans have none."""

    def part(s: Column) -> Column:
        there = F.substr(sequence, s["start"].cast("int"), (s["stop"] - s["start"] + 1).cast("int"))
        other = F.translate(F.reverse(F.lower(there)), *COMPLEMENT)
        return F.when(s["ref"].isNotNull() | s["start"].isNull(), "").when(s["strand"] < 0, other).otherwise(F.lower(there))

    return F.array_join(F.transform(spans(location), part), "")


def coding_features(records: DataFrame) -> DataFrame:
    """A row for each translated CDS of a record, or for a protein record itself: chain, variable and where it lies.

    accession, record_id, pos, product, gene, note, protein_id, translation, location, chain (heavy, light, unknown), is_variable.
    """
    f = F.col("f")
    cds = records.filter("molecule <> 'protein'").select("accession", "record_id", F.posexplode("features").alias("pos", "f")).filter("f.key = 'CDS'")
    cds = cds.select(
        "accession", "record_id", "pos", qualifier(f, "product").alias("product"), qualifier(f, "gene").alias("gene"), all_qualifiers(f, "note").alias("note"), qualifier(f, "protein_id").alias("protein_id"),
        sequences.letters(qualifier(f, "translation")).alias("translation"), location_text(f["location"]).alias("location"),
    )
    whole = records.filter("molecule = 'protein'").select(
        "accession", "record_id", F.lit(0).alias("pos"), F.col("description").alias("product"), F.lit("").alias("gene"), F.col("description").alias("note"), F.col("record_id").alias("protein_id"),
        sequences.letters(F.col("sequence")).alias("translation"), F.lit("").alias("location"),
    )
    n, told = F.length("translation"), sequences.record_chain(F.col("product"), F.col("gene"), F.col("note"))
    by_length = F.lit("unknown")
    for chain, low, high in reversed(PROTEIN_CHAINS):
        by_length = F.when(n.between(low, high), chain).otherwise(by_length)
    variable = F.lower(F.concat_ws(" ", "product", "gene", "note")).rlike("variable region|variable domain|v-region|v region")
    both = cds.withColumn("chain", told).unionByName(whole.withColumn("chain", F.when(told == "unknown", by_length).otherwise(told)))
    return both.filter("translation <> ''").withColumn("is_variable", variable)


def chain_infos(features: DataFrame, preferred: str | None = None) -> DataFrame:
    """accession, chain_type (VH, VL, unknown), location, product, protein_id, translation; with `preferred` the first of that type of each record."""
    told = sequences.record_chain(F.col("product"), F.col("gene"), F.col("note"))
    kind = F.when(told == "heavy", "VH").when(told == "light", "VL").otherwise("unknown")
    info = features.select("accession", "pos", kind.alias("chain_type"), "location", "product", "protein_id", "translation")
    if preferred:
        one = F.struct("chain_type", "location", "product", "protein_id", "translation")
        return info.filter(F.col("chain_type") == preferred).groupBy("accession").agg(F.min_by(one, "pos").alias("i")).select("accession", "i.*")
    return info.drop("pos")
