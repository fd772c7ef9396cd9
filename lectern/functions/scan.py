"""Scanners: identifiers, genes, names and layout in document texts, each a sorted array without repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let

#: Patterns of the scanners.
GENES = {
    "imgt_v": r"(IG[HKL]V\d+-\d+(?:\*\d+)?)", "imgt_d": r"(IGHD\d+-\d+(?:\*\d+)?)", "imgt_j": r"(IG[HKL]J\d+(?:\*\d+)?)",
    "short_v": r"(V[HKL]\d+-\d+(?:\*\d+)?)", "short_d": r"(DH?\d+-\d+(?:\*\d+)?)", "short_j": r"(J[HKL]\d+(?:\*\d+)?)",
    "vdj": r"(VH\d+-\d+(?:\*\d+)?/[DJ]H?\d+-?\d*(?:\*\d+)?(?:/[DJ]H?\d+-?\d*(?:\*\d+)?)*)", "vj": r"(V[KL]\d+-\d+(?:\*\d+)?/J[KL]\d+(?:\*\d+)?)",
}
STRUCTURE_ID = r"\b([0-9][A-Z][A-Z0-9]{2})\b"
PROTEIN_ID = r"\b([A-NR-Z][0-9][A-Z][A-Z0-9]{2}[0-9]|[OPQ][0-9][A-Z0-9]{3}[0-9])\b"
ACCESSION = r"(?i)\b([A-Z]{1,3}(?:[\s_-]+)?\d{5,8}(?:\.\d+)?)\b"
DOI = r"(10\.\d{4,}/[^\s,;)\]]+)"
PUBMED = r"(?i)(?:PMID|PubMed\s*(?:ID)?)\s*[:.]?\s*(\d{6,9})"
HTML_TABLE = r"(?is)(<table[^>]*>.*?</table>)"
PIPE_RULE = r"(?m)^(\|[\s:]*-{3,}[\s:]*(?:\|[\s:]*-{3,}[\s:]*)+\|?)$"
IDENTITY = r"((?:V[HL]\s*(?:region\s*)?identity\s*\(?%?\)?\s*[:=]?\s*\d+\.?\d*)|\d+\.?\d*\s*%\s*(?:identity|identical))"
#: Structure ids that are words, and what marks an accession as a reagent's number.
NOT_STRUCTURES = ["1WAY", "2WAY"]
REAGENT_WORDS = [
    "catalog", "cat.", "cat#", "cat no", "thermo", "fisher", "invitrogen", "sigma", "abcam", "bio-rad", "biolegend",
    "purchased from", "obtained from", "dilut", "μg/ml", "µg/ml",
]
REAGENT_PREFIXES = ["A39", "A63", "K03", "K20", "PB1", "SA0", "AB1", "AB2", "MA1", "MA5", "SC-"]
COMPANIES = ["inc.", "ltd.", "corp."]
#: Patterns of antibody names, words that look like them, and beginnings of other names.
NAMES = [
    r"\b(\d{2,5}-[A-Z]\d{1,3})\b", r"(?:mAb|MAb|monoclonal antibody)\s+([A-Z0-9][\w-]{2,20})", r"\b([a-z]*[mv]i?[rv]?[ui]?mab)\b", r"\b([A-Z]{2,6}[-]?\d{3,6})\b",
    r"\b([A-Z]{2,5}\d+(?:\.\d+)?)\b", r"\b([A-Z]{1,3}\d{2,5}[a-z]\d{1,3})\b", r"(?:[Cc]lone\s+)([A-Z0-9]{2,10})", r"(?:antibody\s*\(\s*)([A-Z]{1,3}\d{2,5}[a-z]\d{1,3})(?:\s*\))",
]
NOT_NAMES = ["COVID", "SARS", "MERS", "BA.1", "BA.2", "BA.4", "BA.5", "BQ.1", "XBB", "WHO", "FDA", "EUA", "ELISA", "FACS", "BSA", "PBS", "DMEM", "RPMI", "FBS", "HRP", "FITC", "PE"]
OTHER_NAMES = ["CDR", "IGHV", "IGKV", "IGLV", "IGHD", "IGHJ", "IGKJ", "IGLJ", "VH", "VK", "VL", "JH", "JK", "JL", "EMD-", "PIIS"]
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
LOOPS = {"h3": r"(?i)CDR[-_\s]?H3\s*[:=]?\s*([A-Z]{5,35})", "l3": r"(?i)CDR[-_\s]?L3\s*[:=]?\s*([A-Z]{5,35})", "h3_anchor": r"\b(C[A-Z]{3,28}W)\b", "l3_anchor": r"\b(C[A-Z]{3,16}[FT])\b", "other": r"\b(C[A-Z]{8,25}[WFTVILG])\b"}
#: Words in capitals that begin with C and end like a loop.
NOT_LOOPS = [
    "COPYRIGHT", "CORRESPONDENCE", "CONTRIBUTION", "CONTRIBUTED", "CONFLICT", "CONCEPTUALIZATION", "COMPREHENSIVE", "COLLECTED", "CHARACTERIZATION", "CONSTRAINT", "CONSISTENT", "CONVALESCENT",
    "CONFIRMATION", "CONFIDENTIAL", "COUNTERPART", "COEFFICIENT", "CONSTRUCT", "CONSTRUCTS", "CONCENTRATED", "COMPLEMENT", "COMPETITIVE", "CONVENTIONAL", "CROSSREACT", "CROSSREACTIVITY",
]


def found(text: Column, pattern: str) -> Column:
    """Every match of the pattern's group, sorted, once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))))


def structure_ids(text: Column) -> Column:
    return F.array_except(found(text, STRUCTURE_ID), F.array(*map(F.lit, NOT_STRUCTURES)))


def protein_ids(text: Column) -> Column:
    return found(text, PROTEIN_ID)


def accession(raw: Column) -> Column:
    """An accession in capitals without separators and version."""
    return F.regexp_replace(F.regexp_replace(F.upper(raw), r"[\s_-]+", ""), r"\.\d+$", "")


def accession_hits(text: Column, around: int = 120) -> Column:
    """Every accession in order: id, kind, reagent.

    A reagent's number has a supplier's word within `around` characters,
    begins like one, or stands in brackets with a company.
    """

    def of(x: Column) -> Column:
        # pieces between the hits tell where each of them begins
        ends = F.transform(x["hits"], lambda _, i: F.aggregate(F.slice(x["between"], F.lit(1), i + 1), F.lit(0), lambda n, p: n + F.length(p)) + F.aggregate(F.slice(x["hits"], F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p)))
        placed = F.transform(x["hits"], lambda h, i: F.struct(h.alias("raw"), accession(h).alias("id"), F.substr(x["t"], F.greatest(F.get(ends, i) - around, F.lit(0)) + 1, F.least(F.get(ends, i), F.lit(around)) + F.length(h) + around).alias("near")))
        return F.filter(F.transform(placed, lambda h: F.struct(h["id"].alias("id"), accession_kind(h["id"]).alias("kind"), _reagent(h).alias("reagent"))), lambda h: h["kind"] != "other")

    t = F.coalesce(text, F.lit(""))
    return let(F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(ACCESSION), F.lit(1)).alias("hits"), F.split(t, ACCESSION).alias("between")), of)


def _reagent(hit: Column) -> Column:
    near = F.lower(hit["near"])
    word = F.exists(F.array(*map(F.lit, REAGENT_WORDS)), lambda w: F.contains(near, w))
    prefix = F.exists(F.array(*map(F.lit, REAGENT_PREFIXES)), lambda w: F.startswith(hit["id"], w))
    inside = F.exists(F.regexp_extract_all(near, F.lit(r"(\([^)]*\))"), F.lit(1)), lambda b: F.contains(b, F.lower(hit["raw"])) & F.exists(F.array(*map(F.lit, COMPANIES)), lambda w: F.contains(b, w)))
    return word | prefix | inside


def accessions(text: Column, kinds: tuple[str, ...] = ("nucleotide", "protein"), reagents: bool = False) -> Column:
    """Ids of the given kinds that are no reagents' numbers (or that are), sorted, once."""
    some = F.filter(accession_hits(text), lambda h: h["kind"].isin(*kinds) & (h["reagent"] == F.lit(reagents)))
    return F.array_sort(F.array_distinct(F.transform(some, lambda h: h["id"])))


def accession_kind(accession: Column) -> Column:
    """nucleotide for one or two letters and five to eight digits, protein for three and five, else other."""
    return F.when(accession.rlike(r"^[A-Z]{1,2}\d{5,8}$"), "nucleotide").when(accession.rlike(r"^[A-Z]{3}\d{5}$"), "protein").otherwise("other")


def genes(text: Column) -> Column:
    return F.struct(*[found(text, p).alias(k) for k, p in GENES.items()], F.regexp_count(F.coalesce(text, F.lit("")), F.lit(IDENTITY)).alias("identity_mentions"))


def dois(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found(text, DOI), lambda d: F.regexp_replace(d, r"[.)]+$", ""))))


def pubmed_ids(text: Column) -> Column:
    return found(text, PUBMED)


def loops(text: Column) -> Column:
    """Candidates of both loops, and others that are neither: four distinct letters at least, and no words."""

    def kept(*keys: str) -> Column:
        both = F.flatten(F.array(*[found(text, LOOPS[k]) for k in keys]))
        rich = F.filter(both, lambda s: (F.size(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))) > 3) & ~F.upper(s).isin(NOT_LOOPS))
        return F.array_sort(F.array_distinct(rich))

    three = F.struct(kept("h3", "h3_anchor").alias("h3"), kept("l3", "l3_anchor").alias("l3"), kept("other").alias("other"))
    return let(three, lambda x: F.struct(x["h3"].alias("h3"), x["l3"].alias("l3"), F.array_except(F.array_except(x["other"], x["h3"]), x["l3"]).alias("other")))


def antibody_names(text: Column) -> Column:
    """Names of antibodies that patterns find, without words, genes and catalogue numbers."""
    all_of = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in NAMES])))
    other = lambda n: F.exists(F.array(*map(F.lit, OTHER_NAMES)), lambda w: F.startswith(F.upper(n), w))
    plain = lambda n: n.isin(NOT_NAMES) | (F.length(n) < 3) | F.endswith(F.lower(n), F.lit("-treated")) | n.rlike(r"^[A-Z]{2,4}\d{5,}$")
    return F.array_sort(F.filter(all_of, lambda n: ~plain(n) & ~other(n)))


def table_counts(text: Column) -> Column:
    n = lambda p: F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)))
    return F.struct(n(HTML_TABLE).alias("html"), n(PIPE_RULE).alias("pipe"))


def images(text: Column) -> Column:
    """Targets of Markdown images in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IMAGE), F.lit(1)))


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1)))


def bundle(text: Column) -> Column:
    """All scanners over one text."""
    return F.struct(
        F.length(F.coalesce(text, F.lit(""))).alias("chars"), structure_ids(text).alias("structure_ids"), accession_hits(text).alias("accessions"), protein_ids(text).alias("protein_ids"),
        genes(text).alias("genes"), loops(text).alias("loops"), dois(text).alias("dois"), pubmed_ids(text).alias("pubmed_ids"), table_counts(text).alias("tables"), antibody_names(text).alias("names"),
    )


def _ids(scan: Column, kinds: tuple[str, ...], reagents: bool = False) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(scan["accessions"], lambda h: h["kind"].isin(*kinds) & (h["reagent"] == F.lit(reagents))), lambda h: h["id"])))


def tracks(scan: Column) -> Column:
    """Which extraction tracks a scan calls for: A for identifiers, C for tables, B always."""
    ids = (F.size(scan["structure_ids"]) > 0) | (F.size(_ids(scan, ("nucleotide", "protein"))) > 0)
    grid = (scan["tables"]["html"] > 0) | (scan["tables"]["pipe"] > 0)
    return F.filter(F.array(F.when(ids, F.lit("A")), F.lit("B"), F.when(grid, F.lit("C"))), lambda x: x.isNotNull())


def routes(scan: Column) -> Column:
    """A line for each source that a track would read, with counts, and one for each track that has none."""
    n = lambda a: F.size(a).cast("string")
    line = lambda count, text: F.when(count > 0, F.concat(F.lit(text[0]), count.cast("string"), F.lit(text[1])))
    acids, proteins = F.size(_ids(scan, ("nucleotide",))), F.size(_ids(scan, ("protein",)))
    html, pipe = scan["tables"]["html"], scan["tables"]["pipe"]
    lines = F.array(
        line(F.size(scan["structure_ids"]), ("Track A (API Fetch): ", " PDB ID(s) → RCSB API")), line(acids, ("Track A (API Fetch): ", " nucleotide GenBank ID(s) → NCBI Entrez")),
        line(proteins, ("Track A (API Fetch): ", " protein accession(s) → NCBI Entrez")), line(html, ("Track C (Script Extract): ", " HTML table(s)")), line(pipe, ("Track C (Script Extract): ", " Markdown table(s)")),
        F.when((F.size(scan["structure_ids"]) == 0) & (acids + proteins == 0), F.lit("Track A not applicable: No external DB IDs found")),
        F.when(html + pipe == 0, F.lit("Track C not applicable: No tables found in document")), F.lit("Track B (Supplementary): Always check supplementary materials"))
    return F.filter(lines, lambda x: x.isNotNull())


def hint_text(scan: Column, names_shown: int = 60, dois_shown: int = 5) -> Column:
    """The scan as lines of a prompt; lists that are empty say so."""
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("None found")
    entry = lambda head, a: F.concat(F.lit(f"- {head}: "), listed(a))
    some = lambda head, a: F.when(F.size(a) > 0, entry(head, a))
    genes_ = F.array_sort(F.array_distinct(F.flatten(F.array(*[scan["genes"][k] for k in ("imgt_v", "imgt_d", "imgt_j", "short_v", "vdj", "vj")]))))
    more = F.when(F.size(scan["names"]) > names_shown, F.concat(F.lit(" (+"), (F.size(scan["names"]) - names_shown).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat_ws(
        "\n", F.lit("[Regex Hints]:"), entry("PDB IDs", scan["structure_ids"]), entry("GenBank IDs (likely)", _ids(scan, ("nucleotide", "protein"))), entry("Nucleotide accessions", _ids(scan, ("nucleotide",))),
        entry("Protein accessions", _ids(scan, ("protein",))), some("Reagent catalog (filtered)", _ids(scan, ("nucleotide", "protein"), True)), entry("UniProt IDs", scan["protein_ids"]), entry("Germline genes", genes_),
        entry("CDRH3 candidates", scan["loops"]["h3"]), entry("CDRL3 candidates", scan["loops"]["l3"]), some("Other CDR3 candidates", scan["loops"]["other"]), entry("DOI", F.slice(scan["dois"], 1, dois_shown)),
        entry("PMID", scan["pubmed_ids"]), F.concat(F.lit("- Tables: "), scan["tables"]["html"].cast("string"), F.lit(" HTML, "), scan["tables"]["pipe"].cast("string"), F.lit(" Markdown")),
        F.concat(entry("Antibody name candidates", F.slice(scan["names"], 1, names_shown)), more))
