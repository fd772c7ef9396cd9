"""Text predicates and normalisers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as empty in scoring, and in the judging of sequences.
EMPTY_MARKERS = ["", "n/a", "n.a.", "n.d.", "nd", "not reported", "not specified", "未报道", "未提供", "未提及", "none", "null", "无", "-", "—"]
EMPTY_SEQUENCE = ["", "n/a", "na", "nd", "n.d.", "none", "-", "not reported", "未报道", "未提供"]
EMPTY_PHRASE = r"^(未提供|未报道|未提及|不适用|not\s+(reported|specified|provided|mentioned|applicable)|n\.?/?[ad]\.?)$"
#: Order in which the parts of an object field are joined.
OBJECT_KEYS = ["value", "pointer", "action", "quote", "metric_name", "metric_value", "germline", "confidence"]
PATENT_ID = r"(?i)^(WO|US|EP|CN|JP|KR|AU|CA|DE|FR|GB|IN)\d"
SUBSETS = {"all": "all", "paper": "paper", "papers": "paper", "literature": "paper", "patent": "patent", "patents": "patent"}
LIST_BREAK = r"[,;/，；、\n]+"


def clean(value: Column) -> Column:
    """Trimmed text; null becomes empty."""
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def folded(value: Column) -> Column:
    return F.lower(clean(value))


def has_output(value: Column) -> Column:
    """Any text at all: a marker such as N/A counts as output."""
    return clean(value) != ""


def is_empty(value: Column) -> Column:
    """Blank, a marker, or a marker once asides in brackets are gone."""
    text = folded(value)
    bare = F.trim(F.regexp_replace(text, r"\s*[\(（].*?[\)）]\s*", ""))
    return text.isin(EMPTY_MARKERS) | bare.isin(EMPTY_MARKERS) | bare.rlike(EMPTY_PHRASE)


def object_text(parts: Column) -> Column:
    """Text of a map field: its non-blank parts in a fixed order, joined by ` | `."""
    found = F.array(*[clean(F.element_at(parts, F.lit(k))) for k in OBJECT_KEYS])
    return F.array_join(F.filter(found, lambda x: x != ""), " | ")


def list_text(items: Column) -> Column:
    return F.array_join(F.filter(F.transform(items, clean), lambda x: x != ""), "; ")


def match_key(value: Column) -> Column:
    """Letters a-z and digits of the folded text."""
    return F.regexp_replace(folded(value), "[^a-z0-9]+", "")


def name_key(value: Column) -> Column:
    """Folded name without spaces, hyphens, en dashes and underscores."""
    return F.translate(folded(value), " -–_", "")


def alnum_key(value: Column) -> Column:
    """Folded name with letters and digits of any script."""
    return F.regexp_replace(folded(value), r"[^\p{L}\p{N}]+", "")


def list_tokens(value: Column) -> Column:
    """Distinct match keys of a list written with separators."""
    return F.array_distinct(F.filter(F.transform(F.split(clean(value), LIST_BREAK), match_key), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of distinct items in common; null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)))


def category(paper_id: Column, given: Column | None = None) -> Column:
    """patent or paper by the id's prefix; a category that is given wins."""
    own = F.when(F.trim(F.coalesce(paper_id, F.lit(""))).rlike(PATENT_ID), "patent").otherwise("paper")
    return own if given is None else F.coalesce(F.nullif(given, F.lit("")), own)


def subset_name(name: str | None) -> str:
    key = (name or "all").strip().lower()
    if key not in SUBSETS:
        raise ValueError(f"unknown subset {name!r}; expected one of {', '.join(sorted(set(SUBSETS.values())))}")
    return SUBSETS[key]


def name_parts(name: Column) -> Column:
    """What names are compared by: the key, and whether the name is written without separators."""
    return F.struct(name_key(name).alias("key"), (~clean(name).rlike(r"[\s\-_–/]")).alias("joined"))


def compact_variant(a: Column, b: Column) -> Column:
    """Of two names' parts: neither has separators, and one is the other and one or two more letters or digits."""
    ka, kb = a["key"], b["key"]
    short, long_ = F.when(F.length(ka) <= F.length(kb), ka).otherwise(kb), F.when(F.length(ka) <= F.length(kb), kb).otherwise(ka)
    rest = F.substr(long_, F.length(short) + 1)
    return a["joined"] & b["joined"] & (ka != "") & (kb != "") & (ka != kb) & F.startswith(long_, short) & rest.rlike(r"^[\p{L}\p{N}]{1,2}$")


def first_filled(*values: Column) -> Column:
    """First value that is not blank, else empty."""
    return F.coalesce(*[F.nullif(clean(v), F.lit("")) for v in values], F.lit(""))


def plain(text: Column) -> Column:
    """Entities resolved and whitespace runs as one space."""
    swaps = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
    out = reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), swaps, F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def shortened(text: Column, limit: int) -> Column:
    """At most limit characters, the last three of a cut text being dots."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def doi(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1)), r"[.,;)]+$", "")


def year(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\b((?:19|20)\d{2})\b", 1)


def first_author(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    inside = F.trim(F.regexp_extract(t, r"(?i)\(([A-Za-z][A-Za-z'`\- ]+?)\s+et al\.?\)", 1))
    last = F.element_at(F.split(inside, r"\s+"), -1)
    outside = F.regexp_extract(t, r"\b([A-Z][A-Za-z'`\-]+)\s+et al\.?", 1)
    return F.regexp_replace(F.lower(F.when(inside != "", last).otherwise(outside)), "[^a-z]", "")


def journal(text: Column) -> Column:
    """The first four words of a reference without asides, DOI, year and `et al`."""
    t = F.regexp_replace(folded(text), r"\([^)]*\)", " ")
    t = F.trim(F.regexp_replace(t, r"doi\s*:?.*$", " "))
    y = year(t)
    t = F.when(y != "", F.replace(t, y, F.lit(" "))).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r"\bet al\.?\b", " "), r"[^a-z0-9. ]+", " ")
    return F.array_join(F.slice(F.filter(F.split(F.trim(t), r"\s+"), lambda w: (w != "and") & (w != "")), 1, 4), "")


def reference(text: Column) -> Column:
    """`Author et al. Journal, Year` and the DOI, where author and year are known; else the text."""
    a, y, d = first_author(text), year(text), doi(text)
    out = F.concat(F.initcap(a), F.lit(" et al. "), F.initcap(journal(text)), F.lit(", "), y, F.when(d != "", F.concat(F.lit(". DOI: "), d)).otherwise(F.lit("")))
    return F.when((a != "") & (y != ""), out).otherwise(clean(text))
