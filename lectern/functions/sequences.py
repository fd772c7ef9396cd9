"""Amino-acid sequences: cleaning, gates, anchors, and checks of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let

STANDARD = "ACDEFGHIKLMNPQRSTVWY"
#: Three-letter names of the residues.
THREE = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}
#: Accepted lengths of variable regions: good from and to, then failing below and above.
REGION = {"H": (110, 135, 90, 160), "L": (105, 120, 85, 145)}
LOOP = {"H": (5, 30), "L": (5, 18)}


def letters(value: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z]", "")


def gapped(value: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z.-]", "")


def standard(seq: Column) -> Column:
    return seq.rlike(f"^[{STANDARD}]+$")


def one_letter(value: Column) -> Column:
    """Runs of three or more three-letter residues, parted only by spaces or hyphens, as one-letter code."""
    v = F.coalesce(value, F.lit(""))
    names = "|".join(THREE)
    three = v.rlike(rf"^\s*(?i:{names})(?:[\s-]*(?i:{names})){{2,}}\s*$")
    found = F.regexp_extract_all(v, F.lit(rf"(?i)({names})"), F.lit(1))
    table = F.create_map(*[F.lit(x) for k, one in THREE.items() for x in (k.lower(), one)])
    return F.when(three, F.array_join(F.transform(found, lambda t: F.element_at(table, F.lower(t))), "")).otherwise(letters(v))


def loop_or_blank(value: Column) -> Column:
    s = letters(value)
    return F.when(standard(s) & F.length(s).between(5, 40), s).otherwise("")


def region_or_blank(value: Column) -> Column:
    s = letters(value)
    return F.when(standard(s) & (F.length(s) >= 80), s).otherwise("")


def full_region(value: Column, most: int | None = None) -> Column:
    s = letters(value)
    ok = standard(s) & (F.length(s) >= 80)
    return ok if most is None else ok & (F.length(s) <= most)


def _loop_by_anchor(s: Column, end: str) -> Column:
    """The last of the loops from C to `end` and G that begin in the second half; empty if there is none."""
    found = F.regexp_extract_all(s, F.lit(f"(C[A-Z]{{3,30}}?{end}G[A-Z]{{1,4}})"), F.lit(1))
    start = lambda m: F.length(s) - F.instr(F.reverse(s), F.reverse(m)) - F.length(m) + 1
    loop = lambda m: F.regexp_extract(m, f"^(C[A-Z]{{3,30}}?{end})G[A-Z]{{1,4}}$", 1)
    good = F.filter(found, lambda m: (start(m) >= F.floor(F.length(s) / 2)) & F.length(loop(m)).between(5, 30) & standard(loop(m)))
    return F.coalesce(loop(F.element_at(F.when(F.size(good) > 0, good), -1)), F.lit(""))


def loop_of(region: Column) -> Column:
    """CDRH3 of a heavy region, its anchors included: up to W and G, else up to F and G; empty if there is none."""
    return let(letters(region), lambda s: F.coalesce(F.nullif(_loop_by_anchor(s, "W"), F.lit("")), _loop_by_anchor(s, "F")))


#: What ends the framework before the loop, in order of preference.
BEFORE_LOOP = ["YYC", "YFC", "FYC", "YHC", "YLC", "YIC", "FFC"]


def loop_core(region: Column) -> Column:
    """CDRH3 of a heavy region without its anchors, between the C of a framework motif and WG.G in the last 15 residues.

    Without a motif the last C within 30 residues before, beyond the 80th,
    serves; empty for regions under 80 and loops under 3.
    """

    def of(s: Column) -> Column:
        tail = F.substring(s, -15, 15)
        head = F.regexp_extract(tail, r"^(.*?)WG[A-Z]G", 1)
        stop = F.length(s) - F.length(tail) + F.length(head)
        before = F.substr(s, F.lit(1), stop)
        motif = F.coalesce(*[F.nullif(F.length(F.regexp_extract(before, f"^(.*{m})", 1)), F.lit(0)) for m in BEFORE_LOOP])
        low = F.greatest(stop - 29, F.lit(80))
        near = F.regexp_extract(F.substr(before, low + 1), "^(.*C)", 1)
        start = F.coalesce(motif, F.when(near != "", low + F.length(near)))
        loop = F.substr(s, start + 1, stop - start)
        return F.when((F.length(s) >= 80) & tail.rlike("WG[A-Z]G") & (F.length(loop) >= 3), loop).otherwise("")

    return let(letters(region), of)


def untangled(loop: Column, region: Column) -> Column:
    """A loop that runs more than three residues past the one its region derives, and begins alike, gives way to it.

    A leading C does not count and is kept where the loop had one.
    """

    def of(x: Column) -> Column:
        a, b = x["loop"], x["core"]
        bare = F.regexp_replace(a, "^C+", "")
        tangled = (b != "") & (F.length(bare) > F.length(b) + 3) & F.startswith(bare, F.substring(b, 1, 10))
        return F.when(tangled, F.when(F.startswith(a, F.lit("C")) & ~F.startswith(b, F.lit("C")), F.concat(F.lit("C"), b)).otherwise(b)).otherwise(a)

    return let(F.struct(letters(loop).alias("loop"), loop_core(region).alias("core")), of)


def conflict(a: Column, b: Column) -> Column:
    """same, near or different; the tolerance is 3 % of the longer, one to three; tags of histidine do not count."""
    return conflict_report(a, b)["verdict"]


def conflict_report(current: Column, incoming: Column) -> Column:
    """verdict, edits, minor and replace of an incoming region against the current one.

    An empty current value, or one that is no whole region, gives way; so does
    one that differs by no more than the tolerance.
    """
    bare = lambda v: F.regexp_replace(letters(v), "H{5,10}$", "")

    def of(v: Column) -> Column:
        x, y = v["x"], v["y"]
        longest = F.greatest(F.length(x), F.length(y))
        allowed = F.least(F.lit(3), F.greatest(F.lit(1), F.bround(longest * 0.03).cast("int")))
        edits = F.levenshtein(x, y)
        verdict = F.when(x == y, "same").when(edits <= allowed, "near").otherwise("different")
        open_ = (x == "") | ~v["whole"]
        return F.struct(verdict.alias("verdict"), edits.alias("edits"), (open_ | (verdict != "different")).alias("minor"), (open_ | (verdict != "different")).alias("replace"))

    return let(F.struct(bare(current).alias("x"), bare(incoming).alias("y"), full_region(current, 160).alias("whole")), of)


#: Motifs with which each chain's variable domain begins, patterns with which it ends, the window where none
#: does, how far from the start its motifs are searched, and the lengths of a likely domain.
STARTS = {
    "H": ["EESGGG", "EVQL", "QVQL", "DVQL", "QLQL", "HLQL", "LQLQ", "VQPGG"],
    "L": ["DIQMTQ", "DIVVTQ", "DVVMTQ", "DIVMTQ", "QSVLTQ", "EIVLTQ", "EVVFTQ", "QVVFSQ", "VVFTQ", "MTQTPS", "VMTQTP"],
}
ENDS = {
    "H": ["C[A-Z]{3,30}?WG[A-Z]{1,8}T[LVI]V?SS", "C[A-Z]{3,30}?FG[A-Z]{1,8}T[LVI]V?SS", "C[A-Z]{3,30}?WG[A-Z]{1,10}TVTV", "C[A-Z]{3,30}?FG[A-Z]{1,10}TVTV"],
    "L": ["C[A-Z]{3,25}?FGGGTR[LVI]TVL", "C[A-Z]{3,25}?FGGGTK[LVI]E?IK", "C[A-Z]{3,25}?FGQGTKV?EIK", "C[A-Z]{3,25}?FG[A-Z]{2,12}LTVL", "C[A-Z]{3,25}?FG[A-Z]{2,12}KLEIK", "C[A-Z]{3,25}?FG[A-Z]{2,12}VK"],
}
WINDOW = {"H": 150, "L": 130}
LIKELY = {"H": (95, 160), "L": (85, 140)}
LINKER = "G{2,4}S(?:G{2,4}S){1,4}"


def _first_of(s: Column, patterns: list[str]) -> Column:
    """Group 1 of the first of the patterns that matches; null if none does."""
    if not patterns:
        return F.lit(None).cast("string")
    return let(F.regexp_extract(s, patterns[0], 1), lambda x: F.when(x != "", x).otherwise(_first_of(s, patterns[1:])))


def _domain(s: Column, chain: str) -> Column:
    at = F.array_min(F.filter(F.array(*[F.instr(F.substring(s, 1, 80), m) for m in STARTS[chain]]), lambda p: p > 0))
    cut = lambda tail: F.coalesce(_first_of(tail, [f"^(.*?{p})" for p in ENDS[chain]]), F.substring(tail, 1, WINDOW[chain]))
    last = lambda: let(_first_of(s, [f"^(.*{p})" for p in ENDS[chain]]), lambda x: F.coalesce(F.regexp_extract(x, f"(.{{1,{WINDOW[chain]}}})$", 1), s))
    return let(F.substr(s, at), lambda tail: F.when(tail.isNotNull(), cut(tail)).otherwise(last()))


def _likely(s: Column, chain: str) -> Column:
    return F.length(s).between(*LIKELY[chain])


def _start_places(s: Column, chain: str, within: int | None = None) -> Column:
    """Places (from one) at which a chain's motifs begin, in order."""
    motifs = "|".join(STARTS[chain])
    searched = s if within is None else F.substring(s, 1, within)

    def of(x: Column) -> Column:
        # cut before every motif, those that overlap too: each piece but the first begins with one
        lengths = F.transform(F.split(x, f"(?={motifs})"), F.length)
        ends = F.aggregate(lengths, F.array(F.lit(1)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n), lambda done: F.slice(done, F.lit(2), F.greatest(F.size(done) - 2, F.lit(0))))
        return F.concat(F.when(x.rlike(f"^({motifs})"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), ends)

    return let(searched, of)


def single_chain_domains(value: Column) -> Column:
    """heavy and light domain of a single-chain fragment, both empty unless it has two likely ones.

    A heavy motif with a light one 70 residues on, else a light one with a
    heavy one 60 on; else, with a linker, each chain's domain of the whole.
    """

    def of(x: Column) -> Column:
        s = x["s"]

        def split(first: str, second: str, gap: int) -> Column:
            starts, others = x[first], x[second]
            cuts = F.transform(starts, lambda a: F.struct(a.alias("a"), F.array_min(F.filter(others, lambda b: b >= a + gap)).alias("b")))

            def both(c: Column) -> Column:
                parts = {first: _domain(F.substr(s, c["a"], c["b"] - c["a"]), first), second: _domain(F.substr(s, c["b"]), second)}
                return F.struct(*[parts[k].alias(k) for k in "HL"])

            found = F.transform(F.filter(cuts, lambda c: c["b"].isNotNull()), both)
            return F.get(F.filter(found, lambda d: _likely(d["H"], "H") & _likely(d["L"], "L")), F.lit(0))

        whole = F.struct(_domain(s, "H").alias("H"), _domain(s, "L").alias("L"))
        linked = F.when(s.rlike(LINKER), let(whole, lambda d: F.when(_likely(d["H"], "H") & _likely(d["L"], "L"), d)))
        usable = (F.length(s) >= 180) & (F.size(x["H"]) > 0) & (F.size(x["L"]) > 0)
        found = F.when(usable, F.coalesce(split("H", "L", 70), split("L", "H", 60), linked))
        return let(found, lambda d: F.struct(F.coalesce(d["H"], F.lit("")).alias("heavy"), F.coalesce(d["L"], F.lit("")).alias("light")))

    return let(letters(value), lambda s: let(F.struct(s.alias("s"), _start_places(s, "H", 140).alias("H"), _start_places(s, "L").alias("L")), of))


def variable_domain(value: Column, chain: str) -> Column:
    """The variable domain of a chain (H or L): of a single-chain fragment its own half, else the cut by motifs."""
    key = {"H": "heavy", "L": "light"}[chain]
    half = F.when(F.length(letters(value)) >= 180, single_chain_domains(value)[key]).otherwise("")
    return F.when(letters(value) == "", "").otherwise(F.coalesce(F.nullif(half, F.lit("")), let(letters(value), lambda s: _domain(s, chain))))


def chain_of(region: Column) -> Column:
    """heavy, light or unknown, by the motif with which a whole region begins, two residues in at most; the earlier wins."""

    def of(s: Column) -> Column:
        first = lambda chain: F.coalesce(F.array_min(F.filter(F.array(*[F.instr(F.substring(s, 1, 2 + max(map(len, STARTS[chain]))), m) for m in STARTS[chain]]), lambda p: p.between(1, 3))), F.lit(9))
        told = let(F.struct(first("H").alias("h"), first("L").alias("l")), lambda x: F.when(x["h"] < x["l"], "heavy").when(x["l"] < x["h"], "light").otherwise("unknown"))
        return F.when(full_region(s, 160), told).otherwise("unknown")

    return let(letters(region), of)


def fits_chain(field: Column, value: Column) -> Column:
    """Whether a region may stand in a field: not if it begins like the opposite chain."""
    wrong = F.when(field == "vh_sequence_aa", "light").when(field == "vl_sequence_aa", "heavy")
    return F.coalesce(chain_of(value) != wrong, F.lit(True))


#: How a chain's description tells its role, in order of trial.
ROLES = [
    ("heavy", r"\bnanobody\b|\bvhh\b|single[- ]domain antibody|camelid antibody fragment"),
    ("scfv", r"\bscfv\b|single[- ]chain fv|single[- ]chain variable fragment"),
    ("heavy", r"\bheavy\s+chain\b|fab(?:\s+fragment)?[^a-z0-9]*heavy\s+chain|immunoglobulin heavy"),
    ("heavy", r"\b(?:hc|vh)\b|(?:hc|vh)$|heavy[_ ]?chain|variable[_ ]?heavy"),
    ("light", r"\blight\s+chain\b|fab(?:\s+fragment)?[^a-z0-9]*light\s+chain|immunoglobulin (?:kappa |lambda )?light"),
    ("light", r"\b(?:kc|lc|vl)\b|(?:kc|lc|vl)$|kappa|lambda|variable[_ ]?light"),
]
RECORD_CHAINS = [
    ("heavy", r"immunoglobulin (?:variable region )?heavy chain|heavy chain (?:variable|variable region)|ighv|vh\b"),
    ("light", r"immunoglobulin (?:variable region )?(?:kappa |lambda )?light chain|light chain (?:variable|variable region)|igk|igl|vk\b|vl\b|kappa|lambda"),
]


def chain_role(description: Column, sequence: Column | None = None) -> Column:
    """scfv, heavy, light or other: a sequence with two domains is an scfv, whatever it is called."""
    text = F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), "[_-]+", " ")
    out = F.lit("other")
    for role, pattern in reversed(ROLES):
        out = F.when(text.rlike(pattern), role).otherwise(out)
    if sequence is None:
        return out
    return F.when(F.coalesce(single_chain_domains(sequence)["heavy"], F.lit("")) != "", "scfv").otherwise(out)


def record_chain(*texts: Column) -> Column:
    """heavy, light or unknown by what a database record says of a feature."""
    text = F.lower(F.concat_ws(" ", *texts))
    return F.when(text.rlike(RECORD_CHAINS[0][1]), "heavy").when(text.rlike(RECORD_CHAINS[1][1]), "light").otherwise("unknown")


def from_alignment(reference: Column, line: Column) -> Column:
    """A diff line against its reference: a dot is the reference's residue, a hyphen a gap, the reference's tail fills up."""
    fixed = F.translate(F.upper(F.regexp_replace(line, r"\s+", "")), "0O1", "QQI")

    def of(r: Column) -> Column:
        # runs of dots, hyphens and letters, each taken whole
        def told(done: Column, run: Column) -> Column:
            here = F.when(F.startswith(run, F.lit(".")), F.substr(r, done["at"], F.length(run))).when(F.startswith(run, F.lit("-")), "").otherwise(run)
            return F.struct((done["at"] + F.length(run)).alias("at"), F.concat(done["s"], here).alias("s"))

        runs = F.regexp_extract_all(fixed, F.lit("([.]+|-+|[^.-]+)"), F.lit(1))
        return F.aggregate(runs, F.struct(F.lit(1).alias("at"), F.lit("").alias("s")), told, lambda done: F.concat(done["s"], F.substr(r, done["at"], F.length(r))))

    return let(gapped(reference), of)


def loop_length(loop: Column, chain: str) -> Column:
    low, high = LOOP[chain]
    return F.when(F.length(letters(loop)).between(low, high), "pass").otherwise("warn")


def loop_start(loop: Column) -> Column:
    return F.when(F.startswith(letters(loop), F.lit("C")), "pass").otherwise("warn")


def loop_end(loop: Column, chain: str) -> Column:
    return F.when(letters(loop).rlike("W$" if chain == "H" else "[FVILT]$"), "pass").otherwise("warn")


def region_length(region: Column, chain: str) -> Column:
    low, high, least, most = REGION[chain]
    n = F.length(letters(region))
    return F.when(n == 0, "skip").when(n.between(low, high), "pass").when((n < least) | (n > most), "fail").otherwise("warn")


def residue_check(value: Column) -> Column:
    s = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", ""))
    return F.when(s.isin("", "N/A", "NULL", "NONE"), "skip").when(standard(s), "pass").otherwise("fail")


def overall(statuses: Column, strict: bool = False) -> Column:
    worst = F.when(F.array_contains(statuses, "warn"), "FAIL" if strict else "WARN").otherwise("PASS")
    return F.when(F.array_contains(statuses, "fail"), "FAIL").otherwise(worst)


def checks(record: dict[str, Column]) -> Column:
    """Array of (check, status) of a record's loops and regions: keys H3, L3, VH, VL."""
    found = []
    for key, chain in (("H3", "H"), ("L3", "L")):
        if key in record:
            found += [(f"{key}_residues", residue_check(record[key])), (f"{key}_length", loop_length(record[key], chain)), (f"{key}_start", loop_start(record[key])), (f"{key}_end", loop_end(record[key], chain))]
    for key, chain in (("VH", "H"), ("VL", "L")):
        if key in record:
            found += [(f"{key}_residues", residue_check(record[key])), (f"{key}_length", region_length(record[key], chain))]
    return F.array(*[F.struct(F.lit(name).alias("check"), status.alias("status")) for name, status in found])
