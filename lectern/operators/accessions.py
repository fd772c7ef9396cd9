"""From a paper's text to the chains of its antibodies in a sequence database: requests, ranges, and the join by preference.

A paper is the unit of every step: antibodies meet the records that the paper
asks for by one shuffle on the paper, and everything after it groups by a key
that begins with the paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import scan, sequences
from lectern.functions.binding import bound, let
from lectern.operators.papers import LIKELY, OF_ANTIBODY, accession_range, plausible_accessions

#: The fields whose hints name accessions, and the chain that each asks for.
HINTED = {"vh_sequence_aa": "heavy", "vl_sequence_aa": "light", "CDRH3_Sequence": "heavy"}
HINT_KEYS = ["pointer", "quote", "value"]
#: Members of a range that are asked for; a wider one is taken for two accessions.
RANGE_MOST = 10_000


def range_members(first: Column, last: Column, most: int = RANGE_MOST) -> Column:
    """All accessions from first to last, if both have the same letters and as many digits; else the two."""
    letters, digits = (lambda a: F.regexp_extract(a, r"^([A-Z]+)", 1)), (lambda a: F.regexp_extract(a, r"(\d+)$", 1))
    low, high = digits(first).try_cast("long"), digits(last).try_cast("long")
    whole = (letters(first) == letters(last)) & (F.length(first) == F.length(last)) & (high >= low) & (high - low < most)
    all_of = F.transform(F.sequence(low, F.greatest(high, low)), lambda n: F.concat(letters(first), F.lpad(n.cast("string"), F.length(digits(first)), F.lit("0"))))
    return F.when(F.coalesce(whole, F.lit(False)), all_of).otherwise(F.array_distinct(F.array(first, last)))


def hint_candidates(hint: Column) -> Column:
    """Accessions of a hint (pointer, quote, value): exact, ranged (the ends of ranges, only without an exact one), present (it says anything)."""

    def part(key: str) -> Column:
        t = F.coalesce(hint[key], F.lit(""))
        return let(plausible_accessions(t), lambda f: F.struct(F.transform(f, lambda x: x["id"]).alias("ids"), accession_range(t, f).alias("ranged")))

    def both(parts: Column) -> Column:
        ids = lambda ranged: F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda p: p["ranged"] == F.lit(ranged)), lambda p: p["ids"])))
        none = F.array().cast("array<string>")
        return let(ids(False), lambda exact: F.struct(exact.alias("exact"), F.when(F.size(exact) > 0, none).otherwise(ids(True)).alias("ranged")))

    said = F.lit(False)
    for key in HINT_KEYS:
        said = said | (F.trim(F.coalesce(hint[key], F.lit(""))) != "")
    return let(both(F.array(*map(part, HINT_KEYS))), lambda b: F.struct(b["exact"].alias("exact"), b["ranged"].alias("ranged"), said.alias("present")))


def requested_accessions(papers: DataFrame, antibodies: DataFrame | None = None) -> DataFrame:
    """paper_id, pos, accession: what a paper asks a database for, each once.

    Accessions of papers (paper_id, text) that are no reagents' numbers come
    first; those of the hints of antibodies (paper_id, idx, name, hints) follow,
    ranges with all members as rows.
    """
    told = papers.select("paper_id", F.posexplode(scan.accessions(F.col("text"))).alias("pos", "accession")).select("paper_id", F.lit(0).alias("of"), F.col("pos").cast("long").alias("pos"), "accession")
    if antibodies is not None:
        hints = antibodies.select("paper_id", "idx", F.explode(F.array(*[F.struct(F.lit(i).alias("field"), hint_candidates(F.col("hints")[f]).alias("c")) for i, f in enumerate(HINTED)])).alias("h"))
        ends = F.transform(F.array_compact(F.array(F.when(F.size("h.c.ranged") > 1, F.lit(0)))), lambda _: range_members(F.get("h.c.ranged", F.lit(0)), F.element_at("h.c.ranged", -1)))
        more = hints.select("paper_id", "idx", F.posexplode(F.array_distinct(F.concat("h.c.exact", "h.c.ranged", F.flatten(ends)))).alias("pos", "accession"))
        told = told.unionByName(more.select("paper_id", F.lit(1).alias("of"), (F.col("idx").cast("long") * 2 * RANGE_MOST + F.col("pos")).alias("pos"), "accession"))
    first = told.groupBy("paper_id", "accession").agg(F.min(F.struct("of", "pos")).alias("at"))
    return first.select("paper_id", (F.col("at.of") * F.lit(1 << 40) + F.col("at.pos")).alias("pos"), "accession")


def record_summaries(records: DataFrame, features: DataFrame) -> DataFrame:
    """A row a database record: the best translation of each chain, what names it, and whether it can fill an antibody's gaps.

    Of a chain's features the named variable regions come first, then those of
    a likely length, then the longer, then the first.  A record's features are
    few, so its texts are gathered.
    """
    n = F.length("translation")
    likely = F.when(F.col("chain") == "heavy", n.between(*LIKELY["heavy"])).otherwise(n.between(*LIKELY["light"]))
    order = F.struct(-F.col("is_variable").cast("int"), -likely.cast("int"), -n, "pos")
    best = lambda c: F.min_by("translation", F.when(F.col("chain") == c, order)).alias(f"_{c}")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "product", "note", "gene"))), lambda f: F.struct(f["product"].alias("product"), f["note"].alias("note"), f["gene"].alias("gene")))
    has = lambda c: F.max((F.col("chain") == c).cast("int")).alias(f"_has_{c}")
    of = features.groupBy("accession").agg(best("heavy"), best("light"), has("heavy"), has("light"), texts.alias("_texts"))
    r = records.select("accession", "record_id", "description").join(of, "accession", "left")
    none = F.array().cast("array<struct<product:string,note:string,gene:string>>")
    side = lambda c: F.when(F.col(f"_has_{c}") == 1, F.col(f"_{c}")).otherwise("").alias(c)
    r = r.select("accession", "record_id", "description", side("heavy"), side("light"), F.coalesce("_texts", none).alias("texts"))
    words = F.lower(F.concat_ws(" ", "description", "record_id", F.array_join(F.transform("texts", lambda t: F.concat_ws(" ", t["product"], t["note"], t["gene"])), " ")))
    speaks = F.exists(F.array(*map(F.lit, OF_ANTIBODY)), lambda w: F.contains(words, w))
    return r.withColumn("usable", (F.col("heavy") != "") | (F.col("light") != "") | speaks)


def _plain(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")


def name_forms(name: Column) -> Column:
    """A name's pattern as a word, its letters and digits, and those of its last part if they are three or more."""
    full = F.trim(F.coalesce(name, F.lit("")))
    parts = F.filter(F.transform(F.split(full, r"[\s._-]+"), _plain), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    word = F.concat(F.lit(r"(?iU)\b\Q"), F.replace(full, F.lit(r"\E"), F.lit("")), F.lit(r"\E\b"))
    return F.struct(word.alias("word"), full.alias("full"), _plain(full).alias("key"), F.when(F.length(last) >= 3, last).otherwise("").alias("last"))


def name_match(value: Column, forms: Column) -> Column:
    """How a text names an antibody: 4 as a word, 3 inside its letters and digits, 2 by the last part of the name, else 0."""
    key = _plain(value)
    inside = lambda k: (k != "") & F.contains(key, k)
    return F.when((forms["full"] != "") & F.regexp_like(F.coalesce(value, F.lit("")), forms["word"]), 4).when(inside(forms["key"]), 3).when(inside(forms["last"]), 2).otherwise(0)


def backfilled(antibodies: DataFrame, fetched: DataFrame) -> DataFrame:
    """paper_id, idx, name, vh, vl, loop, ids: what the records that a paper fetched give to its antibodies.

    antibodies (paper_id, idx, name, hints: a map from field to pointer, quote,
    value) meet fetched (paper_id, pos and what record_summaries() gives) of
    their paper.  For each chain, records that name the antibody come first,
    then the exact accessions of the field's hint, then, without any hint, the
    only usable record of a paper with one antibody, then the only one of a
    range's ends that was fetched: a conflict between two ends fills nothing.
    Among several, how well the record names the antibody decides, then a
    region of that chain, then the order of the hint or of the requests.  A
    loop's hint stands in for a heavy chain that has none.  Antibodies without
    a name or a match give no row.
    """
    of_paper = Window.partitionBy("paper_id")
    a = antibodies.withColumn("_n", F.count("*").over(of_paper)).filter(F.trim(F.coalesce("name", F.lit(""))) != "")
    a = bound(a.select("paper_id", "idx", F.trim("name").alias("name"), "hints", "_n"), _forms=name_forms(F.col("name")), **{f"_c_{f}": hint_candidates(F.col("hints")[f]) for f in HINTED}).drop("hints")
    r = fetched.withColumn("_m", F.sum(F.col("usable").cast("int")).over(of_paper))
    pairs = a.join(r, "paper_id")
    forms, texts = F.col("_forms"), F.col("texts")
    most = lambda values: F.array_max(F.transform(values, lambda t: name_match(t, forms)))
    any_of = most(F.concat(F.array("description", "record_id"), F.transform(texts, lambda t: t["product"]), F.transform(texts, lambda t: t["note"])))
    of_chain = most(F.concat(F.array("description"), F.transform(texts, lambda t: F.concat_ws(" ", t["product"], t["note"], t["gene"]))))
    pairs = bound(pairs, _any=any_of, _named=of_chain)

    aggs, choose = [], {}
    for chain in ("heavy", "light"):
        has, value = F.col(chain) != "", F.struct("accession", F.col(chain).alias("sequence"))
        named = has & F.col("usable") & (F.col("_any") > 0)
        aggs.append(F.min_by(value, F.when(named, F.struct(-F.col("_named"), -F.col("_any"), "pos"))).alias(f"_name_{chain}"))
        aggs.append(F.max(F.when(named, 1)).alias(f"_is_name_{chain}"))
        only = has & F.col("usable") & (F.col("_m") == 1) & (F.col("_n") == 1)
        aggs += [F.min_by(value, F.when(only, F.col("pos"))).alias(f"_only_{chain}"), F.max(F.when(only, 1)).alias(f"_is_only_{chain}")]
    for field, chain in HINTED.items():
        has, value, c = F.col(chain) != "", F.struct("accession", F.col(chain).alias("sequence")), F.col(f"_c_{field}")
        at = F.array_position(c["exact"], F.col("accession"))
        exact, ranged = has & (at > 0), has & F.array_contains(c["ranged"], F.col("accession"))
        aggs += [F.min_by(value, F.when(exact, F.struct(-F.col("_named"), at))).alias(f"_exact_{field}"), F.max(F.when(exact, 1)).alias(f"_is_exact_{field}")]
        aggs += [F.min_by(value, F.when(ranged, F.col("pos"))).alias(f"_range_{field}"), F.sum(F.when(ranged, 1).otherwise(0)).alias(f"_n_range_{field}")]
        aggs += [F.first(c["present"]).alias(f"_present_{field}"), F.first((F.size(c["exact"]) > 0) | (F.size(c["ranged"]) > 0)).alias(f"_some_{field}")]
        choose[field] = (
            F.when(F.col(f"_is_name_{chain}") == 1, F.col(f"_name_{chain}")).when(F.col(f"_is_exact_{field}") == 1, F.col(f"_exact_{field}"))
            .when((F.col(f"_is_only_{chain}") == 1) & ~F.col(f"_present_{field}") & (F.col(f"_n_range_{field}") == 0), F.col(f"_only_{chain}"))
            .when(F.col(f"_n_range_{field}") == 1, F.col(f"_range_{field}"))
        )
    g = pairs.groupBy("paper_id", "idx").agg(F.first("name").alias("name"), *aggs)
    g = g.select("*", *[c.alias(f"_pick_{f}") for f, c in choose.items()])
    loop_pick = F.when(F.col("_some_CDRH3_Sequence"), F.col("_pick_CDRH3_Sequence"))
    by_loop = F.when(F.col("_present_CDRH3_Sequence"), F.col("_pick_CDRH3_Sequence"))
    g = g.select("paper_id", "idx", "name", F.coalesce("_pick_vh_sequence_aa", loop_pick).alias("_h"), F.col("_pick_vl_sequence_aa").alias("_l"), by_loop.alias("_c"))
    heavy = F.coalesce("_h", "_c")
    ids = F.array_join(F.array_distinct(F.array_compact(F.array("_h.accession", "_l.accession", F.when(F.col("_h").isNull(), F.col("_c.accession"))))), ",")
    out = bound(g, loop=F.coalesce(sequences.loop_of(F.coalesce(heavy["sequence"], F.lit(""))), F.lit("")))
    out = out.select("paper_id", "idx", "name", F.coalesce("_h.sequence", F.lit("")).alias("vh"), F.coalesce("_l.sequence", F.lit("")).alias("vl"), "loop", ids.alias("ids"))
    return out.filter((F.col("vh") != "") | (F.col("vl") != "") | (F.col("loop") != ""))


def fetched_records(requests: DataFrame, summaries: DataFrame) -> DataFrame:
    """What a paper asked for and a database has: paper_id, pos and the record's columns; accessions meet without separators and version."""
    asked = requests.select("paper_id", "pos", scan.accession(F.col("accession")).alias("accession"))
    return asked.groupBy("paper_id", "accession").agg(F.min("pos").alias("pos")).join(summaries, "accession")


def fetched_chains(papers: DataFrame, antibodies: DataFrame, records: DataFrame, features: DataFrame) -> DataFrame:
    """The whole stage: requests of papers (paper_id, text) and hints, their records, and what these give to antibodies."""
    fetched = fetched_records(requested_accessions(papers, antibodies), record_summaries(records, features))
    return backfilled(antibodies, fetched)
