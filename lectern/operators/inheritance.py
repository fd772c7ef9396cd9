"""Chains that variants of an antibody share with their parents: names, the clauses that say so, and the copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import sequences, text
from lectern.functions.binding import bound
from lectern.operators.papers import CHAIN_WORDS, IDENTITY_WORDS, clauses, plain_key, states_identity
from lectern.operators.staged import staged

#: What a variant's name has besides its parent's.
VARIANT_NOISE = [
    r"\bwt\b", r"\bwild[- ]type\b", r"\bvariant\b", r"\bmutant\b", r"\bmutation\b", r"\bchimera\b", r"\bchimeric\b", r"\bdelet(?:e|ed|ion)\b", r"\bdel\b", r"\bfr\d+(?:[- ]\d+)?\b", r"\bcdr\d+(?:[- ]?[a-z0-9]+)?\b", r"\b[a-z]\d{1,3}[a-z]\b", r"\bls\b",
]
#: Fixed value: residues of a full variable region at most.
LONGEST = 160
CHAINS = {"vh_sequence_aa": "heavy", "vl_sequence_aa": "light"}


def bare_name(name: Column) -> Column:
    """Letters and digits of a name without its variant's words."""
    out = F.lower(F.coalesce(name, F.lit("")))
    for noise in VARIANT_NOISE:
        out = F.regexp_replace(out, noise, " ")
    return plain_key(out)


def candidate_parents(records: DataFrame) -> DataFrame:
    """records (paper_id, name) -> paper_id, child, parent, rank, size: every possible parent of every name.

    A parent's key (letters and digits) is shorter than its child's: rank 3 if
    it is the child's name without variant words, 2 if the child's key begins
    or ends with it, 1 if the bare name does.  Each child lists these keys, and
    they meet names by one equi-join on (paper, key), so a paper of many names
    that begin alike costs their lengths, not their pairs.
    """
    names = records.select("paper_id", F.trim("name").alias("name")).filter("name <> ''").distinct()
    names = bound(names, key=plain_key(F.col("name")), bare=bare_name(F.col("name")))

    def ends(key: str) -> Column:
        n = F.length(key)
        cuts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(cuts, lambda k: F.array(F.substr(F.col(key), F.lit(1), k), F.substr(F.col(key), n - k + 1, k))))

    children = names.select("paper_id", F.col("name").alias("child"), F.col("key").alias("_key"), F.col("bare").alias("_bare"), F.explode(F.array_distinct(F.concat(F.array("bare"), ends("key"), ends("bare")))).alias("key"))
    pairs = children.filter((F.col("key") != "") & (F.length("key") < F.length("_key"))).join(names.select("paper_id", "key", F.col("name").alias("parent")), ["paper_id", "key"]).filter("child <> parent")
    own = F.startswith("_key", F.col("key")) | F.endswith("_key", F.col("key"))
    return pairs.select("paper_id", "child", "parent", F.when(F.col("_bare") == F.col("key"), 3).when(own, 2).otherwise(1).alias("rank"), F.length("key").alias("size"))


def variant_parents(records: DataFrame) -> DataFrame:
    """paper_id, child, parent, rank: the first of candidate_parents(): by rank, then the longer key, then the name."""
    best = F.min_by(F.struct("parent", "rank"), F.struct(-F.col("rank"), -F.col("size"), "parent"))
    return candidate_parents(records).groupBy("paper_id", "child").agg(best.alias("b")).select("paper_id", "child", "b.*")


def identity_clauses(papers: DataFrame) -> DataFrame:
    """papers (paper_id, text) -> paper_id, field, pos, clause, key: clauses that call a chain identical to another."""
    c = papers.select("paper_id", F.posexplode(clauses(F.col("text"))).alias("pos", "clause")).withColumn("_low", F.lower("clause"))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("_low"), w))
    fields = F.array_compact(F.array(*[F.when(has(words), F.lit(f)) for f, words in CHAIN_WORDS.items()]))
    return c.filter(has(IDENTITY_WORDS)).select("paper_id", F.explode(fields).alias("field"), "pos", "clause", plain_key(F.col("clause")).alias("key"))


def inherited_chains(records: DataFrame, papers: DataFrame, rounds: int = 50) -> DataFrame:
    """What records without a chain take over from their parents: paper_id, idx, name, field, value, from_antibody, origin, evidence.

    records (paper_id, idx, name, vh_sequence_aa, vl_sequence_aa,
    CDRH3_Sequence), papers (paper_id, text).  A parent gives a chain if a
    clause of the paper says that the chain is the same, and if its best record
    (longest VH, then VL, then CDRH3, then the first) has it in full or has
    taken it over itself; chains of the other kind are no values of a field.  A
    child takes all it can from one parent: the first, in the order of
    variant_parents(), that gives anything.  Parents' keys are shorter than
    their children's, so there is no cycle, and a round for each generation
    settles all papers at once; origin is the antibody whose own chain it is.
    With a VH a record without CDRH3 gets the loop that VH derives.
    """
    fields = list(CHAINS)
    r = records.select("paper_id", "idx", F.trim(F.coalesce("name", F.lit(""))).alias("name"), *fields, "CDRH3_Sequence").filter("name <> ''")
    empty = lambda f: text.is_empty(F.col(f))
    wanting = staged(r.select("paper_id", "idx", "name", empty("CDRH3_Sequence").alias("no_loop"), F.explode(F.array_compact(F.array(*[F.when(empty(f), F.lit(f)) for f in fields]))).alias("field")), "wanting")

    lengths = [F.length(sequences.letters(F.col(f))) for f in (*fields, "CDRH3_Sequence")]
    best = r.groupBy("paper_id", F.lower("name").alias("low")).agg(F.max_by(F.struct(*[sequences.letters(F.col(f)).alias(f) for f in fields], *[empty(f).alias(f"no_{f}") for f in fields]), F.struct(*lengths, -F.col("idx"))).alias("b"))
    sides = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").alias("value"), F.col(f"b.no_{f}").alias("open")) for f in fields]))
    best = best.select("paper_id", "low", sides.alias("s")).select("paper_id", "low", "s.*")
    own = staged(best.filter(~F.col("open") & sequences.full_region(F.col("value"), LONGEST) & sequences.fits_chain(F.col("field"), F.col("value"))).select("paper_id", "low", "field", "value", F.col("low").alias("origin")), "own-chains")
    open_parents = best.filter("open").select("paper_id", "low", "field")

    edges = candidate_parents(r).join(wanting.select("paper_id", F.col("name").alias("child"), "field").distinct(), ["paper_id", "child"])
    told = edges.join(identity_clauses(papers), ["paper_id", "field"]).filter(states_identity(F.col("clause"), F.col("key"), F.col("child"), F.col("parent")))
    order = F.struct(-F.col("rank"), -F.col("size"), "parent")
    edges = told.groupBy("paper_id", "field", "child", "parent", F.lower("parent").alias("low")).agg(F.min(order).alias("order"), F.min_by("clause", "pos").alias("evidence"))
    edges = staged(edges, "parent-clauses")

    values, before, taken = own, None, None
    for _ in range(rounds):
        offered = edges.join(values, ["paper_id", "low", "field"])
        first = offered.groupBy("paper_id", "child").agg(F.min("order").alias("order"))
        taken = staged(offered.join(first, ["paper_id", "child", "order"]).select("paper_id", "child", "field", "value", "parent", "origin", "evidence"), "taken-chains")
        after = taken.agg(F.count("*"), F.sum(F.xxhash64("paper_id", "child", "field", "value", "parent").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
        passed = taken.groupBy("paper_id", F.lower("child").alias("low"), "field").agg(F.min(F.struct("child", "value", "origin")).alias("t")).select("paper_id", "low", "field", "t.value", "t.origin")
        values = own.unionByName(passed.join(open_parents, ["paper_id", "low", "field"], "left_semi"))
    else:
        raise RuntimeError(f"variants of variants go deeper than {rounds}")
    out = wanting.join(taken.withColumnRenamed("child", "name"), ["paper_id", "name", "field"])
    loop = F.when(F.col("no_loop") & (F.col("field") == "vh_sequence_aa"), sequences.loop_of(F.col("value"))).otherwise("")
    both = F.array(F.struct("field", "value"), F.struct(F.lit("CDRH3_Sequence").alias("field"), F.coalesce(loop, F.lit("")).alias("value")))
    out = out.select("paper_id", "idx", "name", F.col("parent").alias("from_antibody"), "origin", "evidence", F.explode(both).alias("x"))
    return out.filter("x.value <> ''").select("paper_id", "idx", "name", "x.field", "x.value", "from_antibody", "origin", "evidence")
