"""Which images of a paper are worth a look: sizes, known images, the first ones, relevance to the gaps, and the reader's category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.binding import bound
from lectern.operators.merge import nearest_bonus
from lectern.operators.papers import CATEGORIES, GAPS, gap_categories, large_enough

#: Images of a paper that are looked at in order, and how many of these are shown to a reader.
MOST, KEPT = 40, 30
#: Words and their weights, by the group of gaps that they count for.
WORDS = [
    (["sequence", "alignment", "cdr", "heavy chain", "light chain", "vh", "vl"], 8),
    (["kd", "kon", "koff", "ec50", "ic50", "bli", "spr", "kinetic", "affinity"], 7),
    (["survival", "challenge", "protection", "in vivo", "mouse", "mice"], 7),
]
#: A name's token, a block of recognised text, a long run, names in a cluster.
NAME_TOKEN = r"\b([A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*)\b"
OCR_BLOCK = r"(?s)<!-- OCR extracted from .*?-->\s*(.*?)\s*<!-- end OCR -->"
LONG_RUN, CLUSTER = "[A-Z-]{40,}", 4


def image_category(reply: Column) -> Column:
    """The category that the first word of a reply begins, else NOT_RELEVANT."""
    word = F.upper(F.regexp_extract(F.coalesce(reply, F.lit("")), r"^\s*(\S+)", 1))
    out = F.lit("NOT_RELEVANT")
    for category in reversed(CATEGORIES):
        out = F.when(F.startswith(F.regexp_replace(F.replace(word, F.lit("-"), F.lit("_")), "^_+|_+$", ""), F.lit(category.split("_")[0])), category).otherwise(out)
    return out


def name_cluster(body: Column) -> Column:
    """How many distinct tokens of three characters or more, case aside, have a letter and a digit."""
    found = F.transform(F.regexp_extract_all(body, F.lit(NAME_TOKEN), F.lit(1)), F.lower)
    return F.size(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & t.rlike("[a-z]") & t.rlike("[0-9]"))))


def alignment_block(body: Column) -> Column:
    """Whether a block of recognised text holds a reference line of 60 and four lines of differences of 40 characters."""

    def shown(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), F.trim), lambda x: x != "")
        reference = F.exists(lines, lambda x: (F.length(F.regexp_replace(F.upper(x), "[^A-Z-]", "")) >= 60) & ~F.contains(x, F.lit(".")))
        bare = F.transform(lines, lambda x: F.regexp_replace(F.upper(x), r"[^A-Z.\-]", ""))
        return reference & (F.size(F.filter(bare, lambda x: (F.length(x) >= 40) & F.contains(x, F.lit(".")))) >= CLUSTER)

    return F.exists(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(OCR_BLOCK), F.lit(1)), shown)


def _paper_gaps(targets: DataFrame, sequences_always: bool) -> DataFrame:
    """targets (paper_id, name, missing_fields) -> paper_id, names, allowed, wants: what a paper's gaps ask for; a paper's targets are few."""
    t = targets.select("paper_id", F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("name"), F.coalesce("missing_fields", F.array().cast("array<string>")).alias("missing_fields"))
    g = t.groupBy("paper_id").agg(F.collect_list("name").alias("names"), F.array_distinct(F.flatten(F.collect_list("missing_fields"))).alias("_f"))
    wants = F.array(*[F.arrays_overlap("_f", F.array(*map(F.lit, fields))) for fields, *_ in GAPS])
    return g.select("paper_id", F.filter("names", lambda n: n != "").alias("names"), gap_categories(F.col("_f"), sequences_always).alias("allowed"), wants.alias("wants"))


def relevant_images(images: DataFrame, targets: DataFrame, known: DataFrame, most: int = MOST, kept: int = KEPT, sequences_always: bool = False) -> DataFrame:
    """The images of papers with gaps that a reader should see: paper_id, image, idx, score, category, allowed.

    images (paper_id, pos, image, parts: its group, alt, context, category,
    pixels of each part) lose the small ones (those of unknown size stay); the
    first `most` of each paper are scored against its targets (paper_id, name,
    missing_fields), and the best `kept` stay: by score, then place, then path.
    An image that is known (paper_id, image), itself or a part of it, shows
    sequences.  Evidence of sequences next to an image counts for it too.  Both
    limits are kept within tasks before anything is shuffled.
    """
    i = images.filter(F.coalesce(large_enough(F.col("pixels")), F.lit(True))).withColumn("_all", F.array_distinct(F.concat(F.array("image"), F.coalesce("parts", F.array().cast("array<string>")))))
    w = Window.partitionBy("paper_id").orderBy("pos", "image")
    i = i.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
    hit = i.select("paper_id", "_rn", F.explode("_all").alias("image")).join(known.select("paper_id", "image").distinct().withColumn("_k", F.lit(True)), ["paper_id", "image"])
    own = i.select("paper_id", "image").join(known.select("paper_id", "image").distinct(), ["paper_id", "image"], "left_semi").distinct().withColumn("_own", F.lit(True))
    i = i.join(hit.groupBy("paper_id", "_rn").agg(F.first("_k").alias("_k")), ["paper_id", "_rn"], "left").join(own, ["paper_id", "image"], "left")
    i = i.join(_paper_gaps(targets, sequences_always), "paper_id")
    told = F.when(F.col("_k"), "SEQUENCE_DATA").otherwise(F.coalesce("category", F.lit("")))
    blank = lambda c: F.coalesce(c, F.lit(""))
    i = bound(i, _category=told)
    i = bound(i, _t=F.lower(F.concat_ws(" ", blank("alt"), "image", blank("context"), "_category")), _preset=image_category(F.col("_category")))
    text = F.col("_t")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda x: F.contains(text, x))
    i = bound(i, _names=F.size(F.filter("names", lambda n: F.contains(text, n))), _cluster=name_cluster(text), _run=F.upper(text).rlike(LONG_RUN), _aligned=alignment_block(F.col("context")), _fits=F.array_contains("allowed", F.col("_preset")))
    count = lambda k: sum((F.when(F.contains(text, F.lit(x)), WORDS[k][1]).otherwise(0) for x in WORDS[k][0]), F.lit(0))
    clustered = F.col("_cluster") >= CLUSTER
    # a block of recognised text is told by capitals, so a lower-cased text never counts as one here
    by_need = [count(0) + F.when(clustered, 5 * F.least("_cluster", F.lit(6))).otherwise(0) + F.when(clustered & F.col("_run"), 18).otherwise(0), count(1), count(2)]
    score = F.when(F.col("_own"), 100).otherwise(0) + F.when(F.col("_fits"), 40).otherwise(0) + 25 * F.least("_names", F.lit(3))
    score = score + sum((F.when(F.get("wants", F.lit(k)), n).otherwise(0) for k, n in enumerate(by_need)), F.lit(0)) + F.when(F.contains(text, F.lit("fig")), 2).otherwise(0) + F.when(F.contains(text, F.lit("table")), 2).otherwise(0)
    evidence = F.coalesce(F.col("_own"), F.lit(False)) | ((F.col("_preset") == "SEQUENCE_DATA") & F.col("_fits")) | has(WORDS[0][0]) | F.col("_aligned") | (F.col("_run") & (clustered | (F.col("_names") >= 2)))
    i = bound(i, _score=score, _evidence=evidence)
    near = lambda d: F.max(F.col("_evidence").cast("int")).over(Window.partitionBy("paper_id").orderBy("_rn").rowsBetween(-d, d)) == 1
    distance = F.when(F.col("_evidence"), 0).when(near(1), 1).when(near(2), 2)
    i = i.withColumn("score", F.col("_score") + nearest_bonus(distance))
    last = Window.partitionBy("paper_id").orderBy(F.desc("score"), "_rn", "image")
    i = i.withColumn("_place", F.row_number().over(last)).filter(F.col("_place") <= max(1, kept))
    return i.select("paper_id", "image", (F.col("_rn") - 1).alias("idx"), "score", F.col("_category").alias("category"), "allowed")


def triaged_images(relevant: DataFrame, answers: DataFrame) -> DataFrame:
    """relevant_images() that fill gaps, with their category: one that they have already, else what a reader answered (paper_id, image, reply).

    Images whose reader failed (null) or names a category that no gap asks for go.
    """
    r = relevant.join(answers.select("paper_id", "image", "reply"), ["paper_id", "image"], "left")
    own, told = image_category(F.col("category")), image_category(F.col("reply"))
    category = F.when(F.array_contains("allowed", own), own).when(F.array_contains("allowed", told), told)
    return r.withColumn("category", category).filter("category IS NOT NULL").select("paper_id", "image", "idx", "score", "category")
