"""Images, figures and alignment blocks in document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import sequences, text
from lectern.functions.binding import bound
from lectern.functions.scan import IMAGE
from lectern.operators.records import name_like_tokens

FIGURE = r"(?i)\b(Fig(?:ure)?\.?\s*[A-Za-z0-9]+|Table\s*[A-Za-z0-9]+)\b"
#: Shortest reference line of an alignment, share of it that a line of differences covers at least, and names in a cluster.
REFERENCE_LENGTH, DIFF_SHARE, CLUSTER, SMALL_CLUSTER = 60, 0.7, 4, 2
HEAVY_STARTS, LIGHT_STARTS = ["QVQ", "EVQ", "QMQ", "VQL"], ["DIV", "EIV", "DIQ", "IVL"]


def manifest(blocks: DataFrame, id_col: str, most: int = 400) -> DataFrame:
    """blocks (id, pos, block) -> id, image, pos, figure_label, caption: each image where it is first mentioned.

    The caption is its block and the next; the label is the first figure or
    table that these name.
    """
    w = Window.partitionBy(id_col).orderBy("pos")
    both = blocks.withColumn("_next", F.lead("block").over(w)).filter(F.col("block").rlike(IMAGE))
    joined = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in ("block", "_next")])
    each = both.select(id_col, "pos", joined.alias("_c"), F.posexplode(F.regexp_extract_all("block", F.lit(IMAGE), F.lit(1))).alias("at", "image"))
    first = each.groupBy(id_col, "image").agg(F.min_by(F.struct("pos", "at", "_c"), F.struct("pos", "at")).alias("f"))
    return first.select(id_col, "image", "f.pos", F.regexp_extract("f._c", FIGURE, 1).alias("figure_label"), F.substring("f._c", 1, most).alias("caption"))


def light_gap(gap: Column) -> Column:
    """Whether the text between two images parts them: not if it is a comment, a panel's letters or marks."""
    g = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(gap, F.lit("")), r"(?s)<!--.*?-->", " "), r"\s+", " "))
    return (g == "") | g.rlike(r"^[A-Za-z0-9](?:\s*[A-Za-z0-9]){0,2}$") | g.rlike(r"^[\W_]+$")


def image_groups(images: DataFrame, by: str, most: int = 3) -> DataFrame:
    """images (by, pos, image, gap: text since the one before) -> groups of two to `most` neighbours without text between: by, first, images.

    Every run of neighbours within a stretch is a group once.  A group ends at
    each image, so windows of the last few images find them, not pairs of all.
    """
    w = Window.partitionBy(by).orderBy("pos")
    stretch = F.sum((~light_gap(F.col("gap"))).cast("int")).over(w)
    rows = images.withColumn("_s", stretch)
    inside = Window.partitionBy(by, "_s").orderBy("pos")
    ends = [F.collect_list(F.struct("pos", "image")).over(inside.rowsBetween(-(n - 1), 0)).alias(f"_g{n}") for n in range(2, most + 1)]
    rows = rows.select(by, *ends)
    groups = rows.select(by, F.explode(F.filter(F.array(*[F.when(F.size(f"_g{n}") == n, F.col(f"_g{n}")) for n in range(2, most + 1)]), lambda g: g.isNotNull())).alias("g"))
    return groups.select(by, F.get("g", F.lit(0))["pos"].alias("first"), F.transform("g", lambda x: x["image"]).alias("images")).dropDuplicates([by, "images"])


def known_images(groups: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """groups (by, images, ...) with known: whether any of a group's images is among known (by, image)."""
    keyed = groups.withColumn("_g", F.monotonically_increasing_id())
    hit = keyed.select("_g", by, F.explode("images").alias("image")).join(known.select(by, "image"), [by, "image"], "left_semi").select("_g").distinct()
    return keyed.join(hit.withColumn("known", F.lit(True)), "_g", "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("_g")


def nearest_section(lines: DataFrame, by: str) -> DataFrame:
    """lines (by, pos, line) with section: the last heading of 32 to 64 hex digits at or before each."""
    own = F.nullif(F.regexp_extract("line", r"^#\s+([0-9a-f]{32,64})\s*$", 1), F.lit(""))
    return lines.withColumn("section", F.last(own, ignorenulls=True).over(Window.partitionBy(by).orderBy("pos")))


def identical_clusters(records: DataFrame) -> DataFrame:
    """records (paper_id, image, name, vh, vl, loop, context) -> clusters of the same whole heavy region in one image.

    size, names (those of the first records in order), whether a light region
    or a loop is shared by all that have one, whether a context names all of
    them; review if none of the three holds.
    """
    key = lambda c: sequences.letters(F.col(c))
    rows = bound(records.filter(text.has_output(F.col("image"))), _vh=key("vh"), _vl=F.nullif(key("vl"), F.lit("")), _loop=F.nullif(key("loop"), F.lit("")), _name=text.alnum_key(F.col("name")), _context=text.alnum_key(F.col("context")))
    rows = rows.filter(F.length("_vh") >= 80)
    one = lambda c: F.coalesce((F.min(c) == F.max(c)), F.lit(False))
    found = rows.groupBy("paper_id", "image", "_vh").agg(
        F.count("*").alias("size"), one("_vl").alias("shared_light"), one("_loop").alias("shared_loop"), F.array_sort(F.collect_set(F.nullif(F.trim("name"), F.lit("")))).alias("names"),
        F.collect_set(F.nullif(F.col("_name"), F.lit(""))).alias("_names"), F.collect_set("_context").alias("_contexts"))
    named = F.exists("_contexts", lambda c: F.forall("_names", lambda n: F.contains(c, n))) & (F.size("_names") > 1)
    out = found.filter("size > 1").withColumn("named_together", named)
    return out.select("paper_id", "image", "size", "names", "named_together", "shared_light", "shared_loop", (~(F.col("named_together") | F.col("shared_light") | F.col("shared_loop"))).alias("review"))


def _reference(line: Column) -> Column:
    return F.regexp_replace(F.upper(line), r"[^A-Z-]", "")


def _diff(line: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(line, r"\s+", "")), "0O1", "QQI")


def alignment_chain(reference: Column, context: Column) -> Column:
    """vh_sequence_aa or vl_sequence_aa by a reference's beginning, its context or its end; empty if nothing tells."""
    low = F.lower(F.coalesce(context, F.lit("")))
    starts = lambda xs: F.substring(reference, 1, 3).isin(xs)
    says = lambda *xs: low.rlike("|".join(xs))
    return (
        F.when(starts(HEAVY_STARTS) | says("hcdr", "heavy chain"), "vh_sequence_aa").when(starts(LIGHT_STARTS) | says("lcdr", "light chain"), "vl_sequence_aa")
        .when(F.contains(reference, F.lit("WGQGT")), "vh_sequence_aa").when(reference.rlike("FGQGTK|FGGGTK"), "vl_sequence_aa").otherwise("")
    )


def alignment_records(blocks: DataFrame, id_cols: list[str]) -> DataFrame:
    """blocks (ids, block, context) -> ids, name, field, sequence of OCR'd alignments.

    The first line of 60 residues and more without dots is the reference; the
    lines before it that look like names and the lines after it with dots, of
    70 % of its length at least, go together in order.  A block counts with
    four of each, or two where its context speaks of variants.  Each line of
    differences is written out against the reference.  All of a block's lines
    stay in its row.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("block"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = bound(blocks, _lines=lines)
    at = F.array_position(F.transform("_lines", lambda x: (F.length(_reference(x)) >= REFERENCE_LENGTH) & ~F.contains(x, F.lit(".")) & x.rlike(r"^[A-Za-z\s-]+$")), F.lit(True))
    rows = bound(rows, _at=at).filter("_at > 1")
    rows = bound(rows, _ref=_reference(F.get("_lines", F.col("_at") - 1)))
    rows = bound(rows, _field=alignment_chain(F.col("_ref"), F.col("context"))).filter("_field <> ''")
    name = lambda x: x.rlike(r"^[A-Za-z0-9][\w./()+-]{1,30}$") & x.rlike(r"[A-Za-z]") & (x.rlike(r"\d") | x.rlike(r"[A-Z]{2}")) & ~F.lower(x).isin("hcdr1", "hcdr2", "hcdr3", "lcdr1", "lcdr2", "lcdr3")
    differs = lambda x: F.contains(_diff(x), F.lit(".")) & (F.length(_diff(x)) >= F.greatest(F.lit(20), F.floor(F.length("_ref") * DIFF_SHARE)))
    rows = bound(rows, _names=F.filter(F.slice("_lines", F.lit(1), F.col("_at") - 1), name), _diffs=F.filter(F.slice("_lines", F.col("_at") + 1, F.size("_lines")), differs))
    least = F.when(F.lower("context").rlike("variant sequence|humanized"), SMALL_CLUSTER).otherwise(CLUSTER)
    rows = rows.filter((F.size("_names") >= least) & (F.size("_diffs") >= least))
    pairs = F.filter(F.arrays_zip("_names", "_diffs"), lambda p: p["_names"].isNotNull() & p["_diffs"].isNotNull())
    out = rows.select(*id_cols, F.col("_field").alias("field"), "_ref", F.explode(pairs).alias("p"))
    sequence = sequences.letters(sequences.from_alignment(F.col("_ref"), F.substr(_diff(F.col("p._diffs")), F.lit(1), F.length("_ref"))))
    return out.select(*id_cols, F.col("p._names").alias("name"), "field", sequence.alias("sequence")).filter(F.length("sequence") >= REFERENCE_LENGTH)


def without_supplements(body: Column, names: list[str]) -> Column:
    """Text without the `# Excel Supplement:` sections of the given names; runs of blank lines become one."""
    out = F.coalesce(body, F.lit(""))
    for n in names:
        out = F.regexp_replace(out, rf"(?ms)^# Excel Supplement: \Q{n}\E.*?(?=^# |\z)", "")
    return F.concat(F.rtrim(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"\s+$", "")), F.lit("\n"))


def with_ocr(lines: DataFrame, ocr: DataFrame, by: str) -> DataFrame:
    """lines (by, pos, line) with the text that OCR found in an image added below the line that shows it.

    ocr: by, image, ocr_text; images without text add nothing.  The lines that
    OCR read as an image of their own are left out of its text.
    """
    shown = F.regexp_extract("line", IMAGE, 1)
    name = F.regexp_extract(shown, r"([^/]+)$", 1)
    body = F.array_join(F.filter(F.split("ocr_text", "\n"), lambda x: ~x.rlike(IMAGE)), "\n")
    found = ocr.select(by, F.col("image").alias("_image"), F.trim(body).alias("_ocr")).filter("_ocr <> ''")
    marked = F.concat(F.lit("\n<!-- OCR extracted from "), F.col("_image"), F.lit(" -->\n"), F.col("_ocr"), F.lit("\n<!-- end OCR -->"))
    out = lines.withColumn("_image", F.nullif(name, F.lit(""))).join(found, [by, "_image"], "left")
    return out.select(by, "pos", F.concat("line", F.coalesce(marked, F.lit(""))).alias("line"))


def ocr_owner(lines: DataFrame, by: str) -> DataFrame:
    """lines (by, pos, line) with owner: the image whose OCR a line belongs to, between its opening and closing marks."""
    opens = F.nullif(F.regexp_extract("line", r"<!-- OCR extracted from (.+?) -->", 1), F.lit(""))
    event = F.when(opens.isNotNull(), opens).when(F.contains("line", F.lit("<!-- end OCR -->")), F.lit(""))
    w = Window.partitionBy(by).orderBy("pos")
    owner = F.last(event, ignorenulls=True).over(w)
    return lines.withColumn("owner", F.when(event.isNull(), F.nullif(owner, F.lit(""))))


def image_score(known: Column, category: Column, names: Column, body: Column, cluster: Column, aligned: Column, run: Column, label: Column, words: list[tuple[str, int]]) -> Column:
    """Relevance of an image: known 100, a wanted category 40, up to three names 25 each, words by weight, up to six clustered names 5 each, an alignment 30 or else a long run 18, a label 2."""
    low = F.lower(F.coalesce(body, F.lit("")))
    told = sum((F.when(low.rlike(p), n).otherwise(0) for p, n in words), F.lit(0))
    return (
        F.when(known, 100).otherwise(0) + F.when(category, 40).otherwise(0) + 25 * F.least(names, F.lit(3)) + told + 5 * F.least(cluster, F.lit(6))
        + F.when(aligned, 30).when(run, 18).otherwise(0) + F.when(label, 2).otherwise(0)
    )



#: Words by which a context and an OCR'd text speak of sequences, and by which a text is of another kind of picture.
SEQUENCE_WORDS = ["sequence alignment", "sequence", "alignment", "h chain", "l chain", "heavy chain", "light chain", "cdr"]
OCR_WORDS = ["heavy chain", "light chain", "h chain", "l chain", "cdr", "germline", "imgt", "shm", "fr1", "fr2", "fr3", "fr4"]
OTHER_PICTURES = ["anti-strep", "mw (kda)", "pngase", "od450", "western blot", "fluorescence", "microscopy", "overlay", "dapi"]


def shows_sequences(context: Column, ocr: Column) -> Column:
    """Whether an image may show sequences: by its OCR'd text where that tells, else by its context.

    A text of another kind of picture rejects it unless the text speaks of
    sequences; names in a cluster count with a long run of letters.
    """
    has = lambda t, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(t), w))
    c, o = F.coalesce(context, F.lit("")), F.coalesce(ocr, F.lit(""))
    named = lambda t: (name_like_tokens(t) >= CLUSTER) & F.upper(t).rlike("[A-Z-]{20,}")
    supports = has(o, OCR_WORDS) | named(o)
    told = F.when((o != "") & has(o, OTHER_PICTURES) & ~supports, False).when((o != "") & supports, True)
    return F.coalesce(told, has(c, SEQUENCE_WORDS) | named(c))


def with_crops(images: DataFrame, crops: DataFrame, by: str) -> DataFrame:
    """images (by, image) and each one's crops (by, image, crop), the image itself first: by, image, crop, key; every key once."""
    whole = images.select(by, "image", F.lit(None).cast("string").alias("crop")).distinct()
    parts = crops.join(images.select(by, "image").distinct(), [by, "image"], "left_semi").select(by, "image", "crop").distinct()
    return whole.unionByName(parts).withColumn("key", F.concat("image", F.coalesce(F.concat(F.lit("#crop:"), "crop"), F.lit(""))))
