"""Sources and sinks: Markdown trees, record sets in JSON, FASTA, workbooks as long tables, report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File stems that say nothing about the paper.
GENERIC = ["index", "document", "doc", "paper", "images_ocr_merged", "merged"]
RECORD_SET = T.MapType(T.StringType(), T.StructType([
    T.StructField("title", T.StringType()), T.StructField("category", T.StringType()), T.StructField("antibodies", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
]))


def _part(path: Column, back: int) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-back)), F.lit(""))


def _stem(path: Column) -> Column:
    return F.regexp_replace(_part(path, 1), r"\.[^.]*$", "")


def paper_id(path: Column) -> Column:
    """The file's stem, or its folder where the stem is generic or the same."""
    stem, folder = _stem(path), _part(path, 2)
    return F.when(stem.isin(GENERIC) | (stem == folder), folder).otherwise(stem)


def markdown_rank(path: Column) -> Column:
    """Preference among the files of one paper: merged OCR, enhanced, a vlm folder, a stem like the folder, others."""
    stem, folder = _stem(path), _part(path, 2)
    return F.when(_part(path, 1) == "images_ocr_merged.md", 0).when(F.endswith(stem, F.lit("_enhanced")), 1).when(folder == "vlm", 2).when(stem == folder, 3).otherwise(9)


def markdown_group(path: Column) -> Column:
    """The paper's folder: that above `vlm`, the file's own, or the file itself at the top."""
    folder = _part(path, 2)
    return F.when(folder == "vlm", _part(path, 3)).when(folder == "", _stem(path)).otherwise(folder)


def choose_markdown(files: DataFrame, path_col: str = "path") -> DataFrame:
    """One Markdown file a paper: least rank, then the shorter name, then the path."""
    path = F.col(path_col)
    some = files.filter(F.endswith(path, F.lit(".md")) & ~F.startswith(_part(path, 1), F.lit(".")))
    order = F.struct(markdown_rank(path), F.length(_part(path, 1)), path)
    return some.groupBy(markdown_group(path).alias("paper")).agg(F.min_by(path, order).alias("path"))


def read_documents(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """paper_id, path, text of every matching file under root, one row a file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("paper_id", paper_id(F.col("path"))).select("paper_id", "path", "text")


def parse_records(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON record sets {paper: {title, category, antibodies: [...]}} -> paper_id, title, category, ab_idx, record."""
    papers = raw.select(F.explode(F.from_json(text_col, RECORD_SET)).alias("paper_id", "p"))
    return papers.select("paper_id", "p.title", "p.category", F.posexplode("p.antibodies").alias("ab_idx", "record"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(spark.read.text(path, wholetext=True))


def record_sets(records: DataFrame, idx: str = "ab_idx") -> DataFrame:
    """Records (paper_id, idx, record map) -> one JSON line a paper, records in order."""
    by_idx = lambda a, b: F.when(a[idx] < b[idx], -1).when(a[idx] > b[idx], 1).otherwise(0)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(idx, "record")), by_idx), lambda x: x["record"])
    return records.groupBy("paper_id").agg(ordered.alias("antibodies")).select("paper_id", F.to_json(F.struct("antibodies")).alias("value"))


def parse_fasta(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """FASTA texts -> header, its parts between bars, and the joined sequence of every entry."""
    entry = F.explode(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?m)^>"), lambda e: F.trim(e) != ""))
    rows = raw.select(entry.alias("e")).select(F.trim(F.regexp_extract("e", r"^([^\n]*)", 1)).alias("header"), F.regexp_replace(F.regexp_replace("e", r"^[^\n]*\n?", ""), r"\s+", "").alias("sequence"))
    return rows.withColumn("parts", F.transform(F.split("header", r"\|"), lambda p: F.trim(p)))


def unpivot_sheet(cells: DataFrame) -> DataFrame:
    """Workbook cells (sheet, row_no, col_no, cell): column 0 names the field, other columns are records.

    The first row of a repeated label counts; blank, nan, none and null are empty.
    """
    low = F.lower(F.trim(F.coalesce(F.col("cell"), F.lit(""))))
    value = F.when(low.isin("", "nan", "none", "null"), "").otherwise(F.trim("cell"))
    labels = cells.filter("col_no = 0").groupBy("sheet", F.trim("cell").alias("field")).agg(F.min("row_no").alias("row_no"))
    body = cells.filter("col_no > 0").select("sheet", "row_no", F.col("col_no").alias("ab_idx"), value.alias("value"))
    return body.join(labels, ["sheet", "row_no"]).select(F.col("sheet").alias("paper_id"), "ab_idx", "field", "value")


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A report table, line by line: heading, rule, then a row each; bars in cells are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|"))
    body = df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("value"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(columns) + " |",), ("|" + " --- |" * len(columns),)], "value string").coalesce(1)
    return head.unionByName(body)


METADATA = "recordSet array<struct<name:string,field:array<struct<name:string,dataType:string,source:struct<extract:struct<jsonPath:string>>>>>>"


def record_set_fields(metadata: DataFrame, text_col: str = "value") -> DataFrame:
    """A dataset's metadata in JSON -> record_set, pos, field, data_type, json_path of every field of its record sets."""
    sets = metadata.select(F.explode(F.from_json(text_col, METADATA)["recordSet"]).alias("s"))
    return sets.select(F.col("s.name").alias("record_set"), F.posexplode("s.field").alias("pos", "f")).select("record_set", "pos", F.col("f.name").alias("field"), F.col("f.dataType").alias("data_type"), F.col("f.source.extract.jsonPath").alias("json_path"))


def best_output(files: DataFrame, name: str = "full.md") -> DataFrame:
    """files (paper_id, path) -> the file of that name nearest the top of each paper's tree, of equal depths the first."""
    some = files.filter(_part(F.col("path"), 1) == name)
    return some.groupBy("paper_id").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), "path")).alias("path"))


def ocr_status(files: DataFrame) -> DataFrame:
    """files (paper_id, path) -> paper_id, done (it has a merged text), images: the state of a batch."""
    image = F.col("path").rlike(r"(?i)/images/[^/]+\.(jpe?g|png|webp)$")
    return files.groupBy("paper_id").agg(F.max((_part(F.col("path"), 1) == "images_ocr_merged.md").cast("int")).cast("boolean").alias("done"), F.sum(image.cast("long")).alias("images"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON text a row, other scripts kept as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def numbered(records: DataFrame, by: str, order: list[str], name: str = "Master_ID") -> DataFrame:
    """Records with a running number within each key, from one."""
    return records.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
