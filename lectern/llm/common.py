"""Shared folder, hashing and block helpers of the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Whitespace of the operators' contracts: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
#: Runs of whitespace that are not already one plain space.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Bytes of a batch that goes to a Python worker, however long its texts are (one row at least).
BATCH_BYTES = 4 << 20
#: Hash ranges into which a sample is cut, and keys that can each have so large a share of all rows.
RANGES, HOT = 1024, 1000
#: Written tables after which the driver collects its garbage: plans and broadcasts of steps that are over stay until then, and its heap grows meanwhile.
COLLECT = 1
#: Spark's setting by which a query's shuffle files go as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[list[str]] = []
_written = count(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the warehouse where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    The shuffle files of the write go as it ends, and not whenever the driver
    collects its garbage, so they never lie beside those of the next step.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not next(_written) % COLLECT:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one, for what is written in several steps."""
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    for paths in _made:
        paths.append(path)
    return path


def materialise_told(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """materialise(), and aggregates of what was written, gathered by the same job."""
    seen = Observation()
    return materialise(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), name), seen.get


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """materialise(), and the number of rows, counted by the same job."""
    df, told = materialise_told(df, name, n=F.count(F.lit(1)))
    return df, told["n"]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes on leaving what materialise() wrote inside, but for paths taken off the list that it gives."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield paths
    finally:
        _made.remove(paths)
        for path in paths:
            _delete(spark, path)


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python are bounded by bytes too, not by 10,000 rows of any size alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialised DataFrame that nothing lazy reads any more."""
    for file in df.inputFiles()[:1]:
        _delete(spark, file.rpartition("/")[0])


def collapse(text: Column) -> Column:
    """Null as empty; every whitespace run becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (0 for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0)).cast("int")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Bytes the optimizer expects the input to have; 0 if it cannot tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def bounded_sample(keys: DataFrame, by: str, id_col: str, n: int) -> DataFrame:
    """Distinct (id, by): at most n for each value of `by`, those least by a hash of the id.

    Values are counted first and a share of each, some 4 n rows, is drawn;
    the hash range of these is cut into RANGES parts, and the first parts that
    hold n rows at most together are the sample.  No value's rows are ranked
    or gathered: tasks see counts of ranges.
    """
    counts = keys.groupBy(by).agg(F.count("*").alias("_n"))
    counts, n_counts = counted(counts, "sizes")
    share = F.pmod(F.xxhash64(id_col, F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("_n") / F.lit(4.0 * n + 100)
    some = keys.select(id_col, by).join(narrow_side(counts, n_counts), by).withColumn("_r", F.floor(share * RANGES))
    some = materialise(some.filter(F.col("_r") < RANGES).select(id_col, by, "_r").distinct(), "drawn")
    running = F.sum("_c").over(Window.partitionBy(by).orderBy("_r"))
    held = some.groupBy(by, "_r").agg(F.count("*").alias("_c")).withColumn("_s", running).filter(F.col("_s") <= n)
    cut, n_cut = counted(held.groupBy(by).agg(F.max("_r").alias("_cut")), "cuts")
    return some.join(narrow_side(cut, n_cut), by).filter("_r <= _cut").select(id_col, by)


def narrow_side(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """Hint a broadcast only while the counted rows stay under the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def dealt_join(rows: DataFrame, named: DataFrame, key: str, sizes: DataFrame, total: int) -> DataFrame:
    """rows joined with one row a key from named, whatever share of rows a key has.

    sizes (key, n) has the rows of each key.  Keys with a thousandth of all
    rows or more, a thousand at most, are joined by broadcast; the others meet
    by a shuffle in which none weighs more than that.  Keys without a row in
    named go.
    """
    hot, n = counted(named.join(sizes.filter(F.col("n") * HOT >= total).select(key), key, "left_semi"), "hot")
    if not n:
        return rows.join(named, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(named.join(F.broadcast(hot.select(key)), key, "left_anti"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def salted_join(rows: DataFrame, named: DataFrame, key: str, sizes: DataFrame, total: int) -> DataFrame:
    """rows joined with named, which may have several rows a key, whatever share of rows a key has.

    sizes (key, n) has the rows of each key.  A key with more than a
    thousandth of all rows is cut into parts of that size by a hash of its
    rows, and its rows in named are copied for each part: two thousand copies
    at most over all keys.  The table of parts is broadcast, with a thousand
    rows at most.  Keys without a row in named go.
    """
    many = F.ceil(F.col("n") * HOT / F.lit(max(total, 1))).cast("int")
    parts = sizes.filter(F.col("n") * HOT > total).select(key, many.alias("_parts"))
    hot = parts.collect()
    if not hot:
        return rows.join(named, key)
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, parts.schema))
    rest = [F.col(c) for c in rows.columns if c != key]
    cut = rows.join(parts, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*rest), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    copied = named.join(parts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return cut.join(copied, [key, "_salt"]).drop("_salt")
