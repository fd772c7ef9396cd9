"""A model's replies as a table: versions appended, the last one of a key wins, and what is known is not asked again.

Layout of a cache folder: `gen=N/bucket=B/*.parquet`, a generation for each
write, dealt by a hash of the key.  A generation counts once it is whole (its
_SUCCESS file is there), so an interrupted write leaves nothing; a compacted
one (`base`) stands for all before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.staged import staged
from lectern.sources.connectors import mock_reply, with_retries

BUCKETS = 64
#: Tries after which a key that always failed is left alone.
MOST_TRIES = 3
#: What follows a reply that was cut off.
CONTINUE = "\n[continue the JSON from where it stops]"
ROW = "key string, version long, reply string, error string, tries int, base boolean"


def reply_key(*parts: Column) -> Column:
    """One key of a model, a field and its prompt: a digest, null parts told from empty ones."""
    marked = [F.coalesce(F.concat(F.lit("+"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.length(m).cast("string"), F.lit(":"), m) for m in marked]), 256)


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Whole generations from the last base on; a folder that isn't there has none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    at = lambda n, f: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/{f}")
    whole = {int(n.split("=")[1]): files.exists(at(n, "bucket=base")) for n in names if n.startswith("gen=") and files.exists(at(n, "_SUCCESS"))}
    bases = [g for g, base in whole.items() if base]
    return sorted(g for g in whole if not bases or g >= max(bases))


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """key, version, reply, error, tries: the last version of every key (a reply before a failure, then the greater text)."""
    found = _generations(spark, path)
    if not found:
        return spark.createDataFrame([], ROW).drop("base")
    rows = spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(*[f"{path}/gen={g}" for g in found]).filter("key IS NOT NULL")
    last = F.max(F.struct("version", F.col("reply").isNotNull().alias("ok"), "reply", "error", "tries"))
    return rows.groupBy("key").agg(last.alias("r")).select("key", "r.version", "r.reply", "r.error", "r.tries")


def write_replies(rows: DataFrame, path: str, base: bool = False) -> int:
    """Append rows (key, version, reply, error, tries) as a generation, whose number it gives; written twice they change nothing.

    A base also holds a row without a key, by which it is known.
    """
    spark = rows.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(root) if s.getPath().getName().startswith("gen=")] if files.exists(root) else []
    number = max(taken, default=0) + 1
    out = rows.select("key", F.col("version").cast("long").alias("version"), "reply", "error", F.col("tries").cast("int").alias("tries"), F.lit(base).alias("base"))
    out = out.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("string")).repartition("bucket")
    if base:
        out = out.unionByName(spark.createDataFrame([(None, 0, None, None, 0, True, "base")], f"{ROW}, bucket string"))
    out.write.partitionBy("bucket").parquet(f"{path}/gen={number}")
    return number


def compact_replies(spark: SparkSession, path: str, drop: bool = True) -> int:
    """Write the last version of every key as a base and drop the generations before it."""
    number = write_replies(read_replies(spark, path), path, base=True)
    if drop:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in files.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("gen=") and int(name.split("=")[1]) < number:
                files.delete(s.getPath(), True)
    return number


def asked_once(prompts: DataFrame, call: Callable[[str], str] = mock_reply, tries: int = 1) -> DataFrame:
    """key, reply, error of prompts (key, prompt): a call that fails gives its error as a row, and never the task."""

    def of(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, prompt in zip(batch["key"], batch["prompt"], strict=True):
            try:
                out.append((key, with_retries(lambda p=prompt: call(p), tries), None))
            except Exception as e:
                out.append((key, None, f"{type(e).__name__}: {e}"[:500]))
        return pd.DataFrame(out, columns=["key", "reply", "error"])

    return prompts.mapInPandas(lambda batches: map(of, batches), "key string, reply string, error string")


def ask(asked: DataFrame, path: str, version: int, call: Callable[[str], str] = mock_reply, most_tries: int = MOST_TRIES) -> DataFrame:
    """asked (key, prompt, ...) with reply and error, through the cache at path.

    Keys with a reply, and those that failed most_tries times, are not asked;
    all others are asked once each, and what comes back is written before
    anything reads it, so a run that is repeated or resumed asks only for what
    is missing.  A null prompt has no reply and is never asked.
    """
    spark = asked.sparkSession
    known = read_replies(spark, path)
    new = asked.filter("prompt IS NOT NULL").groupBy("key").agg(F.min("prompt").alias("prompt")).join(known.filter((F.col("reply").isNotNull()) | (F.col("tries") >= most_tries)).select("key"), "key", "left_anti")
    told = asked_once(new.select("key", "prompt").repartition("key"), call)
    before = known.select("key", F.col("tries").alias("_before"))
    rows = told.join(before, "key", "left").select("key", F.lit(version).alias("version"), "reply", "error", (F.coalesce("_before", F.lit(0)) + 1).alias("tries"))
    write_replies(rows, path)
    return asked.join(read_replies(spark, path).select("key", "reply", "error"), "key", "left")


def joined_reply(told: str | None, more: str | None, least: int = 8) -> str | None:
    """A reply and its continuation, without the tail that the continuation repeats (of `least` characters or more)."""
    if told is None or more is None:
        return told
    for n in range(min(len(told), len(more)), least - 1, -1):
        if told.endswith(more[:n]):
            return told + more[n:]
    return told + more


def is_whole(reply: str | None) -> bool:
    try:
        return reply is not None and json.loads(reply) is not None
    except ValueError:
        return False


def _whole(batch: pd.Series) -> pd.Series:
    return batch.map(is_whole).astype(bool)


def _joined(told: pd.Series, more: pd.Series) -> pd.Series:
    return pd.Series([joined_reply(a, b) for a, b in zip(told, more, strict=True)], dtype=object)


def resumed(asked: DataFrame, path: str, version: int, call: Callable[[str], str] = mock_reply, rounds: int = 3, note: str = CONTINUE) -> DataFrame:
    """asked (key, prompt) -> key, reply, rounds, whole: replies in JSON, each continued until it is whole or was asked for `rounds` times more.

    Only replies that are still cut off are asked for again, with their prompt
    and what there is of them; a continuation may repeat their tail.  All
    replies go through the cache at path, so a run that is taken up again asks
    only for what it had not got.  A failed or empty continuation ends a reply.
    """
    whole, joined = F.pandas_udf(_whole, "boolean"), F.pandas_udf(_joined, "string")
    first = ask(asked.select("key", "prompt").dropDuplicates(["key"]), path, version, call)
    now = staged(first.select("key", "prompt", F.col("reply"), F.lit(0).alias("rounds"), whole("reply").alias("whole")), "resumed")
    for k in range(1, rounds + 1):
        open_ = now.filter("NOT whole AND reply IS NOT NULL AND rounds = " + str(k - 1))
        if not open_.count():
            break
        more = open_.select(F.col("key").alias("_key"), reply_key(F.col("key"), F.lit(k)).alias("key"), F.concat("prompt", F.lit("\n"), "reply", F.lit(note)).alias("prompt"))
        got = ask(more, path, version, call).filter(F.coalesce("reply", F.lit("")) != "").select(F.col("_key").alias("key"), F.col("reply").alias("_more"))
        both = now.join(got, "key", "left")
        text = F.when(F.col("_more").isNotNull(), joined("reply", "_more")).otherwise(F.col("reply"))
        now = staged(both.select("key", "prompt", text.alias("reply"), F.when(F.col("_more").isNotNull(), k).otherwise(F.col("rounds")).alias("rounds")).withColumn("whole", whole("reply")), "resumed")
    return now.select("key", "reply", "rounds", "whole")
