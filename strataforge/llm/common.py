"""What the operators share: the staging folder, numbering and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="strataforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows that a Python worker is handed at once; texts may be long.
ROWS_AT_ONCE = 2000


def small_batches(df: DataFrame) -> None:
    """From now on the session hands Python workers ROWS_AT_ONCE rows at most, so that long texts stay within their memory.

    Plans read this setting when they run, and what an operator returns runs later: so it stays set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if not 0 < now <= ROWS_AT_ONCE:
        df.sparkSession.conf.set(key, str(ROWS_AT_ONCE))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    small_batches(df)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Deletes what stage() wrote for frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids fall to 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def sorted_chunks(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df range-sorted by keys and staged, with its chunk's number and the row's position in the chunk."""
    out = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return stage(out.withColumns({"_chunk": F.spark_partition_id(), "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)


def running_sums(chunks: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Adds to each row of sorted_chunks(…) the sum of value over the rows before it in its group.

    Sums by (group, chunk) come first; their running sums, one row for a chunk and group, give each chunk's start.
    """
    totals = chunks.groupBy(group, "_chunk").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunks.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [group, "_chunk"])
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_start", "_inside", "_chunk", "_pos")
    )


def clear_of(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of spans (kind, start, end) that touch none of taken; taken are merged once and searched."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in taken if b > a):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [s for s in spans if (i := bisect_left(starts, s[2])) == 0 or ends[i - 1] <= s[1]]


def slices(part: pd.DataFrame, size: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Rows in runs of about size characters of _text, so that memory follows text, not rows."""
    ends = np.cumsum([len(t) if t else 1 for t in part["_text"]])
    group = ends // size
    for g in np.unique(group):
        yield part.iloc[group == g]


def whole_groups(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches, cut only between groups: the last group waits for the next batch."""
    kept: list[pd.DataFrame] = []
    last = None
    for part in parts:
        if len(part):
            key = part[keys].to_numpy()
            cut = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
            if kept and (cut or (key[-1] != last).any()) or cut:
                yield pd.concat([*kept, part.iloc[:cut]], ignore_index=True)
                kept = []
            kept.append(part.iloc[cut:])
            last = key[-1]
    if kept:
        yield pd.concat(kept, ignore_index=True)


def by_group(work, keys: list[str]):
    """Calls work for each group of sorted rows; small results travel together."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(parts, keys):
            key = part[keys].to_numpy()
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            made = [work(part.iloc[a:b]) for a, b in zip(starts, np.append(starts[1:], len(key)), strict=True)]
            yield pd.concat(made, ignore_index=True)

    return run
