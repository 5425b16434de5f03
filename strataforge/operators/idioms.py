"""Reusable operators over ordered rows: merge, dedup, fill, rank, sample, run-encode, reconcile."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. One aggregate with partial results; no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_row")).select(*keys, *[f"_row.{c}" for c in rest])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: later sources overwrite earlier ones."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_row")).select(*keys, *[f"_row.{c}" for c in rest])


def chunked(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df sorted by keys and order and cut into chunks, written: each row with its chunk and its place there.

    Order is part of the range key, so a key with a third of all rows lies in as many chunks as its rows need.
    """
    ends = [*keys, *order]
    rows = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ends).sortWithinPartitions(*ends) if ends else df
    return written(rows.withColumns({"_chunk": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "chunks")


def inside_chunk(keys: list[str]) -> Window:
    return Window.partitionBy("_chunk", *keys).orderBy("_at")


def carried(chunks: DataFrame, keys: list[str], of: Column, over, out: str, back: bool = False) -> DataFrame:
    """Adds what a key's other chunks hold for a row: over(of each chunk) of the chunks before its own (back: after it).

    Chunks are sorted, so only a chunk's first key (back: its last) lies in another one as well: the rows that carry a
    value are at most as many as the chunks, and are broadcast.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("_chunk") if back else F.asc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = chunks.groupBy(*keys, "_chunk").agg(of.alias("_of"))
    known = sums.withColumn("_carry", over(F.col("_of")).over(w)).where("_carry is not null")
    known = F.broadcast(known.select(F.col("_chunk").alias("_c"), F.col("_carry").alias(out), *[F.col(k).alias(f"_c_{k}") for k in keys]))
    same = chunks["_chunk"] == known["_c"]
    for k in keys:
        same &= chunks[k].eqNullSafe(known[f"_c_{k}"])
    return chunks.join(known, same, "left").drop("_c", *[f"_c_{k}" for k in keys])


def filled(chunks: DataFrame, value: Column, keys: list[str], out: str) -> DataFrame:
    """chunked() rows with the latest non-null value up to and with each row."""
    rows = carried(chunks.withColumn("_value", value), keys, F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))), lambda c: F.last(c, ignorenulls=True), "_before")
    here = F.last("_value", ignorenulls=True).over(inside_chunk(keys).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.coalesce(here, "_before")).drop("_value", "_before")


def numbered(chunks: DataFrame, keys: list[str], out: str) -> DataFrame:
    """chunked() rows with their position in their key, from 0."""
    rows = carried(chunks, keys, F.count("*"), F.sum, "_before")
    return rows.withColumn(out, F.row_number().over(inside_chunk(keys)) - 1 + F.coalesce("_before", F.lit(0))).drop("_before")


def forward_fill(df: DataFrame, value: Column, keys: list[str], order: list[str], out: str) -> DataFrame:
    """The latest non-null value up to and with each row. No key meets in one task."""
    return filled(chunked(df, keys, order), value, keys, out).drop("_chunk", "_at")


def next_value(df: DataFrame, value: str, keys: list[str], order: list[str], end: Column, out: str) -> DataFrame:
    """The next row's value, or end for the last and where the next is null. No key meets in one task."""
    first = F.min_by(F.struct(value), "_at")
    rows = carried(chunked(df, keys, order), keys, first, F.last, "_after", back=True)
    here = F.lead(F.struct(value)).over(inside_chunk(keys))
    return rows.withColumn(out, F.coalesce(F.coalesce(here, "_after").getField(value), end)).drop("_after", "_chunk", "_at")


def capped(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """At most `most` rows of each key. Spark limits groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def priority_topk(df: DataFrame, priority: Column, keys: list[str], order: list, most: int) -> DataFrame:
    """Of the best priority that a key has, its first `most` rows; rows without a priority never count."""
    ranked = df.withColumn("_p", priority).where("_p is not null")
    best = ranked.groupBy(*keys).agg(F.min("_p").alias("_best"))
    return capped(ranked.join(best, keys).where("_p = _best").drop("_best"), keys, order, most).withColumnRenamed("_p", "priority")


def stop_after(df: DataFrame, order: str, productive: Column, n: int) -> DataFrame:
    """Rows up to the n-th productive one in order. The bound comes from a top-n, not from a global window."""
    if n < 1:
        raise ValueError("stop_after needs n of 1 or more")
    last = df.where(productive).select(order).orderBy(order).limit(n).agg(F.max(order).alias("_last"), F.count("*").alias("_found"))
    return df.join(F.broadcast(last), (F.col("_found") < n) | (df[order] <= F.col("_last"))).drop("_last", "_found")


def positions(df: DataFrame, keys: list[str], order: list, out: str = "pos") -> DataFrame:
    """Each row's position in its key, from 0. No key meets in one task."""
    return numbered(chunked(df, keys, order), keys, out).drop("_chunk", "_at")


def run_encode(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values (null equals null): keys, run start (position), value, n. No key meets in one task."""
    at = numbered(chunked(df.select(*dict.fromkeys([*keys, *order, value])), keys, order), keys, "pos")
    last = F.max_by(F.struct(value), "_at")
    rows = carried(at, keys, last, F.last, "_before")
    previous = F.coalesce(F.lag(F.struct(value)).over(inside_chunk(keys)), "_before")
    starts = rows.withColumn("_start", F.when(previous.isNull() | ~previous.getField(value).eqNullSafe(F.col(value)), F.col("pos"))).drop("_before")
    runs = filled(starts, F.col("_start"), keys, "start")
    return runs.groupBy(*keys, value, "start").agg(F.count("*").alias("n"))


def run_expand(runs: DataFrame, start: str = "start", n: str = "n", out: str = "pos") -> DataFrame:
    """One row for each position of each run."""
    return runs.where(F.col(n) > 0).withColumn(out, F.explode(F.sequence(F.col(start).cast("long"), F.col(start) + F.col(n) - 1)))


def grid(df: DataFrame, keys: list[str], order: list, columns: int) -> DataFrame:
    """Column and row of each key's k-th row in a grid."""
    return positions(df, keys, order, "_k").withColumn("col", (F.col("_k") % columns).cast("int")).withColumn("row", F.floor(F.col("_k") / columns).cast("int")).drop("_k")


def reconcile(expected: DataFrame, actual: DataFrame, key: str, want: str, got: str) -> DataFrame:
    """Every key of either side with its status: ok, missing, unexpected or mismatch."""
    both = expected.join(actual, key, "full_outer")
    status = F.when(F.col(got).isNull(), "missing").when(F.col(want).isNull(), "unexpected").when(F.col(want) != F.col(got), "mismatch").otherwise("ok")
    return both.withColumn("status", status)


def tasks(spark: SparkSession) -> int:
    """How many tasks work that is long for its bytes is dealt to: Spark itself would join small partitions into one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where Spark runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="strataforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written to the folder that the cluster shares, in folders by some columns if asked, and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
