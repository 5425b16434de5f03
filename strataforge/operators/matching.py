"""Matching by text order: the first of many prefixes, and stages that only go forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.operators import idioms as I


def first_prefix(names: DataFrame, name: str, prefixes: DataFrame) -> DataFrame:
    """names with ord and prefix of the first of prefixes (prefix, ord) that each name begins with; null where none does.

    Each prefix is an interval of sorted names. Names and prefixes are sorted together; the last prefix before a name
    begins with every prefix of that name, so it carries the prefixes that it begins with itself, and the name keeps
    those that it begins with. No name meets a prefix that is not on that short list. Case counts: fold it before. A
    null name or prefix matches nothing; the empty prefix matches every name; of equal prefixes the first in order holds.
    """
    known = prefixes.where("prefix is not null").groupBy("prefix").agg(F.min("ord").alias("ord"))
    known = I.written(known, "prefixes")
    starts = known.select(F.col("prefix").alias("_long"), F.explode(F.sequence(F.lit(0), F.char_length("prefix"))).alias("_k"))
    starts = starts.select("_long", F.substring("_long", F.lit(1), F.col("_k")).alias("prefix"))
    nested = starts.join(known, "prefix").groupBy("_long").agg(F.array_sort(F.collect_list(F.struct("ord", "prefix"))).alias("_held"))
    rows = names.withColumns({"_text": F.col(name), "_kind": F.lit(1), "_held": F.lit(None).cast(nested.schema["_held"].dataType)})
    marks = nested.select(*[F.lit(None).cast(kind).alias(c) for c, kind in names.dtypes], F.col("_long").alias("_text"), F.lit(0).alias("_kind"), "_held")
    both = marks.unionByName(rows).withColumn("_n", F.monotonically_increasing_id())
    filled = I.forward_fill(I.written(both, "names"), F.col("_held"), [], ["_text", "_kind", "_n"], "_last").where("_kind = 1")
    fits = F.filter("_last", lambda p: F.startswith(F.col(name), p["prefix"]))
    return filled.withColumn("_first", F.get(fits, F.lit(0))).select(*names.columns, F.col("_first.ord").alias("ord"), F.col("_first.prefix").alias("prefix"))


def first_marker(text: Column, markers: list[tuple[str, int]]) -> Column:
    """The value of the first of markers (text, value), in their order, that the text holds; null if none."""
    out = F.lit(None).cast("int")
    for marker, value in reversed(markers):
        out = F.when(F.contains(text, F.lit(marker)), value).otherwise(out)
    return out


def running_max(df: DataFrame, value: Column, keys: list[str], order: list[str], out: str) -> DataFrame:
    """The greatest value up to and with each row. No key meets in one task."""
    rows = I.carried(I.chunked(df.withColumn("_value", value), keys, order), keys, F.max("_value"), F.max, "_before")
    here = F.max("_value").over(I.inside_chunk(keys).rowsBetween(I.Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.greatest(here, "_before")).drop("_value", "_before", "_chunk", "_at")


def stages(lines: DataFrame, text: str, keys: list[str], order: list[str], markers: list[tuple[str, int, str]]) -> DataFrame:
    """lines with progress and stage after each line: the first marker (text, value, stage) that a line holds counts, and only forward.

    Values are above 0 and different from each other. Before any marker progress is 0 and stage null; null lines hold none.
    """
    values = [v for _, v, _ in markers]
    if len(set(values)) < len(values) or min(values, default=1) < 1:
        raise ValueError("markers need different values above 0")
    rows = running_max(lines, first_marker(F.col(text), [(m, v) for m, v, _ in markers]), keys, order, "progress")
    stage = F.lit(None).cast("string")
    for _, value, name in markers:
        stage = F.when(F.col("progress") == value, name).otherwise(stage)
    return rows.withColumn("stage", stage).withColumn("progress", F.coalesce("progress", F.lit(0)))
