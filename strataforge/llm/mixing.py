"""Mixing sources to target weights, in DataFrame operations alone.

Each document gets a hash-random key. Rows are range-sorted by source and key, distributed prefix sums give each
document its interval of the source's word stream, and the stream is cut at the source's exact budget, whole epochs
repeated first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, running_sums, sorted_chunks, stage, word_count


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """sources (_src, source_size) -> the same with target.

    Weights are dealt by the order of _src. All sizes together are shared by weight; a source stops at max_epochs times
    its size and what is left over is shared anew by weight, until no target is above its limit.
    """
    ranked = running_sums(sorted_chunks(sources.withColumns({"_all": F.lit(0), "_one": F.lit(1)}), ["_src"], "mix-sources"), "_all", "_one", "_rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("_src", "source_size", weight.alias("_w"), (F.col("source_size") * max_epochs).alias("_cap")), "mix-weights")
    wide = lambda c: c.cast("decimal(38,0)")
    rest, weight_sum = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    total, all_weights = rest, weight_sum
    while total and weight_sum:
        capped = wide(F.col("_cap")) * weight_sum < wide(F.col("_w")) * rest
        caps, w = ranked.where(capped).agg(F.coalesce(F.sum("_cap"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
        if (total - caps, all_weights - w) == (rest, weight_sum):
            break
        rest, weight_sum = total - caps, all_weights - w
    if not total:
        return ranked.withColumn("target", F.lit(0.0))
    capped = wide(F.col("_cap")) * weight_sum < wide(F.col("_w")) * rest
    share = (F.col("_w") * F.lit(rest)).cast("double") / F.lit(float(weight_sum)) if weight_sum else F.col("_cap").cast("double")
    return ranked.withColumn("target", F.when(capped, F.col("_cap").cast("double")).otherwise(share))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target (of its source), taken (words the mix takes, repeats counted).

    Null and empty texts have size 0 and nothing is taken of them. A null source is a source of its own, after all
    others. Rows that share an id share a key and are ordered by size; equal rows are counted each. Reruns agree: the
    key is a digest of seed and id. An empty table gives an empty table. Other columns of docs are ignored.
    """
    source = docs[source_col].cast("string")
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("_src"),
        word_count(docs[text_col]).alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), docs[id_col].cast("string")).cast("binary")).alias("_key"),
    )
    # Range partitioning looks at its input twice; texts are read once.
    chunks = sorted_chunks(stage(rows, "mix-sizes"), ["_src", "_key", "size"], "mix-rows")
    sources = source_targets(chunks.groupBy("_src").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5)
    sources = sources.withColumns({"_epochs": F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0))})
    sources = sources.withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
    placed = running_sums(chunks, "_src", "size", "_at").join(sources.select("_src", "source_size", "target", "_epochs", "_rest"), "_src")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_at")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of docs: each document as often as its words are taken, the last copy cut after its last taken word.

    Rows of docs are told apart by doc_id; rows that share one are each mixed as their own size asks.
    """
    taken = mix(docs, **options).groupBy("doc_id", "size").agg(F.max("taken").alias("_taken"))
    key = docs.withColumn("_size", word_count(docs["text"]))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("size").alias("_n"), "_taken")
    both = key.join(taken, key["doc_id"].eqNullSafe(taken["_id"]) & (key["_size"] == taken["_n"])).where(F.col("_taken") > 0)
    copies = F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(_taken - 1) div _n")), lambda i: F.least(F.col("_n"), F.col("_taken") - i * F.col("_n")))
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.when(F.col("_part") == F.col("_n"), F.col("text")).otherwise(F.array_join(F.slice(pieces, 1, F.col("_part").cast("int")), ""))
    out = both.withColumn("_part", F.explode(copies)).withColumn("text", cut)
    return out.select(*docs.columns)
