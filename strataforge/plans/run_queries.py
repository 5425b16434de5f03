"""Queries over the star-schema tables for runs, prefixes, stages and archives read by range, each with its SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import tiles
from strataforge.operators import matching, spans
from strataforge.operators.idioms import shared_folder
from strataforge.plans.archive_queries import _le_hex, content_of
from strataforge.plans.binary_queries import le, t, together, zeros
from strataforge.sources import onefile
from strataforge.sources.archive import ranged
from strataforge.sources.files import located, opened, write_tree

MARKERS = [("oroued", 60, "third"), ("hable", 40, "second"), ("ithe", 20, "first"), ("ntat", 90, "last")]


def painted_runs(spark, sf_dir):
    """Pixels that each line of an order leaves to be seen: runs of one row of a grid laid over each other in order."""
    rows = t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("y"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 7 % 3000).alias("x"), (F.col("l_orderkey") % 97 + 1).alias("n"))
    seen = spans.painted(rows, ["y"], ["l_orderkey", "l_linenumber", "l_partkey"], ["l_orderkey", "l_linenumber"], start="x")
    return seen.groupBy("y", "l_orderkey", "l_linenumber").agg(F.sum("n").alias("pixels"))


def tile_paint(spark, sf_dir):
    """Pixels of each value in a version-3 tile of three rows, where each line of an order is a run and later runs cover earlier ones."""
    run = lambda x: F.struct((x["l_partkey"] % 30).alias("x"), (x["l_suppkey"] % 25 + 1).alias("n"), (x["l_partkey"] % 250 + 1).alias("value"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    body = []
    for y in range(3):
        mine = F.transform(F.filter("lines", lambda x: x["l_linenumber"] % 3 == y), run)  # noqa: B023
        piece = lambda r, i: F.concat(le(r["x"] + r["n"], 2), le(r["n"] + F.when(i + 1 == F.size(f"row{y}"), 0x8000).otherwise(0), 2), F.unhex(F.repeat(F.lpad(F.hex(r["value"]), 2, "0"), r["n"].cast("int"))))  # noqa: B023, E731
        rows = rows.withColumn(f"row{y}", mine)
        rows = rows.withColumn(f"row{y}", F.when(F.size(f"row{y}") == 0, F.concat(le(F.lit(0), 2), le(F.lit(0x8000), 2))).otherwise(together(F.transform(f"row{y}", piece))))
        body.append(f"row{y}")
    places = [le(F.lit(12), 4), le(12 + F.octet_length("row0"), 4), le(12 + F.octet_length("row0") + F.octet_length("row1"), 4)]
    blobs = rows.select("l_orderkey", F.concat(le(F.lit(3), 2), le(F.lit(3), 2), le(F.lit(60), 2), zeros(20), *places, *body).alias("tile"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            of, found = tiles.spans_of(part["tile"].tolist(), [True] * len(part))
            yield pd.DataFrame({"l_orderkey": part["l_orderkey"].to_numpy()[of]} | {c: found[c] for c in ("ord", "y", "x", "n", "value")})

    found = blobs.mapInPandas(work, "l_orderkey long, ord long, y long, x long, n long, value long")
    seen = spans.painted(found, ["l_orderkey", "y"], ["ord"], ["value"], start="x")
    return seen.groupBy("l_orderkey", "value").agg(F.sum("n").alias("pixels"))


def tied_runs(spark, sf_dir):
    """Runs of open cells in a grid 60 wide, made from all orders, that steps between cells tie to the first column."""
    cells = t(spark, sf_dir, "orders").where("o_custkey % 8 < 5").select((F.col("o_orderkey") % 60).alias("x"), F.expr("o_orderkey div 60").alias("y")).distinct()
    runs = cells.groupBy("y").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # 60 at most
    first = F.filter("xs", lambda x: ~F.array_contains("xs", x - 1))
    last = F.filter("xs", lambda x: ~F.array_contains("xs", x + 1))
    rows = runs.select("y", F.explode(F.arrays_zip(first.alias("a"), last.alias("b"))).alias("r")).select("y", F.col("r.a").alias("x"), (F.col("r.b") - F.col("r.a") + 1).alias("n"))
    return spans.tied_runs(rows, [], F.col("x") == 0)


def prefix_join(spark, sf_dir):
    """The first of many prefixes, nested ones among them, that a part's name begins with."""
    part = t(spark, sf_dir, "part")
    prefixes = part.where("p_partkey % 9 = 0").select(F.expr("substr(p_name || p_type, 1, 1 + p_partkey % 12)").alias("prefix"), F.expr("p_partkey * 37 % 1009").alias("ord"))
    names = part.select("p_partkey", F.expr("p_name || p_type").alias("name"))
    return matching.first_prefix(names, "name", prefixes)


def stage_progress(spark, sf_dir):
    """Each conversation as a log: after each turn the stage that its markers have brought it to."""
    lines = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("line"))
    return matching.stages(lines, "line", ["conv_id"], ["turn"], MARKERS).select("conv_id", "turn", F.col("progress").cast("long").alias("progress"), "stage")


def range_archives(spark: SparkSession, sf_dir: str) -> str:
    """A folder with an archive for each 4,096 order numbers."""
    lines = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    rows = t(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 4096").alias("k")).agg(lines.alias("lines"))
    root = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_tree(rows.select(F.concat(F.col("k").cast("string"), F.lit(".bin")).alias("name"), content_of().alias("body")), root)
    return root


def archive_ranges(spark, sf_dir):
    """Entries of one kind, read by range from archives on disk, each an archive of 4,096 order numbers."""
    root = range_archives(spark, sf_dir)
    system, place = located(root)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(place))]
    rows = ranged(spark, [f"{root}/{n}" for n in names], most_bytes=1 << 20).where("ext = 'TILE'")
    return rows.select(F.regexp_extract("source", r"(\d+)\.bin$", 1).cast("long").alias("k"), "entry_ord", "display_name", "data_offset", "data_size", F.hex("data").alias("data"))


def zip_members(spark, sf_dir):
    """Members of one archive of all documents, stored as they are: each one's place, and its digest as read back from there."""
    docs = t(spark, sf_dir, "documents")
    files = docs.select(F.format_string("doc-%d.txt", F.col("doc_id")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}.zip"
    placed = onefile.write_zip(files, path, deflate=False)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(path) as file:
            for part in parts:
                digests = []
                for name, packed, at in zip(part["name"], part["packed"], part["at"], strict=True):
                    file.seek(at + 30 + len(name.encode()))
                    digests.append(hashlib.md5(file.read(packed)).hexdigest())
                yield part.assign(md5=digests)

    return placed.select("name", "size", "packed", "at").mapInPandas(work, "name string, size long, packed long, at long, md5 string")


_ALL = (zip_members, painted_runs, tile_paint, tied_runs, prefix_join, stage_progress, archive_ranges)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    lines = "(SELECT *, l_orderkey // 4096 AS k, row_number() OVER (PARTITION BY l_orderkey // 4096 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey // 4096) AS n FROM lineitem)"
    stage = "CASE progress " + " ".join(f"WHEN {v} THEN '{s}'" for _, v, s in MARKERS) + " END"
    marker = "CASE " + " ".join(f"WHEN contains(lower(text), '{m}') THEN {v}" for m, v, _ in MARKERS) + " END"
    return {
        "zip_members": """WITH d AS (SELECT 'doc-' || doc_id || '.txt' AS name, coalesce(text, '') AS text FROM documents), s AS (SELECT *, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM d)
            SELECT name, size, size AS packed, CAST(coalesce(sum(30 + length(name) + size) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at, md5(text) AS md5 FROM s""",
        "painted_runs": """WITH r AS (SELECT l_suppkey % 40 AS y, l_orderkey, l_linenumber, l_partkey, l_partkey * 7 % 3000 AS x, l_orderkey % 97 + 1 AS n FROM lineitem),
            p AS (SELECT y, unnest(range(x, x + n)) AS px, (l_orderkey, l_linenumber, l_partkey) AS o, l_orderkey, l_linenumber FROM r),
            s AS (SELECT y, px, arg_max(l_orderkey, o) AS l_orderkey, arg_max(l_linenumber, o) AS l_linenumber FROM p GROUP BY 1, 2)
            SELECT y, l_orderkey, l_linenumber, count(*) AS pixels FROM s GROUP BY 1, 2, 3""",
        "tile_paint": """WITH r AS (SELECT l_orderkey, l_linenumber % 3 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o, l_partkey % 30 AS x, l_suppkey % 25 + 1 AS n, l_partkey % 250 + 1 AS value FROM lineitem),
            p AS (SELECT l_orderkey, y, o, value, unnest(range(x, x + n)) AS px FROM r),
            s AS (SELECT l_orderkey, y, px, arg_max(value, o) AS value FROM p GROUP BY 1, 2, 3)
            SELECT l_orderkey, value, count(*) AS pixels FROM s GROUP BY 1, 2""",
        "tied_runs": """WITH RECURSIVE c AS (SELECT DISTINCT o_orderkey % 60 AS x, o_orderkey // 60 AS y FROM orders WHERE o_custkey % 8 < 5),
            r AS (SELECT x, y FROM c WHERE x = 0
                UNION SELECT c.x, c.y FROM (SELECT x + a AS x, y + b AS y FROM r, (VALUES (-1), (0), (1)) AS s(a), (VALUES (-1), (0), (1)) AS q(b)) AS m JOIN c ON c.x = m.x AND c.y = m.y),
            g AS (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM r)
            SELECT y, min(x) AS x, count(*) AS n FROM g GROUP BY y, g""",
        "prefix_join": """WITH p AS (SELECT substr(p_name || p_type, 1, 1 + p_partkey % 12) AS prefix, p_partkey * 37 % 1009 AS ord FROM part WHERE p_partkey % 9 = 0),
            u AS (SELECT prefix, min(ord) AS ord FROM p GROUP BY 1), n AS (SELECT p_partkey, p_name || p_type AS name FROM part),
            m AS (SELECT n.p_partkey, min((u.ord, u.prefix)) AS f FROM n JOIN u ON starts_with(n.name, u.prefix) GROUP BY 1)
            SELECT n.p_partkey, n.name, m.f[1] AS ord, m.f[2] AS prefix FROM n LEFT JOIN m ON m.p_partkey = n.p_partkey""",
        "stage_progress": f"""WITH m AS (SELECT conv_id, turn, CAST(coalesce(max({marker}) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS BIGINT) AS progress FROM conversations)
            SELECT conv_id, turn, progress, {stage} AS stage FROM m""",
        "archive_ranges": f"""SELECT k, CAST(i AS INTEGER) AS entry_ord, 'T' || l_linenumber AS display_name, 52 + 60 * n + 6 * i AS data_offset, CAST(6 AS BIGINT) AS data_size,
            {_le_hex('CAST(l_suppkey AS BIGINT)', 4)} || {_le_hex('CAST(l_linenumber AS BIGINT)', 2)} AS data FROM {lines}""",
    }
