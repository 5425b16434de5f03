"""Queries over the star-schema tables: one for each relational operator, with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.functions import scalars as S
from strataforge.operators import idioms as I
from strataforge.operators import spans
from strataforge.plans import archive_queries, binary_queries, raster_queries, run_queries, world_queries

BRANDS = {"Brand#11": "heroes/melee", "Brand#22": "heroes/ranged", "Brand#33": "buildings/main", "Brand#44": "icons/misc"}
NAMED_SIZES = {1: "Stand", 2: "Walk", 3: "Attack", 5: "Die"}
TERMS = ["idiot", "pathetic", "password", "license"]
FAMILIES = ["purchase", "signup", "click"]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(spark: SparkSession, rows: dict, key: str, value: str, kind: str) -> DataFrame:
    """A literal table: as long as its dictionary, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows.items()), f"{key} {kind}, {value} string"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size", "p_retailprice")
    rules = F.when(F.startswith("p_name", F.lit("s")), "sprites/small").when(F.startswith("p_name", F.lit("b")), "sprites/big")
    hit = part.join(lookup(spark, BRANDS, "p_brand", "_hit", "string"), "p_brand", "left")
    return hit.withColumn("category", F.coalesce("_hit", rules)).where("category is not null")


def catalog_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("p_partkey", "category")


def catalog_last_wins(spark, sf_dir):
    return I.last_wins(t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


def first_seen_dedup(spark, sf_dir):
    return I.first_seen(t(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


def palette_forward_fill(spark, sf_dir):
    events = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return I.forward_fill(events, F.when(F.col("event_type") == "signup", F.col("event_id")), ["user_id"], ["event_id"], "carried").select("event_id", "carried")


def next_offset(spark, sf_dir):
    return I.next_value(t(spark, sf_dir, "events").select("user_id", "event_id"), "event_id", ["user_id"], ["event_id"], F.lit(-1).cast("long"), "next_id")


def priority_topk(spark, sf_dir):
    priority = F.coalesce(*[F.when(F.col("event_type") == name, F.lit(i)) for i, name in enumerate(FAMILIES)])
    return I.priority_topk(t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), priority, ["user_id"], ["event_id"], 8).select("user_id", "event_id", "priority")


def ranked(parts: DataFrame, group: str) -> DataFrame:
    return I.capped(parts, [group], [F.desc("p_size"), F.desc("p_retailprice"), F.asc("p_partkey")], 8)


def preview_rank(spark, sf_dir):
    parts = t(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size", "p_retailprice")
    return ranked(parts, "p_type")


def stop_after_n(spark, sf_dir):
    counts = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return I.stop_after(orders, "o_orderkey", F.col("n") > 0, 5)


def cap_per_group(spark, sf_dir):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return I.capped(t(spark, sf_dir, "lineitem").select(*columns), ["l_orderkey"], columns[1:], 4)


def even_samples(spark, sf_dir):
    sizes = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    return sizes.select("user_id", F.explode(S.even_positions(F.col("n"), 12)).alias("pos"))


def slug(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", S.slug(F.col("url")).alias("slug"))


def path_build(spark, sf_dir):
    line = t(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", S.frame_path(F.col("l_returnflag"), F.col("l_linenumber"), (F.col("l_suppkey") % 1000), F.col("l_partkey")).alias("path"))


def bit_unpack(spark, sf_dir):
    e = F.col("event_id") * 37
    return t(spark, sf_dir, "events").select("event_id", S.bits(e, 0, 11).alias("count"), S.bits(e, 15, 1).alias("last"), S.bits(e, 11, 5).alias("flags"))


def base_id(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", S.base_id(F.col("event_id") * 4096).alias("base"))


def set_name_resolve(spark, sf_dir):
    part = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 8 + F.when(F.col("p_partkey") % 2 == 0, 65536).otherwise(0)).cast("long").alias("set_id"))
    exact, low = lookup(spark, NAMED_SIZES, "set_id", "exact", "long"), lookup(spark, NAMED_SIZES, "low_id", "low", "long")
    both = part.join(exact, "set_id", "left").withColumn("low_id", F.col("set_id").bitwiseAND(F.lit(65535))).join(low, "low_id", "left")
    return both.select("p_partkey", S.set_name(F.col("set_id"), F.col("exact"), F.col("low")).alias("set_name"))


def rgb565_scale(spark, sf_dir):
    r, g, b = S.rgb565(F.col("event_id") % 65536)
    return t(spark, sf_dir, "events").select("event_id", r.alias("r"), g.alias("g"), b.alias("b"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.run_encode(t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


def run_encode(spark, sf_dir):
    return runs(spark, sf_dir).select("user_id", "event_type", F.col("start").cast("long").alias("start"), "n")


def run_expand(spark, sf_dir):
    return I.run_expand(runs(spark, sf_dir)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("pos_sum"))


def reconcile_audit(spark, sf_dir):
    # A window's partial sums would tell too, but the two sides must not share a route.
    expected = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").cast("long").alias("want"))
    actual = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").distinct().groupBy("o_orderkey").agg(F.count("*").alias("got"))
    return I.reconcile(expected, actual, "o_orderkey", "want", "got").where("status <> 'ok'").orderBy("o_orderkey").limit(20)


def bounds_agg(spark, sf_dir):
    ends = [f(c).alias(f"{n}_{c}") for c in ("l_partkey", "l_suppkey") for n, f in (("min", F.min), ("max", F.max))]
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*ends)


def weighted_box(spark, sf_dir):
    sums = t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_partkey") * F.col("l_linenumber")).alias("a"), F.sum("l_linenumber").alias("w"))
    return sums.select("l_returnflag", F.expr("a div w").alias("box"))


def dir_dense_rank(spark, sf_dir):
    from pyspark.sql import Window

    pairs = t(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return pairs.withColumn("sheet_row", F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")))


def grid_layout(spark, sf_dir):
    return I.grid(t(spark, sf_dir, "part").select("p_type", "p_partkey"), ["p_type"], ["p_partkey"], 4)


def label_concat(spark, sf_dir):
    direction = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string"))
    frame = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_partkey").cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", S.cell_label(F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_name")), direction, frame).alias("label"))


def size_estimate(spark, sf_dir):
    factor = F.when(F.col("lang") == "en", 2.75).when(F.col("lang") == "de", 0.55).otherwise(0.45)
    return t(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("_n")).select("lang", (F.col("_n") * factor).cast("long").alias("estimate"))


def semi_sources(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def anti_fallback(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def union_manifest(spark, sf_dir):
    part = t(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    supplier = t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    customer = t(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("name"))
    return part.unionByName(supplier).unionByName(customer)


def contains_any(spark, sf_dir):
    return t(spark, sf_dir, "documents").where(S.contains_any(F.col("text"), TERMS)).select("doc_id")


def prefix_first_match(spark, sf_dir):
    first = t(spark, sf_dir, "supplier").where(F.startswith(F.upper("s_name"), F.upper(F.lit("supplier#00")))).agg(F.min(F.struct("s_suppkey", "s_name")).alias("x"))
    return first.select("x.s_suppkey", "x.s_name")


def flood_fill(spark, sf_dir):
    """Cells of a 50-wide grid, from all orders, that a path of open cells ties to the border."""
    cells = t(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0 or o_custkey % 5 < 2").select((F.col("o_orderkey") % 50).alias("x"), F.floor(F.col("o_orderkey") / 50).alias("y")).distinct()
    last = cells.agg(F.max("y").alias("last"))
    seeds = cells.crossJoin(F.broadcast(last)).where("x = 0 or x = 49 or y = 0 or y = last").select("x", "y")
    return spans.reach(cells, seeds, [])


def pixel_count_if(spark, sf_dir):
    line = t(spark, sf_dir, "lineitem")
    index, r, g, b = F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256, (F.col("l_suppkey") + F.col("l_linenumber")) % 256
    return line.groupBy("l_returnflag").agg(F.count_if(~S.is_key_colour(index, r, g, b)).alias("opaque"))


def images_per_category(spark, sf_dir):
    """The flagship's whole result: classified parts, their lines, and the eight best of each category."""
    parts = classified(spark, sf_dir).select("p_partkey", "category", "p_size", "p_retailprice")
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return ranked(parts.join(lines, "p_partkey"), "category").select("category", "p_partkey", "lines", "quantity")


def format_size(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", S.format_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


FLAGSHIP = images_per_category


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FLAGSHIP(spark, sf_dir)


_ALL = (
    catalog_classify, catalog_last_wins, first_seen_dedup, palette_forward_fill, next_offset, priority_topk, preview_rank, stop_after_n, cap_per_group, even_samples, slug, path_build,
    bit_unpack, base_id, set_name_resolve, rgb565_scale, run_encode, run_expand, reconcile_audit, bounds_agg, weighted_box, dir_dense_rank, grid_layout, label_concat, size_estimate,
    semi_sources, anti_fallback, union_manifest, contains_any, prefix_first_match, flood_fill, pixel_count_if, images_per_category, format_size,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL} | binary_queries.queries() | archive_queries.queries() | run_queries.queries() | raster_queries.queries() | world_queries.queries()


_CATEGORY = "coalesce(CASE p_brand " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BRANDS.items()) + " END, CASE WHEN p_name LIKE 's%' THEN 'sprites/small' WHEN p_name LIKE 'b%' THEN 'sprites/big' END)"
_NAME = lambda c: f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMED_SIZES.items()) + " END"
_RUNS = """r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS k FROM events),
runs AS (SELECT user_id, event_type, CAST(min(pos) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY user_id, event_type, pos - k)"""


def oracle_sql() -> dict[str, str]:
    return binary_queries.oracle_sql() | archive_queries.oracle_sql() | run_queries.oracle_sql() | raster_queries.oracle_sql() | world_queries.oracle_sql() | {
        "catalog_classify": f"SELECT * FROM (SELECT p_partkey, {_CATEGORY} AS category FROM part) WHERE category IS NOT NULL",
        "catalog_last_wins": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
        "first_seen_dedup": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
        "palette_forward_fill": "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events",
        "next_offset": "SELECT user_id, event_id, lead(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY event_id) AS next_id FROM events",
        "priority_topk": """WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 END AS priority FROM events)
            SELECT user_id, event_id, priority FROM (SELECT *, min(priority) OVER (PARTITION BY user_id) AS best FROM p) WHERE priority = best QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8""",
        "preview_rank": "SELECT p_type, p_partkey, p_size, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_retailprice DESC, p_partkey) <= 8",
        "stop_after_n": """WITH o AS (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)
            SELECT o_orderkey, n FROM (SELECT *, coalesce(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o) WHERE before < 5""",
        "cap_per_group": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) <= 4",
        "even_samples": """WITH s AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n, CAST(least(count(*), 12) AS INTEGER) AS k FROM events GROUP BY user_id)
            SELECT DISTINCT user_id, CAST(CASE WHEN k = 1 THEN 0 ELSE round_even(i * (n - 1) / (k - 1), 0) END AS INTEGER) AS pos FROM (SELECT *, unnest(range(k)) AS i FROM s)""",
        "slug": r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace(trim(url), chr(0), ''), '[^A-Za-z0-9._ -]+', '_', 'g'), '\s+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'unnamed') AS slug FROM pages""",
        "path_build": "SELECT l_orderkey, l_linenumber, l_partkey, printf('%s_dir%d_frame%03d_tile%05d.png', l_returnflag, l_linenumber, l_suppkey % 1000, l_partkey) AS path FROM lineitem",
        "bit_unpack": "SELECT event_id, (event_id * 37) & 2047 AS count, ((event_id * 37) >> 15) & 1 AS last, ((event_id * 37) >> 11) & 31 AS flags FROM events",
        "base_id": "SELECT event_id, CASE WHEN (event_id * 4096) & 65535 = 0 THEN event_id * 4096 ELSE (event_id * 4096) & 65535 END AS base FROM events",
        "set_name_resolve": f"""SELECT p_partkey, coalesce({_NAME('set_id')}, {_NAME('(set_id & 65535)')} || '-' || CAST(set_id >> 16 AS VARCHAR), 'set-' || CAST(set_id AS VARCHAR)) AS set_name
            FROM (SELECT p_partkey, CAST(p_size % 8 + CASE WHEN p_partkey % 2 = 0 THEN 65536 ELSE 0 END AS BIGINT) AS set_id FROM part)""",
        "rgb565_scale": "SELECT event_id, CAST(((v >> 11) & 31) * 255 // 31 AS INTEGER) AS r, CAST(((v >> 5) & 63) * 255 // 63 AS INTEGER) AS g, CAST((v & 31) * 255 // 31 AS INTEGER) AS b FROM (SELECT event_id, event_id % 65536 AS v FROM events)",
        "run_encode": f"WITH {_RUNS} SELECT user_id, event_type, start, n FROM runs",
        "run_expand": f"WITH {_RUNS} SELECT user_id, event_type, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM (SELECT user_id, event_type, unnest(range(start, start + n)) AS pos FROM runs) GROUP BY ALL",
        "reconcile_audit": """SELECT o_orderkey, want, got, 'mismatch' AS status FROM (SELECT l_orderkey AS o_orderkey, CAST(max(l_linenumber) AS BIGINT) AS want, count(DISTINCT l_linenumber) AS got FROM lineitem GROUP BY 1)
            WHERE want <> got ORDER BY o_orderkey LIMIT 20""",
        "bounds_agg": "SELECT l_returnflag, min(l_partkey) AS min_l_partkey, max(l_partkey) AS max_l_partkey, min(l_suppkey) AS min_l_suppkey, max(l_suppkey) AS max_l_suppkey FROM lineitem GROUP BY 1",
        "weighted_box": "SELECT l_returnflag, CAST(sum(l_partkey * l_linenumber) // sum(l_linenumber) AS BIGINT) AS box FROM lineitem GROUP BY 1",
        "dir_dense_rank": "SELECT user_id, event_type, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS INTEGER) AS sheet_row FROM (SELECT DISTINCT user_id, event_type FROM events)",
        "grid_layout": "SELECT p_type, p_partkey, CAST(k % 4 AS INTEGER) AS col, CAST(k // 4 AS INTEGER) AS row FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS k FROM part)",
        "label_concat": """SELECT p_partkey, substr(coalesce(nullif(concat_ws(' ', CASE WHEN p_partkey % 7 <> 0 THEN nullif(p_name, '') END, CASE WHEN p_size % 3 <> 0 THEN 'd' || p_size END, CASE WHEN p_partkey % 5 <> 0 THEN 'f' || p_partkey END), ''), 'frame'), 1, 24) AS label FROM part""",
        "size_estimate": "SELECT lang, CAST(trunc(CAST(sum(n_chars) AS DOUBLE) * CASE lang WHEN 'en' THEN 2.75 WHEN 'de' THEN 0.55 ELSE 0.45 END::DOUBLE) AS BIGINT) AS estimate FROM documents GROUP BY lang",
        "semi_sources": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "anti_fallback": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "union_manifest": "SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, NULL FROM customer",
        "contains_any": "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'idiot|pathetic|password|license')",
        "prefix_first_match": "SELECT s_suppkey, s_name FROM supplier WHERE starts_with(upper(s_name), 'SUPPLIER#00') ORDER BY s_suppkey LIMIT 1",
        "flood_fill": """WITH RECURSIVE c AS (SELECT DISTINCT o_orderkey % 50 AS x, o_orderkey // 50 AS y FROM orders WHERE o_orderkey % 3 <> 0 OR o_custkey % 5 < 2),
            r AS (SELECT x, y FROM c WHERE x = 0 OR x = 49 OR y = 0 OR y = (SELECT max(y) FROM c)
                UNION SELECT c.x, c.y FROM (SELECT x + a AS x, y + b AS y FROM r, (VALUES (-1), (0), (1)) AS s(a), (VALUES (-1), (0), (1)) AS q(b)) AS m JOIN c ON c.x = m.x AND c.y = m.y) SELECT x, y FROM r""",
        "pixel_count_if": """SELECT l_returnflag, count(*) FILTER (NOT ((i BETWEEN 247 AND 250) OR (r > 150 AND g < 80 AND b > 150 AND abs(r - b) < 60) OR (g = 0 AND r = b AND r BETWEEN 120 AND 140))) AS opaque
            FROM (SELECT l_returnflag, l_partkey % 256 AS i, l_suppkey % 256 AS r, l_orderkey % 256 AS g, (l_suppkey + l_linenumber) % 256 AS b FROM lineitem) GROUP BY 1""",
        "images_per_category": f"""WITH c AS (SELECT p_partkey, {_CATEGORY} AS category, p_size, p_retailprice FROM part),
            l AS (SELECT l_partkey, count(*) AS lines, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1)
            SELECT category, p_partkey, lines, quantity FROM c JOIN l ON l_partkey = p_partkey WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY p_size DESC, p_retailprice DESC, p_partkey) <= 8""",
        "format_size": """WITH n AS (SELECT doc_id, n_chars * n_chars AS n FROM documents),
            u AS (SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS p FROM n),
            e AS (SELECT doc_id, p, CAST(round_even(n * 10 / pow(1024, p), 0) AS BIGINT) AS tenths FROM u)
            SELECT doc_id, CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) || ' ' || ['B', 'KB', 'MB', 'GB'][p + 1] AS size FROM e""",
    }
