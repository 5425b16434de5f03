"""spark-submit entry: archives in, manifest, images, audit and previews out.

    spark-submit -m strataforge.plans.cli --archive main:base=/data/base.bin --names names.csv --out /data/out
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.plans import extraction, safety
from strataforge.plans.rules import MODES
from strataforge.sources.archive import entries, landed, ranged
from strataforge.sources.files import located
from strataforge.sources.listing import file_sizes


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--archive", action="append", required=True, metavar="FAMILY:LABEL=PATH", help="main, interface or picture; order counts")
    p.add_argument("--names", required=True, help="CSV set_id,name")
    p.add_argument("--curated", help="CSV image_id,category of interface records")
    p.add_argument("--catalog", action="append", default=[], metavar="KIND=PATH", help="XML; later files win")
    p.add_argument("--mode", choices=sorted(MODES), default="relevant-raw")
    p.add_argument("--full", action="store_true", help="the same as --mode all-raw")
    p.add_argument("--limit", type=int, help="stop after so many records that give an image; no audit")
    p.add_argument("--out", required=True)
    p.add_argument("--files", action="store_true", help="also one PNG file for each manifest path, under files/")
    p.add_argument("--one-manifest", action="store_true", help="also the manifest as one CSV file, manifest.csv; --out must be mounted")
    p.add_argument("--zip", action="store_true", help="also all images as one file, images.zip; --out must be mounted")
    p.add_argument("--decoder", metavar="MODULE:FUNCTION", help="reads moving pictures: (bytes, frame numbers) to RGBA arrays; without it they are left out")
    p.add_argument("--yes", action="store_true", help="replace what an earlier run wrote")
    return p


#: Archives of these families may be absent; all others must be there.
OPTIONAL = ("picture",)


def present(spark: SparkSession, where: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The archives that are there. SystemExit, with their paths, if required ones are not."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    absent = [w for w in where if not there(w[2])]
    if lost := [path for family, _, path in absent if family not in OPTIONAL]:
        raise SystemExit("these archives are not there:\n" + "\n".join(f"  {p}" for p in lost))
    return [w for w in where if w not in absent]


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries by range, or of whole files where only Spark knows a path's file system."""
    try:
        for path in paths:
            located(path)
    except (ValueError, OSError):
        return entries(spark, paths)
    return ranged(spark, paths)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, int]:
    """Writes manifest/, images/, audit/ and previews/ (and files/ if asked) under --out; gives their counts. The audit raises once all is written."""
    o = parser().parse_args(args)
    if o.limit is not None and o.limit < 1:
        raise SystemExit("--limit must be 1 or more")
    spark = spark or SparkSession.builder.getOrCreate()
    where = [(a.split("=", 1)[0].split(":")[0], a.split("=", 1)[0].split(":")[1], a.split("=", 1)[1]) for a in o.archive]
    where = present(spark, where)
    safety.validate_output(o.out, [path for *_, path in where])
    mode = "all-raw" if o.full else o.mode
    sources = spark.createDataFrame([(f, label, i) for i, (f, label, _) in enumerate(where)], "family string, source string, source_ord int")
    rows = landed(extraction.labelled(read(spark, [path for *_, path in where]), {label: path for _, label, path in where}))
    names = spark.read.csv(o.names, header=True, schema="set_id long, name string")
    curated = spark.read.csv(o.curated, header=True, schema="image_id string, category string") if o.curated else spark.createDataFrame([], "image_id string, category string")
    files = None
    for i, item in enumerate(o.catalog):
        kind, path = item.split("=", 1)
        one = spark.read.text(path, wholetext=True).select(F.lit(i).alias("file_ord"), F.lit(kind).alias("kind"), F.lit(path).alias("source_xml"), F.col("value").alias("xml"))
        files = one if files is None else files.union(one)
    known = extraction.catalog(files if files is not None else spark.createDataFrame([], "file_ord int, kind string, source_xml string, xml string"))

    decoder = None
    if o.decoder:
        module, _, function = o.decoder.partition(":")
        decoder = getattr(importlib.import_module(module), function)

    save = "overwrite" if o.yes else "errorifexists"
    extraction.extract(rows, sources, names, curated, known, mode=mode, limit=o.limit, decoder=decoder).write.mode(save).parquet(f"{o.out}/rows")
    safety.mark(o.out)
    done = spark.read.parquet(f"{o.out}/rows")
    extraction.write_manifest(done, f"{o.out}/manifest", save)
    if o.one_manifest:
        extraction.write_one_manifest(done, f"{o.out}/manifest.csv")
    if o.zip:
        extraction.write_image_archive(done, f"{o.out}/images.zip")
    extraction.write_images(done, f"{o.out}/images", save)
    extraction.previews(done).write.mode(save).parquet(f"{o.out}/previews")
    if decoder:
        extraction.presentation_sheets(done).write.mode(save).parquet(f"{o.out}/presentations")
    if o.files:
        extraction.write_files(done, f"{o.out}/files", o.yes)
    counts = {"images": done.count(), "records": done.select(F.slice("row_ord", 1, 3)).distinct().count()}
    if o.limit is None:
        extraction.audit(done, rows, sources).write.mode(save).parquet(f"{o.out}/audit")
        counts["audited"] = extraction.require_clean(spark.read.parquet(f"{o.out}/audit"))
    return counts


def estimate(spark: SparkSession, archives: dict[str, list[str]], mode: str, video: bool = False) -> int:
    """Bytes that extraction may write; archives: family to paths. Reads file sizes alone."""
    sizes = None
    for family, paths in archives.items():
        one = file_sizes(spark, paths).withColumn("family", F.lit(family))
        sizes = one if sizes is None else sizes.union(one)
    return extraction.size_estimate(sizes, mode=mode, video=video).first()["estimate"]


if __name__ == "__main__":
    print(main())
