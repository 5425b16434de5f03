"""Archives that land in a folder, as a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataforge.sources.archive import MAGIC, entries_of

FILES = "path string, modificationTime timestamp, length long, content binary"


def landing_entries(spark: SparkSession, folder: str, *, exts: list[str] | None = None, magic: bytes = MAGIC, files_per_batch: int = 64) -> DataFrame:
    """A streaming DataFrame of entries; each file is read once, when it first appears. No state is kept but Spark's own log of files."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return entries_of(files, exts=exts, magic=magic)
