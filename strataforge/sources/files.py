"""Files on any file system that pyarrow opens, and a sink that shows all of a job's files at once or none.

Paths without a scheme are a mounted file system's. Tasks write under names of their own in a staging folder beside the
target and move each file to its place in the staged tree once it is whole; the driver's commit moves the tree to the
target in one step, and an abort deletes it. What passes through the driver is a count for each task.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def opened(path: str):
    system, place = located(path)
    return system.open_input_file(place)


def file_size(path: str) -> int:
    system, place = located(path)
    info = system.get_file_info(place)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size


def place_in(root: str, name: str) -> str:
    """root/name; ValueError where name leads out of root."""
    path = posixpath.normpath(posixpath.join(root, name))
    if not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{name} leaves {root}")
    return path


@dataclass
class Wrote(WriterCommitMessage):
    files: int


class FilesWriter(DataSourceWriter):
    """Rows (name, body) to files root/name. A null body is no file; of equal names the last one written stays."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.system, place = located(root)
        self.place = place.rstrip("/")
        self.job = f"{self.place}._writing-{uuid.uuid4().hex}"
        if not overwrite and self.there():
            raise ValueError(f"{root} is there already")
        self.system.create_dir(f"{self.job}/own")
        self.system.create_dir(f"{self.job}/tree")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "system"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.system = located(self.root)[0]

    def there(self) -> bool:
        return self.system.get_file_info(self.place).type != fs.FileType.NotFound

    def write(self, iterator: Iterator) -> Wrote:
        # Folders are made one by one below those of the job: a task that goes on after the job's abort makes nothing.
        own, made, n = f"{self.job}/own/{uuid.uuid4().hex}", {f"{self.job}/tree"}, 0
        self.system.create_dir(own, recursive=False)
        try:
            for name, body in iterator:
                if body is None:
                    continue
                path = place_in(f"{self.job}/tree", name)
                new, folder = [], posixpath.dirname(path)
                while folder not in made:
                    new.append(folder)
                    folder = posixpath.dirname(folder)
                for folder in reversed(new):
                    self.system.create_dir(folder, recursive=False)
                    made.add(folder)
                with self.system.open_output_stream(f"{own}/whole") as file:
                    file.write(bytes(body))
                self.system.move(f"{own}/whole", path)
                n += 1
        finally:
            if self.system.get_file_info(own).type != fs.FileType.NotFound:
                self.system.delete_dir(own)
        return Wrote(n)

    def commit(self, messages: list[Wrote | None]) -> None:
        old = f"{self.job}/old"
        if replaced := self.there():
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{self.root} came to be meanwhile")
            self.system.move(self.place, old)
        try:
            self.system.move(f"{self.job}/tree", self.place)
        except OSError:
            if replaced:
                self.system.move(old, self.place)
            raise
        self.system.delete_dir(self.job)

    def abort(self, messages: list[Wrote | None]) -> None:
        if self.system.get_file_info(self.job).type != fs.FileType.NotFound:
            # Tasks may still write: once the folder has another name they find none, and deleting meets no new files.
            gone = f"{self.job}-aborted"
            self.system.move(self.job, gone)
            self.system.delete_dir(gone)


class FilesSink(DataSource):
    """df.select(name, body).write.format("whole_files").option("root", …).mode("append" or "overwrite").save()"""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if [f.name for f in schema.fields] != ["name", "body"]:
            raise ValueError("whole_files takes the columns name and body")
        return FilesWriter(self.options["root"], overwrite)


def write_tree(files: DataFrame, root: str, overwrite: bool = False) -> None:
    """files (name, body) as files under root, all or none of them. root must not be there, or is replaced as a whole."""
    files.sparkSession.dataSource.register(FilesSink)
    rows = files.select(F.col("name").cast("string").alias("name"), F.col("body").cast("binary").alias("body"))
    rows.write.format("whole_files").option("root", root).mode("overwrite" if overwrite else "append").save()
