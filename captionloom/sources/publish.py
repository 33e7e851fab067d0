"""A sink of files: a row is a file, which appears whole or not at all.

Executors write each file below a folder of the run that no reader looks at, and one list for each task; when all
tasks are done the driver moves the files to their places, a task's list at a time. A task that dies leaves
nothing but what is deleted with the run's folder, and what it has written is not moved (a task that is still
running when its run is given up may write there once more). Files appear one by
one: a reader may see some of a run's files before the others, but no part of one.

    rows.write.format("captionloom_files").mode("append").save("file:///jobs")

with rows of (path, content): the path below the folder and the text.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Folders of runs that are not done; readers skip names that begin so.
STAGING = "_publishing"


@dataclass
class Written(WriterCommitMessage):
    """A task's list of files, and how many there are."""

    listing: str
    files: int


def _store(uri: str):
    """(file system, path) of a folder by its location."""
    from pyarrow import fs

    plain = re.sub("^file:/+", "file:///", uri) if re.match("[A-Za-z][A-Za-z0-9+.-]*:", uri) else f"file://{uri}"
    return fs.FileSystem.from_uri(quote(plain, safe=":/@%"))


def safe(path: str | None) -> str:
    """A path that stays below its folder."""
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in path.split("/")) or path.split("/")[0] == STAGING or "\0" in path:
        raise ValueError("a path leaves the folder")
    return path


class FileWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.run = root.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        store, root = _store(self.root)
        here = f"{root}/{STAGING}/{self.run}/{uuid.uuid4().hex}"  # each attempt of a task has its own
        store.create_dir(here, recursive=True)
        n = 0
        with store.open_output_stream(f"{here}/files") as listing:
            for row in iterator:
                target = safe(row["path"])
                with store.open_output_stream(f"{here}/{n}") as f:
                    f.write((row["content"] or "").encode())
                listing.write(json.dumps([f"{here}/{n}", target]).encode() + b"\n")
                n += 1
        return Written(f"{here}/files", n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.root)
        made = set()
        for m in messages:
            if m is None or not m.files:
                continue
            with store.open_input_stream(m.listing) as f:
                for line in f.read().decode().splitlines():
                    of, target = json.loads(line)
                    folder = f"{root}/{target}".rpartition("/")[0]
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    store.move(of, f"{root}/{target}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.root))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        at = f"{root}/{STAGING}/{self.run}"
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captionloom_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if [f.name for f in schema] != ["path", "content"]:
            raise ValueError("a sink of files takes (path, content)")
        return FileWriter(self.options["path"], overwrite)


def publish(files: DataFrame, folder: str, template: str = "{job_id}/{path}") -> None:
    """Write artifacts (job_id, path, content) below the folder; files that are there already are replaced one by one.

    Null contents are empty files; a path that is null or would leave the folder fails the whole run, of
    which then nothing appears; rows of one path are an error, as it cannot be told which counts.
    """
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(FileSink)
    pieces = re.split(r"\{(\w+)\}", template)
    name = F.concat(*[F.lit(p) if k % 2 == 0 else F.col(p).cast("string") for k, p in enumerate(pieces)])
    rows = files.select(name.alias("path"), F.col("content").cast("string").alias("content"))
    if not rows.groupBy("path").count().filter("count > 1").isEmpty():
        raise ValueError("two files of one path")
    rows.write.format(FileSink.name()).mode("append").save(folder)
