"""Files: hashes, ingest of a source, private workspaces, atomic JSON. Driver-side but for the hashes."""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
import tempfile
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionloom.functions.redaction import refused_paths
from captionloom.plans.config import check_job_id
from captionloom.plans.engine import StageBlocked

FOLDERS = ("source", "audio", "asr", "transcript", "translation", "subtitles", "output", "validation", "logs")
MEDIA_SUFFIXES = {".mp4", ".mkv", ".mov", ".webm", ".m4v", ".avi"}
_STEP = 1 << 20


class SensitiveDataError(ValueError):
    """Sensitive content was about to be stored, or a path left its workspace."""


def file_hashes(spark: SparkSession, path: str | list[str], most_bytes: int = 1 << 28) -> DataFrame:
    """(path, bytes, sha256) of all files below `path` (or several), which the executors reach.

    Files up to `most_bytes` are hashed by the built-in function as one value each; a value cannot hold
    larger ones, which are read in pieces, a file in a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= most_bytes).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > most_bytes).select("path", F.col("length").alias("bytes"))

    def pieces(batches):
        from urllib.parse import quote

        from pyarrow import RecordBatch, fs

        for b in batches:
            hashes = []
            for uri in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", uri), safe=":/@"))
                digest = hashlib.sha256()
                with store.open_input_stream(name) as f:
                    while block := f.read(_STEP):
                        digest.update(block)
                hashes.append(digest.hexdigest())
            yield RecordBatch.from_pydict({"path": b.column(0), "bytes": b.column(1), "sha256": hashes})

    return small.union(large.mapInArrow(pieces, "path string, bytes long, sha256 string"))


class Fingerprints:
    """File hashes kept in a table (path, length, modified, sha256), so that a file is read once for each change.

    A file counts as unchanged if its length and time of change are as in its newest row. Rows are only
    ever added, by one append each update(): a writer that dies leaves the table as it was, and one that runs
    twice adds equal rows. Files that are gone stay in the table and are left out of files(); so are files without
    content, which the reader does not list.
    """

    #: Changed files whose content is read by name; with more, all files below the folders are read in one scan.
    NAMED = 10_000
    SCHEMA = "path string, length long, modified timestamp, sha256 string"

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table.rstrip("/")

    def known(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.table)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy("path", "length", "modified").agg(F.max("sha256").alias("sha256"))

    def listed(self, folders: list[str]) -> DataFrame:
        """(path, length, modified) of the files below the folders, whose content is not read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
        return files.select("path", "length", F.col("modificationTime").alias("modified"))

    def update(self, folders: list[str]) -> int:
        """Hash what is new or changed below the folders; how many files were read."""
        changed = self.listed(folders).join(self.known(), ["path", "length", "modified"], "left_anti")
        first = changed.limit(self.NAMED + 1).collect()
        if not first:
            return 0
        if len(first) <= self.NAMED:
            rows = self.spark.createDataFrame(first, changed.schema)
            hashed = file_hashes(self.spark, [_literal(r["path"]) for r in first])
        else:
            rows, hashed = changed, file_hashes(self.spark, folders)
        made = rows.join(hashed.select("path", F.col("bytes").alias("length"), "sha256"), ["path", "length"]).select("path", "length", "modified", "sha256")
        n = changed.count() if len(first) > self.NAMED else len(first)
        made.write.mode("append").parquet(self.table)
        return n

    def files(self, folders: list[str]) -> DataFrame:
        """(path, bytes, sha256) of the files below the folders, after update()."""
        self.update(folders)
        return self.listed(folders).join(self.known(), ["path", "length", "modified"]).select("path", F.col("length").alias("bytes"), "sha256")


def _literal(uri: str) -> str:
    """A listed file's location as a path for a reader, which takes some characters for patterns."""
    from urllib.parse import unquote

    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(uri))


def sha256_file(path: str | os.PathLike) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(_STEP):
            digest.update(block)
    return digest.hexdigest()


class Workspace:
    """A job's private folder; nothing leaves it, nothing sensitive is stored in it."""

    def __init__(self, root: Path, job_id: str):
        self.root = root / check_job_id(job_id)

    @classmethod
    def create(cls, jobs_root: str | os.PathLike, job_id: str) -> Workspace:
        space = cls(Path(jobs_root), job_id)
        for p in (space.root, *[space.root / f for f in FOLDERS]):
            p.mkdir(mode=0o700, parents=True, exist_ok=True)
        return cls.open(jobs_root, job_id)

    @classmethod
    def open(cls, jobs_root: str | os.PathLike, job_id: str) -> Workspace:
        space = cls(Path(jobs_root), job_id)
        info = os.lstat(space.root)
        if not stat.S_ISDIR(info.st_mode) or info.st_mode & 0o077:
            raise SensitiveDataError("the job folder is not private")
        return space

    def resolve(self, relative: str) -> Path:
        p = (self.root / relative).resolve()
        if not p.is_relative_to(self.root.resolve()):
            raise SensitiveDataError("a path leaves the job folder")
        return p

    def write_json(self, relative: str, value: Any, checked: bool = True) -> Path:
        """Publish JSON at once or not at all, readable by the owner alone."""
        if checked and refused_paths(value):
            raise SensitiveDataError("sensitive fields are not stored")
        to = self.resolve(relative)
        to.parent.mkdir(mode=0o700, parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=to.parent)
        try:
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
                f.flush()
                os.fsync(f.fileno())
            os.chmod(name, 0o600)
            os.replace(name, to)
        except BaseException:
            Path(name).unlink(missing_ok=True)
            raise
        return to

    def read_json(self, relative: str) -> dict[str, Any]:
        try:
            value = json.loads(self.resolve(relative).read_text(encoding="utf-8"))
        except (OSError, ValueError) as e:
            raise StageBlocked("ARTIFACT_INVALID") from e
        if not isinstance(value, dict):
            raise StageBlocked("ARTIFACT_INVALID")
        return value

    def source(self) -> Path:
        found = [p for p in (self.root / "source").glob("source.*") if p.suffix.lower() in MEDIA_SUFFIXES]
        if len(found) != 1:
            raise StageBlocked("SOURCE_MISSING")
        return found[0]

    def ingest(self, given: str | os.PathLike) -> dict[str, Any]:
        """Copy a media file in as source.<suffix>, read-only; the same bytes again are accepted, others refused."""
        path = Path(given)
        info = os.lstat(path)
        if not stat.S_ISREG(info.st_mode) or not info.st_size or path.suffix.lower() not in MEDIA_SUFFIXES:
            raise SensitiveDataError("the source is not a regular media file")
        digest = hashlib.sha256()
        to = self.root / "source" / f"source{path.suffix.lower()}"
        handle, name = tempfile.mkstemp(dir=to.parent)
        try:
            fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
            with os.fdopen(fd, "rb") as f, os.fdopen(handle, "wb") as out:
                if os.fstat(f.fileno()).st_ino != info.st_ino:
                    raise SensitiveDataError("the source changed while it was opened")
                while block := f.read(_STEP):
                    digest.update(block)
                    out.write(block)
            have = [p for p in to.parent.glob("source.*")]
            if have and sha256_file(have[0]) != digest.hexdigest():
                raise SensitiveDataError("the job has another source")
            if not have:
                if sha256_file(name) != digest.hexdigest():
                    raise SensitiveDataError("the copy differs from the source")
                os.chmod(name, 0o400)
                os.replace(name, to)
        finally:
            Path(name).unlink(missing_ok=True)
        return {"schema_version": 1, "status": "PASS", "transport": "local", "source_path": f"source/{to.name}", "bytes": info.st_size, "sha256": digest.hexdigest()}
