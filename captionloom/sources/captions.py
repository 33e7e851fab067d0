"""SRT and WebVTT: parsing and rendering as columns, and Spark data sources `srt` and `vtt`."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from captionloom.functions.text import format_timestamp, parse_timestamp, strip

#: An SRT block: number, times, lines up to a blank line or the end.
SRT_BLOCK = r"(?ms)^\s*(\d+)\s*\n(\d\d:\d\d:\d\d,\d{3})\s+-->\s+(\d\d:\d\d:\d\d,\d{3})\s*\n(.*?)(?=\n{2,}|\z)"
CUE_SCHEMA = "path string, index int, start_ms bigint, end_ms bigint, text string"


def _plain(text: Column) -> Column:
    return strip(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\ufeff"), F.lit("")))


def parse_srt(files: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    """(keys, seq, index, start_ms, end_ms, text): cues in the file's order, with the file's numbers; other text is skipped."""
    body = _plain(F.col(column))
    group = lambda k: F.regexp_extract_all(body, F.lit(SRT_BLOCK), F.lit(k))
    zipped = F.arrays_zip(group(1).alias("n"), group(2).alias("s"), group(3).alias("e"), group(4).alias("t"))
    rows = files.select(*keys, F.posexplode(zipped).alias("seq", "c"))
    return rows.select(*keys, "seq", F.col("c.n").cast("int").alias("index"), parse_timestamp(F.col("c.s")).alias("start_ms"), parse_timestamp(F.col("c.e")).alias("end_ms"), strip(F.col("c.t")).alias("text"))


def parse_vtt(files: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    """Like parse_srt(); cues are numbered anew, blocks without times are ignored, cue settings dropped.

    Times that are not HH:MM:SS.mmm are null.
    """
    blocks = F.split(_plain(F.col(column)), r"\n\s*\n")
    rows = files.select(*keys, F.posexplode(blocks).alias("block", "b")).filter(F.contains("b", F.lit(" --> ")))
    lines = F.split("b", r"\r\n|[\n\r]")
    timing = F.get(F.filter(lines, lambda x: F.contains(x, F.lit(" --> "))), F.lit(0))
    rows = rows.select(*keys, "block", lines.alias("lines"), timing.alias("timing"))
    at = F.array_position("lines", F.col("timing")).cast("int")
    later = F.slice("lines", at + 1, F.greatest(F.size("lines") - at, F.lit(0)))
    text = F.array_join(F.filter(later, lambda x: F.length(strip(x)) > 0), "\n")
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("block"))
    sides = F.split("timing", " --> ", 2)
    end = F.regexp_extract(strip(F.get(sides, F.lit(1))), r"^(\S+)", 1)
    return rows.select(*keys, (index - 1).alias("seq"), index.alias("index"), parse_timestamp(strip(F.get(sides, F.lit(0)))).alias("start_ms"), parse_timestamp(end).alias("end_ms"), text.alias("text"))


def _rendered(cues: DataFrame, keys: list[str], block, start: str, jobs: DataFrame | None) -> DataFrame:
    """Cues in order of seq (or index) with texts stripped, a null one being empty; jobs without cues have none in their file."""
    by = "seq" if "seq" in cues.columns else "index"
    text = strip(F.coalesce("text", F.lit(""))).alias("text")
    rows = cues.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(by, "start_ms", "end_ms", text))).alias("_cues"))
    if jobs is not None:
        rows = jobs.select(*keys).distinct().join(rows, keys, "left")
    body = F.concat(F.array_join(F.transform("_cues", block), "\n\n"), F.lit("\n"))
    return rows.select(*keys, F.concat(F.lit(start), F.when(F.size("_cues") > 0, body).otherwise("")).alias("content"))


def _times(c: Column, mark: str) -> Column:
    return F.concat(format_timestamp(c["start_ms"], mark), F.lit(" --> "), format_timestamp(c["end_ms"], mark))


def render_srt(cues: DataFrame, keys: list[str], jobs: DataFrame | None = None) -> DataFrame:
    """(keys, content): cues numbered from 1; of `jobs` (keys), those without cues have an empty file."""
    return _rendered(cues, keys, lambda c, k: F.concat((k + 1).cast("string"), F.lit("\n"), _times(c, ","), F.lit("\n"), c["text"]), "", jobs)


def render_vtt(cues: DataFrame, keys: list[str], jobs: DataFrame | None = None) -> DataFrame:
    """(keys, content): cues under the header; of `jobs` (keys), those without cues have the header alone."""
    return _rendered(cues, keys, lambda c: F.concat(_times(c, "."), F.lit("\n"), c["text"]), "WEBVTT\n\n", jobs)


def parity(srt: DataFrame, vtt: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, equal): whether both files hold the same cues."""
    flat = lambda d, n: d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "index", "start_ms", "end_ms", "text"))).alias(n))
    return flat(srt, "a").join(flat(vtt, "b"), keys, "full_outer").select(*keys, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """All caption files under a path: .vtt as WebVTT, others as SRT; keyed by `path`."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    is_vtt = F.lower("path").endswith(".vtt")
    return parse_srt(files.filter(~is_vtt), ["path"]).union(parse_vtt(files.filter(is_vtt), ["path"]))


#: Files, and their bytes, that one task reads.
PACK_FILES, PACK_BYTES = 2_000, 32 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _CueReader(DataSourceReader):
    """Cues of many small files, some thousands of them a task, from any store that pyarrow reaches.

    With the option `errors` set to `rows`, a file that is no UTF-8 or that cannot be opened, and one without a cue, is a
    row of its own with a code; otherwise the first fails the query and the second has no row. Comparisons
    of `path` with a string, or with a list of them, leave other files unopened.
    """

    def __init__(self, path: str, suffix: str, coded: bool = False):
        self.path, self.suffix, self.coded, self.wanted = path, suffix, coded, None

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or tuple(f.attribute) != ("path",):
                yield f
            else:
                self.wanted = set(values) if self.wanted is None else self.wanted & set(values)

    def partitions(self) -> list[_Files]:
        """Files in order of their path, packed by number and bytes. The path is one that driver and executors share."""
        from pyarrow import fs

        from captionloom.sources.publish import _store

        store, root = _store(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.base_name.lower().endswith(self.suffix)]
        out: list[list[str]] = []
        size = 0
        for x in sorted(found, key=lambda x: x.path):
            if self.wanted is not None and x.path not in self.wanted:
                continue
            if not out or len(out[-1]) >= PACK_FILES or size + x.size > PACK_BYTES:
                out.append([])
                size = 0
            out[-1].append(x.path)
            size += x.size
        return [_Files(paths) for paths in out] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        from captionloom.sources.publish import _store

        store, _ = _store(self.path)
        for path in partition.paths:
            n = 0
            try:
                with store.open_input_stream(path) as f:
                    text = f.read().decode("utf-8-sig").replace("\r\n", "\n").strip()
            except (OSError, UnicodeDecodeError):
                if not self.coded:
                    raise
                yield path, None, None, None, None, "SUBTITLES_INVALID"
                continue
            for cue in self._cues(text):
                n += 1
                yield (path, *cue, None) if self.coded else (path, *cue)
            if self.coded and not n:
                yield path, None, None, None, None, "SUBTITLES_EMPTY"

    def _cues(self, text: str) -> Iterator[tuple]:
        number, stamp = 0, re.compile(r"(\d+):(\d+):(\d+)[,.](\d+)$")

        def ms(s: str) -> int | None:
            found = stamp.match(s)
            return found and ((int(found[1]) * 60 + int(found[2])) * 60 + int(found[3])) * 1000 + int(found[4])

        if self.suffix == ".srt":
            for n, s, e, t in re.findall(SRT_BLOCK.replace(r"\z", r"\Z"), text):
                yield int(n), ms(s), ms(e), t.strip()
            return
        for block in re.split(r"\n\s*\n", text):
            lines = re.split(r"[\n\r]", block)
            at = next((k for k, x in enumerate(lines) if " --> " in x), None)
            if at is not None:
                s, e = lines[at].split(" --> ", 1)
                number += 1
                yield number, ms(s.strip()), ms(e.split()[0]), "\n".join(x for x in lines[at + 1 :] if x.strip())


class SrtSource(DataSource):
    """spark.read.format("srt").load(path) -> CUE_SCHEMA, and `code` with the option errors=rows"""

    suffix = ".srt"

    @classmethod
    def name(cls) -> str:
        return cls.suffix[1:]

    @property
    def coded(self) -> bool:
        return self.options.get("errors", "").lower() == "rows"

    def schema(self) -> str:
        return CUE_SCHEMA + (", code string" if self.coded else "")

    def reader(self, schema) -> _CueReader:
        return _CueReader(self.options["path"], self.suffix, self.coded)


class VttSource(SrtSource):
    suffix = ".vtt"


def register(spark: SparkSession) -> None:
    # Filters on the path are taken by the reader.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SrtSource)
    spark.dataSource.register(VttSource)
