"""What the operators share: reading tables, Arrow row mapping, scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from captionloom.session import bound_batches, shared_folder, ship_package

#: A word: a run of anything but ASCII white space. Written for Java, Python and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a lookup table (some tens of bytes each) small enough to send to every executor.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prepare(spark: SparkSession) -> None:
    """Make a session ready for the Python stages: sources shipped, batches bounded."""
    ship_package(spark)
    bound_batches(spark)


def map_columns(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Map Arrow batches: `make()` runs once a task and returns f(*columns as lists) -> columns as lists.

    A result may have other row counts than its batch. Nulls arrive as None, so integers stay integers.
    """
    prepare(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                made = f(*[c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(made, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, make: Callable[[], Callable], schema: str, *of: str) -> DataFrame:
    """The columns of df and of `schema`: `make()` gives f(*columns `of` as lists) -> as many rows of the new columns.

    The other columns pass through as Arrow arrays, whatever their names; those named like a new one,
    in any case of letters, give way.
    """
    prepare(df.sparkSession)
    new = StructType.fromDDL(schema)
    carry = [c for c in df.columns if c.lower() not in {n.lower() for n in new.names}]
    packed = df.select(*of, F.struct(*[named(c) for c in carry]).alias("_row"))
    out = StructType([packed.schema["_row"], *new])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                made = f(*[c.to_pylist() for c in batch.columns[: len(of)]])
                yield pa.RecordBatch.from_arrays([batch.column(len(of)), *[pa.array(c, t.type) for c, t in zip(made, list(arrow)[1:], strict=True)]], schema=arrow)

    made = packed.mapInArrow(run, out)
    return made.select(*[F.col("_row").getField(c).alias(c) for c in carry], *new.names)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live on between tasks."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def named(column: str) -> F.Column:
    """A column by its whole name, which may hold dots or backticks."""
    return F.col("`" + column.replace("`", "``") + "`").alias(column)


_scratch: list[tuple[SparkSession, str]] = []


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The folder has a fresh name, so that reruns never meet. It is deleted by release(), or else when the
    program ends: a result that is still to be read may need it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/captionloom-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    wanted = {t.scratch_path for t in tables}
    for spark, path in [x for x in _scratch if x[1] in wanted]:
        _scratch.remove((spark, path))
        _delete(spark, path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted when the program ends."""
    path = f"{shared_folder(spark)}/captionloom-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _scratch:
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc() is not None and not spark.sparkContext._jsc.sc().isStopped():
            _delete(spark, path)


def join_checked(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined to a written lookup table with few columns and unique keys, without a hot task.

    A table of at most BROADCAST_ROWS is sent to every executor. A larger one is joined by shuffling;
    as it is a plain table, not an aggregate, adaptive execution can split a key's rows.
    """
    return rows.join(F.broadcast(lookup) if lookup.count() <= BROADCAST_ROWS else lookup, keys, how)
