"""Session factory and the few session services that operators share."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that every result depends on or that keep plans adaptive.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

#: Rows and bytes in one Arrow batch: what a Python worker holds is these bytes or one row, if that is longer.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20

_shipped: weakref.WeakSet = weakref.WeakSet()


def build_session(master: str = "local[*]", name: str = "captionloom", **more: str) -> SparkSession:
    """A session with SETTINGS; `more` takes extra settings with `__` for dots."""
    conf = SETTINGS | {k.replace("__", "."): v for k, v in more.items()}
    return SparkSession.builder.master(master).appName(name).config(map=conf).getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is sent at once, as Spark's 10,000 rows may be whole transcripts.

    Spark reads the bounds when a plan runs, so they stay set in the session; smaller ones are kept.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors once for each SparkContext.

    Python workers on a cluster do not see the driver's source folder; without this, functions
    pickled by reference could not be imported there.
    """
    context = spark.sparkContext
    if context in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="captionloom-")), "captionloom_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(archive)
    _shipped.add(context)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves a local master (tests); on a cluster every
    machine would write to its own disk, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(os.path.realpath(tempfile.gettempdir()), "captionloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
