"""Session-level helpers shared by every operator: the shared work folder, written stages, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parent
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(name: str = "tracewright", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    repo = str(_ROOT.parent)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if repo not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([repo, *filter(None, paths)])
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, once a session; in local mode they share the driver's Python path."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster") or getattr(sc, "_tracewright_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "tracewright.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in _ROOT.rglob("*.py"):
            z.write(f, f.relative_to(_ROOT.parent))
    sc.addPyFile(str(out))
    sc._tracewright_shipped = True  # type: ignore[attr-defined]


def work_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: what the cluster names in spark.checkpoint.dir.

    Only where that setting is absent, as in tests on one machine, a folder of our own is made (and removed at exit).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jdir.get() if jdir.isDefined() else None
    if not named:
        own = tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared folder; it goes when the application's JVM ends."""
    sc = spark.sparkContext
    own = getattr(sc, "_tracewright_dir", None)
    if own is None:
        own = f"{work_dir(spark)}/tracewright-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._tracewright_dir = own  # type: ignore[attr-defined]
    return own


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewright_path = path  # type: ignore[attr-defined]
    return out


def discard(*staged: DataFrame) -> None:
    """Remove staged tables that no frame to come reads; only for tables that their operator gave to nobody."""
    for df in staged:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._tracewright_path)  # type: ignore[attr-defined]
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids and hashes that may be sent to every executor (16 MB at 16 bytes each).
FEW = 1_000_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A staged table of narrow rows, marked to be broadcast if it is counted to have `most` rows or fewer; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files whose results have been written; the driver's Python gives memory back, too."""
    gc.collect()
    _trim()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound batches for Python to 4 MB where the session leaves Spark's 64: whole texts take that several times over, on both sides."""
    if spark.conf.get(_BATCH, "64m") == "64m":
        spark.conf.set(_BATCH, "4m")


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose worker gives back at the task's end what the allocators hold; workers outlive tasks and stages."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        _trim()

    return run


def partitions(spark: SparkSession) -> int:
    """The shuffle width that the cluster set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
