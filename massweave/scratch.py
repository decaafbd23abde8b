"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a local folder is made and set, but only if the master is local: on a
    cluster each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        named = "file://" + tempfile.mkdtemp(prefix="massweave-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or archive in the shared folder."""
    return f"{shared_dir(spark)}/massweave-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it.

    The table outlives lost executors.  :func:`drop` deletes it; what a result still reads
    stays, and whoever owns the shared folder clears it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._massweave_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_massweave_path", None)
        if path:
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Short rows that are broadcast at most; larger tables are joined by a shuffle.
SMALL_ROWS = 1 << 19


def few(df: DataFrame) -> DataFrame:
    """A written table of at most ``SMALL_ROWS`` short rows as the side that a join broadcasts; a larger one as it is."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: Spark sizes what an Arrow function or an explode makes like one row for each row of its input."""
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, and give freed memory of the driver back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
    spark.sparkContext._jvm.System.gc()


#: Bytes of a batch that a Python worker gets at once (a longer row is a batch of its own).
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of the cluster, once for each context, and bound the batches they hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_massweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="massweave-")) / "massweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(archive))
    sc._massweave_shipped = True
