"""What the corpus operators share: code shipping, batch bounds, shared scratch folders, bounded caches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch handed to a Python worker ends at so many rows or bytes, whichever is first.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, sees to a checkpoint folder and ships this package to the executors, once a session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_dir(spark)
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-code-"), "graphloom_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, f"{top.name}/{p.relative_to(top)}")
    context.addPyFile(path)
    context._graphloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only where it is unset and Spark runs in one process (tests), a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_graphloom_dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-checkpoints-")
        atexit.register(shutil.rmtree, at[7:], ignore_errors=True)
        spark.sparkContext._graphloom_dir = at
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Computes df once into a Parquet table in the shared folder, and reads that: compressed, and lineage is cut."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables whose successors exist."""
    for t in tables:
        remove(t.sparkSession, t._graphloom_path)


def kept(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage through reliable shared storage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucket_of_id(col: str, modulus: int):
    """crc32 of the id's decimal text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % modulus


def settle() -> None:
    """Gives memory that a Python worker has freed back to the system: the worker stays, and its next work is another stage's."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def settle_driver(spark: SparkSession) -> None:
    """Has the driver forget the plans and broadcasts that nothing refers to, and gives freed memory of its Python and JVM back to the system."""
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # not every JVM has this command
        server, name = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # the server's own class isn't open
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = name, "systemTrimNativeHeap"
        call.invoke(server, args)
    settle()


class Memo(dict):
    """A dict that computes what is missing and forgets everything when it is full; long keys are not held."""

    def __init__(self, compute, limit: int = 400_000, longest: int = 48):
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
