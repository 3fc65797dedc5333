"""Session plumbing that the corpus operators share: scratch tables, code shipping."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_SCRATCH: dict[str, list[str]] = {}
_scope: list[str] = [""]


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="loomstone-"), "loomstone_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("loomstone", os.path.relpath(full, package)))
    sc.addPyFile(archive)
    atexit.register(shutil.rmtree, os.path.dirname(archive), True)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        named = tempfile.mkdtemp(prefix="loomstone-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back.

    The files stay until their scope is released or the shared folder goes, since a result may be
    read lazily.
    """
    path = f"{shared_dir(spark)}/loomstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.setdefault(f"{spark.sparkContext.applicationId}/{_scope[-1]}", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Send at most so many rows to Python at once in what is run inside; for wide rows, whose batches would be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Count what `written` writes inside as scratch of that name."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def release(spark: SparkSession, name: str) -> None:
    """Delete the scratch tables of a scope; call it only when no lazy result still needs them."""
    for path in _SCRATCH.pop(f"{spark.sparkContext.applicationId}/{name}", []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Bytes of the files behind a table made by `written`."""
    total = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: two 64-bit hashes with different seeds, as 16 bytes."""
    text = F.coalesce(text, F.lit(""))
    return F.unhex(F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7919), text)), 16, "0")))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra ones, whatever their names, can't clash."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
