"""Session plumbing shared by every part of the engine."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(app: str = "gleaner", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Rows of an Arrow batch: of whole documents, Spark's 10,000 take tens of megabytes in every worker.
BATCH = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, whatever their own path holds; keep their batches small, unless the
    session has a size of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; set here only where it is unset, and only if driver
    and executors are one machine. A cluster without that setting is refused: its executors would each write to a disk
    of their own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    known = sc._jsc.sc().getCheckpointDir()
    if at is None and known.isDefined():
        at = known.get()
    if at is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    if not known.isDefined():
        sc.setCheckpointDir(at)
    return at


#: Whether Spark deletes the shuffle files of an action when it ends, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions in here go when these end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, name: str = "step", run: Callable[[Iterator], Iterator] | None = None, schema: str | None = None, lean: bool = False) -> DataFrame:
    """Write df, or df.mapInArrow(run, schema), to the shared folder and read it back: the lineage ends there and survives
    lost executors. lean: with little disk; the shuffle files of this step go when it ends, and digests are squeezed."""
    spark = df.sparkSession
    df = df if run is None else df.mapInArrow(run, schema)
    path = f"{shared_dir(spark).rstrip('/')}/gleaner-{name}-{uuid.uuid4().hex}"
    with cleaned_up(spark) if lean else nullcontext():
        df.write.parquet(path, compression="zstd" if lean else None)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


#: Bytes of a row group in files that Python workers write.
GROUP = 8 << 20


def to_files(folder: str, run: Callable[[Iterator], Iterator] | None = None):
    """Writes what run makes of a task's batches (or these) to a Parquet file; gives its name, or nothing without rows."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs, parquet

        store, base = fs.FileSystem.from_uri(folder)
        name, out, held, size = f"part-{uuid.uuid4().hex}.parquet", None, [], 0
        for batch in run(batches) if run else batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = parquet.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=store)
            held.append(batch)
            size += batch.nbytes
            if size >= GROUP:
                out.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if out is not None:
            if held:
                out.write_table(pa.Table.from_batches(held))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return write


def settle_in_python(df: DataFrame, name: str = "step", run: Callable[[Iterator], Iterator] | None = None, schema: str | None = None) -> DataFrame:
    """settle() of df, or of df.mapInArrow(run, schema), by Python workers where the shared folder is a local file system.

    Hadoop's writer starts helper processes there, for the permissions of each file and of its checksum; each one has the
    whole address space of the executor until it runs its program. The worker of run is the one that writes, so that no
    task has two. Only files that tasks have finished are read: those of failed attempts stay unread in the folder. The
    shuffle files of this step go when it ends, as nothing needs them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gleaner-{name}-{uuid.uuid4().hex}"
    if not path.startswith("file:"):
        return settle(df, name, run, schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)
    with cleaned_up(spark):
        files = sorted(r.name for r in df.mapInArrow(to_files(path, run), "name string").collect())
    schema = df.schema if run is None else schema
    out = spark.read.schema(schema).parquet(*(f"{path}/{x}" for x in files)) if files else spark.createDataFrame([], schema)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what settle() wrote, once nothing reads it any more. Tables that settle() didn't return are left alone."""
    for df in tables:
        at = df.__dict__.pop("settled_at", None)
        if at is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
