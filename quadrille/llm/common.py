"""Shared scratch tables, held-out rules and small helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves in local mode only.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_quadrille_scratch"):
        spark._quadrille_scratch = "file://" + tempfile.mkdtemp(prefix="quadrille-")
    return spark._quadrille_scratch


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


BATCH_ROWS = 1000  # documents handed to Python at once
BATCH_BYTES = 4 << 20  # and their bytes, but for a longer row


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few documents and few bytes, which bounds the memory of Python workers and that of
    the buffers in which executors write batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


#: Spark then removes the shuffle files of an execution when it ends, not when the driver's garbage is collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``release`` and ``only`` remove those that no later step reads, at once; what is left goes when the
    session's JVM ends. An operator leaves at most its result behind.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bound_batches(spark)
        self.names: dict[str, list[tuple[str, weakref.ref]]] = {}

    def path(self, name: str) -> str:
        out = f"{shared_dir(self.spark)}/quadrille-{name}-{uuid.uuid4().hex}"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        return out

    def cut(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write ``df`` as Parquet and return it as read back."""
        out = self.path(name)
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(out)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        back = self.spark.read.schema(df.schema).parquet(out)
        self.names.setdefault(name, []).append((out, weakref.ref(back)))
        return back

    def release(self, *names: str) -> None:
        """Remove all tables written under these names."""
        for name in names:
            for out, _ in self.names.pop(name, []):
                _remove(self.spark, out)

    def only(self, *tables: DataFrame) -> None:
        """Remove every table but these."""
        keep = {id(t) for t in tables}
        for name, written in list(self.names.items()):
            left = [(out, ref) for out, ref in written if id(ref()) in keep]
            self.names[name] = left
            for out, _ in (x for x in written if x not in left):
                _remove(self.spark, out)

    def drop(self, *tables: DataFrame) -> None:
        gone = {id(t) for t in tables}
        for name, written in self.names.items():
            for out, _ in (x for x in written if id(x[1]()) in gone):
                _remove(self.spark, out)
            self.names[name] = [x for x in written if id(x[1]()) not in gone]

    def result(self, df: DataFrame) -> DataFrame:
        """Write an operator's result and remove all that it was made of."""
        out = self.cut(df, "result")
        self.only(out)
        return out


def remainder(spark_col: str, n: int):
    """crc32 of the column's text form, modulo ``n``."""
    return F.crc32(F.col(spark_col).cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Partitions for a keyed exchange."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
