"""Tables of tuples in a folder: Parquet parts and a small JSON configuration for each."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators import tuples, versions
from quadrille.operators.versions import TableConfig


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which all executors share; it goes when the JVM ends.

    Where ``spark.checkpoint.dir`` is unset, a temporary folder serves in local mode only.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    out = f"{base or 'file://' + tempfile.gettempdir()}/quadrille-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return out


def schema(n: int) -> T.StructType:
    kinds = {"version_ts": T.LongType(), "received_ts": T.LongType()}
    return T.StructType([T.StructField(c, T.DoubleType() if c[:3] in ("lo_", "hi_") else kinds.get(c, T.StringType())) for c in tuples.columns(n)])


class Catalog:
    """Groups of tables of one dimension. All files go through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _put(self, path: str, value: dict) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _get(self, path: str) -> dict:
        fs, p = self._fs(path)
        if not fs.exists(p):
            raise KeyError(path)
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def create_group(self, group: str, dimensions: int, **options) -> None:
        self._put(f"{self.root}/{group}/group.json", {"dimensions": dimensions, **options})

    def delete_group(self, group: str) -> None:
        self._delete(f"{self.root}/{group}")

    def groups(self) -> list[str]:
        return self._list(self.root)

    def dimensions(self, group: str) -> int:
        return self._get(f"{self.root}/{group}/group.json")["dimensions"]

    def create_table(self, name: str, config: TableConfig = TableConfig()) -> None:
        """``name`` is ``group_table``."""
        group = name.split("_")[0]
        self.dimensions(group)
        self._put(f"{self.root}/{group}/{name}/table.json", asdict(config))

    def delete_table(self, name: str) -> None:
        self._delete(self._folder(name))

    def tables(self, group: str) -> list[str]:
        return [t for t in self._list(f"{self.root}/{group}") if t != "group.json"]

    def config(self, name: str) -> TableConfig:
        return TableConfig(**self._get(f"{self.root}/{name.split('_')[0]}/{name}/table.json"))

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name.split('_')[0]}/{name}"

    def _data(self, name: str) -> str:
        """The folder of the current generation, which compaction moves on."""
        fs, p = self._fs(f"{self._folder(name)}/current.json")
        return f"{self._folder(name)}/data-{self._get(str(p))['generation'] if fs.exists(p) else 0}"

    def _stream(self, name: str) -> str:
        return f"{self._folder(name)}/stream"

    def _append(self, name: str, rows: DataFrame, path: str, bloom: bool = True) -> None:
        n = self.dimensions(name.split("_")[0])
        missing = set(tuples.columns(n)).symmetric_difference(rows.columns)
        if missing:
            raise ValueError(f"the tuples do not fit {n} dimensions: {sorted(missing)}")
        out = tuples.check(rows, n).select(*tuples.columns(n)).sortWithinPartitions("key", "version_ts").write.mode("append")
        (out.option("parquet.bloom.filter.enabled#key", "true") if bloom else out).parquet(path)

    def put(self, name: str, rows: DataFrame, bloom: bool = True) -> None:
        """Append tuples; a box of another dimension fails."""
        self._append(name, rows, self._data(name), bloom)

    def put_streaming_only(self, name: str, rows: DataFrame) -> None:
        """Tuples for continuous queries alone: no query on the table sees them."""
        self._append(name, rows, self._stream(name), False)

    def stream(self, name: str, files_per_trigger: int = 100) -> DataFrame:
        """Tuples put for continuous queries, as a stream."""
        fs, p = self._fs(self._stream(name))
        fs.mkdirs(p)
        return self.spark.readStream.schema(schema(self.dimensions(name.split("_")[0]))).option("maxFilesPerTrigger", files_per_trigger).parquet(self._stream(name))

    def update(self, name: str, rows: DataFrame) -> None:
        """New versions of keys; of tables that keep several versions, each key's old one is deleted at the
        version before the new one."""
        if self.config(name).duplicates:
            at = rows.groupBy("key").agg((F.min("version_ts") - 1).alias("at"))
            old = versions.newest(self.table(name), 1).where(F.col("kind") == tuples.TUPLE).select("key").join(at, "key")
            gone = tuples.tombstones(old, self.dimensions(name.split("_")[0]), F.col("at"))
            self.put(name, gone.unionByName(rows))
        else:
            self.put(name, rows)

    def delete(self, name: str, keys: DataFrame, ts=None) -> None:
        self.put(name, tuples.tombstones(keys, self.dimensions(name.split("_")[0]), ts))

    def table(self, name: str) -> DataFrame:
        n = self.dimensions(name.split("_")[0])
        fs, p = self._fs(self._data(name))
        return self.spark.read.schema(schema(n)).parquet(self._data(name)) if fs.exists(p) else self.spark.createDataFrame([], schema(n))

    def resolved(self, name: str) -> DataFrame:
        return versions.resolve(self.table(name), self.config(name))

    def put_if_newest(self, name: str, row: DataFrame, expected_version: int) -> bool:
        """Append a new version of one key if its newest is the expected one (an optimistic lock by one writer)."""
        key = row.first()["key"]
        newest = self.table(name).where(F.col("key") == key).agg(F.max("version_ts")).first()[0]
        if newest != expected_version:
            return False
        self.put(name, row)
        return True

    def compact(self, name: str, major: bool = True) -> None:
        """Write a new generation of the table and make it the current one; until then the old one stands."""
        old = self._data(name)
        generation = int(old.rsplit("-", 1)[1]) + 1
        new = f"{self._folder(name)}/data-{generation}"
        versions.compact(self.spark, self.table(name), new, self.config(name), major=major)
        self._put(f"{self._folder(name)}/current.json", {"generation": generation})
        self._delete(old)
