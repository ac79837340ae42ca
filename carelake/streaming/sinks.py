"""Sinks that a repeated batch doesn't change: upserts into versioned tables, append-only logs, archive flags.

Plain Parquet has no merge, so a table is a folder of versions and a pointer: a merge writes a new version of those hash
partitions that it touches, then one small manifest that names every partition's folder and the batches that are in.
Readers and later merges go by the newest manifest, so a merge that fails half-way has changed nothing, and a batch that
comes again is recognised by its number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


class VersionedTable:
    """A table at a path (of any file system that Spark writes), with a key, in so many hash partitions."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], partitions: int = 64):
        self.spark, self.path, self.schema, self.key, self.partitions = spark, path.rstrip("/"), schema, key, partitions

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> int:
        jvm, path, fs = self._files()
        if not fs.exists(path):
            return -1
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def manifest(self) -> tuple[int, dict]:
        version = self._version()
        if version < 0:
            return -1, {"parts": {}, "batches": {}}
        return version, json.loads(self.spark.read.text(f"{self.path}/_manifests/{version:020d}", wholetext=True).first()[0])

    def _commit(self, version: int, told: dict) -> None:
        """Put a manifest in place by a rename, which fails if another writer has made the same version."""
        jvm, path, fs = self._files()
        fs.mkdirs(path)
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifests/{version:020d}")
        if fs.exists(done) or not fs.rename(draft, done):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.partitions)).cast("int")

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The rows of the newest version, or of some of its partitions."""
        held = self.manifest()[1]["parts"]
        paths = [p for k, p in held.items() if parts is None or int(k) in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, rows: DataFrame, batch: int, writer: str = "", order: list[Column] = (), update: list[str] | None = None, keep: str | None = None) -> bool:
        """Insert rows with new keys and update those with known ones; False, with no change, if the batch is in already.

        Of several rows with one key the last by `order` counts. update names the columns that a known row takes over
        (all by default), so those to insert may be more. Where `keep` holds for a known row, it stays as it is. Only
        partitions with keys of the batch are read and written.
        """
        version, told = self.manifest()
        if told["batches"].get(writer, -1) >= batch:
            return False
        names = [f.split()[0] for f in self.schema.split(", ")]
        new = rows.select(*names)
        if order:
            place = F.row_number().over(W.Window.partitionBy(*self.key).orderBy(*[c.desc() for c in order]))
            new = new.withColumn("_place", place).where("_place = 1").drop("_place")
        touched = sorted(r[0] for r in new.select(self._part()).distinct().collect())  # at most `partitions` numbers
        others = [c for c in names if c not in self.key]
        known = self.read(touched).select(*self.key, *[F.col(c).alias(f"_{c}") for c in others], F.lit(True).alias("_known"))
        both = known.join(new.withColumn("_new", F.lit(True)), self.key, "full")
        stays = F.col("_new").isNull()
        if keep:
            for c in sorted(others, key=len, reverse=True):
                keep = keep.replace(f"{{{c}}}", f"_{c}")
            stays = stays | (F.col("_known").isNotNull() & F.coalesce(F.expr(keep), F.lit(False)))
        fixed = [c for c in others if update is not None and c not in update]

        def value(c: str) -> Column:
            from_known = stays | F.col("_known").isNotNull() if c in fixed else stays
            return F.when(from_known, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

        folder = f"{self.path}/{version + 1:020d}-{uuid.uuid4().hex}"
        merged = both.select(*self.key, *[value(c) for c in others]).select(*names)
        merged.withColumn("_part", self._part()).repartition("_part").write.partitionBy("_part").parquet(folder)
        parts = told["parts"] | {str(p): f"{folder}/_part={p}" for p in touched}
        self._commit(version + 1, {"parts": parts, "batches": told["batches"] | {writer: batch}})
        return True

    def archive(self, keys: DataFrame, batch: int, flag: str = "archived", writer: str = "archive") -> bool:
        """Set a flag on the rows with these keys; they stay in the table, and live() leaves them out."""
        rows = self.read().join(keys.select(*self.key).distinct(), self.key, "left_semi").withColumn(flag, F.lit(True))
        return self.merge(rows, batch, writer)

    def live(self, flag: str = "archived") -> DataFrame:
        return self.read().where(~F.coalesce(F.col(flag), F.lit(False)))

    def writer(self, name: str, order: list[Column] = (), update: list[str] | None = None, keep: str | None = None):
        """A function for foreachBatch, which merges each batch once under its number."""

        def write(rows: DataFrame, batch: int) -> None:
            self.merge(rows, batch, name, order, update, keep)

        return write


def append_once(path: str):
    """A function for foreachBatch that appends each batch to a log once: a batch's folder is overwritten when repeated.

    What others logged is never touched. A reader of the path gets all batches, with `batch` as a column.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return write
