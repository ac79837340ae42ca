"""Small helpers shared by the training-data operators: shared scratch tables and ASCII-only lower-casing."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import string
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 200_000
#: Spark's own setting for removing an execution's shuffle files when it ends; stage retries still work after that.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by the session.

    A folder of our own is made only where spark.checkpoint.dir is unset, as in local tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="carelake-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The scratch tables of the step that is being run, where they are dropped behind it.
_held: list[Scratch] | None = None


@contextlib.contextmanager
def dropped_behind():
    """Drop the scratch tables of all calls inside when it ends, which must write what it takes from them."""
    global _held
    before, _held = _held, []
    try:
        yield
        for scratch in _held:
            scratch.drop()
    finally:
        _held = before


class Scratch:
    """Intermediate tables of one call, in the shared folder: what executors compute survives their loss.

    A written table cuts lineage, so loops and long chains of steps stay short plans.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"
        if _held is not None:
            _held.append(self)

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write df and return the written table; of at most so many rows, in files of up to ROWS_PER_FILE.

        A written table needs its shuffles no more, so their files go when the write ends.
        """
        out = df if rows is None else df.coalesce(1 + rows // ROWS_PER_FILE)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            out.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Remove written tables of these names, or all, once nothing that is still to run reads them."""
        for path in [f"{self.root}/{name}" for name in names] or [self.root]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; lower() does just that on pure ASCII and is much faster there."""
    is_ascii = F.length(text) == F.octet_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILTER_BITS = 1 << 24


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """One bit for each value of the low bits of an integer column, set where some row has it.

    Its size is fixed, so it may be broadcast whatever the table; it spares rows before a join that decides.
    """
    slot = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int")
    rows = (
        df.select(slot.alias("slot"))
        .distinct()
        .groupBy(F.shiftright("slot", 3).alias("byte"))
        .agg(F.bit_or(F.expr("cast(shiftright(128, slot & 7) as int)")).alias("v"))
    )
    found = rows.toArrow()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[found["byte"].to_numpy()] = found["v"].to_numpy()
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value's bit is set; bits stay packed, so a worker holds FILTER_BITS / 8 bytes."""
    slots = values.astype(np.int64) & (FILTER_BITS - 1)
    return ((bits[slots >> 3] << (slots & 7).astype(np.uint8)) & 128).astype(bool)


NATIVE_BITS = 1 << 24


def bit_filter(values: DataFrame, column: str) -> DataFrame:
    """(word, mask): one bit for each value of the low bits of an integer column, set where some row has it.

    It has NATIVE_BITS bits, so NATIVE_BITS / 64 rows at most whatever the table, and within() may broadcast it.
    """
    slot = F.col(column).bitwiseAND(F.lit(NATIVE_BITS - 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return values.select(F.shiftright(slot, 6).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def within(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """The rows whose value has its bit set, and so all that have an equal value among those of the filter.

    It spares rows before a shuffle; what it lets through is decided by the join or grouping behind it.
    """
    slot = F.col(column).bitwiseAND(F.lit(NATIVE_BITS - 1))
    bit = F.call_function("shiftright", F.col("mask"), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    found = rows.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(bits), "word")
    return found.where(bit == 1).drop("word", "mask")
