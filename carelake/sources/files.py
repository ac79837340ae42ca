"""Files that imports and devices bring: CSV with quotes and line ends inside, JSON arrays, annotations, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files as texts, with `file` and `row_number`, which counts a file's rows that aren't blank from 1.

    The first row names the columns, trimmed. Quotes are doubled inside quotes, where line ends may stand too. Missing
    and empty cells are empty texts; blank rows go. Files of more than one part keep their order by position.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "inferSchema": False}
    rows = spark.read.options(**options).csv(path)
    names = [c.strip().lstrip("﻿") for c in rows.columns]
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in zip(rows.columns, names)]
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = rows.select(at.alias("_at"), *cells)
    blank = F.forall(F.array(*[F.col(f"`{n}`") for n in names]), lambda x: F.trim(x) == "")
    number = F.row_number().over(W.Window.partitionBy("_at.f").orderBy("_at.b", "_at.i"))
    rows = rows.where(~blank).withColumn("row_number", number.cast("long"))
    return rows.select(F.col("_at.f").alias("file"), "row_number", *[F.col(f"`{n}`") for n in names])


def header_key(name: str) -> str:
    """A column's name by lower-case letters and digits alone, by which aliases are looked up."""
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def aliased(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their known names: of a name's aliases the first that the file has; null where it has none."""
    have = {header_key(c): c for c in reversed(rows.columns)}
    out = []
    for name, others in aliases.items():
        found = next((have[header_key(x)] for x in [name, *others] if header_key(x) in have), None)
        out.append((F.nullif(F.trim(F.col(f"`{found}`")), F.lit("")) if found else F.lit(None).cast("string")).alias(name))
    return rows.select("file", "row_number", *out)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row per object of JSON files that hold an array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


COCO = """images array<struct<id: long, file_name: string, width: int, height: int, split: string>>,
    annotations array<struct<id: long, image_id: long, bbox: array<double>>>"""


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotation with its image: (id, image_id, file_name, split, x, y, width, height)."""
    whole = spark.read.schema(COCO).option("multiLine", True).json(path)
    images = whole.select(F.explode("images").alias("i")).select("i.id", "i.file_name", "i.split").withColumnRenamed("id", "image_id")
    boxes = whole.select(F.explode("annotations").alias("a")).select("a.id", "a.image_id", "a.bbox")
    corners = [F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate(("x", "y", "width", "height"))]
    return boxes.join(images, "image_id").select("id", "image_id", "file_name", "split", *corners)


def telemetry(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A stream of JSON lines; a line that is no JSON gives a row of nulls, which goes."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.dropna("all")
