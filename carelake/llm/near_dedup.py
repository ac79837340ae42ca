"""MinHash near-duplicate detection with tensored banding and exact verification.

Two collections of half-keys are computed per document, each half-key made of two minhashes. A table key pairs
one half-key of the left collection with one of the right, so HALVES * HALVES tables of four minhashes cost
4 * HALVES minhashes. At Jaccard similarity 0.75 a pair misses all of the 144 tables of HALVES = 12 with
probability 1e-4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm import tokens
from carelake.llm.components import components
from carelake.llm.shared import Scratch, bitmap, in_bitmap
from carelake.llm.similarity import agreement, fits, links, small
from carelake.shipping import ship

HALVES = 12
SHINGLE = 5
_SIGNED = "doc_id long, text_hash long, n_shingles long, cls string, halves array<int>"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes: of n words, or of all words where there are fewer."""
    words, first = tokens.word_hashes(raw, offsets)
    runs = tokens.window_hashes(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield tokens.window_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield runs[:0]


def _class_of(shingles: np.ndarray) -> str | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest() if len(shingles) else None


def _signer(shingle: int, halves: int):
    """A mapInArrow function: documents to set sizes, set digests and the two collections of half-keys."""
    keys = tokens.stream(11, 4 * halves)
    slots = np.arange(2 * halves, dtype=np.uint64)[:, None]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tokens.text_buffers(batch.column("text"))
            for lo, hi in tokens.slices(offsets, 1 << 20):
                sets = list(shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle))
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                mins = np.zeros((4 * halves, len(full)), np.uint64)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    with np.errstate(over="ignore"):
                        for k, key in enumerate(keys):
                            mins[k] = np.minimum.reduceat((every ^ key) * (key | np.uint64(1)), at)
                        half = tokens.mix(mins[0::2] * np.uint64(3) + tokens.mix(mins[1::2]) + slots) >> np.uint64(32)
                else:
                    half = mins[0::2]
                # The lowest bit tells the collection: 0 for the left, 1 for the right one.
                half = (half & ~np.uint64(1)) | (slots >= halves).astype(np.uint64)
                values = pa.array(np.ascontiguousarray(half.T).ravel().astype(np.uint32).view(np.int32))
                ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, 2 * halves, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()),
                        batch.column("text_hash").slice(lo, hi - lo),
                        pa.array(sizes),
                        pa.array([_class_of(s) for s in sets], pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends), values),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "cls", "halves"],
                )

    return sign


def _setter(shingle: int, wanted):
    """A mapInArrow function: (doc_id, text) to (id, cls, shingles), the full sets of documents in a bitmap."""

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(in_bitmap(wanted.value, ids.fill_null(0).to_numpy()) & named)
            batch, ids = batch.take(pa.array(keep)), ids.take(pa.array(keep))
            raw, offsets = tokens.text_buffers(batch.column("text"))
            for lo, hi in tokens.slices(offsets, 1 << 20):
                sets = list(shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle))
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array([_class_of(s) for s in sets], pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))),
                    ],
                    names=["id", "cls", "shingles"],
                )

    return full_sets


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs (a, b) of fitting sizes with at least so many equal half-keys, which spares moving most other sets.

    A pair at similarity 0.75 shares each half-key with probability 0.56; that it has fewer than a sixth of
    them in common happens once in 100,000 times with 24 half-keys.
    """
    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("halves").alias("ka"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("halves").alias("kb"))
    alike = fits(percent) & (agreement("ka", "kb") >= least)
    return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b").distinct()


def _holders(classes: DataFrame) -> DataFrame:
    """(id, sketch, l, r): the half-keys of each collection that some other class has too.

    A table key can only be shared if both its half-keys are, so others need not be paired.
    """
    halves = classes.select(F.col("rep").alias("id"), F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("half")
    left = F.col("half").bitwiseAND(F.lit(1)) == 0
    kept = (
        halves.join(small(met, met.count()), "half")
        .groupBy("id")
        .agg(F.collect_list(F.when(left, F.col("half"))).alias("l"), F.collect_list(F.when(~left, F.col("half"))).alias("r"))
    )
    sketch = classes.groupBy(F.col("rep").alias("id")).agg(F.first("halves").alias("sketch"))
    return kept.join(sketch, "id")


def _tables(holders: DataFrame, *columns: str) -> DataFrame:
    """The table keys of each holder: every pair of a left and a right half-key."""
    rows = holders.select(*columns, "r", F.explode("l").alias("lk")).select(*columns, "lk", F.explode("r").alias("rk"))
    return rows.select(F.xxhash64("lk", "rk").alias("key"), *columns)


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE, halves: int = HALVES) -> DataFrame:
    """One row per document: (doc_id, text_hash, n_shingles, component_id, kept), text_hash the xxhash64 of its text.

    Documents with equal shingle sets form a class, whose smallest doc_id is a vertex. Vertices that meet in a
    table are linked as similarity.links() says, on full sets of 64-bit shingle hashes. Two similar classes fail to
    meet in any table with probability 1e-4 at most, and to pass the comparison of half-keys with 1e-5.

    A null or empty text, or one without words, has no shingles: it is linked with nothing and stays. So is a
    row with a null doc_id. Rows that repeat a doc_id count as one document, with the links of all its texts.
    Extra columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = scratch.write(docs.mapInArrow(_signer(shingle, halves), _SIGNED), "signed")
    classes = (
        signed.where("cls is not null and doc_id is not null")
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("halves").alias("halves"),
        )
    )
    classes = scratch.write(classes, "classes")
    holders = scratch.write(_holders(classes), "holders")

    def sets_of(members: DataFrame) -> DataFrame:
        wanted = spark.sparkContext.broadcast(bitmap(members, "id"))
        carriers = classes.select(F.col("rep").alias("id"), F.col("cls").alias("class")).join(members, "id")
        sets = docs.drop("text_hash").mapInArrow(_setter(shingle, wanted), "id long, cls string, shingles array<long>")
        sets = sets.join(carriers, "id").where("cls = class").drop("class")
        return scratch.write(sets.dropDuplicates(["id", "cls"]), "sets")

    least = halves // 3
    edges = links(
        holders, _tables, sets_of, percent, least, scratch, lambda pairs: _agreeing(pairs, classes, percent, least)
    )
    roots = components(edges, scratch)
    moved = signed.join(classes.select("cls", "rep"), "cls", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return moved.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
