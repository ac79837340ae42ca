"""Product codes of vectors, with nearest codebook entries by partial-distance search.

Vectors become integers and are cut into equal parts; every part position has a codebook of its own, which starts from
the vectors of smallest ids and is moved in rounds to the means of the parts nearest to each entry. Everything is
integer arithmetic, so codes don't depend on how rows are dealt to tasks.

The search takes the dimensions of a part in the order of falling variance of its codebook. The entry that is nearest
in the first of them gives each vector a complete distance to start from; from then on masks drop a vector's entries as
soon as the distance that they have gathered exceeds the least complete one. Entries at an equal distance stay, so ties
go to the lowest index. A round needs one pass over the vectors; a task sums what it assigns before anything is
shuffled, so a round's shuffle and what the driver sees of it is one row for each entry and task at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.shared import Scratch
from carelake.shipping import ship

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components are held to this, so that squared distances and sums of a round fit 64 bits.
LARGEST = 1 << 26
#: Vectors that are searched at a time; the first dimension's distances of all entries are held for so many.
BLOCK = 4096
#: Each label's error is joined to its rows in so many shares.
SALTS = 16


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def search(parts: np.ndarray, codebook: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each row of parts the index of the nearest codebook row, the lowest of several, and its squared distance."""
    n, dims = len(parts), parts.shape[1]
    index, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not dims:
        return index, least
    spread = [len(codebook) * int(c @ c) - int(c.sum()) ** 2 for c in codebook.T.astype(object)]
    order = sorted(range(dims), key=lambda d: -spread[d])
    entries = np.ascontiguousarray(codebook[:, order])
    for at in range(0, n, block):
        x = parts[at : at + block][:, order]
        first = (x[:, :1] - entries[None, :, 0]) ** 2
        guess = first.argmin(1)
        best = ((x - entries[guess]) ** 2).sum(1)
        row, entry = np.nonzero(first <= best[:, None])
        gathered = first[row, entry]
        for d in range(1, dims):
            gathered = gathered + (x[row, d] - entries[entry, d]) ** 2
            kept = gathered <= best[row]
            row, entry, gathered = row[kept], entry[kept], gathered[kept]
        # Pairs stand by row, then entry, and each row still has its first guess.
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least[at : at + block] = shortest = np.minimum.reduceat(gathered, begins)
        hits = np.flatnonzero(gathered == shortest[row])
        rows, where = np.unique(row[hits], return_index=True)
        index[at + rows] = entry[hits[where]]
    return index, least


def _integers(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(len(column), width)


def _assigned(batch: pa.RecordBatch, books: np.ndarray):
    """The parts of a batch's vectors, and of each part position the indices and distances of the nearest entries."""
    parts, _, dims = books.shape
    x = _integers(batch.column("embedding"), parts * dims).reshape(batch.num_rows, parts, dims)
    return x, [search(x[:, p], books[p]) for p in range(parts)]


def _summer(shared):
    """One row (part, entry, n, sums) for each entry that a task has assigned something to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, k, dims = books.shape
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, found = _assigned(batch, books)
                for p, (index, _) in enumerate(found):
                    counts[p] += np.bincount(index, minlength=k)
                    np.add.at(sums[p], index, x[:, p])
        p, e = np.nonzero(counts)
        held = pa.FixedSizeListArray.from_arrays(pa.array(sums[p, e].ravel()), dims) if dims else pa.array([[]] * len(p), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), held.cast(pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _coder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = _assigned(batch, shared.value)
            codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
            error = sum(distance for _, distance in found)
            texts = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(error, pa.int64()), batch.column("label")], names=["vec_id", "code", "error", "label"])

    return run


def _moved(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries go to the floored means of their parts, and unused ones stay."""
    sc, dims = kept.sparkSession.sparkContext, books.shape[2]
    shared = sc.broadcast(books)
    found = kept.select("embedding").mapInArrow(_summer(shared), "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    out = books.copy()
    for part, entry, n, *sums in found.groupBy("part", "entry").agg(F.sum("n"), *total).collect():
        out[part, entry] = [int(s) // n for s in sums]
    shared.unpersist()
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that can be coded.

    vectors has vec_id, embedding and label; other columns are ignored. Vectors that are null or hold a null, NaN or
    infinite component are dropped, as are those that can't be cut into equal parts or whose length isn't that of the
    vector with the smallest id (of those with components, if there are any). Where ids repeat, the smaller vector counts first; null ids come last. With fewer vectors
    than entries the codebooks have as many entries as there are vectors; there are at most 256. An empty table gives
    no rows. A vector without components has code 00... and error 0. Components beyond 2 ** 18 in magnitude count as
    that. label_error is null where it doesn't fit a long; null labels are one label.
    """
    spark = vectors.sparkSession
    ship(spark)
    vector = F.col("embedding")
    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector, "label")
    named = named.where(usable(vector) & (F.size(vector) % parts == 0))
    by_id = [F.col("vec_id").asc_nulls_last(), vector]
    leader = named.orderBy(F.size(vector) == 0, *by_id).select("embedding").limit(1).collect()
    if not leader:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = len(leader[0][0])
    kept = named.where(F.size(vector) == width)
    seeds = pa.array([r[0] for r in kept.orderBy(*by_id).select("embedding").limit(entries).collect()], pa.list_(pa.float64()))
    books = _integers(seeds, width).reshape(len(seeds), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _moved(kept, books)
    shared = spark.sparkContext.broadcast(books)
    label = dict(vectors.dtypes)["label"]
    coded = Scratch(spark, "codes").write(kept.mapInArrow(_coder(shared), f"vec_id long, code string, error long, label {label}"), "coded")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    sums = coded.groupBy("label").agg(total).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("share", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).alias("c")
    same = F.expr("c.label <=> s.label and c.share = s.share")
    return rows.join(sums.alias("s"), same).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
