"""Mixing sources to target weights.

The words of each source are packed into blocks of fixed length. Each output shard draws how many of its slots
go to each source from a multinomial. The slots of a source are numbered over all shards and mapped through the
source's pseudorandom permutation of block indices, and blocks are joined by index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.llm import tokens
from carelake.llm.shared import Scratch
from carelake.shipping import ship

BLOCK_WORDS = 64
BUCKET_WORDS = 1 << 16
SHARD_SLOTS = 4096
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20240131


def water_fill(sizes: list[int], weights: list[int], most: int = MOST_REPEATS) -> list[float]:
    """Shares of the total by weight, none above most times its size; excess goes to the others by weight."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    left, open_ = total, list(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 for each key: a Feistel network with cycle walking."""
    out = index.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))) / 2 + 0.5).astype(np.uint64))
    mask = (np.uint64(1) << half) - np.uint64(1)
    walking = np.ones(len(out), bool)
    while walking.any():
        at = np.flatnonzero(walking)
        left, right = out[at] >> half[at], out[at] & mask[at]
        for turn in range(4):
            with np.errstate(over="ignore"):
                f = tokens.mix(right + key[at] + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15)) & mask[at]
            left, right = right, left ^ f
        out[at] = (left << half[at]) | right
        walking[at] = out[at] >= size[at].astype(np.uint64)
    return out.astype(np.int64)


def n_words(text: str) -> Column:
    """Words of a text: maximal runs of other characters than space and \\x09-\\x0D; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_sum(df: DataFrame, key: str, order: str, value: str, out: str, chunk: int = 1024) -> DataFrame:
    """Sum of value over rows of lower order within a key, for a dense integer order: by chunks, then within."""
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    sums = df.groupBy(key, "_chunk").agg(F.sum(value).alias("_sum"))
    before = W.Window.partitionBy(key).orderBy("_chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select(key, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = W.Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return df.join(sums, [key, "_chunk"]).withColumn(out, F.col(out) + F.col("_base")).drop("_chunk", "_base")


@dataclass
class Mix:
    """What a mix consists of.

    slots: (shard, slot, source, block); pieces: (row, doc_id, source, block, start, words), the word ranges of
    documents that a block holds; taken: one row per document.
    """

    slots: DataFrame
    pieces: DataFrame
    taken: DataFrame

    def shards(self) -> DataFrame:
        """(shard, slot, doc_id, start, words): what each slot of each output shard is to contain."""
        return self.slots.join(self.pieces, ["source", "block"]).select("shard", "slot", "doc_id", "start", "words")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Mix:
    """Mix documents so that each source's words come near its target.

    A document's size is its number of words; null and empty texts have none and are never taken. Sources are
    ordered by code point, null last and counting as a source of its own, and weigh 1, 2, 3, 1, ... Targets share
    the total of sizes; none exceeds three times its source's size, so no block is used more than three times and
    no document exceeds three times its size. Draws depend on the seed and on ids and sizes alone, so reruns
    agree. Repeated rows each count. Extra columns are ignored; an empty table gives an empty mix.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mix")
    sized = scratch.write(
        docs.select("doc_id", "source", n_words("text").alias("size")).withColumn("row", F.monotonically_increasing_id()),
        "sized",
    )
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in rows]
    targets = water_fill(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    sources = spark.createDataFrame(
        [(i, r["source"], int(r["size"]), t) for i, (r, t) in enumerate(zip(rows, targets))],
        "sid int, name string, source_size long, target double",
    )
    known = sized.join(sources, sized.source.eqNullSafe(sources.name)).select(
        "row", "doc_id", "sid", "size", "source_size", "target"
    )
    full = known.where("size > 0").withColumn(
        "bucket",
        F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("source_size") / BUCKET_WORDS).cast("long")),
    )
    order = W.Window.partitionBy("sid", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "row")
    full = full.withColumn("end", F.sum("size").over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    full = scratch.write(full.withColumn("begin", F.col("end") - F.col("size")), "full")
    buckets = full.groupBy("sid", "bucket").agg(F.max("end").alias("w"))
    buckets = buckets.withColumn("blocks", F.ceil(F.col("w") / block_words).cast("long"))
    buckets = running_sum(buckets, "sid", "bucket", "blocks", "base")
    b = F.lit(block_words)
    pieces = (
        full.join(buckets.select("sid", "bucket", "base"), ["sid", "bucket"])
        .withColumn("k", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("end") - 1) / b))))
        .withColumn("from", F.greatest("begin", F.col("k") * b))
        .select(
            "row",
            "doc_id",
            F.col("sid").alias("source"),
            (F.col("base") + F.col("k")).alias("block"),
            (F.col("from") - F.col("begin")).alias("start"),
            (F.least("end", (F.col("k") + 1) * b) - F.col("from")).alias("words"),
        )
    )
    blocks = np.zeros(len(rows), np.int64)
    for r in buckets.groupBy("sid").agg(F.sum("blocks").alias("n")).collect():
        blocks[r["sid"]] = r["n"]
    slots = _slots(spark, np.array(sizes, np.int64), np.array(targets), blocks, seed, scratch)
    uses = slots.groupBy("source", "block").agg(F.count("*").alias("uses"))
    sums = pieces.join(uses, ["source", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("t"))
    taken = known.join(sums, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("t", F.lit(0)).alias("taken")
    )
    return Mix(slots, pieces, taken)


def _slots(spark, sizes, targets, blocks, seed: int, scratch: Scratch) -> DataFrame:
    """Every slot of every shard with its source and block.

    Draws that exceed a source's quota of slots go to sources that were drawn too rarely, in order, so each
    source ends with exactly its quota.
    """
    share = np.divide(targets, np.maximum(sizes, 1))
    quota = np.minimum(np.rint(share * blocks).astype(np.int64), MOST_REPEATS * blocks)
    total = int(quota.sum())
    shards = -(-total // SHARD_SLOTS)
    p = quota / max(total, 1)

    def draw(frames):
        for frame in frames:
            out = []
            for shard in frame["id"]:
                n = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
                drawn = np.random.default_rng([seed, shard]).multinomial(n, p)
                for s in np.flatnonzero(drawn):
                    out.append((shard, s, drawn[s], drawn[:s].sum()))
            yield pd.DataFrame(out, columns=["shard", "sid", "n", "at"])

    drawn = scratch.write(spark.range(shards).mapInPandas(draw, "shard long, sid int, n long, at long"), "drawn")
    counts = np.zeros(len(quota), np.int64)
    for r in drawn.groupBy("sid").agg(F.sum("n").alias("n")).collect():
        counts[r["sid"]] = r["n"]
    over = np.concatenate(([0], np.cumsum(np.maximum(counts - quota, 0))))
    under = np.concatenate(([0], np.cumsum(np.maximum(quota - counts, 0))))
    keys = tokens.stream(seed & 0xFFFFFF, len(quota))

    def place(frames):
        for frame in frames:
            if not len(frame):
                continue
            n = frame["n"].to_numpy()
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sid = np.repeat(frame["sid"].to_numpy(), n)
            j = np.repeat(frame["first"].to_numpy(), n) + step
            extra = np.flatnonzero(j >= quota[sid])
            g = over[sid[extra]] + j[extra] - quota[sid[extra]]
            to = np.searchsorted(under, g, "right") - 1
            sid[extra], j[extra] = to, counts[to] + g - under[to]
            block = permute(j % blocks[sid], blocks[sid], keys[sid])
            yield pd.DataFrame(
                {
                    "shard": np.repeat(frame["shard"].to_numpy(), n),
                    "slot": np.repeat(frame["at"].to_numpy(), n) + step,
                    "source": sid,
                    "block": block,
                }
            )

    first = running_sum(drawn, "sid", "shard", "n", "first")
    first = first.select("shard", "sid", "n", "at", "first")
    return first.mapInPandas(place, "shard long, slot long, source int, block long")
