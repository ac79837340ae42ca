"""Benchmark decontamination with spaced seeds.

Each mask looks at some token positions of a window and ignores the others, so a hit survives substituted words.
Hashes of training windows are joined with those of the benchmark; each hit names a diagonal (the shift between a
document and an item). On diagonals with two hits the aligned words are then compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm import tokens
from carelake.llm.shared import Scratch, bit_filter, bitmap, in_bitmap, within
from carelake.shipping import ship

#: Masks of weight 4, found by search. Of all runs of 8 to 16 words with at least 8 equal ones, three in four or more,
#: each is hit at least twice, wherever its other words stand; so are longer runs, which hold such ones.
MASKS = ("11011", "11000011", "101000101")
HITS = 2
#: The two hits of a run begin within so many words of each other.
NEAR = 16
MIN_WORDS = 8
PERCENT = 75


def seeds(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of each window of words under a mask; entry i is the window that starts at word i."""
    picked = [j for j, x in enumerate(mask) if x == "1"]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in picked:
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        return tokens.mix(out)


def _crowded(at: np.ndarray) -> np.ndarray:
    """Which positions have another one within NEAR of them."""
    order = np.argsort(at, kind="stable")
    near = np.diff(at[order]) <= NEAR
    out = np.zeros(len(at), bool)
    out[order] = np.append(near, False) | np.insert(near, 0, False)
    return out


def _seeder(key: str, masks, present, lengths: tuple[int, ...]):
    """A mapInArrow function from texts to (key, pos, weight, hash) rows, of windows that the filter lets through.

    lengths are the word counts of benchmark items that are too short for the masks; those are sought whole, and
    such a hit weighs as much as all that are wanted. Of the others, lone ones are left out.
    """

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if present is None else present.value
        for batch in batches:
            raw, offsets = tokens.text_buffers(batch.column("text"))
            for lo, hi in tokens.slices(offsets):
                words, first = tokens.word_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

                def met(h: np.ndarray, span: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
                    """Windows within one row that the filter lets through; of the benchmark, all or whole rows."""
                    at = np.arange(len(h)) if bits is None else np.flatnonzero(in_bitmap(bits, h))
                    row = np.searchsorted(first, at, "right") - 1
                    inside = at + span <= first[row + 1] if len(at) else at > 0
                    if whole and bits is None:
                        inside = inside & (first[row + 1] - first[row] == span)
                    return at[inside], h[at[inside]]

                each = [met(seeds(words, mask, salt), len(mask)) for salt, mask in enumerate(masks)]
                at, h = (np.concatenate(x) for x in zip(*each))
                if bits is not None:
                    keep = _crowded(at)
                    at, h = at[keep], h[keep]
                short = [met(tokens.window_hashes(words, n), n, True) for n in lengths]
                weight = np.repeat(np.array([1, HITS], np.int32), [len(at), sum(len(x) for x, _ in short)])
                at, h = np.concatenate([at, *(x for x, _ in short)]), np.concatenate([h, *(x for _, x in short)])
                row = np.searchsorted(first, at, "right") - 1
                keys = batch.column(key).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(at - first[row]), pa.array(weight), pa.array(h.view(np.int64))],
                    names=[key, "pos", "weight", "hash"],
                )

    return seed


def aligned_region(doc: np.ndarray, item: np.ndarray, shift: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """The run of item positions on a diagonal with the most equal words: (first, end, equal words).

    At least percent of a run's words are equal, and its first and last ones are. Equal words add 100 - percent and
    others take percent away, so such runs are those whose sum isn't negative; for each end, the earliest start with
    no larger a sum before it gives the longest.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if lo >= hi:
        return 0, 0, 0
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    total = np.concatenate(([0], np.cumsum(np.where(same, 100 - percent, -percent))))
    equal = np.concatenate(([0], np.cumsum(same)))
    starts = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(equal - equal[starts]))
    inside = np.flatnonzero(same[starts[end] : end])
    if not len(inside):
        return 0, 0, 0
    first = lo + int(starts[end])
    return first + int(inside[0]), first + int(inside[-1]) + 1, len(inside)


_FOUND = ["doc_start", "doc_end", "item_start", "n_equal", "item_words"]


def _verifier(percent: int, min_words: int):
    """A mapInArrow function over (row, doc_id, text_hash, item_id, shifts, text, item) to verified overlaps."""

    def words(text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return tokens.word_hashes(raw, np.array([0, len(raw)]))[0]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc = None, None
        for batch in batches:
            at, found = [], []
            columns = (batch.column(c).to_pylist() for c in ("row", "shifts", "item"))
            for i, (row, shifts, item_text) in enumerate(zip(*columns)):
                if row != last:  # the items of a document follow each other
                    last, doc = row, words(batch.column("text")[i].as_py())
                item = words(item_text)
                runs = ((*aligned_region(doc, item, s, percent), s) for s in sorted(shifts))
                start, end, same, shift = max(runs, key=lambda r: r[2])
                if same >= min(min_words, len(item)) and same:
                    at.append(i)
                    found.append((start + shift, end + shift, start, same, len(item)))
            kept = batch.select(["doc_id", "text_hash", "item_id"]).take(pa.array(at, pa.int64()))
            numbers = [pa.array(x, pa.int64()) for x in zip(*found)] if found else [pa.array([], pa.int64())] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([*kept.columns, *numbers], names=[*kept.schema.names, *_FOUND])

    return verify


def contaminated(
    docs: DataFrame, benchmark: DataFrame, masks=MASKS, percent: int = PERCENT, min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per document and benchmark item that overlap: word ranges and the number of equal words.

    An overlap is a run of aligned words, on one diagonal, of which at least percent are equal; it counts from
    min_words equal words on, or from the whole item where that is shorter. Words are compared with A-Z
    lower-cased. Null, empty and wordless texts overlap with nothing; nor does anything with an empty benchmark.
    Rows with the same doc_id and text give one row, other rows of that doc_id their own; text_hash, the xxhash64
    of the text, tells them apart. A null doc_id or item_id is reported as null. Extra columns are ignored. Only
    bit filters of fixed size are broadcast, whatever the tables; they only spare rows, and the joins decide.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "leaks")
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id", "text").alias("row"), "text")
    benchmark = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").distinct()
    # Items that the longest mask does not fit; their distinct word counts are fewer than its span.
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    short = benchmark.select(n_words.alias("n")).where(F.col("n").between(1, max(len(m) for m in masks) - 1)).distinct()
    lengths = tuple(sorted(r["n"] for r in short.collect()))
    wanted = benchmark.mapInArrow(_seeder("item", masks, None, lengths), "item long, pos long, weight int, hash long")
    wanted = scratch.write(wanted, "seeds")
    present = spark.sparkContext.broadcast(bitmap(wanted, "hash"))
    asked = docs.select("row", "text").mapInArrow(
        _seeder("row", masks, present, lengths), "row long, pos long, weight int, hash long"
    )
    hits = (
        asked.drop("weight")
        .join(wanted.withColumnRenamed("pos", "item_pos"), "hash")
        .groupBy("row", "item", (F.col("pos") - F.col("item_pos")).alias("shift"))
        .agg(F.sum("weight").alias("weight"))
        .where(F.col("weight") >= HITS)
        .groupBy("row", "item")
        .agg(F.collect_list("shift").alias("shifts"))
    )
    hits = scratch.write(hits, "hits")
    texts = within(docs, "row", bit_filter(hits, "row")).distinct()
    pairs = (
        hits.join(benchmark.select("item", "item_id", F.col("text").alias("item_text")), "item")
        .join(texts, "row")
        .select("row", "doc_id", "text_hash", "item_id", "shifts", "text", F.col("item_text").alias("item"))
    )
    schema = "doc_id long, text_hash long, item_id long, " + ", ".join(f"{c} long" for c in _FOUND)
    return pairs.mapInArrow(_verifier(percent, min_words), schema)
