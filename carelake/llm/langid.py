"""Language identification with blended-spectrum presence kernels.

Two texts are as similar as the n-grams of 1 to 3 bytes that both contain, k(x, y) = |N(x) & N(y)|, scaled to
k / sqrt(k(x, x) k(y, y)); N(x) holds those n-grams of x that some landmark text has. Nyström features over the
landmarks turn kernel ridge regression, one class against the rest, into a small linear problem. The landmark kernel,
its whitening and the ridge weights fold into one matrix, so a batch of texts is scored by one product of its
presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from carelake.llm import tokens
from carelake.shipping import ship

#: Bounds of the fit: labelled rows in all, shared evenly among languages, and how many of them are landmarks.
SAMPLE_ROWS = 2048
LANDMARKS = 256
RIDGE = 1e-2
UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = 256 + (1 << 16) + (1 << 24)
_BATCH = 64


def _grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: the row of each n-gram that lies within a row, and its code."""
    low = _LOWER[raw].astype(np.int32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    yield row, low
    if len(low) > 1:
        two = (low[:-1] << 8) | low[1:]
        same = row[:-1] == row[1:]
        yield row[:-1][same], two[same] + 256
    if len(low) > 2:
        three = (two[:-1] << 8) | low[2:]
        same = row[:-2] == row[2:]
        yield row[:-2][same], three[same] + 256 + (1 << 16)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, codes): the distinct n-grams of each text."""
    for batch in batches:
        raw, offsets = tokens.text_buffers(batch.column("text"))
        codes = []
        for i in range(batch.num_rows):
            part = raw[offsets[i] : offsets[i + 1]]
            grams = [c for _, c in _grams(part, np.array([0, len(part)]))]
            codes.append(np.unique(np.concatenate(grams)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(codes, pa.list_(pa.int32()))], names=["lang", "codes"]
        )


@dataclass
class LanguageModel:
    """Languages, the n-grams of the landmarks and their weights for each language."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scorer(self):
        """A mapInArrow function from rows with a text to the same rows, with lang_pred and score in place of the text."""
        languages, codes, weights, bias = self.languages, self.codes, self.weights, self.bias

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            column = np.full(_CODES, len(codes), np.int32)
            column[codes] = np.arange(len(codes), dtype=np.int32)
            for batch in batches:
                texts = batch.column("text")
                raw, offsets = tokens.text_buffers(texts)
                letters = np.array([any(c.isalpha() for c in x or "") for x in texts.to_pylist()], bool)
                best, value = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                for at in range(0, batch.num_rows if languages else 0, _BATCH):
                    end = min(batch.num_rows, at + _BATCH)
                    present = np.zeros((end - at, len(codes) + 1), np.float32)
                    for lo, hi in tokens.slices(offsets[at : end + 1], 1 << 20):
                        a, b = offsets[at + lo], offsets[at + hi]
                        for row, code in _grams(raw[a:b], offsets[at + lo : at + hi + 1] - a):
                            present[row + lo, column[code]] = 1
                    present = present[:, :-1]
                    norm = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
                    margin = (present @ weights) / norm + bias
                    best[at:end] = margin.argmax(axis=1)
                    value[at:end] = margin.max(axis=1)
                known = letters & bool(languages)
                names = [languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
                points = np.where(known, np.clip((value + 1) / 2, 0, 1), 0.0)
                others = [x for x in batch.schema.names if x != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x) for x in others), pa.array(names, pa.string()), pa.array(points)],
                    names=[*others, "lang_pred", "score"],
                )

        return score


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """Fit on (doc_id, lang, text) rows: at most sample_rows of them, as many of each language, taken by hash.

    Of more languages than sample_rows only the most frequent are learned.
    """
    labelled = labelled.where("lang is not null and text is not null").select(
        "lang", "text", (F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
    )
    counts = labelled.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang")
    counts = [tuple(r) for r in counts.limit(sample_rows).collect()]
    if not counts:
        return LanguageModel([], np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    quota = max(1, sample_rows // len(counts))
    # A first cut by hash leaves each language about twice its quota, however many rows it has.
    known = F.broadcast(labelled.sparkSession.createDataFrame(counts, "lang string, rows long"))
    near = labelled.join(known, "lang").where(F.col("draw") * F.col("rows") < 2.0 * quota + 50)
    order = W.Window.partitionBy("lang").orderBy("draw", "text")
    taken = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota).select("lang", "text")
    return _solve(taken.mapInArrow(_presence, "lang string, codes array<int>").toPandas(), landmarks, ridge)


class Landmarks:
    """The n-grams of landmark texts, each with the landmarks that have it."""

    def __init__(self, texts: list[np.ndarray]):
        grams = np.concatenate([np.zeros(0, np.int32), *texts])
        of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        order = np.argsort(grams, kind="stable")
        self.n, self.of = len(texts), of[order]
        self.codes, self.first = np.unique(grams[order], return_index=True)
        self.first = np.append(self.first, len(grams))

    def kernel(self, text: np.ndarray) -> tuple[np.ndarray, int]:
        """How many n-grams a text shares with each landmark, and with any."""
        at = np.minimum(np.searchsorted(self.codes, text), max(len(self.codes) - 1, 0))
        at = at[self.codes[at] == text] if len(self.codes) else at[:0]
        size = self.first[at + 1] - self.first[at]
        ends = np.cumsum(size)
        place = np.arange(int(size.sum())) - np.repeat(ends - size, size) + np.repeat(self.first[at], size)
        return np.bincount(self.of[place], minlength=self.n).astype(np.float64), len(at)

    def fold(self, weights: np.ndarray) -> np.ndarray:
        """Weights of landmarks as weights of their n-grams."""
        out = np.zeros((len(self.codes), weights.shape[1]))
        np.add.at(out, np.repeat(np.arange(len(self.codes)), np.diff(self.first)), weights[self.of])
        return out.astype(np.float32)


def _solve(sample, landmarks: int, ridge: float) -> LanguageModel:
    """Ridge regression on Nyström features. Memory follows the sample's n-grams; no matrix is texts by n-grams."""
    languages = sorted(set(sample["lang"]))
    turn = sample.groupby("lang").cumcount()
    sample = sample.iloc[np.lexsort((sample["lang"], turn))]  # languages take turns, so landmarks hold each of them
    texts = [np.asarray(x, np.int32) for x in sample["codes"]]
    marks = Landmarks(texts[:landmarks])
    shared = [marks.kernel(x) for x in texts]
    norm = np.sqrt(np.maximum([n for _, n in shared], 1))
    kernel = np.array([k for k, _ in shared]) / norm[:, None] / norm[None, : marks.n]
    values, vectors = np.linalg.eigh(kernel[: marks.n])
    inverse_root = vectors / np.sqrt(np.maximum(values, 1e-8)) @ vectors.T
    features = kernel @ inverse_root
    wanted = np.where(sample["lang"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    bias = wanted.mean(axis=0)
    gram = features.T @ features + ridge * len(sample) / 100 * np.eye(marks.n)
    w = inverse_root @ np.linalg.solve(gram, features.T @ (wanted - bias))
    return LanguageModel(languages, marks.codes, marks.fold(w / norm[: marks.n, None]), bias.astype(np.float32))


def held_out(docs: DataFrame, folds: int = 4, fold: int = 2) -> F.Column:
    """Whether crc32 of the id as text falls into the fold that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def _model_of(docs: DataFrame, sample_rows: int, landmarks: int) -> LanguageModel:
    ship(docs.sparkSession)
    return fit(docs.where(~held_out(docs) & F.col("doc_id").isNotNull()), sample_rows, landmarks)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score).

    The model learns from the text and non-null lang of documents that are not held out (nor without an id), and
    predicts from whole texts alone. score is (margin + 1) / 2 of the winning class, within 0 to 1. A null text, or
    one without any letter, is `und` with score 0, as is everything where no row is labelled. Ties go to the first
    language in order. Repeated rows each give a row; extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = _model_of(docs, sample_rows, landmarks)
    return docs.select("doc_id", held_out(docs).alias("held_out"), "text").mapInArrow(
        model.scorer(), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def annotate(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """Each row as a struct `doc`, with lang_pred and score as identify() has them; rows are not matched by id."""
    model = _model_of(docs.select("doc_id", "text", "lang"), sample_rows, landmarks)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    schema = T.StructType([rows.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(model.scorer(), schema)
