"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies.

Every prefix of a byte string has exactly one last token, and what stands before it is encoded as that shorter prefix
is; a token can be the last one where the pair that it makes with the last token before it is left alone by the merges.
So one pass of dynamic programming over a piece gives the count of each of its prefixes, from those of shorter ones.

Texts are first cut into units, each white space with what it precedes, such that a prefix's tokens are those of the
whole units in it and those of the cut unit's prefix. The rules of the split at the end of a text (white space stays
together there, contractions need all their letters, control strings too) are followed inside the cut unit, so every
count is that of the prefix encoded on its own. Units are computed once in a worker and kept.

What is stored of a text is the change of the count with each character. Truncation and budgets are answered from it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from carelake.shipping import ship

LIMIT = 1024
#: Entries of a worker's caches of units and of pairs of tokens, some 100 bytes each; a full cache starts anew.
CACHED, CACHED_PAIRS = 1 << 18, 1 << 19
#: Units of more characters aren't kept.
LONG_UNIT = 64
STEP = "<i2"

_SPLIT = r"\s*(?:(?<! )'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+"
_LATE = ("'re", "'ve", "'ll")


def _byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of a vocabulary file's contents: BPE on bytes with the usual split and plain control strings.

    Other files are refused with a ValueError, since their prefixes follow other rules.
    """

    def __init__(self, spec: str):
        told = json.loads(spec)
        model, split, added = told["model"], told["pre_tokenizer"] or {}, told["added_tokens"]
        plain = ("single_word", "lstrip", "rstrip", "normalized")
        wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        unusual = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if told["normalizer"] or unusual or model["type"] != "BPE" or any(split.get(k, True) != v for k, v in wanted.items()) or any(a[k] for a in added for k in plain):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.control = [a["content"] for a in added]
        if any(a != b and a in b for a in self.control for b in self.control):
            raise ValueError("control strings that contain others")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.vocabulary = {as_bytes(t) for t in model["vocab"] if t not in self.control}
        self.endings = {t[i:] for t in self.vocabulary for i in range(len(t))}
        self._after: dict[bytes, dict[bytes, bool]] = {}
        self._known = 0
        self._units: dict[str, bytes] = {}
        self._find = regex.compile(_SPLIT).findall
        self._space = regex.compile(r"\s*").match
        self._cut = regex.compile("|".join(map(regex.escape, self.control))).finditer if self.control else None

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of a few bytes, by merging the pair of lowest rank again and again."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks)
        ranks = [self.ranks.get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (rank := min(ranks)) < none:
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ranks[at : at + 1] = []
            for i in (at - 1, at):
                if 0 <= i < len(ranks):
                    ranks[i] = self.ranks.get((parts[i], parts[i + 1]), none)
        return parts

    def _follows(self, before: bytes, token: bytes) -> bool:
        """Whether token can be the next one after `before`, or the first one."""
        if self._known >= CACHED_PAIRS:
            self._after, self._known = {}, 0
        found = self.merged(before + token) == ([before, token] if before else [token])
        self._after.setdefault(before, {})[token] = found
        self._known += 1
        return found

    def counts(self, piece: bytes) -> list[int]:
        """The token count of each prefix of a piece's bytes, the empty one first."""
        vocabulary = self.vocabulary
        count, last, after = [0], [b""], [self._after.setdefault(b"", {})]
        for end in range(1, len(piece) + 1):
            for begin in range(end - 1, -1, -1):
                token = piece[begin:end]
                fits = after[begin].get(token)
                if fits is None:
                    if token in vocabulary:
                        fits = self._follows(last[begin], token)
                    elif token not in self.endings:
                        raise ValueError("bytes that the vocabulary can't spell")
                if fits:
                    break
            count.append(count[begin] + 1)
            last.append(token)
            after.append(self._after.setdefault(token, {}))
        return count

    def _at_letters(self, piece: str) -> list[int]:
        """The count after each character of a piece."""
        count = self.counts(piece.encode())
        return count[1:] if len(count) == len(piece) + 1 else [count[e] for e in accumulate(len(c.encode()) for c in piece)]

    def _unit(self, unit: str) -> bytes:
        """The changes of the count with each character of a unit."""
        space = self._space(unit).group()
        body = unit[len(space) :]
        if space == " ":  # the usual case, where all is one piece
            out = self._at_letters(unit)
        else:
            out = self._at_letters(space) if space else []
        if body and space != " ":
            taken = space[-1:] if space[-1:] == " " else ""
            lone = [space[:-1]] if taken else [space[:-1], space[-1:]]
            base = sum(self._at_letters(x)[-1] for x in lone if x)
            within = self._at_letters(taken + body)[len(taken) :]
            if not taken and body in _LATE:
                within[1] = within[0] + self._at_letters(body[1])[-1]
            out = out + [base + n for n in within]
        return array("h", [b - a for a, b in zip([0, *out], out)]).tobytes()

    def _plain_steps(self, text: str) -> bytes:
        units, found = self._units, []
        for unit in self._find(text):
            steps = units.get(unit)
            if steps is None:
                steps = self._unit(unit)
                if len(unit) <= LONG_UNIT:
                    if len(units) >= CACHED:
                        units.clear()
                    units[unit] = steps
            found.append(steps)
        return b"".join(found)

    def steps(self, text: str) -> bytes:
        """The change of the count with each character of a text, as 16-bit integers; a count is their running sum."""
        cuts = list(self._cut(text)) if self._cut and any(c in text for c in self.control) else ()
        out, at = [], 0
        for cut in cuts:
            # Until its last character a control string is ordinary text behind the text before it.
            within = np.frombuffer(self._plain_steps(text[at : cut.end() - 1]), STEP)
            ahead = int(within[cut.start() - at :].sum())
            out += [within.tobytes(), np.array([1 - ahead], STEP).tobytes()]
            at = cut.end()
        return b"".join([*out, self._plain_steps(text[at:])])


def running(steps: bytes) -> np.ndarray:
    """The counts after 0, 1, 2... characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, STEP), dtype=np.int64)])


def longest(counts: np.ndarray, limit: int) -> int:
    """The length of the longest prefix of at most so many tokens. Counts don't always rise, so a longer one may fit."""
    return int(np.flatnonzero(counts <= limit)[-1]) if limit >= 0 else 0


_counters: dict[int, PrefixCounter] = {}


def _counter(spec: str) -> PrefixCounter:
    """The counter of a vocabulary, made once in a worker so that its caches last."""
    if hash(spec) not in _counters:
        _counters.clear()
        _counters[hash(spec)] = PrefixCounter(spec)
    return _counters[hash(spec)]


def _teller(shared, limit: int, store: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            steps = [counter.steps(t) for t in texts]
            counts = [running(s) for s in steps]
            total = pa.array([int(c[-1]) for c in counts], pa.int64())
            out = {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": total,
                "over_limit": pa.array([int(c[-1]) > limit for c in counts], pa.bool_()),
                "fit_chars": pa.array([longest(c, limit) for c in counts], pa.int64()),
            } | ({"steps": pa.array(steps, pa.binary())} if store else {})
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def token_prefixes(docs: DataFrame, vocabulary: str, limit: int = LIMIT, store: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars, steps) of each document.

    vocabulary is the path of a tokenizer file on the driver, which sends its contents (a few MB) to the workers.
    Counts are without begin, end or added special tokens; control strings inside texts are one token each. fit_chars
    is the length in characters of the longest prefix with at most `limit` tokens. steps holds the count of every
    prefix, for at() and cut(); without store it isn't handed on. A null text counts as empty, repeated rows give a row
    each, an empty table gives no rows, and other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + (", steps binary" if store else "")
    return docs.select("doc_id", "text").mapInArrow(_teller(shared, limit, store), schema)


def _told(ask):
    """A column function of stored steps and a number, null where either is null."""

    def tell(steps: pa.Array, numbers: pa.Array) -> pa.Array:
        pairs = zip(steps.to_pylist(), numbers.to_pylist())
        return pa.array([None if s is None or k is None else ask(running(s), k) for s, k in pairs], pa.int64())

    return F.arrow_udf(tell, LongType())


def at(steps: Column, chars: Column) -> Column:
    """The token count of the first so many characters, from stored steps; null where either is null."""
    return _told(lambda counts, k: int(counts[max(0, min(k, len(counts) - 1))]))(steps, chars.cast("long"))


def cut(steps: Column, limit: Column) -> Column:
    """The length of the longest prefix with at most so many tokens, from stored steps; null where either is null."""
    return _told(longest)(steps, limit.cast("long"))
