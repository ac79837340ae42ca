"""Similarity of names as recognition distorts them, in Arrow batches where Spark has no function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that recognition takes for each other, either way, and what replacing one by the other costs.
CONFUSED = {
    "ac": 0.2, "ao": 0.25, "ae": 0.25, "au": 0.3,
    "o0": 0.1, "od": 0.25, "oq": 0.25, "ou": 0.3, "oc": 0.25,
    "l1": 0.1, "li": 0.1, "l|": 0.1, "l!": 0.15, "lt": 0.25, "lj": 0.3, "i1": 0.1,
    "s5": 0.15, "sz": 0.25,
    "z2": 0.15,
    "b8": 0.15, "b6": 0.25, "bd": 0.3,
    "g9": 0.15, "gq": 0.2, "gy": 0.3,
    "ec": 0.2,
    "uv": 0.2,
    "ft": 0.25,
    "pb": 0.3,
}
#: Pairs of letters that look like one, in the order in which they are replaced.
MERGED = (("vv", "w"), ("rn", "m"), ("cl", "d"), ("ph", "f"), ("ri", "n"), ("li", "h"))
_COST = {k: v for (a, b), v in CONFUSED.items() for k in ((a, b), (b, a))}


def seen_form(text: str) -> str:
    """Lower-case letters and digits, with pairs that look like one letter merged."""
    out = re.sub("[^a-z0-9]", "", text.lower())
    for pair, one in MERGED:
        out = out.replace(pair, one)
    return out


def weighted_distance(a: str, b: str) -> float:
    """Edit distance of seen forms in which look-alike letters are cheap to replace."""
    a, b = seen_form(a), seen_form(b)
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else _COST.get((x, y), 1.0)
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + swap)
    return row[-1]


@F.pandas_udf(T.DoubleType())
def ocr_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else weighted_distance(a, b) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.LongType())
def fnv_id(text: pd.Series) -> pd.Series:
    """A positive 31-bit identifier from 32-bit FNV-1a over UTF-16 code units."""

    def one(x):
        if x is None:
            return None
        h = 0x811C9DC5
        for unit in memoryview(x.encode("utf-16-le")).cast("H"):
            h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
        signed = h - (1 << 32) if h >= 1 << 31 else h
        return abs(signed) % 2147483647 or 1

    return text.map(one).astype("Int64")
