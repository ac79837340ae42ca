"""Leader clustering of mentions: each joins the first cluster with all of whose members it can stand for one medicine."""

from __future__ import annotations

import functools
import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.operators.folds import folded

COLUMNS = (
    "doc_id", "page", "seq", "mention_id", "raw_text", "canonical", "normalized", "generator", "confidence", "variant", "dosage", "frequency",
    "times", "duration_days", "quantity", "instructions", "evidence_id", "line", "engine", "evidence_variant", "bbox",
)
SCHEMA = (
    "doc_id long, page int, first_seq long, cluster_id string, normalized_name string, primary_name string, mention_ids array<string>, dosage string, "
    "frequency string, times array<string>, duration_days long, quantity long, instructions string, max_score double, generators array<string>, "
    "variants array<string>, evidence_ids array<string>, conflicts array<string>"
)
#: Least shares of letters for prefixes and edits, and of the smaller box for overlaps.
PREFIX_SHARE, EDIT_SHARE, BOX_SHARE = 0.85, 0.86, 0.4


@functools.lru_cache(1 << 16)
def edits(a: str, b: str, most: int) -> int:
    """The Levenshtein distance, or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def same_name(a: str | None, b: str | None) -> bool:
    if a == b:
        return True
    if not a or not b:
        return False
    short, long = sorted((len(a), len(b)))
    if short >= 5 and (a.startswith(b) or b.startswith(a)) and short / long >= PREFIX_SHARE:
        return True
    return long >= 6 and 1 - edits(a, b, 1 + int(long * (1 - EDIT_SHARE))) / long >= EDIT_SHARE


def _overlap(a, b) -> bool:
    if not a or not b or len(a) != 4 or len(b) != 4:
        return False
    shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    least = min(max(0, x[2] - x[0]) * max(0, x[3] - x[1]) for x in (a, b))
    return shared > 0 and least > 0 and shared / least >= BOX_SHARE


def compatible(a: dict, b: dict) -> bool:
    """Whether two mentions of a page stand at one place, with no other strength and no other frequency."""
    if a["evidence_id"] is None or b["evidence_id"] is None:
        return False
    near = (
        a["evidence_id"] == b["evidence_id"]
        or all(a[k] == b[k] for k in ("line", "evidence_variant", "engine"))
        or _overlap(a["bbox"], b["bbox"])
    )
    if not near:
        return False
    if a["dosage"] and b["dosage"] and "".join(a["dosage"].lower().split()) != "".join(b["dosage"].lower().split()):
        return False
    return not (a["frequency"] and b["frequency"] and a["frequency"] != b["frequency"])


class Leaders:
    """The clusters of one page of a document, in the order of their first mentions."""

    def __init__(self, *_):
        self.clusters: list[dict] = []

    def add(self, *values):
        m = dict(zip(COLUMNS, values))
        for cluster in self.clusters:  # names come last, as edits cost most
            if all(compatible(x, m) for x in cluster["members"]) and same_name(cluster["normalized"], m["normalized"]):
                self._join(cluster, m)
                return ()
        self.clusters.append(
            {
                "doc_id": m["doc_id"], "page": m["page"], "seq": m["seq"], "normalized": m["normalized"], "name": m["canonical"] or m["raw_text"],
                "members": [m], "times": m["times"] or [], "score": m["confidence"], "generators": [m["generator"]],
                "variants": [m["variant"] or "ORIGINAL"], "evidence": [m["evidence_id"]] if m["evidence_id"] is not None else [], "conflicts": [],
                **{k: m[k] if m[k] != "" else None for k in ("dosage", "frequency", "duration_days", "quantity", "instructions")},
            }
        )
        return ()

    def _join(self, cluster: dict, m: dict) -> None:
        cluster["members"].append(m)
        for held, value in (("generators", m["generator"]), ("variants", m["variant"]), ("evidence", m["evidence_id"])):
            if value and value not in cluster[held]:
                cluster[held].append(value)
        for key, told in (("dosage", "dosage"), ("frequency", "frequency"), ("duration_days", "durationDays"), ("quantity", "quantity"), ("instructions", "instructions")):
            if m[key] is None or m[key] == "":
                continue
            if cluster[key] is None:
                cluster[key] = m[key]
            elif cluster[key] != m[key]:
                conflict = f"{told}:{cluster[key]} vs {m[key]}"
                if conflict not in cluster["conflicts"]:
                    cluster["conflicts"].append(conflict)
        cluster["times"] = cluster["times"] or m["times"] or []
        cluster["score"] = max(cluster["score"], m["confidence"])
        if m["canonical"] and len(m["canonical"]) >= len(cluster["name"]):
            cluster["name"], cluster["normalized"] = m["canonical"], m["normalized"]

    def done(self):
        return [_row(c) for c in self.clusters]


def _row(c: dict) -> tuple:
    signed = {"name": c["normalized"], "evidence": sorted(c["evidence"]), "dosage": c["dosage"] or "", "frequency": c["frequency"] or "", "variants": sorted(c["variants"])}
    told = hashlib.sha256(json.dumps(signed, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    return (
        c["doc_id"], c["page"], c["seq"], told, c["normalized"], c["name"], [m["mention_id"] for m in c["members"]], c["dosage"], c["frequency"], c["times"],
        c["duration_days"], c["quantity"], c["instructions"], c["score"], c["generators"], c["variants"], c["evidence"], c["conflicts"],
    )


def clusters(mentions: DataFrame) -> DataFrame:
    """One row for each cluster of mentions (COLUMNS), whose first_seq orders the clusters of a document.

    Mentions are taken by seq, then id. Those of different pages are never together, so a page of a document is folded
    on its own; a null page is page 0. One without evidence joins no cluster and is joined by none, so it needs no fold
    and a document of many such mentions is no large group. A confidence that is null counts as 0.
    """
    rows = mentions.select(*[F.col(c) for c in COLUMNS])
    rows = rows.withColumns({"page": F.coalesce("page", F.lit(0)), "confidence": F.coalesce("confidence", F.lit(0.0))})
    own = F.when(F.col("evidence_id").isNull(), F.col("mention_id"))
    return folded(rows.withColumn("own", own), ["doc_id", "page", "own"], [F.col("seq"), F.col("mention_id")], Leaders, SCHEMA)
