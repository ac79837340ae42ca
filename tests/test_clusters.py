"""Clusters of mentions, against the rules read one after the other."""

import functools
import random

from pyspark.sql import functions as F

from carelake.operators import clusters as C
from carelake.plans import registry

MENTION = (
    "doc_id long, page int, seq long, mention_id string, raw_text string, canonical string, normalized string, generator string, confidence double, "
    "variant string, dosage string, frequency string, times array<string>, duration_days long, quantity long, instructions string, evidence_id string, "
    "line int, engine string, evidence_variant string, bbox array<double>"
)


def _mention(**given):
    base = dict.fromkeys(C.COLUMNS) | {"doc_id": 1, "page": 0, "seq": 0, "generator": "regex", "confidence": 0.9}
    m = base | given
    return tuple(m[c] for c in C.COLUMNS)


def _found(spark, rows):
    return sorted((r.asDict() for r in C.clusters(spark.createDataFrame(rows, MENTION).repartition(3)).collect()), key=lambda r: (r["doc_id"], r["first_seq"], r["page"]))


@functools.cache
def _distance(a, b):
    rows = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return rows[-1][-1]


def _together(a, b):
    if a["evidence_id"] is None or b["evidence_id"] is None or (a["page"] or 0) != (b["page"] or 0):
        return False
    if a["evidence_id"] != b["evidence_id"] and (a["line"], a["evidence_variant"], a["engine"]) != (b["line"], b["evidence_variant"], b["engine"]):
        p, q = a["bbox"], b["bbox"]
        if not p or not q:
            return False
        area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        wide, high = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        if wide <= 0 or high <= 0 or wide * high / min(area(p), area(q)) < 0.4:
            return False
    strength = [(x["dosage"] or "").lower().replace(" ", "") for x in (a, b)]
    return (not all(strength) or strength[0] == strength[1]) and (not a["frequency"] or not b["frequency"] or a["frequency"] == b["frequency"])


def _brute(mentions):
    """Clusters as lists of mention ids, by document, with all pairs compared by the full rules."""
    out = []
    for m in sorted(mentions, key=lambda m: (m["doc_id"], m["seq"], m["mention_id"])):
        for c in out:
            a, b = c["normalized"], m["normalized"]
            longest, shortest = max(len(a), len(b)), min(len(a), len(b))
            named = a == b or (shortest >= 5 and (a.startswith(b) or b.startswith(a)) and shortest / longest >= 0.85) or (longest >= 6 and 1 - _distance(a, b) / longest >= 0.86)
            if c["doc_id"] == m["doc_id"] and named and all(_together(x, m) for x in c["members"]):
                c["members"].append(m)
                if m["canonical"] and len(m["canonical"]) >= len(c["name"]):
                    c["name"], c["normalized"] = m["canonical"], m["normalized"]
                break
        else:
            out.append({"doc_id": m["doc_id"], "members": [m], "name": m["canonical"] or m["raw_text"], "normalized": m["normalized"]})
    return sorted((c["doc_id"], [m["mention_id"] for m in c["members"]], c["name"], c["normalized"]) for c in out)


def test_generators_variants_and_overlapping_boxes_make_one_cluster(spark):
    one = dict(raw_text="Amoxicillin", normalized="amoxicillin", dosage="500mg", frequency="DAILY", line=1)
    rows = [
        _mention(mention_id="m1", evidence_id="ev1", variant="ORIGINAL", bbox=[10.0, 10.0, 50.0, 20.0], engine="a", **one),
        _mention(mention_id="m2", seq=1, evidence_id="ev2", variant="ENHANCED", generator="dictionary", confidence=0.85, bbox=[11.0, 10.0, 49.0, 21.0], engine="b", **one),
    ]
    (found,) = _found(spark, rows)
    assert found["mention_ids"] == ["m1", "m2"] and found["primary_name"] == "Amoxicillin" and found["max_score"] == 0.9
    assert found["generators"] == ["regex", "dictionary"] and found["variants"] == ["ORIGINAL", "ENHANCED"] and found["evidence_ids"] == ["ev1", "ev2"]


def test_other_strengths_schedules_and_untraced_mentions_stay_apart(spark):
    one = dict(raw_text="Amoxicillin", normalized="amoxicillin", line=1, evidence_id="ev1")
    rows = [
        _mention(mention_id="a", dosage="500 mg", **one),
        _mention(mention_id="b", seq=1, dosage="250mg", **one),
        _mention(mention_id="c", seq=2, dosage="500MG", quantity=3, **one),
        _mention(mention_id="d", seq=3, dosage="500MG", quantity=4, **one),
        _mention(mention_id="e", seq=4, **one | {"evidence_id": None}),
        _mention(mention_id="f", seq=5, **one | {"evidence_id": None}),
        _mention(mention_id="g", seq=6, page=1, dosage="500mg", **one),
    ]
    found = _found(spark, rows)
    assert [r["mention_ids"] for r in found] == [["a", "c", "d"], ["b"], ["e"], ["f"], ["g"]]
    assert found[0]["conflicts"] == ["dosage:500 mg vs 500MG", "quantity:3 vs 4"]


def test_same_as_brute_force_on_the_whole_query_and_on_a_hot_document(spark, sf_dir):
    from carelake.plans.extraction import line_mentions

    for mentions in (line_mentions(spark, sf_dir), line_mentions(spark, sf_dir).where("doc_id < 30").withColumn("doc_id", F.lit(1).cast("long"))):
        rows = [r.asDict() for r in mentions.collect()]
        found = C.clusters(mentions).collect()
        assert sorted((r["doc_id"], r["mention_ids"], r["primary_name"], r["normalized_name"]) for r in found) == _brute(rows)
        assert any(len(r["mention_ids"]) > 2 for r in found) and any(r["conflicts"] for r in found)
    assert registry.queries()["mention_clusters"](spark, sf_dir).count() > 0


def test_edits_stop_early_and_equal_the_full_table():
    draw = random.Random(2)
    for _ in range(500):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(9))) for _ in range(2))
        assert C.edits(a, b, 9) == _distance(a, b)
        assert C.edits(a, b, 2) == min(3, _distance(a, b))


def test_empty_table(spark):
    assert C.clusters(spark.createDataFrame([], MENTION)).count() == 0
