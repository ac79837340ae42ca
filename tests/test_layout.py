"""Page layout against rules that are applied page by page, and on pages that hold most boxes."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from carelake.operators import layout as L
from carelake.plans import layout as P

BOX = "page long, seq long, box_id string, text string, confidence double, bbox array<double>"
SPOT = "page long, box_id long, confidence double, cx double, cy double, page_height int"


def _kept(boxes, height):
    tol, kept = max(16, int(height * 0.016)), []
    for b in sorted(boxes, key=lambda b: (-b[2], b[4], b[1])):
        if not any(abs(b[4] - k[4]) <= tol and abs(b[3] - k[3]) <= 250 for k in kept):
            kept.append(b)
    return {(k[0], k[1]) for k in kept}


def test_suppression_is_greedy_also_on_a_page_with_most_boxes(spark):
    draw = random.Random(4)
    pages = {0: (4000, 2400), 1: (300, 900), 2: (200, None), 3: (1, 50)}
    rows = [(p, i, draw.randrange(20) / 20, float(draw.randrange(2000)), float(draw.randrange(-100, 3000) // (1 + 40 * (p == 1)) * (1 + 40 * (p == 1))), h) for p, (n, h) in pages.items() for i in range(n)]
    rows += [(None, 1, 0.5, 1.0, 1.0, 100), (None, 2, 0.4, 2.0, 2.0, 100), (5, 1, None, 1.0, 1.0, 9), (5, 2, 0.5, None, 1.0, 9)]
    found = L.suppressed(spark.createDataFrame(rows, SPOT).repartition(5)).collect()
    want = set().union(*(_kept([r for r in rows if r[0] == p], h or 0) for p, (_, h) in pages.items()))
    assert {(r[0], r[1]) for r in found if r[2]} == want | {(None, 1)}
    assert len(found) == sum(n for n, _ in pages.values()) + 2


def test_columns_follow_moving_means_also_on_a_page_with_most_boxes(spark):
    draw = random.Random(6)
    rows = [(p, i, draw.randrange(1000), draw.randrange(2000), 1000) for p, n in ((0, 3000), (1, 40), (None, 30)) for i in range(n)]
    rows += [(2, 1, 10, 5, 100), (2, 2, 28, 4, 100), (2, 3, 37, 3, 100), (2, 4, 38, 2, 100), (2, 5, None, 2, 100)]
    found = L.columns(spark.createDataFrame(rows, "page long, box_id long, x1 int, cy int, page_width int").repartition(3)).collect()
    want = set()
    for page in (0, 1, 2, None):
        groups = []
        boxes = sorted((r for r in rows if r[0] == page and r[2] is not None), key=lambda r: (r[2], r[1]))
        for b in boxes:
            near = [(abs(b[2] - statistics.mean(x[2] for x in g)), i) for i, g in enumerate(groups)]
            near = [n for n in near if n[0] <= b[4] * 0.18]
            groups[min(near)[1]].append(b) if near else groups.append([b])
        for i, g in enumerate(sorted(groups, key=lambda g: statistics.mean(x[2] for x in g)), 1):
            want |= {(page, b[1], i, k) for k, b in enumerate(sorted(g, key=lambda b: (b[3], b[2], b[1])), 1)}
    assert {tuple(r) for r in found} == want


def _beside(a, b):
    shared = max(0, min(a[3], b[3]) - max(a[1], b[1]))
    heights = a[3] - a[1], b[3] - b[1]
    away = abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)
    return shared / max(1, min(heights)) >= 0.25 or away <= max(32, min(150, max(heights) * 0.72))


def test_nearest_anchors_are_those_of_all_pairs(spark):
    draw = random.Random(8)

    def side(n, pages):
        out = []
        for i in range(n):
            top, high = draw.randrange(4000) * 1.0, draw.choice([10, 30, 60, 400]) * 1.0
            out.append((draw.choice(pages), i, top, top + high, top + high / 2))
        return out

    boxes, anchors = side(1500, [0, 0, 0, 1, None]), side(120, [0, 1, None])
    schema = "page long, seq long, y1 double, y2 double, mid double"
    found = L.nearest_anchor(spark.createDataFrame(boxes, schema), spark.createDataFrame(anchors, schema)).collect()
    want = set()
    for page, seq, y1, y2, mid in boxes:
        near = [(abs(mid - a[4]), a[1]) for a in anchors if a[0] == page and _beside((0, a[2], 0, a[3]), (0, y1, 0, y2))]
        if near:
            want.add((page, seq, min(near)[1]))
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 1000


def _boxes(spark, *told):
    rows = [(0, i, f"b{i}", text, float(rest[0]) if rest else 90.0, [float(x) for x in box] if box else None) for i, (text, box, *rest) in enumerate(told)]
    return L.medicine_rows(spark.createDataFrame(rows, BOX)).orderBy(F.col("bbox")[1], F.col("bbox")[0]).collect()


def test_forms_are_read_at_the_anchors_of_rows_only(spark):
    told = ["Pal. Ultrafen-ply", "2 Inb. Relentu", "byp mefial - P", "Amoxicillin 500mg Cap #21", "Ad: knee cap", "Temp chart", "Tab 12"]
    df = spark.createDataFrame([(t,) for t in told], "t string").select(L.form_anchor(F.col("t")).alias("a"))
    found = [r["a"] and tuple(r["a"]) for r in df.collect()]
    assert found == [("Tablet", "Tablet Ultrafen-ply"), ("Tablet", "Tablet Relentu"), ("Syrup", "Syrup mefial - P"), ("Capsule", "Capsule Amoxicillin 500mg #21"), None, None, None]


def test_strengths_and_times_join_the_nearest_medicine(spark):
    rows = _boxes(
        spark, ("Patient name: Test", [20, 20, 300, 50]), ("1. Tab Cinacalcet", [200, 200, 520, 260], 98), ("30 mg", [560, 205, 650, 250], 94), ("1-0-1", [700, 210, 790, 250], 92),
        ("After food", [820, 205, 980, 255]), ("2. Cap Ferric Maltol", [200, 310, 560, 370], 97), ("30 mg", [600, 315, 690, 360], 94), ("1-1-0", [730, 315, 820, 360], 92),
        ("Advice: review after 2 weeks", [100, 600, 700, 660]), ("5 mg", None), (None, [0, 0, 9, 9]), ("7 mg", [9, 9, 9, 9]),
    )
    assert [(r["form"], r["text"]) for r in rows] == [("Tablet", "Tablet Cinacalcet 30 mg 1-0-1 After food"), ("Capsule", "Capsule Ferric Maltol 30 mg 1-1-0")]
    assert rows[0]["sources"] == ["b1", "b2", "b3", "b4"] and rows[0]["bbox"] == [200, 200, 980, 260]
    assert rows[0]["confidence"] == math.floor((98 * 17 + 94 * 5 + 92 * 5 + 90 * 10) / 37 + 0.5)


def test_headers_advice_and_body_parts_are_no_rows(spark):
    assert _boxes(spark, ("Trauma Center", [10, 10, 300, 50]), ("Pain right knee", [100, 100, 500, 160]), ("knee cap", [100, 300, 400, 360])) == []


def test_dense_pages_and_forms_that_stand_alone(spark):
    rows = _boxes(
        spark, ("Pal. Ultrafen-ply", [466, 640, 1018, 758], 77), ("50ng 2+0+1", [894, 702, 1215, 788], 75), ("2 Inb. Relentu", [402, 774, 859, 874], 75), ("0+0+1", [1036, 824, 1226, 884], 82),
        ("Ad: knee cap", [365, 1281, 890, 1394]), ("byp mefial - P", [622, 947, 1383, 1169], 93), ("4ml", [1491, 949, 1779, 1105], 92), ("Temp chart", [503, 1269, 1300, 1489], 89),
        ("Pub.", [481, 1661, 638, 1749], 89), ("Dlracal-D-0+2t", [641, 1660, 1204, 1758], 77), ("Capi", [469, 1755, 660, 1828], 85), ("Oneprong 2+0+0", [640, 1741, 1190, 1829], 77),
    )
    assert [r["text"] for r in rows] == ["Tablet Ultrafen-ply 50ng 2+0+1", "Tablet Relentu 0+0+1", "Syrup mefial - P 4ml", "Tablet Dlracal-D-0+2t", "Capsule Oneprong 2+0+0"]
    assert rows[3]["sources"] == ["b8", "b9"]


def _page(boxes):
    """The rows of one page, by the rules one after the other."""
    bare = lambda t: re.sub(r"^\(?\d{1,2}\)?[.)]?\s*", "", re.sub(r"^[\s\-_*]+", "", t))
    form = lambda w: L.FORMS.get(re.sub("[^a-z]", "", w.lower()))

    def anchor(text):
        text = bare(text).strip()
        m = re.match(r"^([^\W\d_]{2,12})\.?\s+(.+)$", text)
        if m and form(m[1]) and re.search(r"[^\W\d_]{3}", m[2]):
            return form(m[1]), f"{form(m[1])} {m[2].strip()}"
        m = re.match(r"(?i)^(.+?)\s+([^\W\d_]{2,12})\.?(\s+(?:#|no\.?|qty\.?)?\s*\d+)?$", text)
        if m and form(m[2]) and re.search(r"[^\W\d_]{3}", m[1]) and (re.search(L.QUALIFIER, m[1]) or m[3]):
            return form(m[2]), f"{form(m[2])} {m[1].strip()}{m[3] or ''}"
        return None

    lone = lambda t: form(re.sub(r"[.:;,]+$", "", bare(t)).strip())
    items = [dict(id=[b["box_id"]], text=" ".join(b["text"].split()), sure=b["confidence"], box=list(b["bbox"])) for b in sorted(boxes, key=lambda b: b["seq"])]
    used, made = [], []
    for f in items:
        if not lone(f["text"]) or f in used:
            continue
        near = [
            (abs((m["box"][1] + m["box"][3]) / 2 - (f["box"][1] + f["box"][3]) / 2) + max(0, m["box"][0] - f["box"][2]) * 0.15, i)
            for i, m in enumerate(items)
            if m not in used and not lone(m["text"]) and not anchor(m["text"]) and _beside(f["box"], m["box"]) and m["box"][0] >= f["box"][0] - (f["box"][2] - f["box"][0]) * 0.1
            and len(re.sub(r"[\W\d_]", "", m["text"])) >= 4 and not re.search(L.ADMINISTRATIVE, m["text"])
        ]
        if near:
            m = items[min(near)[1]]
            used += [f, m]
            box = [min(f["box"][0], m["box"][0]), min(f["box"][1], m["box"][1]), max(f["box"][2], m["box"][2]), max(f["box"][3], m["box"][3])]
            made.append(dict(id=f["id"] + m["id"], text=f"{lone(f['text'])} {m['text']}", sure=math.floor((f["sure"] + m["sure"]) / 100 * 50 + 0.5), box=box))
    items = [i for i in items if i not in used] + made
    anchors = [i for i in items if anchor(i["text"])]
    out = []
    for a in anchors:
        group = [a]
        for c in items:
            if anchor(c["text"]) or not re.search(L.CONTINUATION, c["text"]) or c["box"][0] < a["box"][0] - (a["box"][2] - a["box"][0]) * 0.12:
                continue
            near = [(abs((x["box"][1] + x["box"][3]) / 2 - (c["box"][1] + c["box"][3]) / 2), i) for i, x in enumerate(anchors) if _beside(x["box"], c["box"])]
            if near and anchors[min(near)[1]] is a:
                group.append(c)
        group.sort(key=lambda g: (g["box"][0], g["box"][1]))
        text = " ".join([anchor(a["text"])[1], *[g["text"] for g in group[1:]]])
        out.append((anchor(a["text"])[0], text, [i for g in group for i in g["id"]]))
    return out


def test_rows_of_all_pages_are_those_of_the_rules(spark, sf_dir):
    boxes = P.prescriptions(spark, sf_dir)
    pages = {}
    for r in boxes.collect():
        pages.setdefault(r["page"], []).append(r.asDict())
    want = sorted((p, *row) for p, held in pages.items() for row in _page(held))
    found = L.medicine_rows(boxes).collect()
    assert sorted((r["page"], r["form"], r["text"], r["sources"]) for r in found) == want
    assert {"Tablet", "Capsule", "Syrup"} <= {r["form"] for r in found} and any(len(r["sources"]) > 4 for r in found)


def test_no_boxes_go_through_the_driver(spark, sf_dir):
    """Tables of parts are small files, but their boxes aren't small: none may be broadcast."""
    found = P.medicine_rows(spark, sf_dir)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_orientation_and_half_turns(spark):
    def line(text, x, y, w, h):
        return text, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]

    side = [line("abcdef", 0.0, 0.0, 10.0, 60.0)] * 3
    bill = [line("Amount", 10.0, 0.0, 50.0, 9.0), line("Description", 300.0, 0.0, 90.0, 9.0), line("Qty", 90.0, 0.0, 9.0, 9.0)]
    told = {1: side, 2: side[:2], 3: bill, 4: [bill[1], line("Rate", 500.0, 0.0, 9.0, 9.0)], 5: [("Amount", None), (None, [[1.0, 1.0]]), bill[1]], 6: [("xxxxxxxxxxxxxxxx", [[0.0], [0.0], [0.0], [0.0]])] * 3}
    df = spark.createDataFrame([(p, t, c) for p, held in told.items() for t, c in held], "page long, text string, points array<array<double>>")
    found = {r[0]: (r[1], r[2]) for r in L.orientation(df).collect()}
    assert found == {1: (True, False), 2: (False, False), 3: (False, True), 4: (False, False), 5: (False, False), 6: (False, False)}
    turned = df.where("page = 3 and text = 'Amount'").select(L.turned_around(F.col("points"), F.lit(400.0), F.lit(50.0)).alias("p")).first()["p"]
    assert turned == [[390.0, 50.0], [340.0, 50.0], [340.0, 41.0], [390.0, 41.0]]


def test_quality_gate_and_the_order_of_its_reasons(spark):
    told = {
        1: ("prescription", [("Tab Paracetamol 500mg", 0.9), ("twice daily", 0.8)]),
        2: ("package", [("Zyx", 0.3)]),
        3: ("package", [("  ", 0.1), ("Crocin", 0.9), ("", 0.2)]),
        4: ("generic", [("!!!! ---- ???? ....", 0.9)]),
        5: ("package", [("some plain words here", 0.6)]),
        6: ("generic", [("contains 500", 0.9), (" ", 0.5), ("mg of it", 0.9)]),
        7: ("bill", [(None, None)]),
    }
    df = spark.createDataFrame([(p, k, i, t, c) for p, (k, held) in told.items() for i, (t, c) in enumerate(held)], "page long, kind string, line int, text string, confidence double")
    found = {r["page"]: r for r in L.quality(df).collect()}
    assert found[1]["accepted"] and found[1]["cue"] and found[1]["text_length"] == 33
    assert found[2]["reasons"] == ["insufficient_text", "low_average_confidence", "no_medication_signal"] and found[2]["reason"] == "insufficient_text"
    assert found[3]["accepted"] and found[3]["text_length"] == 6
    assert found[4]["reasons"] == ["low_alphanumeric_ratio"]
    assert found[5]["reasons"] == ["no_medication_signal"]
    assert found[6]["cue"] and found[7]["reasons"][0] == "insufficient_text"
    average = (0.9 * 19 + 0.8 * 10) / 29
    assert abs(found[1]["score"] - (0.55 * average + 0.2 * 33 / 160 + 0.15 * 2 / 8 + 0.1)) < 6e-5


@pytest.mark.parametrize(
    "names, kept",
    [
        (["Amoxicillin", "Amoxycillin", "Amoxi-cillin", "Clavulanic"], ["Amoxicillin", "Clavulanic"]),
        (["aaaadefgh", "aabbdefgh", "bbbbdefgh"], ["aaaadefgh", "bbbbdefgh"]),
        (["aabbdefgh", "aaaadefgh", "bbbbdefgh"], ["aabbdefgh"]),
        (["abc", "abd"], ["abc", "abd"]),
        ([], []),
    ],
)
def test_the_first_of_similar_names_stays(spark, names, kept):
    df = spark.createDataFrame([(names,)], "n array<string>")
    assert df.select(L.first_of_similar(F.col("n")).alias("k")).first()["k"] == kept
