"""Layout of recognised pages: suppression of boxes, columns, medicine rows, orientation and the quality of a reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.functions import text as X
from carelake.lineage import cut
from carelake.operators.folds import folded

#: The least and the relative height, and the width, within which a box hides others.
TOLERANCE, TOLERANCE_SHARE, REACH = 16, 0.016, 250


class _Kept:
    """The kept boxes of a part of a page, by strips as high as the tolerance: near ones are in three of them."""

    def __init__(self, *_):
        self.strips: dict[int, list[tuple[float, float]]] = {}

    def add(self, page, island, box_id, confidence, cx, cy, tolerance):
        strip = int(cy // tolerance)
        near = (k for s in (strip - 1, strip, strip + 1) for k in self.strips.get(s, ()))
        kept = not any(abs(cy - y) <= tolerance and abs(cx - x) <= REACH for x, y in near)
        if kept:
            self.strips.setdefault(strip, []).append((cx, cy))
        return [(page, box_id, kept)]

    def done(self):
        return ()


def suppressed(boxes: DataFrame) -> DataFrame:
    """(page, box_id, kept) of boxes (page, box_id, confidence, cx, cy, page_height): greedy, most confident first.

    A box is kept unless one kept before is within the tolerance of its height and 250 of its width. Equal confidences
    go by cy, then box_id. What decides reaches no further than the tolerance, so a page is cut where a strip of that
    height is empty, which is found from its different strips; within such a part only the kept boxes are held, which
    can't stand closer than that. Boxes without a place or confidence are dropped.
    """
    rows = boxes.where("cx is not null and cy is not null and confidence is not null")
    tolerance = F.greatest(F.lit(TOLERANCE), F.floor(F.col("page_height") * TOLERANCE_SHARE)).cast("double")
    rows = rows.select("page", "box_id", F.col("confidence").cast("double"), F.col("cx").cast("double"), F.col("cy").cast("double"), F.coalesce(tolerance, F.lit(float(TOLERANCE))).alias("tolerance"))
    rows = rows.withColumn("strip", F.floor(F.col("cy") / F.col("tolerance")))
    place = F.row_number().over(W.Window.partitionBy("page", "tolerance").orderBy("strip"))
    islands = rows.select("page", "tolerance", "strip").distinct().withColumn("island", F.col("strip") - place)
    parts = rows.alias("r").join(islands.alias("i"), F.expr("r.page <=> i.page and r.tolerance = i.tolerance and r.strip = i.strip"))
    parts = parts.select("r.page", F.concat_ws(":", "r.tolerance", "i.island").alias("island"), "box_id", "confidence", "cx", "cy", "r.tolerance")
    kinds = dict(parts.dtypes)
    order = [F.desc("confidence"), F.asc("cy"), F.asc("box_id")]
    return folded(parts, ["page", "island"], order, _Kept, f"page {kinds['page']}, box_id {kinds['box_id']}, kept boolean")


#: Fixed value: the share of a page's width within which a box joins a column.
COLUMN_SHARE = 0.18


def columns(boxes: DataFrame, share: float = COLUMN_SHARE) -> DataFrame:
    """(page, box_id, column, place): columns by greedy clustering of left edges, with a mean that moves with each box.

    boxes is (page, box_id, x1, cy, page_width). From left to right a box joins the nearest mean within the share of the
    page's width, else begins a column. Edges come in order, so the last column's mean is always the nearest, and all
    boxes at one edge go the same way: a page is folded over its different edges with their counts, which partial
    aggregation has made few. Places run downwards in a column, by cy, then x1, then box_id.
    """
    rows = boxes.where("x1 is not null and page_width is not null")
    edges = rows.groupBy("page", "page_width", "x1").agg(F.count("*").alias("n"))
    held = edges.groupBy("page", "page_width").agg(F.array_sort(F.collect_list(F.struct(F.col("x1").cast("double").alias("x"), "n", "x1"))).alias("edges"))
    kind = dict(edges.dtypes)["x1"]
    start = F.struct(
        F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("column"),
        F.array().cast(f"array<struct<x1:{kind},column:int>>").alias("out"),
    )
    limit = F.col("page_width").cast("double") * share

    def step(acc, e):
        joins = (acc["n"] > 0) & (e["x"] - acc["sum"] / F.greatest(acc["n"], F.lit(1)) <= limit)
        column = F.when(joins, acc["column"]).otherwise(acc["column"] + 1)
        return F.struct(
            (F.when(joins, acc["sum"]).otherwise(0.0) + e["x"] * e["n"]).alias("sum"),
            (F.when(joins, acc["n"]).otherwise(0) + e["n"]).alias("n"),
            column.alias("column"),
            F.concat(acc["out"], F.array(F.struct(e["x1"].alias("x1"), column.alias("column")))).alias("out"),
        )

    told = held.select("page", "page_width", F.inline(F.aggregate("edges", start, step, lambda acc: acc["out"])))
    both = rows.alias("b").join(told.alias("t"), F.expr("b.page <=> t.page and b.page_width = t.page_width and b.x1 = t.x1"))
    place = F.row_number().over(W.Window.partitionBy("b.page", "b.page_width", "column").orderBy("cy", "b.x1", "box_id"))
    return both.select("b.page", "box_id", F.col("column").cast("long").alias("column"), place.cast("long").alias("place"))


#: How a dosage form is written, and as what recognition reads it at the start of a line.
FORMS = {
    "tab": "Tablet", "tabs": "Tablet", "tablet": "Tablet", "tablets": "Tablet", "tbl": "Tablet", "tb": "Tablet", "tob": "Tablet",
    "tal": "Tablet", "pal": "Tablet", "pub": "Tablet", "inb": "Tablet",
    "cap": "Capsule", "caps": "Capsule", "capsule": "Capsule", "capsules": "Capsule", "cab": "Capsule", "capi": "Capsule",
    "syp": "Syrup", "syr": "Syrup", "syrup": "Syrup", "byp": "Syrup",
    "inj": "Injection", "injection": "Injection", "drop": "Drops", "drops": "Drops", "cream": "Cream", "ointment": "Ointment",
    "gel": "Gel", "inhaler": "Inhaler", "solution": "Solution", "susp": "Suspension", "suspension": "Suspension", "powder": "Powder", "spray": "Spray",
}
#: What continues a medicine's line, and words of lines that are about something else.
CONTINUATION = (
    r"(?i)(?:\b\d+(?:\.\d+)?\s*(?:mcg|ug|mg|g|ml|iu|units?)\b|\b(?:od|bd|bid|tds|tid|qid|sos|prn|hs|daily|weekly|twice|thrice)\b"
    r"|\b(?:before|after|with)\s+(?:food|meal|breakfast|lunch|dinner)\b|\b(?:for|x)\s*\d+\s*(?:days?|weeks?|months?)\b"
    r"|\b(?:qty|quantity)\b|(?:^|\s)\d+(?:\s*[-+]\s*\d+){1,3}(?:\s|$))"
)
ADMINISTRATIVE = r"(?i)\b(?:patient|doctor|hospital|address|advice|diagnosis|exercise|physiotherapy|signature|date|age|sex|gender|phone|knee|pain)\b"
QUALIFIER = r"(?i)\b\d+(?:\.\d+)?\s*(?:mcg|ug|mg|g|ml|iu|units?|%)\b"
PREFIXED = r"^(\p{L}{2,12})\.?\s+(.+)$"
SUFFIXED = r"(?i)^(.+?)\s+(\p{L}{2,12})\.?(\s+(?:#|no\.?|qty\.?)?\s*\d+)?$"
#: Heights from the centre within which boxes stand in one line at least and at most, and shares of heights.
NEAR, FAR, HEIGHT_SHARE, OVERLAP = 32, 150, 0.72, 0.25


def _bare(c: Column) -> Column:
    """A line without bullets and numbers in front."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\s\-_*]+", ""), r"^(?:\p{No}|\(?\d{1,2}\)?[.)]?)\s*", "")


def _form(word: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair])
    return F.try_element_at(names, F.regexp_replace(F.lower(word), "[^a-z]", ""))


def form_anchor(line: Column) -> Column:
    """(form, text) of a normalised line that names a dosage form and a medicine, else null.

    The form stands first, or last after a strength or before a count.
    """
    bare = F.trim(_bare(line))

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(bare, pattern, i)

    first, behind = _form(part(PREFIXED, 1)), F.trim(part(PREFIXED, 2))
    last, before, count = _form(part(SUFFIXED, 2)), F.trim(part(SUFFIXED, 1)), part(SUFFIXED, 3)
    named = r"\p{L}{3}"
    told = before.rlike(QUALIFIER) | (count != "")
    return F.when(first.isNotNull() & behind.rlike(named), F.struct(first.alias("form"), F.concat_ws(" ", first, behind).alias("text"))).when(
        last.isNotNull() & before.rlike(named) & told, F.struct(last.alias("form"), F.concat(last, F.lit(" "), before, count).alias("text"))
    )


def lone_form(line: Column) -> Column:
    """The dosage form that a normalised line consists of, else null."""
    return _form(F.trim(F.regexp_replace(_bare(line), r"[.:;,]+$", "")))


def _beside(a: str, b: str) -> Column:
    """Whether two boxes stand in one line: they overlap by a quarter of the lower one, or their centres are near."""
    shared = F.greatest(F.lit(0.0), F.expr(f"least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)"))
    lower, higher = F.expr(f"least({a}.y2 - {a}.y1, {b}.y2 - {b}.y1)"), F.expr(f"greatest({a}.y2 - {a}.y1, {b}.y2 - {b}.y1)")
    limit = F.greatest(F.lit(float(NEAR)), F.least(F.lit(float(FAR)), higher * HEIGHT_SHARE))
    return (shared / F.greatest(F.lit(1.0), lower) >= OVERLAP) | (F.abs(F.expr(f"{a}.mid - {b}.mid")) <= limit)


def _strips(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / FAR), F.floor(high / FAR)))


def _in_strips(wide: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by strips of a page: boxes that can stand in one line share one.

    They overlap, or their centres are at most FAR apart, so one side with that margin meets the other's own height.
    """
    left = wide.withColumn("strip", _strips(F.col("y1") - FAR, F.col("y2") + FAR))
    return left, own.withColumn("strip", _strips(F.col("y1"), F.col("y2")))


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of boxes by shuffles. Spark would guess from the tables' files, which are small beside the boxes drawn from
    their rows, and send whole pages of boxes through the driver."""
    return left.join(right.hint("merge"), F.expr(on), how)


def nearest_anchor(boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(page, seq, anchor) of each box that stands in a line with an anchor: the nearest centre, the first of equal ones.

    Both have page, seq, y1, y2 and mid. One sorted pass over each page's boxes and anchors gives the last anchor above
    and the first below; within NEAR the nearer of them is always in line, and so the answer. Only boxes further from
    any anchor are joined with the anchors around them, of which there are none within NEAR.
    """
    both = boxes.select("page", "seq", "y1", "y2", "mid", F.lit(None).cast("long").alias("anchor")).unionByName(
        anchors.select("page", F.lit(None).cast("long").alias("seq"), "y1", "y2", "mid", F.col("seq").alias("anchor"))
    )
    held = F.when(F.col("anchor").isNotNull(), F.struct("mid", "anchor"))
    down = W.Window.partitionBy("page").orderBy("mid", F.col("anchor").isNull(), F.desc("anchor"))
    up = W.Window.partitionBy("page").orderBy(F.desc("mid"), F.col("anchor").isNull(), F.desc("anchor"))
    so_far = W.Window.unboundedPreceding, W.Window.currentRow
    both = both.withColumn("a", F.last(held, True).over(down.rowsBetween(*so_far))).withColumn("b", F.last(held, True).over(up.rowsBetween(*so_far)))

    def away(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col("mid") - F.col(f"{side}.mid")).alias("far"), F.col(f"{side}.anchor").alias("anchor")))

    told = both.where("seq is not null").withColumn("best", F.least(away("a"), away("b")))
    near = told.where(F.col("best.far") <= NEAR).select("page", "seq", "best.anchor")
    rest = told.where(F.col("best.far") > NEAR).select("page", "seq", "y1", "y2", "mid")
    wide, own = _in_strips(anchors.select("page", "seq", "y1", "y2", "mid"), rest)
    pairs = _met(own.alias("c"), wide.alias("a"), "c.page <=> a.page and c.strip = a.strip").where(_beside("a", "c"))
    nearest = F.min(F.struct(F.abs(F.expr("a.mid - c.mid")).alias("far"), F.col("a.seq").alias("anchor"))).alias("best")
    return near.unionByName(pairs.groupBy("c.page", "c.seq").agg(nearest).select("page", "seq", "best.anchor"))


class _Joined:
    """Of the pairs of forms and medicines of a page, best first for each form, those that take what is still free."""

    def __init__(self, *_):
        self.taken, self.form = set(), None

    def add(self, page, form, medicine, score):
        if form == self.form or medicine in self.taken:
            return ()
        self.form = form
        self.taken.add(medicine)
        return [(page, form, medicine)]

    def done(self):
        return ()


def _certainty(c: Column) -> Column:
    """A share of 0 to 1 from a share or a percentage."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c > 1, c / 100).otherwise(c)))


def _percent(share: Column) -> Column:
    return F.floor(share * 100 + 0.5).cast("long")


def evidence(boxes: DataFrame) -> DataFrame:
    """Boxes (page, seq, box_id, text, confidence, bbox) with their normalised text, edges and whether they have a place."""
    line = X.compatible_form(F.col("text"))
    rows = boxes.select("page", "seq", "box_id", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), line.alias("line"), "bbox")
    edge = {c: F.get(F.col("bbox"), F.lit(i)).cast("double") for i, c in enumerate(("x1", "y1", "x2", "y2"))}
    rows = rows.where("line != ''").withColumns(edge).drop("bbox")
    finite = [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in edge]
    placed = finite[0] & finite[1] & finite[2] & finite[3] & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    return rows.withColumns({"placed": F.coalesce(placed, F.lit(False)), "mid": (F.col("y1") + F.col("y2")) / 2, "sources": F.array("box_id")})


def medicine_rows(boxes: DataFrame) -> DataFrame:
    """One row for each anchor of a dosage form: (page, seq, form, text, confidence, bbox, sources).

    A form that stands alone is joined with the best medicine beside it, in the order of the page, each medicine once.
    Then what continues a medicine's line (strengths, times, food) goes to the nearest anchor in its line, unless it
    stands too far to the left of it; all other text is left out. Parts are put together from left to right. seq orders
    a page's boxes and is unique in it; boxes without text are left out, those without a place take no part.
    """
    # Written once: many joins read it, and it takes Python and long patterns to make.
    line = F.col("line")
    marked = cut(evidence(boxes).withColumns({"lone": lone_form(line), "anchored": form_anchor(line)}))
    letters = F.length(F.regexp_replace("line", r"[^\p{L}]", ""))
    forms = marked.where("placed and lone is not null")
    named = marked.where("placed and lone is null and anchored is null").where((letters >= 4) & ~F.col("line").rlike(ADMINISTRATIVE))
    wide, own = _in_strips(forms, named)
    pairs = _met(wide.alias("f"), own.alias("m"), "f.page <=> m.page and f.strip = m.strip").where(_beside("f", "m"))
    pairs = pairs.where("m.x1 >= f.x1 - (f.x2 - f.x1) * 0.1")
    score = F.abs(F.expr("m.mid - f.mid")) + F.greatest(F.lit(0.0), F.expr("m.x1 - f.x2")) * 0.15
    pairs = pairs.select("f.page", F.col("f.seq").alias("form"), F.col("m.seq").alias("medicine"), score.alias("score")).distinct()
    page = dict(boxes.dtypes)["page"]
    joined = cut(folded(pairs, ["page"], [F.col("form"), F.col("score"), F.col("medicine")], _Joined, f"page {page}, form long, medicine long"))
    gone = joined.select("page", F.explode(F.array("form", "medicine")).alias("seq"))
    rest = _met(marked.alias("g"), gone.alias("x"), "g.page <=> x.page and g.seq = x.seq", "left_anti").drop("lone").withColumn("joined", F.lit(False))
    a, b = marked.alias("a"), marked.alias("b")
    made = _met(_met(joined.alias("j"), a, "j.page <=> a.page and j.form = a.seq"), b, "j.page <=> b.page and j.medicine = b.seq")
    made = made.select(
        "a.page", "a.seq", "a.box_id", _percent((_certainty(F.col("a.confidence")) + _certainty(F.col("b.confidence"))) / 2).cast("double").alias("confidence"),
        F.concat_ws(" ", "a.lone", "b.line").alias("line"), F.least("a.x1", "b.x1").alias("x1"), F.least("a.y1", "b.y1").alias("y1"), F.greatest("a.x2", "b.x2").alias("x2"),
        F.greatest("a.y2", "b.y2").alias("y2"), F.lit(True).alias("placed"), F.lit(None).cast("double").alias("mid"), F.array("a.box_id", "b.box_id").alias("sources"), F.lit(True).alias("joined"),
    ).withColumns({"mid": (F.col("y1") + F.col("y2")) / 2, "anchored": form_anchor(line)})
    # Joined rows come behind all others of their page.
    rows = rest.unionByName(made).withColumn("seq", F.when(F.col("joined"), F.col("seq") + (1 << 40)).otherwise(F.col("seq")))
    rows = cut(rows.where("placed").where(F.col("anchored").isNotNull() | line.rlike(CONTINUATION)))
    anchors, others = rows.where("anchored is not null"), rows.where("anchored is null")
    found = nearest_anchor(others, anchors).alias("n")
    parts = _met(found, others.alias("c"), "n.page <=> c.page and n.seq = c.seq")
    parts = _met(parts, anchors.alias("a"), "n.page <=> a.page and n.anchor = a.seq")
    parts = parts.where("c.x1 >= a.x1 - (a.x2 - a.x1) * 0.12").select(*[f"c.{c}" for c in others.columns], F.col("n.anchor").alias("anchor"))
    parts = parts.unionByName(anchors.withColumn("anchor", F.col("seq")))
    place = F.when(F.col("seq") == F.col("anchor"), F.lit(-1)).otherwise(F.col("seq"))
    piece = F.struct("x1", "y1", place.alias("place"), "line", _certainty(F.col("confidence")).alias("sure"), F.greatest(F.length("line"), F.lit(1)).alias("weight"), "sources")
    head = F.max(F.when(F.col("seq") == F.col("anchor"), F.col("anchored"))).alias("head")
    rows = parts.groupBy("page", "anchor").agg(
        F.array_sort(F.collect_list(piece)).alias("p"), head, F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    weight = F.aggregate("p", F.lit(0), lambda n, x: n + x["weight"])
    sure = F.aggregate("p", F.lit(0.0), lambda n, x: n + x["sure"] * x["weight"]) / weight
    behind = F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x["line"])
    text = F.trim(F.regexp_replace(F.array_join(F.concat(F.array("head.text"), behind), " "), r"\s+", " "))
    return rows.select(
        "page", F.col("anchor").alias("seq"), "head.form", text.alias("text"), _percent(sure).alias("confidence"), F.array("x1", "y1", "x2", "y2").alias("bbox"),
        F.flatten(F.transform("p", lambda x: x["sources"])).alias("sources"),
    )


def signs(line: Column) -> Column:
    """Letters and digits of a text."""
    return F.length(F.regexp_replace(F.coalesce(line, F.lit("")), r"[^\p{L}\p{N}]", ""))


#: How much higher than wide a line is on its side; and least lines, signs and share of signs for a page.
UPRIGHT, SIDE_LINES, SIDE_SIGNS, SIDE_SHARE = 1.35, 3, 15, 0.65
IDENTITY, FINANCIAL = r"(?i)\b(?:description|discription|product|item|mfg)\b", r"(?i)\b(?:amount|rate|qty|quantity)\b"


def orientation(lines: DataFrame) -> DataFrame:
    """(page, sideways, reversed) of lines (page, text, points), points being corners [x, y].

    A page lies on its side when most of its signs are in lines that are higher than wide; a bill is turned around when
    its amounts stand left of its names, by the means of the middles of such lines. Lines with fewer than four corners,
    or one that isn't two numbers, have no place. A page without lines that have one is neither.
    """
    points = F.col("points")
    whole = F.coalesce(F.forall(points, lambda p: F.coalesce((F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull(), F.lit(False))), F.lit(False)) & (F.size(points) >= 4)
    high = F.coalesce(F.forall(points, lambda p: F.get(p, F.lit(1)).isNotNull()), F.lit(False))
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    width, height = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    rows = lines.select("page", F.coalesce("text", F.lit("")).alias("text"), whole.alias("whole"), (whole & high).alias("placed"), width.alias("w"), height.alias("h"), ((F.array_max(xs) + F.array_min(xs)) / 2).alias("middle"))
    flat = F.col("placed") & (F.col("w") > 0) & (F.col("h") > 0)
    weight = F.when(flat, F.greatest(F.lit(1), signs(F.col("text")))).otherwise(0)
    upright = F.when(flat & (F.col("h") > F.col("w") * UPRIGHT), weight).otherwise(0)

    def middle(pattern: str) -> Column:
        return F.avg(F.when(F.col("whole") & F.col("text").rlike(pattern), F.col("middle")))

    sums = rows.groupBy("page").agg(
        F.count_if(flat).alias("n"), F.sum(weight).alias("all"), F.sum(upright).alias("up"), middle(IDENTITY).alias("names"), middle(FINANCIAL).alias("sums")
    )
    sideways = (F.col("n") >= SIDE_LINES) & (F.col("all") >= SIDE_SIGNS) & (F.col("up") / F.greatest(F.col("all"), F.lit(1)) >= SIDE_SHARE)
    return sums.select("page", sideways.alias("sideways"), F.coalesce(F.col("sums") < F.col("names"), F.lit(False)).alias("reversed"))


def turned_around(points: Column, width: Column, height: Column) -> Column:
    """Corners after half a turn of the page; those of a line without a place stay."""
    turned = F.transform(points, lambda p: F.array(width - F.get(p, F.lit(0)), height - F.get(p, F.lit(1))))
    return F.when(F.size(points) >= 4, turned).otherwise(points)


#: What tells a medicine; the least confidence by kind of page; and least lengths.
CUE = (
    r"(?i)\b(?:tab(?:let)?s?|cap(?:sule)?s?|syr(?:up)?|inj(?:ection)?|drops?|cream|ointment|suspension"
    r"|\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|iu|units?|%w/[wv])|od|bd|bid|tds|tid|qid|sos|prn)\b"
)
LEAST_SURE = {"package": 0.48, "bill": 0.45, "prescription": 0.30, "generic": 0.42}
BRAND_SURE, BRAND_LENGTH, PACKAGE_LENGTH, OTHER_LENGTH, PACKAGE_SURE, SIGN_SHARE = 0.72, 4, 10, 14, 0.65, 0.45


def quality(lines: DataFrame) -> DataFrame:
    """(page, accepted, score, reason, reasons, text_length, sign_share, cue) of lines (page, kind, line, text, confidence).

    The mean confidence weighs a line by its letters and digits, and is added up from the last line to the first,
    so a mean at a limit falls on the same side however rows are dealt. Reasons stand in the order in which they are tested, and the
    first is the reason. A cue may run over a line's end between a number and its unit, so each line is also read with
    the next one that isn't blank.
    """
    text, sure = F.coalesce("text", F.lit("")), F.coalesce("confidence", F.lit(0.0))
    filled = text.rlike(r"\S")
    behind = W.Window.partitionBy("page").orderBy("line").rowsBetween(1, W.Window.unboundedFollowing)
    after = F.first(F.when(filled, text), True).over(behind)
    weight = F.greatest(F.lit(1), signs(text))
    back = W.Window.partitionBy("page").orderBy(F.desc("line")).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    rows = lines.select(
        "page", "kind", "line", text.alias("text"), sure.alias("sure"), F.coalesce(after, F.lit("")).alias("after"), filled.alias("filled"), F.sum(sure * weight).over(back).alias("so_far"), weight.alias("weight")
    )
    # A page's text is stripped; only white space at its ends is lost, and it counts for the length alone.
    first, last = F.min(F.when(F.col("filled"), F.col("line"))), F.max(F.when(F.col("filled"), F.col("line")))
    ends = rows.groupBy("page").agg(first.alias("first"), last.alias("last"))
    rows = rows.join(ends, "page")
    at_first, at_last = F.col("line") == F.col("first"), F.col("line") == F.col("last")
    left = F.when(at_first, F.regexp_replace("text", r"^\s+", "")).otherwise(F.col("text"))
    inner = F.when(at_last, F.regexp_replace(left, r"\s+$", "")).otherwise(left)
    within = F.col("line").between(F.col("first"), F.col("last"))
    brand = F.col("text").rlike(r"\b[A-Za-z][A-Za-z0-9-]{3,}\b") & (F.col("sure") >= BRAND_SURE)
    cue = F.col("text").rlike(CUE) | F.concat_ws("\n", "text", "after").rlike(CUE)
    sums = rows.groupBy("page", "kind").agg(
        (F.sum(F.when(within, F.length(inner) + 1).otherwise(0)) - 1).alias("length"),
        F.sum(signs(F.col("text"))).alias("signs"),
        (F.min_by("so_far", "line") / F.sum("weight")).alias("average"),
        F.bool_or(brand).alias("brand"),
        F.bool_or(cue).alias("cue"),
        F.count("*").alias("n"),
    )
    length, average = F.greatest(F.col("length"), F.lit(0)), F.col("average")
    least = F.create_map(*[F.lit(x) for kv in LEAST_SURE.items() for x in kv])[F.col("kind")]
    package = F.col("kind") == "package"
    shortest = F.when(package & F.col("brand"), BRAND_LENGTH).when(package, PACKAGE_LENGTH).otherwise(OTHER_LENGTH)
    share = F.col("signs") / F.greatest(F.lit(1), length)
    reasons = F.array_compact(
        F.array(
            F.when(length < shortest, "insufficient_text"),
            F.when(average < least, "low_average_confidence"),
            F.when(share < SIGN_SHARE, "low_alphanumeric_ratio"),
            F.when(package & ~F.col("cue") & (average < PACKAGE_SURE), "no_medication_signal"),
        )
    )
    # Nine places first, so that the order in which a mean was added up doesn't show.
    score = 0.55 * average + 0.2 * F.least(length / 160.0, F.lit(1.0)) + 0.15 * F.least(F.col("n") / 8.0, F.lit(1.0)) + 0.1 * F.col("cue").cast("int")
    return sums.select(
        "page", (F.size(reasons) == 0).alias("accepted"), F.round(F.round(score, 9), 4).alias("score"), F.get(reasons, F.lit(0)).alias("reason"), reasons.alias("reasons"),
        length.cast("long").alias("text_length"), F.round(F.round(share, 9), 4).alias("sign_share"), F.col("cue").alias("cue"),
    )


def first_of_similar(names: Column) -> Column:
    """The names of an array without those that are like an earlier kept one: equal keys, or near ones with one ending.

    Being like another isn't transitive, so what is kept depends on the order, which is the array's. Keys are the letters
    and digits of a name; long ones are alike when one ends as the other and at most three edits apart. Null stays null.
    """

    def key(c: Column) -> Column:
        return X.name_key(c)

    def alike(a: Column, b: Column) -> Column:
        long = (F.length(a) >= 6) & (F.length(b) >= 6)
        ends = F.endswith(a, F.right(b, F.lit(5))) | F.endswith(b, F.right(a, F.lit(5)))
        return (a == b) | (long & ends & (F.levenshtein(a, b) <= 3))

    none = F.array().cast("array<string>")
    return F.aggregate(names, none, lambda kept, x: F.when(F.exists(kept, lambda y: alike(key(y), key(x))), kept).otherwise(F.concat(kept, F.array(x))))
