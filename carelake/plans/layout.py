"""Queries of page layout: suppression, columns, medicine rows, orientation, quality, near names."""

from pyspark.sql import functions as F

from carelake.operators import layout as L
from carelake.plans.registry import query
from carelake.sources.views import table

_BOX = """b AS (SELECT DISTINCT l_orderkey // 40 AS page, concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS box_id,
    l_partkey * 7 % 1200 AS cx, l_orderkey * 131 % 2000 + l_suppkey % 9 AS cy, CAST(l_suppkey % 40 AS DOUBLE) / 40 AS confidence, CAST(900 + l_orderkey // 40 % 5 * 400 AS BIGINT) AS high, l_partkey % 90 * 13 AS x1 FROM lineitem)"""


def boxes(spark, sf_dir):
    """Order lines as boxes on a page for each forty orders."""
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    page = F.floor(o / 40).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        page.alias("page"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("box_id"), (p * 7 % 1200).alias("cx"), (o * 131 % 2000 + s % 9).alias("cy"),
        (s % 40 / 40).alias("confidence"), (900 + page % 5 * 400).alias("page_height"), (p % 90 * 13).alias("x1"), F.lit(1200).alias("page_width"),
    ).distinct()


@query(f"""WITH RECURSIVE {_BOX}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, cy, box_id) AS n, greatest(16, floor(high * 0.016)) AS tol FROM b),
    f AS (SELECT page, 0::BIGINT AS n, ''::VARCHAR AS box_id, FALSE AS kept, []::STRUCT(x BIGINT, y BIGINT)[] AS held FROM (SELECT DISTINCT page FROM o)
          UNION ALL
          SELECT page, n, box_id, free, CASE WHEN free THEN list_append(held, {{'x': cx, 'y': cy}}) ELSE held END
          FROM (SELECT f.page, o.n, o.box_id, f.held, o.cx, o.cy, len(list_filter(f.held, lambda k: abs(k.y - o.cy) <= o.tol AND abs(k.x - o.cx) <= 250)) = 0 AS free
                FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1))
    SELECT page, box_id, kept FROM f WHERE n > 0""")
def suppressed_boxes(spark, sf_dir):
    return L.suppressed(boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE {_BOX}, o AS (SELECT page, x1, count(*) AS c, row_number() OVER (PARTITION BY page ORDER BY x1) AS n FROM b GROUP BY 1, 2),
    f AS (SELECT page, x1, n, x1 * c::DOUBLE AS total, c AS seen, 1::BIGINT AS col FROM o WHERE n = 1
          UNION ALL
          SELECT page, x1, n, CASE WHEN near THEN total ELSE 0 END + x1 * c::DOUBLE, CASE WHEN near THEN seen ELSE 0 END + c, CASE WHEN near THEN col ELSE col + 1 END
          FROM (SELECT o.page, o.x1, o.n, o.c, f.total, f.seen, f.col, o.x1 - f.total / f.seen::DOUBLE <= 1200 * 0.18::DOUBLE AS near FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1))
    SELECT b.page, b.box_id, f.col AS "column", row_number() OVER (PARTITION BY b.page, f.col ORDER BY b.cy, b.x1, b.box_id) AS place FROM b JOIN f ON f.page = b.page AND f.x1 = b.x1""")
def box_columns(spark, sf_dir):
    return L.columns(boxes(spark, sf_dir))


def prescriptions(spark, sf_dir):
    """Parts as boxes of prescription pages, twenty rows a page: forms before, behind and alone, with pieces to their right."""
    key, size = F.col("p_partkey"), F.col("p_size")
    top, name = (key % 20 * 62 + key % 7 * 3).cast("double"), F.initcap("p_name")

    def box(text, left, width, down, height=50):
        y = top + down
        return F.struct(text.alias("text"), F.array(F.lit(float(left)), y, F.lit(float(left + width)), y + height).alias("bbox"))

    kind = size % 8
    head = (
        F.when(kind == 0, F.concat(F.lit("1. Tab "), name)).when(kind == 1, F.concat(F.lit("- Syp. "), name)).when(kind == 2, F.concat(name, F.lit(" 500 mg Cap #21")))
        .when(kind == 3, F.concat(name, F.lit(" knee cap"))).when(kind == 4, F.concat(F.lit("Patient "), name)).when(kind == 5, name).otherwise(F.concat(F.lit("2) Inb. "), name))
    )
    drawn = F.array(
        box(head, 200, 300, 0),
        F.when(kind == 5, box(F.when(size % 3 == 0, F.lit("Pub.")).otherwise(F.lit("Capi")), 90, 80, 4)),
        F.when(key % 3 != 0, box(F.concat(size.cast("string"), F.lit(" mg")), 560, 80, 9)),
        F.when(key % 4 != 0, box(F.lit("1-0-1"), 700, 90, 28)),
        F.when(key % 5 == 0, box(F.lit("After  food"), 820, 150, 70, 30)),
        F.when(key % 6 == 0, box(F.lit("for 5 days"), 20, 90, 5)),
        F.when(key % 9 == 0, box(F.lit("Advice: rest"), 100, 600, 30)),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.floor(key / 20).cast("long").alias("page"), F.posexplode(F.array_compact(drawn)).alias("i", "b"))
    return rows.select(
        "page", (F.col("p_partkey") % 20 * 10 + F.col("i")).cast("long").alias("seq"), F.concat_ws("-", "p_partkey", "i").alias("box_id"), "b.text",
        (70 + F.col("p_partkey") % 29).cast("double").alias("confidence"), "b.bbox",
    )


@query()
def medicine_rows(spark, sf_dir):
    """Rows of prescriptions from boxes; compared with the rules applied page by page in the tests."""
    return L.medicine_rows(prescriptions(spark, sf_dir))


_LINES = """l AS (SELECT doc_id AS page, n AS line, t[n] AS text, ['package', 'bill', 'prescription', 'generic'][doc_id % 4 + 1] AS kind, ((doc_id * 7 + n * 13) % 101)::DOUBLE / 100 AS sure,
    ((doc_id + n * 3) % 400)::DOUBLE AS x, (doc_id % 3 * 30 + 12)::DOUBLE AS w, 30::DOUBLE AS h FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(n))"""
_SIGNS = "length(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


def lines(spark, sf_dir):
    """The lines of documents as recognised lines of a page."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "text"))
    n, page = F.col("n") + 1, F.col("page")
    x, w = ((page + n * 3) % 400).cast("double"), (page % 3 * 30 + 12).cast("double")
    zero, high = F.lit(0.0), F.lit(30.0)
    return rows.select(
        "page", n.cast("long").alias("line"), "text", F.element_at(F.array(*[F.lit(k) for k in L.LEAST_SURE]), (page % 4 + 1).cast("int")).alias("kind"),
        ((page * 7 + n * 13) % 101 / 100).alias("confidence"), F.array(F.array(x, zero), F.array(x + w, zero), F.array(x + w, high), F.array(x, high)).alias("points"),
    )


@query(f"""WITH {_LINES}, s AS (SELECT page, count(*) AS n, sum(greatest(1, {_SIGNS.format("text")})) AS total, sum(CASE WHEN h > w * 1.35 THEN greatest(1, {_SIGNS.format("text")}) ELSE 0 END) AS up,
      avg(CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(on|the)([^\\p{{L}}\\p{{N}}_]|$)') THEN x + w / 2 END) AS names, avg(CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(of|de|der)([^\\p{{L}}\\p{{N}}_]|$)') THEN x + w / 2 END) AS sums FROM l GROUP BY 1)
    SELECT page, n >= 3 AND total >= 15 AND up / total::DOUBLE >= 0.65 AS sideways, coalesce(sums < names, FALSE) AS reversed FROM s""")
def page_orientations(spark, sf_dir):
    """Pages on their side and turned around; words of documents stand in for the heads of a bill's columns."""
    rows = lines(spark, sf_dir)
    low = F.lower("text")
    head = F.when(low.rlike(r"\b(?:on|the)\b"), F.lit(" item")).otherwise(F.lit(" "))
    amount = F.when(low.rlike(r"\b(?:of|de|der)\b"), F.lit(" qty")).otherwise(F.lit(" "))
    # The added words have signs of their own, so they stand in lines without weight.
    told = rows.withColumn("text", F.concat(head, amount)).withColumn("points", F.transform("points", lambda p: F.array(F.get(p, F.lit(0)), F.lit(0.0))))
    return L.orientation(rows.select("page", "text", "points").union(told.select("page", "text", "points")))


_CUE = L.CUE.removeprefix("(?i)")


@query(f"""WITH {_LINES}, s AS (SELECT page, any_value(kind) AS kind, length(trim(string_agg(text, chr(10) ORDER BY line), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS len, sum({_SIGNS.format("text")}) AS signs,
      sum(sure * greatest(1, {_SIGNS.format("text")})) / sum(greatest(1, {_SIGNS.format("text")})) AS average, bool_or(sure >= 0.72 AND regexp_matches(text, '\\b[A-Za-z][A-Za-z0-9-]{{3,}}\\b')) AS brand,
      regexp_matches(string_agg(text, chr(10) ORDER BY line), '{_CUE}', 'i') AS cue, count(*) AS n FROM l GROUP BY 1),
    r AS (SELECT *, signs / greatest(1, len)::DOUBLE AS share, list_filter([CASE WHEN len < CASE WHEN kind = 'package' AND brand THEN 4 WHEN kind = 'package' THEN 10 ELSE 14 END THEN 'insufficient_text' END,
      CASE WHEN average < CASE kind WHEN 'package' THEN 0.48 WHEN 'bill' THEN 0.45 WHEN 'prescription' THEN 0.30 ELSE 0.42 END THEN 'low_average_confidence' END,
      CASE WHEN signs / greatest(1, len)::DOUBLE < 0.45 THEN 'low_alphanumeric_ratio' END, CASE WHEN kind = 'package' AND NOT cue AND average < 0.65 THEN 'no_medication_signal' END], lambda x: x IS NOT NULL) AS reasons FROM s)
    SELECT page, len(reasons) = 0 AS accepted, CAST(round(CAST(0.55::DOUBLE * average + 0.2::DOUBLE * least(len / 160.0::DOUBLE, 1) + 0.15::DOUBLE * least(n / 8.0::DOUBLE, 1) + CASE WHEN cue THEN 0.1::DOUBLE ELSE 0 END AS DECIMAL(18, 9)), 4) AS DOUBLE) AS score,
      reasons[1] AS reason, array_to_string(reasons, ',') AS reasons, CAST(len AS BIGINT) AS text_length, CAST(round(CAST(share AS DECIMAL(18, 9)), 4) AS DOUBLE) AS sign_share, cue FROM r""")
def page_quality(spark, sf_dir):
    found = L.quality(lines(spark, sf_dir))
    return found.withColumn("reasons", F.array_join("reasons", ","))


_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_A, _B = _KEY.format("e"), _KEY.format("b[1]")


@query(f"""WITH w AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), lambda x: length(x) > 3) AS names FROM benchmark)
    SELECT item_id, CASE WHEN len(names) = 0 THEN '' ELSE array_to_string(list_reduce(list_transform(names, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda e: {_A} = {_B}
      OR (length({_A}) >= 6 AND length({_B}) >= 6 AND (ends_with({_A}, right({_B}, 5)) OR ends_with({_B}, right({_A}, 5))) AND levenshtein({_A}, {_B}) <= 3))) > 0 THEN a ELSE list_concat(a, b) END), ' ') END AS kept FROM w""")
def names_without_variants(spark, sf_dir):
    """The longer words of each benchmark item in order, without those that are like an earlier one."""
    names = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), lambda x: F.length(x) > 3)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(L.first_of_similar(names), " ").alias("kept"))
