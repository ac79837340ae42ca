"""Matching, search and spatial queries."""

from pyspark.sql import functions as F

from carelake.functions import similarity as U
from carelake.functions import text as X
from carelake.operators import matching as M
from carelake.plans.registry import query
from carelake.shipping import ship
from carelake.sources.views import DOSES, doses, table

_NAMES = "n AS (SELECT DISTINCT lower(p_name) AS name FROM part)"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substr({0}, i, 3)))"


@query(f"""WITH {_NAMES}, p AS (SELECT a.name AS a, b.name AS b, {_GRAMS.format("a.name")} AS ga, {_GRAMS.format("b.name")} AS gb FROM n a JOIN n b ON a.name < b.name),
    s AS (SELECT a, b, len(list_intersect(ga, gb)) AS shared, len(ga) AS la, len(gb) AS lb, 1.0::DOUBLE - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS edit FROM p)
    SELECT a, b, round(edit, 9) AS edit, round(2.0::DOUBLE * shared / (la + lb), 9) AS dice, round(shared::DOUBLE / (la + lb - shared), 9) AS jaccard FROM s WHERE shared::DOUBLE / (la + lb - shared) >= 0.3""")
def name_similarity(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    pairs = M.similar_names(names, 0.3)
    ga, gb = X.grams(F.col("a"), 3), X.grams(F.col("b"), 3)
    return pairs.select(
        "a",
        "b",
        F.round(X.edit_similarity(F.col("a"), F.col("b")), 9).alias("edit"),
        F.round(X.dice(ga, gb), 9).alias("dice"),
        F.round(X.jaccard(ga, gb), 9).alias("jaccard"),
    )


@query("""WITH k AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k, count(*) AS n FROM part GROUP BY 1), m AS (SELECT substr(k, 2) AS k, sum(n) AS n FROM k GROUP BY 1)
    SELECT m.k AS left_key, k.k AS right_key, CAST(levenshtein(m.k, k.k) AS BIGINT) AS edits, CAST(m.n AS BIGINT) AS left_ids, k.n AS right_ids FROM m JOIN k ON
    (m.k = k.k OR substr(m.k, 1, 4) = substr(k.k, 1, 4) OR (substr(m.k, 1, 1) = substr(k.k, 1, 1) AND abs(length(m.k) - length(k.k)) <= 2))
    AND CASE WHEN length(m.k) <= 6 THEN levenshtein(m.k, k.k) <= 1 ELSE levenshtein(m.k, k.k) <= 2 AND 1.0 - levenshtein(m.k, k.k) / greatest(length(m.k), length(k.k))::DOUBLE >= 0.75 END""")
def fuzzy_match(spark, sf_dir):
    """All part names, one letter short, against all part names: matching keys and how many parts have each."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.name_key(F.col("p_name")).alias("k"))
    left = part.select(F.col("id").alias("left_id"), F.expr("substring(k, 2)").alias("left_key"))
    return M.fuzzy_keys(left, part.select(F.col("id").alias("right_id"), F.col("k").alias("right_key")))


@query("""WITH d AS (SELECT DISTINCT p_name AS entry FROM part), n AS (SELECT p_partkey AS id, p_name || 'x' AS name FROM part),
    s AS (SELECT id, entry, 1.0::DOUBLE - levenshtein(name, entry) / greatest(length(name), length(entry))::DOUBLE AS similarity FROM n, d)
    SELECT id, entry, similarity FROM s WHERE similarity >= 0.82 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, entry) = 1""")
def best_dictionary_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("x")).alias("name"))
    return M.best_match(names, part.select(F.col("p_name").alias("entry")).distinct())


@query("""WITH k AS (SELECT p_partkey AS id, lower(p_name || ' 1047|!mg Clarm phivv') AS t FROM part), o AS (SELECT id,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[0o]', 'o', 'g'), '[1l|!]', 'l', 'g'), '[5s]', 's', 'g'), '[2z]', 'z', 'g'), '[8b]', 'b', 'g') AS t FROM k)
    SELECT id, regexp_replace(replace(replace(replace(replace(t, 'vv', 'w'), 'rn', 'm'), 'cl', 'd'), 'ph', 'f'), '[^a-z0-9]', '', 'g') AS key FROM o""")
def lookalike_keys(spark, sf_dir):
    name = F.concat("p_name", F.lit(" 1047|!mg Clarm phivv"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.lookalike_key(name).alias("key"))


@query()
def ocr_distances(spark, sf_dir):
    ship(spark)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    seen = F.translate("p_name", "leo", "1c0")
    return part.select(
        "id", F.round(U.ocr_distance("p_name", seen), 6).alias("distance"), U.fnv_id("p_name").alias("number"), X.compatible_form(F.col("p_name")).alias("form")
    )


_PLACES = "(c_custkey % 700) / 10.0::DOUBLE - 30 AS lat, (c_custkey % 1300) / 10.0::DOUBLE - 60 AS lon"


@query(f"""WITH p AS (SELECT c_custkey AS point_id, {_PLACES} FROM customer),
    s AS (SELECT s_suppkey AS place_id, (s_suppkey * 7 % 700) / 10.0::DOUBLE - 30 AS plat, (s_suppkey * 13 % 1300) / 10.0::DOUBLE - 60 AS plon FROM supplier),
    d AS (SELECT point_id, place_id, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2))) AS km FROM p, s)
    SELECT point_id, place_id, round(km, 6) AS km, row_number() OVER (PARTITION BY point_id ORDER BY km, place_id) AS rank FROM d WHERE km <= 600 QUALIFY rank <= 3""")
def nearest_facilities(spark, sf_dir):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "customer").select(c.alias("point_id"), ((c % 700) / 10.0 - 30).alias("lat"), ((c % 1300) / 10.0 - 60).alias("lon"))
    places = table(spark, sf_dir, "supplier").select(
        s.alias("place_id"), ((s * 7 % 700) / 10.0 - 30).alias("plat"), ((s * 13 % 1300) / 10.0 - 60).alias("plon")
    )
    return M.nearest(points, places, 600.0, 3).withColumn("km", F.round("km", 6))


@query(f"""WITH {DOSES}, o AS (SELECT id AS event_id, user_id, scheduled_at AS m FROM doses WHERE status = 'SKIPPED'),
    j AS (SELECT event_id, d.id AS dose_id, d.scheduled_at AS s FROM o JOIN doses d ON d.user_id = o.user_id AND d.status = 'PENDING' AND abs(epoch_us(d.scheduled_at) - epoch_us(m)) <= 10800000000)
    SELECT event_id, arg_min(dose_id, (s, dose_id)) AS dose_id FROM j GROUP BY 1""")
def smartcap_match(spark, sf_dir):
    rows = doses(spark, sf_dir)
    opened = rows.where("status = 'SKIPPED'").select(F.col("id").alias("event_id"), "user_id", F.col("scheduled_at").alias("at"))
    return M.in_window(opened, rows.where("status = 'PENDING'"))
