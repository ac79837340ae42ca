"""Fuzzy matching and entity resolution over block keys; never an unblocked join of two large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.functions import text as X


def blocks(key: Column) -> Column:
    """Keys of which two similar names share one: the name, its first four letters, and its first letter and length."""
    near = [F.concat(F.lit("l:"), F.substring(key, 1, 1), (F.length(key) + d).cast("string")) for d in (-2, -1, 0, 1, 2)]
    return F.array_distinct(F.array(F.concat(F.lit("="), key), F.concat(F.lit("p:"), F.substring(key, 1, 4)), *near))


def own_blocks(key: Column) -> Column:
    length = F.concat(F.lit("l:"), F.substring(key, 1, 1), F.length(key).cast("string"))
    return F.array_distinct(F.array(F.concat(F.lit("="), key), F.concat(F.lit("p:"), F.substring(key, 1, 4)), length))


def similar_names(names: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs (a, b) of distinct names whose sets of trigrams have a Jaccard similarity of at least `least`.

    Two such sets share one of their n - ceil(least * n) + 1 rarest trigrams, so only those are joined: complete for the
    threshold, and trigrams that most names have are joined by none.
    """
    names = names.select("name").where("name is not null").distinct()
    each = names.select("name", F.explode(X.grams(F.col("name"), 3)).alias("gram"))
    count = each.groupBy("gram").agg(F.count("*").alias("n"))
    ordered = each.join(count, "gram").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))
    size = F.size("g")
    prefix = F.slice("g", F.lit(1), size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1)
    rare = ordered.select("name", F.explode(F.transform(prefix, lambda x: x["gram"])).alias("gram"))
    pairs = rare.withColumnRenamed("name", "a").join(rare.withColumnRenamed("name", "b"), "gram").where("a < b").select("a", "b").distinct()
    return pairs.where(X.jaccard(X.grams(F.col("a"), 3), X.grams(F.col("b"), 3)) >= least)


def fuzzy_keys(left: DataFrame, right: DataFrame, least: float = 0.75) -> DataFrame:
    """Keys of (left_id, left_key) and (right_id, right_key) that match, with the numbers of ids that have them.

    They match when equal, or within one edit up to six letters, else two with a similarity of at least `least`. Keys
    are matched once each, and pairs aren't expanded to ids: joining either side on its key gives the members.
    """
    lk = left.groupBy("left_key").agg(F.count("*").alias("left_ids"))
    rk = right.groupBy("right_key").agg(F.count("*").alias("right_ids"))
    lb = lk.withColumn("block", F.explode(blocks(F.col("left_key"))))
    rb = rk.withColumn("block", F.explode(own_blocks(F.col("right_key"))))
    edits = F.levenshtein("left_key", "right_key")
    close = F.when(F.length("left_key") <= 6, edits <= 1).otherwise(
        (edits <= 2) & (X.edit_similarity(F.col("left_key"), F.col("right_key")) >= least)
    )
    both = lb.join(rb, "block").where(close)
    return both.select("left_key", "right_key", edits.cast("long").alias("edits"), "left_ids", "right_ids").distinct()


def _pieces(text: Column, n: int) -> Column:
    """What stands in each of n cuts of a text into parts of nearly equal length, with its place from the front."""
    size = F.length(text)
    cut = [F.floor(size * i / n).cast("int") for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.substring(text, cut[i] + 1, cut[i + 1] - cut[i]).alias("piece"), cut[i].alias("at")) for i in range(n)])


def best_match(names: DataFrame, dictionary: DataFrame, least: float = 0.82) -> DataFrame:
    """The most similar dictionary entry of each name: (id, entry, similarity); ties go to the lesser entry.

    A similarity of `least` allows an entry of m letters at most d = (1 / least - 1) * m edits, so of d + 1 pieces of it
    one stands unchanged in the name, moved by d places at most. The join is on piece, length and place; only equal
    pieces meet. Names are matched once each. Entries with hot pieces are split by their length.
    """
    edits = F.floor((1 / least - 1) * F.length("entry") + 1e-9).cast("int")
    entries = dictionary.select("entry").where("entry is not null").distinct().withColumn("d", edits)
    most = entries.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]
    cut = F.array(*[F.when(F.col("d") == d, _pieces(F.col("entry"), d + 1)) for d in range(most + 1)])
    held = entries.select("entry", "d", F.explode(cut[F.col("d")]).alias("p")).where("p.piece != ''")
    held = held.select("entry", "d", "p.piece", F.col("p.at").alias("at"), F.length("p.piece").alias("w"))
    spans = held.select("w", "at", "d").groupBy("w", "at").agg(F.max("d").alias("reach"))
    asked = names.select("name").where("name is not null").distinct()
    # Which widths and places pieces have is a table of lengths, not of entries.
    widths = F.broadcast(spans.groupBy().agg(F.collect_set(F.struct("w", "at", "reach")).alias("spans")))
    places = F.sequence(F.greatest(F.col("s.at") - F.col("s.reach"), F.lit(0)), F.col("s.at") + F.col("s.reach"))
    cutouts = asked.join(widths).select("name", F.explode("spans").alias("s")).select("name", "s.w", "s.at", F.explode(places).alias("x"))
    cutouts = cutouts.where(F.col("x") + F.col("w") <= F.length("name")).select("name", "at", F.substring("name", F.col("x") + 1, F.col("w")).alias("piece"))
    score = X.edit_similarity(F.col("name"), F.col("entry"))
    both = cutouts.distinct().join(held, ["piece", "at"]).select("name", "entry").distinct().withColumn("similarity", score)
    best = both.where(F.col("similarity") >= least).groupBy("name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "entry")).alias("b"))
    return names.join(best, "name").select("id", F.col("b.entry").alias("entry"), (-F.col("b.s")).alias("similarity"))


def resolution(scores: DataFrame, strong: float = 0.9, possible: float = 0.7) -> DataFrame:
    """STRONG, POSSIBLE or UNKNOWN for each query by its best score."""
    best = scores.groupBy("qid").agg(F.max("score").alias("best"))
    told = F.when(F.col("best") >= strong, F.lit("STRONG")).when(F.col("best") >= possible, F.lit("POSSIBLE"))
    return best.withColumn("outcome", told.otherwise(F.lit("UNKNOWN")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def nearest(points: DataFrame, places: DataFrame, radius_km: float, k: int) -> DataFrame:
    """The k nearest places within a radius of each point: (point_id, place_id, km, rank).

    Both sides are dealt to grid cells of latitude bands a radius high; a band's cells are as wide as the radius is at
    its edge nearest to a pole, so each point looks into three cells of three bands. Longitudes wrap around, and bands
    at the poles are one cell. Points of one position meet places once, and of a position's places only the k first can
    be among the k nearest of a point, so however many stand in one position, no more meet.
    """
    every = points.select("point_id", "lat", "lon")
    points = every.select("lat", "lon").distinct()
    there = W.Window.partitionBy("plat", "plon").orderBy("place_id")
    places = places.withColumn("rn", F.row_number().over(there)).where(F.col("rn") <= k)
    high = F.lit(max(radius_km / 111.0, 0.01))

    def cells(band: Column) -> Column:
        """How many cells a band has: each at least a radius wide everywhere in it."""
        edge = F.least(F.greatest(F.abs(band * high), F.abs((band + 1) * high)), F.lit(90.0))
        return F.greatest(F.floor(360.0 * F.cos(F.radians(edge)) / high).cast("long"), F.lit(1))

    def cell(lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("long"), n)

    band = F.floor(F.col("lat") / high).cast("long")
    left = points.select("lat", "lon", F.explode(F.array(band - 1, band, band + 1)).alias("x"))
    n = cells(F.col("x"))
    mine = cell(F.col("lon"), n)
    around = F.array_distinct(F.array(*[F.pmod(mine + d, n) for d in (-1, 0, 1)]))
    left = left.select("lat", "lon", "x", F.explode(around).alias("y"))
    there = F.floor(F.col("plat") / high).cast("long")
    right = places.select("place_id", "plat", "plon", there.alias("x"), cell(F.col("plon"), cells(there)).alias("y"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    both = left.join(right, ["x", "y"]).withColumn("km", km).where(F.col("km") <= radius_km)
    order = W.Window.partitionBy("lat", "lon").orderBy("km", "place_id")
    near = both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return every.join(near.select("lat", "lon", "place_id", "km", "rank"), ["lat", "lon"]).select("point_id", "place_id", "km", "rank")


def in_window(opened: DataFrame, doses: DataFrame, hours: int = 3) -> DataFrame:
    """The earliest pending dose within some hours of each cap event of its user: (event_id, dose_id).

    Times are dealt to buckets of the tolerance, so the join is on user and bucket.
    """
    span = hours * 3600
    bucket = F.floor(F.unix_timestamp("at") / span)
    left = opened.withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    right = doses.select("user_id", F.col("id").alias("dose_id"), "scheduled_at", F.floor(F.unix_timestamp("scheduled_at") / span).alias("b"))
    gap = F.abs(F.unix_micros("at") - F.unix_micros("scheduled_at"))
    both = left.join(right, ["user_id", "b"]).where(gap <= span * 1_000_000)
    order = W.Window.partitionBy("event_id").orderBy("scheduled_at", "dose_id")
    return both.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("event_id", "dose_id")
