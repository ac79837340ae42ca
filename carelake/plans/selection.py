"""Queries of filters, set operations, orders and pages."""

from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.operators import selection as S
from carelake.plans.registry import query
from carelake.sources.views import DOSES, doses, table


@query(f"""WITH {DOSES} SELECT id, status FROM doses WHERE (status = 'PENDING' AND scheduled_at >= TIMESTAMP '2024-01-10 00:00:00' AND scheduled_at <= TIMESTAMP '2024-01-11 00:00:00')
    OR (status = 'SNOOZED' AND scheduled_at + INTERVAL 30 MINUTE <= TIMESTAMP '2024-01-10 00:00:00')""")
def due_or_woken(spark, sf_dir):
    """Pending doses within a window, or snoozed ones whose time is over."""
    at, lo, hi = F.col("scheduled_at").cast("timestamp_ntz"), F.expr("timestamp_ntz'2024-01-10 00:00:00'"), F.expr("timestamp_ntz'2024-01-11 00:00:00'")
    pending = (F.col("status") == "PENDING") & at.between(lo, hi)
    woken = (F.col("status") == "SNOOZED") & (at + F.expr("interval 30 minutes") <= lo)
    return doses(spark, sf_dir).where(pending | woken).select("id", "status")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
def optional_date_range(spark, sf_dir):
    """The end is no date, so only the start counts."""
    return S.in_optional_range(table(spark, sf_dir, "orders"), "o_orderdate", "1997-06-01", "not-a-date").select(F.col("o_orderkey").alias("id"))


@query("""SELECT p_partkey AS id FROM part WHERE lower(p_name) LIKE 'widg%' OR lower(p_type) LIKE 'widg%' OR contains(lower(p_name), 'widg') OR contains(lower(p_type), 'widg')""")
def name_or_type_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(S.found_in(["p_name", "p_type"], "WIDG")).select(F.col("p_partkey").alias("id"))


@query("""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 365 DAY END AS expires FROM orders)
    SELECT id FROM s WHERE expires IS NULL OR expires > TIMESTAMP '1998-01-01 00:00:00'""")
def unexpired_shares(spark, sf_dir):
    expires = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("interval 365 days"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), expires.alias("expires"))
    return rows.where(S.not_expired("expires", F.expr("timestamp_ntz'1998-01-01 00:00:00'"))).select("id")


@query("""WITH d AS (SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS emergency, s_suppkey % 5 = 0 AS trauma, s_acctbal > 0 AS open FROM supplier)
    SELECT id, 'emergency' AS category FROM d WHERE emergency OR trauma UNION ALL SELECT id, 'open' FROM d WHERE open""")
def directory_categories(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        key.alias("id"), (key % 3 == 0).alias("emergency"), (key % 5 == 0).alias("trauma"), (F.col("s_acctbal") > 0).alias("open")
    )
    of = F.array_compact(F.array(F.when(F.col("emergency") | F.col("trauma"), F.lit("emergency")), F.when(F.col("open"), F.lit("open"))))
    return rows.select("id", F.explode(of).alias("category"))


@query("SELECT p_partkey AS id FROM part WHERE len(list_filter(string_split(p_type, ' '), lambda x: contains(lower(x), 'ee'))) > 0")
def any_of_a_list(spark, sf_dir):
    words = F.split("p_type", " ")
    return table(spark, sf_dir, "part").where(F.exists(words, lambda x: F.lower(x).contains("ee"))).select(F.col("p_partkey").alias("id"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500")
def keyset_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return S.after_cursor(rows, "id", 100, 500)


@query("""SELECT p_brand AS brand, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, length(p_name) DESC, p_retailprice, p_type, p_name, p_partkey) AS position
    FROM part QUALIFY position <= 5""")
def six_key_priority(spark, sf_dir):
    order = W.Window.partitionBy("p_brand").orderBy(F.desc("p_size"), F.desc(F.length("p_name")), "p_retailprice", "p_type", "p_name", "p_partkey")
    rows = table(spark, sf_dir, "part").withColumn("position", F.row_number().over(order).cast("long"))
    return rows.where("position <= 5").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), "position")


@query("""SELECT p_brand AS brand, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 40 THEN 0 ELSE 1 END, p_partkey) AS position FROM part QUALIFY position <= 6""")
def identity_first_six(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), "p_size")
    return S.two_lists(rows, "brand", F.col("p_size") > 40, ["id"], 6).select("brand", "id", "position")


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey // 50 AS page, (p_partkey * 37 % 400) / 1.0::DOUBLE AS y, (p_partkey * 91 % 900) / 1.0::DOUBLE AS x FROM part)
    SELECT id, page, row_number() OVER (PARTITION BY page ORDER BY round_even(y / 13.0::DOUBLE, 0), x, y) AS place FROM b""")
def reading_order(spark, sf_dir):
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        key.alias("id"), F.floor(key / 50).cast("long").alias("page"), (key * 37 % 400).cast("double").alias("y"), (key * 91 % 900).cast("double").alias("x")
    )
    return S.reading_order(rows, "page", "y", "x", F.lit(13.0)).select("id", "page", "place")


@query("""SELECT p_partkey AS id, 'name' AS generator, p_name AS mention FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part
    UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_size > 10""")
def all_generators(spark, sf_dir):
    """Mentions of several generators, none of which is dropped."""
    part = table(spark, sf_dir, "part")

    def one(name, rows=part):
        return rows.select(F.col("p_partkey").alias("id"), F.lit(name).alias("generator"), F.col(f"p_{name}").alias("mention"))

    return one("name").unionByName(one("type")).unionByName(one("brand", part.where("p_size > 10")))


@query("""WITH p AS (SELECT s_suppkey AS id, 'Clinic ' || s_name AS name, s_suppkey * 7 % 101 AS km FROM supplier UNION ALL SELECT c_custkey + 1000000, 'CLINIC-' || substr(c_name, 1, 14), c_custkey * 11 % 211 FROM customer),
    k AS (SELECT *, substr(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 1, 16) AS prefix FROM p)
    SELECT prefix, id, name, km FROM k QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY km, id) = 1""")
def nearest_of_a_name(spark, sf_dir):
    """Two lists of places in one, of each name the nearest."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Clinic "), "s_name").alias("name"), (F.col("s_suppkey") * 7 % 101).alias("km"))
    c = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1000000).alias("id"), F.concat(F.lit("CLINIC-"), F.substring("c_name", 1, 14)).alias("name"), (F.col("c_custkey") * 11 % 211).alias("km")
    )
    return S.nearest_by_prefix(s.unionByName(c), "name", "km", "id")


@query("""SELECT l_orderkey AS key, min(n) AS place, arg_max(q, n) AS quantity FROM (SELECT l_orderkey, l_quantity AS q,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) GROUP BY 1""")
def unique_by_key(spark, sf_dir):
    order = W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.row_number().over(order).cast("long").alias("n"), F.col("l_quantity").alias("quantity")
    )
    return S.first_place_last_value(rows, "key", "n")


@query("SELECT sha256(text) AS id, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1")
def identical_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("id"), "doc_id")
    return rows.groupBy("id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))


@query("""WITH r AS (SELECT lower(p_name) AS key, p_partkey AS id, p_type AS line, CASE WHEN p_size % 3 = 0 THEN p_size END AS strength, CASE WHEN p_size % 5 = 0 THEN p_brand END AS pack FROM part)
    SELECT key, arg_max(line, (length(line), -id)) AS line, arg_min(strength, id) FILTER (strength IS NOT NULL) AS strength, arg_min(pack, id) FILTER (pack IS NOT NULL) AS pack FROM r GROUP BY 1""")
def merged_fields(spark, sf_dir):
    """One row per name: the longest line, and of other fields the first that is known."""
    size, i = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.lower("p_name").alias("key"), i.alias("id"), F.col("p_type").alias("line"), F.when(size % 3 == 0, size).alias("strength"), F.when(size % 5 == 0, F.col("p_brand")).alias("pack")
    )

    def first(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)

    return rows.groupBy("key").agg(F.max_by("line", F.struct(F.length("line"), -F.col("id"))).alias("line"), first("strength"), first("pack"))


@query("""WITH p AS (SELECT s_suppkey AS id, lower(substr(s_name, 1, 9)) AS name, (s_suppkey * 7 % 50) / 4000.0::DOUBLE AS lat, (s_suppkey * 13 % 70) / 4000.0::DOUBLE AS lon FROM supplier)
    SELECT name || '-' || CAST(CAST(floor(lat * 1000 + 0.5) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(lon * 1000 + 0.5) AS BIGINT) AS VARCHAR) AS key, min(id) AS id FROM p GROUP BY 1""")
def rounded_places(spark, sf_dir):
    key = F.col("s_suppkey")

    def cell(x):
        return F.floor(x * 1000 + 0.5).cast("string")

    name = F.lower(F.substring("s_name", 1, 9))
    k = F.concat_ws("-", name, cell((key * 7 % 50) / 4000.0), cell((key * 13 % 70) / 4000.0))
    return table(spark, sf_dir, "supplier").groupBy(k.alias("key")).agg(F.min("s_suppkey").alias("id"))


@query("""WITH c AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS identity, p_type, p_size FROM part)
    SELECT identity, id, rank FROM (SELECT *, p_size * 2 + length(p_type) AS rank FROM c) QUALIFY row_number() OVER (PARTITION BY identity ORDER BY rank DESC, id) = 1""")
def best_of_identity(spark, sf_dir):
    """Of equivalent rows the one of the highest rank."""
    identity = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "")
    rank = (F.col("p_size") * 2 + F.length("p_type")).alias("rank")
    rows = table(spark, sf_dir, "part").select(identity.alias("identity"), F.col("p_partkey").alias("id"), rank)
    return rows.groupBy("identity").agg(F.max_by(F.struct("id", "rank"), F.struct("rank", -F.col("id"))).alias("b")).select("identity", "b.*")
