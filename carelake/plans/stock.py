"""Stock queries over orders and line items as refills and an inventory ledger."""

from pyspark.sql import functions as F

from carelake.operators import stock as S
from carelake.plans.registry import query
from carelake.sources.views import table


@query("""SELECT o_custkey AS key, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank
    FROM orders QUALIFY rank <= 5""")
def latest_n_per_parent(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return S.latest_per(rows, "key", [F.desc("o_orderdate"), "id"], 5).drop("o_orderdate")


@query("""WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
    SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS recent FROM k WHERE rn <= 5 GROUP BY 1""")
def nested_recent_refills(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    out = S.nested_latest(rows, "o_custkey", [F.desc("o_orderdate"), "o_orderkey"], 5, F.col("o_orderkey"))
    return out.select("o_custkey", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("recent"))


_STOCK = """s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 != 0 THEN p_size - 3 END AS remaining,
    CASE WHEN p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE (p_partkey % 5 + 1) / 2.0::DOUBLE END AS daily,
    CASE WHEN p_partkey % 4 = 0 THEN 12 END AS threshold FROM part)"""


@query(f"""WITH {_STOCK}, d AS (SELECT *, CASE WHEN daily > 0 AND remaining IS NOT NULL THEN CAST(floor(remaining / daily) AS BIGINT) END AS n FROM s),
    l AS (SELECT id, n, CASE WHEN remaining IS NULL THEN 'UNKNOWN' WHEN remaining <= 0 THEN 'OUT' WHEN n <= 3 THEN 'CRITICAL'
           WHEN remaining <= threshold OR n <= 7 THEN 'LOW' WHEN n <= 14 THEN 'ADEQUATE' WHEN n IS NULL AND threshold IS NULL THEN 'UNKNOWN' ELSE 'GOOD' END AS status FROM d)
    SELECT id, status, coalesce(n, -1) AS days, status IN ('OUT', 'CRITICAL', 'LOW') AS needs_refill,
           CASE WHEN n IS NOT NULL THEN CAST(DATE '2024-01-31' + CAST(greatest(0, n - 5) AS INTEGER) AS DATE) END AS suggested FROM l""")
def stock_forecast(spark, sf_dir):
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.when(key % 9 != 0, F.col("p_size") - 3).alias("remaining"),
        F.when(key % 7 == 0, F.lit(0.0)).otherwise((key % 5 + 1) / 2.0).alias("daily"),
        F.when(key % 4 == 0, F.lit(12)).alias("threshold"),
    )
    return S.forecast(rows, "2024-01-31")


_LEVELS = """l AS (SELECT l_partkey AS key, l_shipdate AS moment, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS id,
    CAST(l_quantity AS BIGINT) - 10 AS remaining FROM lineitem)"""


@query(f"""WITH {_LEVELS}, v AS (SELECT key, moment, id, CASE WHEN remaining <= 0 THEN 3 WHEN remaining <= 5 THEN 2 WHEN remaining <= 10 THEN 1 ELSE 0 END AS level FROM l)
    SELECT key, moment, id, level FROM v QUALIFY level > coalesce(lag(level) OVER (PARTITION BY key ORDER BY moment, id), 0)""")
def stock_alert_escalation(spark, sf_dir):
    number = "row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity)"
    level = S.alert_level(F.col("l_quantity").cast("long") - 10, F.lit(10))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.col("l_shipdate").alias("at"), F.expr(number).cast("long").alias("id"), level.alias("level")
    )
    return S.escalations(rows).withColumnRenamed("at", "moment")


@query("""WITH e AS (SELECT l_partkey AS key, l_shipdate AS moment, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS id,
    CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS delta FROM lineitem),
    a AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY key ORDER BY moment, id) AS BIGINT) AS after FROM e)
    SELECT key, moment, id, delta, after, after - delta AS before FROM a""")
def ledger_balance(spark, sf_dir):
    number = "row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity)"
    delta = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.col("l_shipdate").alias("at"), F.expr(number).cast("long").alias("id"), delta.alias("delta")
    )
    return S.ledger(rows).withColumnRenamed("at", "moment")


@query("""SELECT l_partkey AS item, l_suppkey % 3 AS provider, arg_min(l_orderkey, (CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END, -epoch_us(l_shipdate), l_orderkey)) AS link_id
    FROM lineitem GROUP BY 1, 2""")
def best_link_per_provider(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("item"),
        (F.col("l_suppkey") % 3).alias("provider"),
        F.when(F.col("l_linestatus") == "F", F.lit("PACKAGE")).otherwise(F.lit("MEDICINE")).alias("scope"),
        F.col("l_shipdate").alias("verified_at"),
        F.col("l_orderkey").alias("link_id"),
    )
    return S.best_links(rows).select("item", "provider", "link_id")


@query("""SELECT p_partkey AS id, CAST(floor((p_retailprice - p_retailprice * (p_size / 100.0::DOUBLE)) / p_retailprice * 100 + 0.5) AS BIGINT) AS savings FROM part""")
def generic_savings(spark, sf_dir):
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), S.savings(price, price * (F.col("p_size") / 100.0)).alias("savings")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(CAST(l_shipdate AS DATE) + CAST(floor(l_quantity / 2.5::DOUBLE) AS INTEGER) AS DATE) AS finish,
    CAST(greatest(CAST(l_shipdate AS DATE) + 1, CAST(l_shipdate AS DATE) + CAST(floor(l_quantity / 2.5::DOUBLE) AS INTEGER) - 5) AS DATE) AS reminder FROM lineitem""")
def bill_forecast(spark, sf_dir):
    bought = F.to_date("l_shipdate")
    finish = F.date_add(bought, F.floor(F.col("l_quantity") / 2.5).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        finish.alias("finish"), F.greatest(F.date_add(bought, 1), F.date_sub(finish, 5)).alias("reminder"),
    )
