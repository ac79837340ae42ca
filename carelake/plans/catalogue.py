"""Catalogue queries over parts and pages."""

from pyspark.sql import functions as F

from carelake.functions import compositions as K
from carelake.functions import text as X
from carelake.operators import catalogue as C
from carelake.plans.registry import query
from carelake.sources.views import DOSES, dealt, doses, table


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("""SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key,
    regexp_replace(regexp_replace(lower(trim(p_type || ' ' || p_brand)), '[^a-z0-9%]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part""")
def normalized_names(spark, sf_dir):
    return _parts(spark, sf_dir).select(
        F.col("p_partkey").alias("id"),
        X.name_key(F.col("p_name")).alias("key"),
        X.slug(F.concat_ws(" ", "p_type", "p_brand")).alias("slug"),
    )


_ROWS = """r AS (SELECT p_partkey AS n, lower(p_name) || '|' || p_brand AS key, p_type AS name, p_size > 2 AS valid FROM part)"""


def _rows(spark, sf_dir):
    return _parts(spark, sf_dir).select(
        F.col("p_partkey").alias("n"),
        F.concat_ws("|", F.lower("p_name"), "p_brand").alias("key"),
        F.col("p_type").alias("name"),
        (F.col("p_size") > 2).alias("valid"),
    )


_MARKED = "d AS (SELECT *, coalesce(n > min(n) FILTER (valid) OVER (PARTITION BY key), false) AS duplicate FROM r)"


@query(f"WITH {_ROWS}, {_MARKED} SELECT n, key, duplicate FROM d")
def in_file_duplicates(spark, sf_dir):
    """Rows that repeat a valid one. Their second key holds the first, so that SQL can say it without rounds."""
    return _marked(spark, sf_dir).select("n", "key", "duplicate")


def _marked(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("identity", F.concat_ws("|", "key", "name"))
    return C.first_in_file(rows, ["key", "identity"], "n", "valid")


_EXISTING = """e AS (SELECT lower(p_name) || '|' || p_brand AS key, min(p_type) AS stored, min(p_partkey) % 5 = 0 AS protected
    FROM part GROUP BY 1 HAVING min(p_retailprice) < 1200)"""
_ACTIONS = f"""WITH {_ROWS}, {_MARKED}, {_EXISTING},
    a AS (SELECT n, CASE WHEN duplicate THEN 'DUPLICATE_IN_FILE' WHEN NOT valid THEN 'INVALID' WHEN protected OR stored = name THEN 'NOOP'
    WHEN stored IS NOT NULL THEN 'UPDATE' ELSE 'CREATE' END AS action FROM d LEFT JOIN e USING (key))"""


def _actions(spark, sf_dir):
    known = _parts(spark, sf_dir).groupBy(F.concat_ws("|", F.lower("p_name"), "p_brand").alias("key")).agg(
        F.min("p_type").alias("stored_name"), (F.min("p_partkey") % 5 == 0).alias("protected"), F.min("p_retailprice").alias("price")
    )
    return C.actions(_marked(spark, sf_dir), known.where("price < 1200").drop("price"))


@query(_ACTIONS + " SELECT * FROM a")
def import_actions(spark, sf_dir):
    return _actions(spark, sf_dir).select("n", "action")


@query(_ACTIONS + " SELECT action, count(*) AS rows FROM a GROUP BY 1")
def import_action_counts(spark, sf_dir):
    return _actions(spark, sf_dir).groupBy("action").agg(F.count("*").alias("rows"))


@query("""WITH r AS (SELECT p_partkey AS id, lower(p_name) AS key, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM part)
    SELECT id, CASE WHEN rn = 1 THEN key ELSE key || '-' || CAST(rn AS VARCHAR) END AS unique_key FROM r""")
def key_decollision(spark, sf_dir):
    rows = _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("key"))
    return C.unique_keys(rows, "key", ["id"]).select("id", "unique_key")


@query("""SELECT p_brand AS brand, arg_min(p_partkey, (CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END, p_partkey)) AS id FROM part GROUP BY 1""")
def source_preference(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    missing = F.when(F.col("p_size") % 4 == 0, 1).otherwise(0)
    return C.prefer(rows, "p_brand", [missing, "p_partkey"]).select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"))


_PLAN = """m AS (SELECT p_partkey AS id, p_name || '|' || p_type AS key, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_size DESC, p_partkey) AS rn,
    count(*) OVER (PARTITION BY p_name, p_type) AS c FROM part)"""


def _plan(spark, sf_dir):
    return C.merge_plan(
        _parts(spark, sf_dir).select(
            F.col("p_partkey").alias("id"), F.concat_ws("|", "p_name", "p_type").alias("key"), F.col("p_size").alias("rank"), F.lit(0).alias("created_at")
        )
    )


@query(f"""WITH {_PLAN} SELECT key, max(id) FILTER (rn = 1) AS winner, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) FILTER (rn > 1) AS losers
    FROM m WHERE c > 1 GROUP BY key""")
def merge_plan(spark, sf_dir):
    losers = F.array_join(F.transform("losers", lambda x: x.cast("string")), ",")
    return _plan(spark, sf_dir).select("key", "winner", losers.alias("losers"))


@query(f"""WITH {_PLAN}, w AS (SELECT key, id AS winner FROM m WHERE rn = 1 AND c > 1), v AS (SELECT id, winner FROM m JOIN w USING (key) WHERE rn > 1)
    SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(winner, l_partkey) AS l_partkey FROM lineitem LEFT JOIN v ON l_partkey = id""")
def merge_repoint(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return C.repoint(lines, _plan(spark, sf_dir), "l_partkey")


@query("""WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 2 // 3 END AS merged_into, p_size > 40 AS archived FROM part)
    SELECT m.id, CASE WHEN m.merged_into IS NULL THEN m.id ELSE t.id END AS resolved FROM m LEFT JOIN m t ON t.id = m.merged_into AND NOT t.archived""")
def merge_redirect(spark, sf_dir):
    key = F.col("p_partkey")
    target = F.when(key % 3 == 0, F.floor(key * 2 / 3).cast("long"))
    return C.redirected(_parts(spark, sf_dir).select(key.alias("id"), target.alias("merged_into"), (F.col("p_size") > 40).alias("archived")))


@query(f"""WITH {DOSES}, n AS (SELECT medicine_id AS key, count(*) AS n FROM doses WHERE status = 'MISSED' GROUP BY 1),
    s AS (SELECT p_partkey AS key, p_partkey % 7 AS demand FROM part WHERE p_size <= 25)
    SELECT coalesce(s.key, n.key) AS key, coalesce(demand, 0) + coalesce(n, 0) AS demand FROM s FULL OUTER JOIN n ON s.key = n.key""")
def demand_counter(spark, sf_dir):
    key = F.col("p_partkey")
    stored = _parts(spark, sf_dir).where("p_size <= 25").select(key.alias("key"), (key % 7).alias("demand"))
    asked = doses(spark, sf_dir).where("status = 'MISSED'").select(F.col("medicine_id").alias("key"))
    return C.demand(stored, asked)


@query(f"""WITH {DOSES} SELECT user_id, status AS raw, arg_min(medicine_id, (scheduled_at, medicine_id)) AS corrected, count(*) AS uses,
    max(scheduled_at) AS last_used FROM doses GROUP BY 1, 2""")
def correction_learning(spark, sf_dir):
    log = doses(spark, sf_dir).select("user_id", F.col("status").alias("raw"), F.col("medicine_id").alias("corrected"), F.col("scheduled_at").alias("at"))
    return C.corrections(log)


@query("""SELECT count(*) AS masters, count(*) FILTER (p_size > 10) AS with_size, floor(count(*) FILTER (p_size > 10) * 10000.0::DOUBLE / count(*) + 0.5) / 100.0::DOUBLE AS share,
    count(DISTINCT p_name) AS names FROM part""")
def coverage_report(spark, sf_dir):
    wanted = F.count_if(F.col("p_size") > 10)
    return _parts(spark, sf_dir).agg(
        F.count("*").alias("masters"), wanted.alias("with_size"), (F.floor(wanted * 10000.0 / F.count("*") + 0.5) / 100.0).alias("share"), F.countDistinct("p_name").alias("names")
    )


@query("""WITH c AS (SELECT p_partkey AS id, CAST(p_partkey * 7919 + 10000000 AS VARCHAR) AS code FROM part
      UNION ALL SELECT o_orderkey + 1000000000, CAST(o_orderkey * 104729 + 1000000000000 AS VARCHAR) FROM orders
      UNION ALL SELECT o_orderkey + 2000000000, '0' || CAST(o_orderkey * 1299709 AS VARCHAR) || 'x' FROM orders),
    d AS (SELECT id, code, list_transform(range(1, length(code) + 1), lambda i: try_cast(substr(reverse(code), i, 1) AS BIGINT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) AS w FROM c)
    SELECT id, code, regexp_matches(code, '^([0-9]{8}|[0-9]{12,14})$') AND coalesce(list_sum(w), 0) % 10 = 0 AS valid FROM d""")
def gtin_checksums(spark, sf_dir):
    """Codes of 8 and 13 digits from keys, and some that aren't digits alone."""
    part, orders = _parts(spark, sf_dir), table(spark, sf_dir, "orders")
    key, order = F.col("p_partkey"), F.col("o_orderkey")
    rows = part.select(key.alias("id"), (key * 7919 + 10000000).cast("string").alias("code"))
    rows = rows.union(orders.select(order + 1000000000, (order * 104729 + 1000000000000).cast("string")))
    odd = orders.select(order + 2000000000, F.concat(F.lit("0"), (order * 1299709).cast("string"), F.lit("x")))
    return rows.union(odd).select("id", "code", X.gtin_valid(F.col("code")).alias("valid"))


@query("""WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '₹' || CAST(CAST(p_retailprice * 10 AS BIGINT) / 10.0 AS DECIMAL(12,1)) WHEN 1 THEN ' 1,' || CAST(p_size + 100 AS VARCHAR) || ' '
      WHEN 2 THEN p_name ELSE CAST(p_size AS VARCHAR) || '.12345' END AS raw FROM part),
    b AS (SELECT id, raw, regexp_replace(raw, '[₹,\\s]', '', 'g') AS bare FROM r)
    SELECT id, raw, CASE WHEN regexp_matches(bare, '^[0-9]+([.][0-9]{1,4})?$') THEN CAST(bare AS DECIMAL(18,2)) END AS price,
           CASE WHEN regexp_matches(bare, '^[0-9]+([.][0-9]{1,4})?$') THEN '' ELSE 'price ignored: invalid decimal value.' END AS warning FROM b""".replace("\\\\", "\\"))
def price_parse(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    tenths = (F.round(F.col("p_retailprice") * 10).cast("long") / 10.0).cast("decimal(12,1)").cast("string")
    raw = (
        F.when(key % 4 == 0, F.concat(F.lit("₹"), tenths))
        .when(key % 4 == 1, F.concat(F.lit(" 1,"), (F.col("p_size") + 100).cast("string"), F.lit(" ")))
        .when(key % 4 == 2, F.col("p_name"))
        .otherwise(F.concat(size, F.lit(".12345")))
    )
    rows = _parts(spark, sf_dir).select(key.alias("id"), raw.alias("raw"))
    price = X.price(F.col("raw"))
    told = F.when(price.isNull(), F.lit("price ignored: invalid decimal value.")).otherwise(F.lit(""))
    return rows.select("id", "raw", price.alias("price"), told.alias("warning"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)
    SELECT page_id, host, CASE WHEN host LIKE '%.example.net' OR host = 'example.net' THEN 'official' WHEN host LIKE '%.example.org' OR host = 'example.org' THEN 'reference' ELSE 'rejected' END AS source FROM h""")
def source_domains(spark, sf_dir):
    host = F.parse_url("url", F.lit("HOST"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    lists = {"official": ["example.net"], "reference": ["example.org"]}
    return rows.withColumn("source", C.domain_class(F.col("host"), lists))


@query("""WITH p AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-' || CAST(CASE WHEN p_size % 3 = 0 THEN p_size * 1000 ELSE p_size END AS VARCHAR) || 'mg' AS a FROM part)
    SELECT id, array_to_string(list_sort([a, 'ascorbic-acid-500mg', 'ambroxol-30mg-per-5ml']), '+') AS key FROM p""")
def composition_keys(spark, sf_dir):
    """Keys of compositions made of each part's name and size, a vitamin under another name and a concentration."""
    size = F.col("p_size").cast("string")
    dose = F.when(F.col("p_size") % 3 == 0, F.concat(size, F.lit(" g"))).otherwise(F.concat(F.lit("("), size, F.lit(" MG)")))
    made = F.concat(F.lit("Vit C 0.5 g & "), F.initcap("p_name"), F.lit(" "), dose, F.lit(" with Ambroxol (30mg/5ml)"))
    return dealt(_parts(spark, sf_dir), "p_partkey").select(F.col("p_partkey").alias("id"), K.salt_key(made).alias("key"))


@query("""SELECT p_partkey AS id, p_name AS brand, CASE WHEN p_size % 2 = 0 THEN 'kit' WHEN p_size % 3 = 0 THEN 'capsule' ELSE 'syrup' END AS form FROM part""")
def brands_and_forms(spark, sf_dir):
    size = F.col("p_size")
    form = F.when(size % 3 == 0, F.lit("Capsules")).otherwise(F.lit("Syrup"))
    name = F.concat("p_name", F.lit("  "), form)
    kind = F.when(size % 2 == 0, F.lit(" Kit ")).otherwise(F.lit("Allopathy"))
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), K.clean_brand(name).alias("brand"), K.form_of(kind, name, F.lit(None).cast("string")).alias("form"))
