"""Queries of sliding windows, ordered folds and evaluation metrics."""

from pyspark.sql import functions as F

from carelake.operators import windows as O
from carelake.plans.registry import query
from carelake.sources.views import table

_E = "e AS (SELECT event_id AS id, user_id, event_type AS kind, value, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("kind"), "value", "ts", F.get_json_object("props", "$.k").cast("long").alias("k")
    )


@query(f"""WITH {_E} SELECT CAST(ts AS DATE) AS day, count(*) AS runs, count(*) FILTER (kind = 'error') AS empty, CAST(sum(k) AS BIGINT) AS latency, count(*) FILTER (k >= 90) AS accurate FROM e GROUP BY 1""")
def daily_counters(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"))
    return rows.agg(F.count("*").alias("runs"), F.count_if(F.col("kind") == "error").alias("empty"), F.sum("k").alias("latency"), F.count_if(F.col("k") >= 90).alias("accurate"))


@query(f"""WITH RECURSIVE {_E}, o AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM e),
    f AS (SELECT user_id, n, CAST(k AS DOUBLE) AS mean FROM o WHERE n = 1 UNION ALL
          SELECT o.user_id, o.n, floor((f.mean * (o.n - 1) + o.k) / o.n::DOUBLE + 0.5) FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
    SELECT user_id, arg_max(mean, n) AS mean, max(n) AS n FROM f GROUP BY 1""")
def rounded_rolling_means(spark, sf_dir):
    """A mean rounded at every step, folded over each user's values in order."""
    seen = F.sort_array(F.collect_list(F.struct("ts", "id", "k")))
    rows = _events(spark, sf_dir).groupBy("user_id").agg(seen.alias("seen"))
    mean = O.rounded_rolling_mean(F.transform("seen", lambda x: x["k"].cast("double")))
    return rows.select("user_id", mean.alias("mean"), F.size("seen").cast("long").alias("n"))


@query("""SELECT source, round(sum((doc_id % 100) * greatest(length(coalesce(text, '')), 1))::DOUBLE / sum(greatest(length(coalesce(text, '')), 1))::DOUBLE, 9) AS mean FROM documents GROUP BY 1""")
def length_weighted_mean(spark, sf_dir):
    weight = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))
    rows = table(spark, sf_dir, "documents").groupBy("source")
    return rows.agg(F.round(F.sum((F.col("doc_id") % 100) * weight) / F.sum(weight), 9).alias("mean"))


@query(f"WITH {_E} SELECT kind, median(value) AS median, count(value) AS n FROM e GROUP BY 1")
def medians(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("kind").agg(F.median("value").alias("median"), F.count("value").alias("n"))


@query(f"""WITH {_E}, c AS (SELECT user_id, kind, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT user_id, string_agg(kind || ':' || CAST(n AS VARCHAR), '; ' ORDER BY kind) AS modes FROM c GROUP BY 1""")
def mode_counters(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("user_id", "kind").count().groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("kind", "count"))).alias("m"))
    return rows.select("user_id", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["kind"], x["count"].cast("string"))), "; ").alias("modes"))


@query("""WITH r AS (SELECT d.source AS category, l.quality = 1 AS wanted, length(coalesce(d.text, '')) % 3 != 0 AS told FROM labels l JOIN documents d USING (doc_id)),
    c AS (SELECT category, count(*) FILTER (wanted AND told) AS tp, count(*) FILTER (NOT wanted AND told) AS fp, count(*) FILTER (wanted AND NOT told) AS fn FROM r GROUP BY 1)
    SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
           CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM c""")
def confusion_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    told = F.length(F.coalesce("text", F.lit(""))) % 3 != 0
    rows = rows.select(F.col("source").alias("category"), (F.col("quality") == 1).alias("wanted"), told.alias("told"))
    return O.confusion(rows, "category", "wanted", "told")


@query("""SELECT c_custkey % 40 AS family, count(*) AS members, count(*) FILTER (c_acctbal > 5000) AS done, count(*) FILTER (c_acctbal <= 5000 AND c_acctbal > 0) AS due, count(*) FILTER (c_acctbal <= 0) AS overdue,
    CAST(floor(count(*) FILTER (c_acctbal > 5000) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS completion FROM customer GROUP BY 1""")
def family_summary(spark, sf_dir):
    x, done = F.col("c_acctbal"), F.count_if(F.col("c_acctbal") > 5000)
    return table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 40).alias("family")).agg(
        F.count("*").alias("members"),
        done.alias("done"),
        F.count_if((x <= 5000) & (x > 0)).alias("due"),
        F.count_if(x <= 0).alias("overdue"),
        F.floor(done * 100.0 / F.count("*") + 0.5).alias("completion"),
    )


@query("""WITH s AS (SELECT vec_id, label, CASE WHEN vec_id % 10 < 8 THEN 'train' WHEN vec_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM embeddings)
    SELECT split, label, count(*) AS n, count(DISTINCT vec_id // 2) AS images FROM s GROUP BY 1, 2""")
def split_counts(spark, sf_dir):
    i = F.col("vec_id")
    split = F.when(i % 10 < 8, F.lit("train")).when(i % 10 == 8, F.lit("val")).otherwise(F.lit("test"))
    return table(spark, sf_dir, "embeddings").groupBy(split.alias("split"), "label").agg(F.count("*").alias("n"), F.countDistinct(F.floor(i / 2)).alias("images"))


@query("""SELECT CAST(sha256_part AS VARCHAR) AS split, count(*) AS n FROM (SELECT CASE WHEN h < 13 THEN 'train' WHEN h = 13 THEN 'val' ELSE 'test' END AS sha256_part
    FROM (SELECT instr('0123456789abcdef', substr(sha256('seed:' || CAST(doc_id AS VARCHAR)), 1, 1)) - 1 AS h FROM documents)) GROUP BY 1""")
def stable_hash_split(spark, sf_dir):
    """The split of a seed and an index by their SHA-256, so it stays when rows are added."""
    share = F.conv(F.substring(F.sha2(F.concat(F.lit("seed:"), F.col("doc_id").cast("string")), 256), 1, 16), 16, 10).cast("decimal(20)") / F.lit(2.0**64)
    split = F.when(share < 13 / 16, F.lit("train")).when(share < 14 / 16, F.lit("val")).otherwise(F.lit("test"))
    return table(spark, sf_dir, "documents").groupBy(split.alias("split")).agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS place FROM e QUALIFY place <= 50")
def newest_buffer(spark, sf_dir):
    return O.newest(_events(spark, sf_dir), "user_id", [F.desc("ts"), F.desc("id")], 50).select("user_id", "id", "place")


@query("""WITH t AS (SELECT conv_id, turn, role AS text, length(coalesce(text, ''))::DOUBLE AS v FROM conversations WHERE turn IS NOT NULL),
    u AS (SELECT conv_id, turn, min(text) AS text, max(v) AS v FROM t GROUP BY 1, 2),
    w AS (SELECT *, lead(text, 1) OVER o AS t1, lead(text, 2) OVER o AS t2, lead(v, 1) OVER o AS v1, lead(v, 2) OVER o AS v2 FROM u WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, 1 AS lines, text, v AS mean FROM w WHERE text IS NOT NULL UNION ALL SELECT conv_id, turn, 2, concat_ws(' ', text, t1), (v + v1) / 2 FROM w WHERE t1 IS NOT NULL
    UNION ALL SELECT conv_id, turn, 3, concat_ws(' ', text, t1, t2), (v + v1 + v2) / 3 FROM w WHERE t2 IS NOT NULL""")
def line_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("turn is not null")
    rows = rows.groupBy("conv_id", "turn").agg(F.min("role").alias("text"), F.max(F.length(F.coalesce("text", F.lit(""))).cast("double")).alias("v"))
    return O.text_windows(rows, "conv_id", "turn", "text", "v")


@query("""WITH t AS (SELECT p_partkey AS id, string_split(lower(p_name || ' ' || p_type), ' ') AS t FROM part)
    SELECT id, unnest(list_concat(list_concat(list_transform(range(1, len(t) + 1), lambda i: t[i]), list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])),
      list_concat(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]), list_transform(range(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3])))) AS gram FROM t""")
def token_grams(spark, sf_dir):
    tokens = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(O.token_grams(tokens)).alias("gram"))


@query(f"WITH {_E}, g AS (SELECT user_id, id, lead(k) OVER (PARTITION BY user_id ORDER BY ts, id) - k AS gap FROM e) SELECT user_id, id, gap FROM g WHERE gap > 0")
def positive_gaps(spark, sf_dir):
    return O.positive_gaps(_events(spark, sf_dir), "user_id", ["ts", "id"], F.col("k")).select("user_id", "id", "gap")


@query(f"""WITH {_E} SELECT id, sum(k) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9.0::DOUBLE AS box,
    avg(k) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS edge FROM e""")
def smoothed(spark, sf_dir):
    k = F.col("k")
    return _events(spark, sf_dir).select("id", O.box_smoothed(k, "user_id", ["ts", "id"]).alias("box"), O.edge_smoothed(k, "user_id", ["ts", "id"], 3).alias("edge"))


@query(f"""WITH {_E}, r AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
    SELECT user_id, k FROM r WHERE i = floor((n - 1) * 0.9::DOUBLE)""")
def nearest_rank(spark, sf_dir):
    return O.nearest_rank(_events(spark, sf_dir), "user_id", "k", 0.9)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_type AS salt, count(*) FILTER (p_size <= 10) AS old, count(*) FILTER (p_size > 10) AS now FROM part GROUP BY 1)
    SELECT count(*) FILTER (now > 0) AS salts, count(*) FILTER (now > 0 AND old = 0) AS created, count(*) FILTER (now > 0 AND old > 0) AS reused FROM s""")
def new_and_reused(spark, sf_dir):
    """Distinct salts of an import: those that were there before and those that are new."""
    old, now = F.count_if(F.col("p_size") <= 10).alias("old"), F.count_if(F.col("p_size") > 10).alias("now")
    rows = table(spark, sf_dir, "part").groupBy("p_type").agg(old, now).where("now > 0")
    return rows.agg(F.count("*").alias("salts"), F.count_if(F.col("old") == 0).alias("created"), F.count_if(F.col("old") > 0).alias("reused"))


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS category, o_orderkey % 7 = 0 AS recovered, o_orderkey % 5000 AS latency FROM orders), l AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_partkey % 6 AS VARCHAR) AS told, CAST(l_suppkey % 6 AS VARCHAR) AS wanted FROM lineitem),
    f AS (SELECT id, told, min(n) AS n FROM l WHERE told != '5' GROUP BY 1, 2), w AS (SELECT id, wanted, min(n) AS n FROM l WHERE wanted != '5' GROUP BY 1, 2),
    a AS (SELECT c.*, coalesce((SELECT list(told ORDER BY n, told) FROM f WHERE f.id = c.id), []) AS told, coalesce((SELECT list(wanted ORDER BY n, wanted) FROM w WHERE w.id = c.id), []) AS wanted FROM c),
    b AS (SELECT *, len(list_intersect(told, wanted)) AS hits FROM a),
    s AS (SELECT category, count(*) AS cases, CAST(sum(hits) AS BIGINT) AS tp, CAST(sum(len(told) - hits) AS BIGINT) AS fp, CAST(sum(len(wanted) - hits) AS BIGINT) AS fn, count(*) FILTER (told[1] = wanted[1]) AS one, count(*) FILTER (list_contains(told[1:3], wanted[1])) AS three,
      count(*) FILTER (recovered) AS recoveries, count(*) FILTER (recovered AND len(told) > 0 AND hits = 0) AS lost, count(*) FILTER (len(told) = 0) AS nothing, avg(latency) AS latency FROM b GROUP BY 1)
    SELECT category, cases, tp, fp, fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, one / cases::DOUBLE AS top1, three / cases::DOUBLE AS top3,
      CASE WHEN recoveries > 0 THEN lost / recoveries::DOUBLE ELSE 0 END AS false_recovery, nothing / cases::DOUBLE AS empty, round(latency, 9) AS latency FROM s""")
def recognition_quality(spark, sf_dir):
    """Orders as cases of recognition, whose lines tell the names that were read and those that were meant."""
    lines = table(spark, sf_dir, "lineitem")

    def names(key, column):
        name = (F.col(key) % 6).cast("string")
        first = lines.where(name != "5").groupBy("l_orderkey", name.alias("x")).agg(F.min("l_linenumber").alias("n"))
        held = F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"])
        return first.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(held.alias(column))

    orders = table(spark, sf_dir, "orders").join(names("l_partkey", "told"), "o_orderkey", "left").join(names("l_suppkey", "wanted"), "o_orderkey", "left")
    key = F.col("o_orderkey")
    return O.recognition(orders.select(F.col("o_orderpriority").alias("category"), "told", "wanted", (key % 7 == 0).alias("recovered"), (key % 5000).alias("latency")), "category")
