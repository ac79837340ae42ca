"""Queries of record rules, validation, masking and state transitions."""

from pyspark.sql import functions as F

from carelake.functions import text as X
from carelake.operators import records as R
from carelake.plans.registry import query
from carelake.sources.views import DOSES, doses, table

_PLAIN = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '', 'g')"


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("""WITH s AS (SELECT p_partkey AS id, CAST(least(greatest(floor((p_size * 2) * 0.4::DOUBLE + (p_partkey % 101) * 0.3::DOUBLE + (p_partkey * 7 % 101) * 0.3::DOUBLE + 0.5), 0), 100) AS BIGINT) AS score FROM part)
    SELECT id, score, CASE WHEN score >= 85 THEN 'VERIFIED' WHEN score >= 60 THEN 'VERIFY_REQUIRED' WHEN score >= 20 THEN 'NEEDS_REVIEW' ELSE 'REJECT' END AS status FROM s""")
def confidence_scores(spark, sf_dir):
    key = F.col("p_partkey")
    score = R.confidence(F.col("p_size") * 2, key % 101, key * 7 % 101)
    return _part(spark, sf_dir).select(key.alias("id"), score.alias("score")).withColumn("status", R.confidence_status(F.col("score")))


@query("""WITH s AS (SELECT p_partkey AS id, CAST(least(greatest(floor(coalesce(CASE WHEN p_size % 5 != 0 THEN p_size * 3 END, 0) * 0.45::DOUBLE + coalesce(CASE WHEN p_size % 3 != 0 THEN p_partkey % 101 END, 0) * 0.30::DOUBLE
      + coalesce(CASE WHEN p_size % 2 = 0 THEN p_partkey * 7 % 101 END, CASE WHEN p_size % 7 != 0 THEN 100 END, 0) * 0.15::DOUBLE + CASE WHEN p_size % 4 = 1 THEN 100 ELSE 0 END * 0.10::DOUBLE + 0.5), 0), 100) AS BIGINT) AS score FROM part)
    SELECT id, score, CASE WHEN score >= 85 THEN 'VERIFIED' WHEN score >= 60 THEN 'VERIFY_REQUIRED' WHEN score >= 20 THEN 'NEEDS_REVIEW' ELSE 'REJECT' END AS status FROM s""")
def legacy_confidence_scores(spark, sf_dir):
    """Confidence by the older weights, with parts that aren't known."""
    key, size = F.col("p_partkey"), F.col("p_size")
    score = R.legacy_confidence(F.when(size % 5 != 0, size * 3), F.when(size % 3 != 0, key % 101), F.when(size % 2 == 0, key * 7 % 101), F.when(size % 7 != 0, 100), F.when(size % 4 < 2, size % 4 == 1))
    return _part(spark, sf_dir).select(key.alias("id"), score.alias("score")).withColumn("status", R.confidence_status(F.col("score")))


@query("""WITH v AS (SELECT p_partkey AS id, p_partkey // 4 AS page, 0.6::DOUBLE * (p_size * 2) + 0.25::DOUBLE * length(p_name) + 0.15::DOUBLE * length(p_type) AS utility FROM part)
    SELECT page, arg_max(id, (round(utility, 6), -id)) AS id FROM v GROUP BY 1""")
def best_variant(spark, sf_dir):
    value = F.round(R.utility(F.col("p_size") * 2, F.length("p_name"), F.length("p_type")), 6)
    page = F.floor(F.col("p_partkey") / 4).alias("page")
    return _part(spark, sf_dir).groupBy(page).agg(F.max_by("p_partkey", F.struct(value, -F.col("p_partkey"))).alias("id"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size <= 5 OR p_partkey % 20 <= 3 THEN 'critical' WHEN p_size <= 10 OR p_partkey % 20 <= 7 THEN 'low' WHEN p_partkey % 20 <= 14 THEN 'adequate' ELSE 'good' END AS status FROM part""")
def refill_levels(spark, sf_dir):
    key = F.col("p_partkey")
    return _part(spark, sf_dir).select(key.alias("id"), R.refill_status(F.col("p_size"), key % 20).alias("status"))


@query("""WITH m AS (SELECT p_brand AS raw, p_partkey AS id, floor((p_partkey * 37 % 97) / 97.0::DOUBLE * 100 + 0.5) AS points FROM part),
    t AS (SELECT *, max(points) OVER (PARTITION BY raw) AS top FROM m), o AS (SELECT *, top - points <= CASE WHEN top > 90 THEN 3 WHEN top >= 70 THEN 6 ELSE 10 END AS option FROM t)
    SELECT raw, id, option AND count(*) FILTER (option) OVER (PARTITION BY raw) >= 2 AS ambiguous FROM o""")
def ambiguity(spark, sf_dir):
    rows = _part(spark, sf_dir).select(F.col("p_brand").alias("raw"), F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37 % 97) / 97.0).alias("similarity"))
    return R.ambiguous(rows, "raw", "similarity").select("raw", "id", "ambiguous")


@query("""WITH n AS (SELECT p_partkey AS id, lower(p_name) AS a, lower(p_type) AS b FROM part),
    g AS (SELECT id, a, b, list_transform(range(1, length(a)), lambda i: substr(a, i, 2)) AS ga, list_transform(range(1, length(b)), lambda i: substr(b, i, 2)) AS gb FROM n)
    SELECT id, round(2.0::DOUBLE * coalesce(list_sum(list_transform(list_intersect(list_distinct(ga), list_distinct(gb)), lambda x: least(len(list_filter(ga, lambda y: y = x)), len(list_filter(gb, lambda y: y = x))))), 0)
      / (length(a) + length(b) - 2), 9) AS dice, CASE WHEN length(b) > 0 THEN length(a) / length(b)::DOUBLE ELSE 0 END AS share FROM g""")
def bigram_similarity(spark, sf_dir):
    a, b = F.lower("p_name"), F.lower("p_type")
    return _part(spark, sf_dir).select(
        F.col("p_partkey").alias("id"), F.round(R.bigram_dice(a, b), 9).alias("dice"), R.coverage(F.length(a), F.length(b)).alias("share")
    )


@query("""SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM part""")
def titles(spark, sf_dir):
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), R.title_case(F.concat_ws(" ", "p_name", F.lower("p_type"))).alias("title"))


@query("""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 30) AS s FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, s[1] AS sentence FROM s""")
def first_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", R.first_sentence(F.col("text")).alias("sentence"))


@query(f"""WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'MISSING_IMAGE' WHEN 1 THEN 'MISSING_CLINICAL_DETAILS' WHEN 2 THEN 'OCR' END AS kind, CASE WHEN p_size % 2 = 0 THEN p_brand END AS source, p_name AS name,
      CASE WHEN p_size % 7 = 0 THEN 'EAN ' || CAST(p_partkey AS VARCHAR) END AS code, CASE WHEN p_size % 3 = 0 THEN '10 mg' END AS strength, CASE WHEN p_size % 5 != 0 THEN 'm' || CAST(p_partkey AS VARCHAR) END AS master FROM part)
    SELECT id, CASE WHEN code IS NOT NULL THEN 'barcode:' || {_PLAIN.format("code")} WHEN kind = 'MISSING_IMAGE' AND master IS NOT NULL THEN 'missing-image:' || master
      WHEN kind = 'MISSING_CLINICAL_DETAILS' AND master IS NOT NULL THEN 'missing-clinical:' || master
      ELSE coalesce(kind, 'UNKNOWN') || ':' || {_PLAIN.format("coalesce(source, 'MANUAL')")} || ':' || {_PLAIN.format("name")} || ':' || {_PLAIN.format("strength")} END AS key FROM r""")
def review_keys(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(key % 4 == 0, F.lit("MISSING_IMAGE")).when(key % 4 == 1, F.lit("MISSING_CLINICAL_DETAILS")).when(key % 4 == 2, F.lit("OCR"))
    master = F.when(size % 5 != 0, F.concat(F.lit("m"), key.cast("string")))
    code = F.when(size % 7 == 0, F.concat(F.lit("EAN "), key.cast("string")))
    made = R.review_key(kind, F.when(size % 2 == 0, F.col("p_brand")), F.col("p_name"), code, F.when(size % 3 == 0, F.lit("10 mg")), master, master)
    return _part(spark, sf_dir).select(key.alias("id"), made.alias("key"))


@query("""SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'BLUETOOTH_REAL' WHEN 'signup' THEN 'BLUETOOTH_SIMULATED' ELSE 'UNVERIFIED_DEVICE' END AS source,
    CASE event_type WHEN 'purchase' THEN 'DEVICE_REPORTED' ELSE 'QUESTIONABLE' END AS quality, CASE event_type WHEN 'purchase' THEN '' WHEN 'signup' THEN 'SIMULATED_DATA' ELSE 'UNVERIFIED_DEVICE' END AS flags FROM events""")
def device_provenance(spark, sf_dir):
    kind = F.col("event_type")
    trust = F.when(kind == "purchase", F.lit("VERIFIED")).when(kind == "signup", F.lit("SIMULATOR"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), R.provenance(trust).alias("p"))
    return rows.select("id", "p.source", "p.quality", F.array_join("p.flags", ",").alias("flags"))


@query("""WITH t AS (SELECT conv_id, coalesce(role, '') || ': ' || substr(coalesce(text, ''), 1, 200) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC NULLS LAST, text DESC NULLS LAST) AS place FROM conversations)
    SELECT conv_id, string_agg(line, chr(10) ORDER BY place DESC) AS context FROM t WHERE place <= 4 GROUP BY 1""")
def conversation_context(spark, sf_dir):
    return R.context_window(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 4, 200)


@query("""SELECT event_id AS id, array_to_string(list_filter([CASE WHEN value IS NULL THEN 'value missing' END, CASE WHEN value > 90 THEN 'value out of range' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown kind' END], lambda x: x IS NOT NULL), '; ') AS errors FROM events""")
def validation_errors(spark, sf_dir):
    value, kind = F.col("value"), F.col("event_type")
    told = F.array_compact(
        F.array(
            F.when(value.isNull(), F.lit("value missing")),
            F.when(value > 90, F.lit("value out of range")),
            F.when(~kind.isin("view", "click", "purchase"), F.lit("unknown kind")),
        )
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array_join(told, "; ").alias("errors"))


@query("""WITH j AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '{"glucose":1,"extra":"' || p_brand || '"}' ELSE '{"glucose":2,"mealStatus":"FASTING"}' END AS payload FROM part)
    SELECT id, CASE WHEN payload LIKE '%extra%' THEN 'extra' ELSE '' END AS unexpected FROM j""")
def unexpected_keys(spark, sf_dir):
    size = F.col("p_size")
    payload = F.when(size % 2 == 0, F.concat(F.lit('{"glucose":1,"extra":"'), "p_brand", F.lit('"}'))).otherwise(F.lit('{"glucose":2,"mealStatus":"FASTING"}'))
    left = F.array_except(F.json_object_keys(payload), F.array(F.lit("glucose"), F.lit("mealStatus")))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.array_join(left, ",").alias("unexpected"))


@query("""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(string_split(lower(p_type || ' ' || p_name || ' ' || p_type), ' '))), ',') AS permissions FROM part""")
def normalized_permissions(spark, sf_dir):
    words = F.split(F.lower(F.concat_ws(" ", "p_type", "p_name", "p_type")), " ")
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(F.array_distinct(words)), ",").alias("permissions"))


@query("""SELECT c_custkey AS id, substr(c_name, 1, 1) || '***@example.org' AS email, substr(trim(regexp_replace('  ' || c_name || '   of  ' || c_mktsegment, '\\s+', ' ', 'g')), 1, 20) AS label,
    CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS medicine FROM customer""")
def masked_patients(spark, sf_dir):
    """Masked e-mail addresses, cut labels, and a section that only the permitted see."""
    rows = table(spark, sf_dir, "customer").withColumn("permissions", F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("VIEW_MEDICINES"))).otherwise(F.array(F.lit("VIEW_VITALS"))))
    label = F.concat(F.lit("  "), "c_name", F.lit("   of  "), "c_mktsegment")
    return rows.select(
        F.col("c_custkey").alias("id"),
        X.masked_email(F.concat("c_name", F.lit("@example.org"))).alias("email"),
        X.squeezed(label, 20).alias("label"),
        F.when(F.array_contains("permissions", "VIEW_MEDICINES"), F.col("c_mktsegment")).alias("medicine"),
    )


@query(f"""WITH {DOSES} SELECT id, CASE WHEN status IN ('PENDING', 'SNOOZED') AND greatest(scheduled_at + to_minutes(CAST(id % 120 AS INTEGER)), CASE WHEN status = 'SNOOZED' THEN scheduled_at + INTERVAL 3 HOUR END) < TIMESTAMP '2024-01-15 00:00:00'
    THEN 'MISSED' ELSE status END AS status FROM doses""")
def overdue_marking(spark, sf_dir):
    at = F.col("scheduled_at").cast("timestamp_ntz")
    rows = doses(spark, sf_dir).select("id", "status", at.alias("scheduled_at"), (F.col("id") % 120).alias("grace_minutes"), (at + F.expr("interval 3 hours")).alias("snooze_until"))
    return R.overdue(rows, F.expr("timestamp_ntz'2024-01-15 00:00:00'")).select("id", "status")


@query(f"""WITH {DOSES}, c AS (SELECT (l_orderkey * 7 + l_linenumber) % 500 AS id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_orderkey * 100 + l_linenumber AS claim, CASE WHEN l_linenumber % 2 = 0 THEN 'PENDING' ELSE 'SNOOZED' END AS expected FROM lineitem),
    u AS (SELECT DISTINCT id, claim, expected FROM c), w AS (SELECT u.id, min(claim) AS winner FROM u JOIN doses d ON d.id = u.id AND d.status = u.expected GROUP BY 1)
    SELECT u.id, u.claim, coalesce(u.claim = w.winner, false) AS won FROM u LEFT JOIN w ON u.id = w.id""")
def claimed_rows(spark, sf_dir):
    line = F.col("l_linenumber")
    claims = table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 7 + line) % 500).alias("id"), (F.col("l_orderkey") * 100 + line).alias("claim"), F.when(line % 2 == 0, F.lit("PENDING")).otherwise(F.lit("SNOOZED")).alias("expected")
    )
    return R.claimed(doses(spark, sf_dir), claims.distinct())


@query("""WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' ELSE 'SENT' END AS state, o_orderkey % 6 AS tries, o_orderdate AS since, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS ok FROM orders)
    SELECT id, CASE WHEN state != 'PROCESSING' THEN state WHEN ok THEN 'SENT' WHEN NOT ok AND tries + 1 >= 5 THEN 'FAILED' WHEN NOT ok OR since < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 10 MINUTE THEN 'PENDING' ELSE 'PROCESSING' END AS state,
      CASE WHEN state = 'PROCESSING' AND NOT ok THEN tries + 1 ELSE tries END AS tries FROM o""")
def outbox_states(spark, sf_dir):
    key, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    state = F.when(key % 3 == 0, F.lit("PENDING")).when(key % 3 == 1, F.lit("PROCESSING")).otherwise(F.lit("SENT"))
    rows = orders.select(key.alias("id"), state.alias("state"), (key % 6).alias("tries"), F.col("o_orderdate").alias("since"))
    answers = orders.where(key % 7 != 0).select(key.alias("id"), (key % 2 == 0).alias("ok"))
    return R.outbox(rows, answers, F.expr("timestamp_ntz'1997-01-01 00:00:00'"))


@query("""WITH n AS (SELECT l_orderkey AS parent, l_partkey + 1000000 AS child FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT l_orderkey AS parent, l_partkey AS child FROM lineitem)
    SELECT * FROM s WHERE parent NOT IN (SELECT parent FROM n) UNION ALL SELECT * FROM n""")
def replaced_children(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    stored = lines.select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child"))
    new = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("parent"), (F.col("l_partkey") + 1000000).alias("child"))
    return R.replaced_children(stored, "parent", new)


@query("""SELECT o_custkey AS share, count(*) AS accesses, max(o_orderdate) AS last_accessed FROM orders GROUP BY 1""")
def access_counters(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("share")).agg(F.count("*").alias("accesses"), F.max("o_orderdate").alias("last_accessed"))


@query("""SELECT c_custkey AS relationship, o_orderkey AS audit FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 50""")
def access_log(spark, sf_dir):
    """The newest fifty audit rows of each relationship; rows of no relationship are left out."""
    from carelake.operators.windows import newest

    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return newest(rows, "c_custkey", [F.desc("o_orderdate"), "o_orderkey"], 50).select(F.col("c_custkey").alias("relationship"), F.col("o_orderkey").alias("audit"))


@query("""SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 90 DAY)""")
def retention_purge(spark, sf_dir):
    """What stays when read notifications of more than ninety days go."""
    old = F.col("o_orderdate") < F.expr("timestamp_ntz'1997-01-01 00:00:00' - interval 90 days")
    return table(spark, sf_dir, "orders").where(~((F.col("o_orderstatus") == "F") & old)).select(F.col("o_orderkey").alias("id"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1997-01-01 00:00:00' THEN 'EXPIRED' ELSE o_orderstatus END AS status FROM orders""")
def expiry_sweep(spark, sf_dir):
    over = F.col("o_orderdate") + F.expr("interval 30 days") <= F.expr("timestamp_ntz'1997-01-01 00:00:00'")
    status = F.when((F.col("o_orderstatus") == "O") & over, F.lit("EXPIRED")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) || ' mg' END AS strength, CASE p_size % 5 WHEN 0 THEN 'CUSTOM' WHEN 1 THEN 'TWICE_DAILY' WHEN 2 THEN 'THREE_TIMES_DAILY' WHEN 3 THEN 'AS_NEEDED' ELSE 'DAILY' END AS frequency,
    CASE WHEN p_size % 2 = 0 THEN p_size % 10 * 7 ELSE p_size % 10 END AS days FROM part""".replace("|| ' mg'", "|| 'mg'"))
def prescription_parts(spark, sf_dir):
    """Strength, frequency and days read back from prescription lines that are made of part rows."""
    size = F.col("p_size")
    dose = F.when(size % 4 == 0, F.lit("")).otherwise(F.concat(size.cast("string"), F.lit(" mg ")))
    often = F.element_at(F.array(*[F.lit(x) for x in ("1-0-1", "bd", "three times a day", "SOS", "once daily")]), (size % 5 + 1).cast("int"))
    span = F.concat((size % 10).cast("string"), F.when(size % 2 == 0, F.lit(" weeks")).otherwise(F.lit(" days")))
    line = F.concat("p_name", F.lit(" "), dose, often, F.lit(" for "), span)
    return _part(spark, sf_dir).select(
        F.col("p_partkey").alias("id"), X.strength(line).alias("strength"), X.frequency(line).alias("frequency"), X.duration_days(line).alias("days")
    )


@query(f"""WITH {DOSES}, d AS (SELECT id, status, scheduled_at, scheduled_at + INTERVAL 45 MINUTE AS woken, medicine_id % 10 != 3 AS planned, user_id % 7 != 3 AS active FROM doses),
    r AS (SELECT id, CASE WHEN NOT active THEN NULL WHEN status = 'PENDING' AND planned AND scheduled_at BETWEEN TIMESTAMP '2024-01-12 08:00:00' AND TIMESTAMP '2024-01-12 20:00:00' THEN 'UPCOMING' WHEN status = 'SNOOZED' AND woken <= TIMESTAMP '2024-01-12 08:00:00' THEN 'SNOOZE' END AS kind, woken FROM d),
    k AS (SELECT id, kind, CASE WHEN kind = 'SNOOZE' THEN CAST(id AS VARCHAR) || ':' || strftime(woken, '%Y%m%d%H%M%S') ELSE CAST(id AS VARCHAR) END AS key FROM r WHERE kind IS NOT NULL)
    SELECT * FROM k WHERE key NOT IN (SELECT CAST(c_custkey * 3 AS VARCHAR) FROM customer)""")
def due_reminders(spark, sf_dir):
    at = F.col("scheduled_at").cast("timestamp_ntz")
    rows = doses(spark, sf_dir).select(
        "id", "status", at.alias("scheduled_at"), (at + F.expr("interval 45 minutes")).alias("snooze_until"),
        (F.col("medicine_id") % 10 != 3).alias("schedule_active"), (F.col("user_id") % 7 != 3).alias("user_active"),
    )
    sent = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).cast("string").alias("key"))
    return R.reminders(rows, sent, F.expr("timestamp_ntz'2024-01-12 08:00:00'"), 720)


@query("""SELECT p_partkey AS id, p_type || ',' || p_brand AS names, '{"id":' || CAST(p_partkey AS VARCHAR) || ',"name":"' || p_name || '"}' AS snapshot FROM part""")
def mixed_json(spark, sf_dir):
    """Names from an array of texts and objects, and a row as JSON."""
    made = F.concat(F.lit('["'), "p_type", F.lit('",{"name":"'), "p_brand", F.lit('"},{"other":1}]'))
    snapshot = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.array_join(R.mixed_names(made), ",").alias("names"), snapshot.alias("snapshot"))


@query("""WITH c AS (SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(kind, ',' ORDER BY n DESC, kind) AS kinds FROM c GROUP BY 1""")
def sorted_entries(spark, sf_dir):
    """The entries of each user's counters by count, then by name."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    entries = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "event_type")))
    return counts.groupBy("user_id").agg(F.array_join(F.transform(entries, lambda x: x["event_type"]), ",").alias("kinds"))


@query("""WITH e AS (SELECT o_orderkey AS id, o_orderkey % 900 AS elapsed, 1 + o_orderkey % 20 AS eta FROM orders), s AS (SELECT *, least(elapsed / greatest(90, eta * 60)::DOUBLE, 1.0::DOUBLE) AS share FROM e)
    SELECT id, round(share, 9) AS share, CAST(ceil(round(eta * (1 - share), 9)) AS BIGINT) AS minutes FROM s""")
def arrival_progress(spark, sf_dir):
    key = F.col("o_orderkey")
    share, _ = R.progress(key % 900, 1 + key % 20)
    rows = table(spark, sf_dir, "orders").select(key.alias("id"), share.alias("share"), (1 + key % 20).alias("eta"))
    return rows.select("id", F.round("share", 9).alias("share"), F.ceil(F.round(F.col("eta") * (1 - F.col("share")), 9)).cast("long").alias("minutes"))
