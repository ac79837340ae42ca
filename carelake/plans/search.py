"""Queries of catalogue search: true scores of every twentieth part's name, whole, cut, misread and with strengths."""

from pyspark.sql import functions as F

from carelake.functions import similarity as U
from carelake.operators import matching as M
from carelake.operators import search as S
from carelake.plans.registry import query
from carelake.sources.views import table


def catalogue(spark, sf_dir):
    """Parts as a catalogue with compositions and salts."""
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.lower("p_type")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.initcap("p_name").alias("brand"), F.concat((size * 10).cast("string"), F.lit(" mg")).alias("strength"),
        F.when(size % 4 == 0, F.concat(kind, F.lit("ine "), (size * 10).cast("string"), F.lit("mg"))).alias("composition"), F.when(size % 3 == 0, F.col("p_brand")).alias("generic"),
        F.concat(F.col("p_type"), F.lit(" Salt")).alias("salt_name"), F.concat(kind, (size % 3).cast("string")).alias("salt_key"),
        F.when(size % 5 == 0, F.array("p_type", "p_brand")).alias("ingredients"), (size == 13).alias("discontinued"),
        (F.when(size % 4 == 0, 50).otherwise(0) + F.when(size % 7 == 0, 30).otherwise(0)).alias("rank"),
    )


def asked(spark, sf_dir):
    """Every twentieth part's name as a query, in one of six forms."""
    key, name = F.col("p_partkey"), F.col("p_name")
    form, size = F.floor(key / 20) % 6, F.col("p_size")
    q = (
        F.when(form == 0, name).when(form == 1, F.substring(name, F.lit(1), (3 + size % 6).cast("int"))).when(form == 2, F.translate(name, "ieo", "lc0"))
        .when(form == 3, F.concat(name, F.lit(" "), (size * 10).cast("string"), F.lit(" mg"))).when(form == 4, F.lower("p_type")).otherwise(F.concat(F.expr("substring(p_name, 1, length(p_name) - 1)"), F.lit(" 70")))
    )
    return table(spark, sf_dir, "part").where(key % 20 == 0).select(key.alias("qid"), q.alias("q"))


_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


def _parts(name: str, source: str, column: str) -> str:
    """CTEs of the parts of a text."""
    return f"""{name}0 AS (SELECT *, lower(trim({column})) AS low, {_KEY.format(f"trim({column})")} AS key FROM {source}),
    {name}1 AS (SELECT *, regexp_replace(key, '[0-9]', '', 'g') AS letters, list_filter(regexp_split_to_array(low, '[^a-z0-9]+'), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT regexp_matches(t, '{S.NO_BRAND}')) AS words FROM {name}0),
    {name}2 AS (SELECT *, coalesce(words[1], letters) AS stem FROM {name}1),
    {name} AS (SELECT *, list_filter([stem, letters, CASE WHEN length(stem) >= 6 THEN substr(stem, 1, 6) END, CASE WHEN length(stem) >= 5 THEN substr(stem, 1, 5) END, CASE WHEN length(stem) >= 4 THEN substr(stem, 1, 4) END,
        CASE WHEN length(letters) >= 5 THEN substr(letters, 1, 5) END, CASE WHEN length(letters) >= 4 THEN substr(letters, 1, 4) END], lambda s: s IS NOT NULL AND length(s) >= 3) AS stems,
        regexp_extract_all(trim({column}), '\\d+(?:\\.\\d+)?') AS numbers,
        regexp_replace(replace(replace(replace(replace(translate(CASE WHEN stem != '' THEN stem ELSE key END, '01|!528', 'olllszb'), 'vv', 'w'), 'rn', 'm'), 'cl', 'd'), 'ph', 'f'), '[^a-z0-9]', '', 'g') AS look FROM {name}2)"""


_COSTS = "MAP {" + ", ".join(f"'{a}{b}': {cost}::DOUBLE" for (a, b), cost in U._COST.items()) + "}"


def _merged(c: str) -> str:
    for pair, one in U.MERGED:
        c = f"replace({c}, '{pair}', '{one}')"
    return c


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substr({0}, i, 3)))"
_SEEN = f"""pairs_seen AS (SELECT DISTINCT low AS a, blow AS b FROM pair UNION SELECT DISTINCT stem, bstem FROM pair),
    seen0 AS (SELECT a, b, {_KEY.format("a")} AS x, {_KEY.format("b")} AS y FROM pairs_seen), seen1 AS (SELECT *, {_merged("x")} AS mx, {_merged("y")} AS my FROM seen0),
    seen2 AS (SELECT *, list_reduce(list_concat([range(0, length(my) + 1)::DOUBLE[]], list_transform(range(1, length(mx) + 1), lambda i: [i::DOUBLE])), lambda prev, ii:
        list_reduce(list_concat([[ii[1]]], list_transform(range(1, length(my) + 1), lambda j: [j::DOUBLE])), lambda acc, jj:
          list_append(acc, least(acc[len(acc)] + 1, prev[CAST(jj[1] AS INTEGER) + 1] + 1, prev[CAST(jj[1] AS INTEGER)] + CASE WHEN substr(mx, CAST(ii[1] AS INTEGER), 1) = substr(my, CAST(jj[1] AS INTEGER), 1) THEN 0
            ELSE coalesce({_COSTS}[substr(mx, CAST(ii[1] AS INTEGER), 1) || substr(my, CAST(jj[1] AS INTEGER), 1)], 1) END)))) AS rows FROM seen1),
    seen AS (SELECT a, b, CASE WHEN x = '' OR y = '' THEN FALSE WHEN x = y THEN TRUE ELSE greatest(0, 1 - rows[len(rows)] / greatest(length(x), length(y))) * 0.7::DOUBLE
        + 2.0::DOUBLE * len(list_intersect({_GRAMS.format("x")}, {_GRAMS.format("y")})) / (len({_GRAMS.format("x")}) + len({_GRAMS.format("y")})) * 0.3::DOUBLE >= 0.78::DOUBLE END AS seen FROM seen2)"""

_SCORES = f"""WITH raw AS (SELECT p_partkey AS qid, CASE p_partkey // 20 % 6 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, CAST(3 + p_size % 6 AS INTEGER)) WHEN 2 THEN translate(p_name, 'ieo', 'lc0') WHEN 3 THEN p_name || ' ' || CAST(p_size * 10 AS VARCHAR) || ' mg'
        WHEN 4 THEN lower(p_type) ELSE substr(p_name, 1, length(p_name) - 1) || ' 70' END AS q FROM part WHERE p_partkey % 20 = 0),
    {_parts("asked", "(SELECT DISTINCT q FROM raw WHERE length(trim(q)) >= 2)", "q")},
    full_rows AS (SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS brand, CAST(p_size * 10 AS VARCHAR) || ' mg' AS strength, CASE WHEN p_size % 4 = 0 THEN lower(p_type) || 'ine ' || CAST(p_size * 10 AS VARCHAR) || 'mg' END AS composition,
        CASE WHEN p_size % 3 = 0 THEN p_brand END AS generic, p_type || ' Salt' AS salt_name, lower(p_type) || CAST(p_size % 3 AS VARCHAR) AS salt_key, CASE WHEN p_size % 5 = 0 THEN [p_type, p_brand] END AS ingredients, p_size = 13 AS gone,
        CASE WHEN p_size % 4 = 0 THEN 50 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 30 ELSE 0 END AS rank FROM part),
    {_parts("brands", "(SELECT DISTINCT brand FROM full_rows)", "brand")},
    kinds AS (SELECT DISTINCT brand, strength, composition, generic, salt_name, salt_key, ingredients, gone FROM full_rows),
    cand AS (SELECT a.*, k.*, b.low AS blow, b.key AS normal, b.stem AS bstem, b.look AS blook FROM asked a, kinds k JOIN brands b ON b.brand = k.brand),
    tiers AS (SELECT *, list_transform(list_filter([composition, generic, salt_name], lambda v: v IS NOT NULL), lambda v: {_KEY.format("v")}) AS names, list_transform(coalesce(ingredients, []), lambda v: {_KEY.format("v")}) AS inside, {_KEY.format("salt_key")} AS salt,
        list_filter(list_transform(regexp_split_to_array(trim(q), '\\s+'), lambda t: {_KEY.format("t")}), lambda t: length(t) >= 4) AS tokens,
        length(key) >= 4 AND length(letters) >= 6 AND (contains(lower(salt_key), letters) OR contains(lower(salt_name), low)) AS salted FROM cand),
    pair AS (SELECT *, CASE WHEN key = '' THEN NULL WHEN list_contains(inside, key) OR list_contains(names, key) THEN 'exact' WHEN starts_with(salt, key) OR len(list_filter(names, lambda v: starts_with(v, key))) > 0 THEN 'strong'
        WHEN len(list_filter(inside, lambda v: contains(v, key))) > 0 OR contains(salt, key) OR len(list_filter(names, lambda v: contains(v, key))) > 0
          OR (len(tokens) > 0 AND len(list_filter(names, lambda v: len(list_filter(tokens, lambda t: contains(v, t))) = len(tokens))) > 0) THEN 'contains' END AS tier FROM tiers
        WHERE starts_with(normal, key) OR starts_with(blow, low) OR (stem != '' AND (starts_with(normal, stem) OR starts_with(blow, stem)))
          OR (length(key) >= 4 AND (contains(normal, key) OR contains(blow, low) OR len(list_filter([composition, generic, salt_name], lambda v: v IS NOT NULL AND contains(lower(v), low))) > 0 OR contains(lower(salt_key), key)))
          OR salted OR len(list_filter(stems, lambda s: starts_with(normal, s) OR starts_with(blow, s))) > 0),
    {_SEEN},
    judged AS (SELECT p.*, bool_or(salted AND length(key) >= 6 AND coalesce(tier IN ('exact', 'strong'), FALSE)) OVER (PARTITION BY q) AS molecule, w.seen AS whole, f.seen AND stem != '' AND bstem != '' AS first,
        normal = key OR blow = low AS exact, stem != '' AND bstem != '' AND stem = bstem AS stem_exact, look != '' AND look = blook AS look_exact,
        starts_with(blow, low) OR starts_with(normal, key) OR (length(stem) >= 4 AND (starts_with(bstem, stem) OR starts_with(stem, bstem))) AS begins0,
        contains(blow, low) OR contains(normal, key) OR (length(stem) >= 4 AND (contains(bstem, stem) OR contains(stem, bstem))) AS holds0, levenshtein(stem, bstem) AS far, greatest(length(stem), length(bstem)) AS longest,
        len(list_filter(numbers, lambda s: len(list_filter([blow, normal, lower(strength), lower(composition), lower(salt_name), {_KEY.format("salt_key")}], lambda v: v IS NOT NULL AND contains(v, s))) > 0)) > 0 AS strong,
        len(numbers) = 0 AS plain, starts_with(normal, stems[1]) AS head, contains(normal, stems[1]) AS inner_stem
        FROM pair p JOIN seen w ON w.a = p.low AND w.b = p.blow JOIN seen f ON f.a = p.stem AND f.b = p.bstem),
    flags AS (SELECT *, NOT exact AND begins0 AS begins, NOT exact AND NOT begins0 AND holds0 AS holds, stem != '' AND bstem != '' AND longest >= 5 AND far <= CASE WHEN longest >= 8 THEN 2 ELSE 1 END AND far / longest::DOUBLE <= 0.22 AS fuzzy, strong OR plain AS fits, first OR whole AS seen FROM judged),
    told AS (SELECT *, CASE tier WHEN 'exact' THEN CASE WHEN molecule THEN 0.99 ELSE 0.94 END WHEN 'strong' THEN CASE WHEN molecule THEN 0.97 ELSE 0.92 END WHEN 'contains' THEN CASE WHEN molecule THEN 0.9 ELSE 0.82 END ELSE 0.35 END::DOUBLE AS base,
        CASE WHEN molecule AND tier IS NULL THEN CASE WHEN exact OR stem_exact THEN 0.62 WHEN begins OR look_exact THEN 0.5 WHEN whole THEN 0.5 WHEN holds THEN 0.42 WHEN head AND strong THEN 0.4 ELSE 0 END
        ELSE CASE WHEN exact OR (stem_exact AND fits) THEN 1 WHEN (look_exact OR seen) AND fits THEN 0.98 WHEN fuzzy AND fits THEN 0.95 WHEN begins AND strong THEN 0.96 WHEN begins THEN 0.9 WHEN seen THEN 0.92 WHEN fuzzy THEN 0.88 WHEN holds AND strong THEN 0.88
          WHEN holds THEN 0.75 WHEN head AND strong THEN 0.88 WHEN inner_stem AND strong THEN 0.78 ELSE 0 END END::DOUBLE AS named FROM flags),
    scored AS (SELECT t.q, r.id, round(greatest(0, greatest(base, named) - CASE WHEN t.gone THEN 0.2::DOUBLE ELSE 0 END), 9) AS score, tier, molecule, rank, r.brand FROM told t JOIN full_rows r ON r.brand = t.brand AND r.strength = t.strength
        AND r.composition IS NOT DISTINCT FROM t.composition AND r.generic IS NOT DISTINCT FROM t.generic AND r.salt_name = t.salt_name AND r.salt_key = t.salt_key AND r.ingredients IS NOT DISTINCT FROM t.ingredients AND r.gone = t.gone),
    one AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q, brand ORDER BY rank DESC, score DESC, brand, id) = 1),
    best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank DESC, brand, id) AS place FROM one QUALIFY place <= 8)"""


@query(_SCORES + " SELECT q, id, score, tier, molecule, rank FROM scored")
def search_scores(spark, sf_dir):
    """The score of every candidate of every query."""
    return S.scores(asked(spark, sf_dir).select("q"), catalogue(spark, sf_dir)).drop("brand")


def _hits(spark, sf_dir):
    queries = asked(spark, sf_dir)
    found = S.best(S.scores(queries.select("q"), S.leaders(catalogue(spark, sf_dir))), F.col("brand"), 8)
    return queries.join(found, "q").select("qid", "id", "brand", "score", "place")


@query(_SCORES + " SELECT qid, id, brand, score, place FROM raw JOIN best USING (q)")
def catalogue_search(spark, sf_dir):
    """The eight best brands of each query."""
    return _hits(spark, sf_dir)


@query(_SCORES + """ SELECT qid, max(score) AS best, CASE WHEN max(score) >= 0.9 THEN 'STRONG' WHEN max(score) >= 0.7 THEN 'POSSIBLE' ELSE 'UNKNOWN' END AS outcome
    FROM raw JOIN best USING (q) GROUP BY qid""")
def search_resolution(spark, sf_dir):
    return M.resolution(_hits(spark, sf_dir))


@query("""WITH r AS (SELECT p_partkey AS id, [p_type, substr(p_name, 1, 5), 'xyz' || CAST(p_size % 3 AS VARCHAR)][1:1 + p_size % 3] AS w, regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', '', 'g') AS t, p_size % 4 = 0 AS sure, p_size = 13 AS gone FROM part),
    s AS (SELECT *, len(list_filter(w, lambda x: contains(t, regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')) OR len(list_filter(list_transform(string_split(x, ' '), lambda y: regexp_replace(lower(y), '[^a-z0-9]+', '', 'g')), lambda y: length(y) >= 3 AND NOT contains(t, y))) = 0
      AND len(list_filter(string_split(x, ' '), lambda y: length(regexp_replace(lower(y), '[^a-z0-9]+', '', 'g')) >= 3)) > 0)) / len(w)::DOUBLE AS share FROM r)
    SELECT id, round(greatest(0, least(0.91::DOUBLE, 0.62::DOUBLE + share * 0.14::DOUBLE + CASE WHEN share = 1 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN sure THEN 0.03::DOUBLE ELSE 0 END - CASE WHEN gone THEN 0.12::DOUBLE ELSE 0 END)), 9) AS score FROM s""")
def composition_scores(spark, sf_dir):
    size = F.col("p_size")
    wanted = F.slice(F.array("p_type", F.substring("p_name", 1, 5), F.concat(F.lit("xyz"), (size % 3).cast("string"))), F.lit(1), (1 + size % 3).cast("int"))
    row = {"composition": F.col("p_name"), "generic": F.col("p_brand"), "salt_name": F.col("p_type"), "salt_key": F.lit(None).cast("string"), "verified": size % 4 == 0, "discontinued": size == 13}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.composition_score(wanted, row).alias("score"))


@query("""WITH k AS (SELECT l_partkey AS id, bool_or(l_returnflag = 'R') AS verified, bool_or(l_quantity > 45) AS image FROM lineitem GROUP BY 1)
    SELECT p_partkey AS id, CAST(CASE WHEN p_size % 4 = 0 THEN 50 ELSE 0 END + CASE WHEN verified THEN 30 ELSE 0 END + CASE WHEN image THEN 10 ELSE 0 END + CASE WHEN k.id IS NOT NULL THEN 5 ELSE 0 END AS BIGINT) AS rank FROM part LEFT JOIN k ON k.id = p_partkey""")
def completeness_ranks(spark, sf_dir):
    pack = F.struct((F.col("l_returnflag") == "R").alias("verified"), F.when(F.col("l_quantity") > 45, F.lit("strip.png")).alias("image"))
    packs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(pack).alias("packs"))
    rows = table(spark, sf_dir, "part").join(packs, "p_partkey", "left")
    return rows.select(F.col("p_partkey").alias("id"), S.completeness(F.col("p_size") % 4 == 0, F.col("packs")).cast("long").alias("rank"))
