"""Queries of medicine identity: compatible packages, equivalent rows, ingredients with fallbacks."""

from pyspark.sql import functions as F

from carelake.operators import identity as I
from carelake.plans.registry import query
from carelake.sources.views import dealt, table


@query("""WITH p AS (SELECT p_partkey AS id, p_name, p_size, p_brand, CASE p_size % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'other' WHEN 2 THEN 'strength' WHEN 3 THEN 'brand' ELSE 'nobrand' END AS kind FROM part)
    SELECT id, kind IN ('match', 'brand') AS compatible, CASE kind WHEN 'match' THEN 'composition_match' WHEN 'brand' THEN 'brand_match' WHEN 'nobrand' THEN 'brand_mismatch' ELSE 'composition_mismatch' END AS reason FROM p""")
def package_compatibility(spark, sf_dir):
    """Packages against catalogue rows: other salts and orders, other molecules, other strengths, or brands alone."""
    kind, name = F.col("p_size") % 5, F.initcap("p_name")
    seen = F.when(kind == 0, F.concat(name, F.lit(" Sodium 10mg + Amoxycillin"))).when(kind == 1, F.concat(name, F.lit(" + Tinidazole"))).when(kind == 2, F.concat(name, F.lit(" 5 mg, Amoxicillin 20mg")))
    held = F.when(kind < 3, F.when(kind == 1, F.concat(F.lit("Domperidone 30mg + "), name)).when(kind == 2, F.concat(F.lit("Amoxicillin 20mg + "), name, F.lit(" 6mg"))).otherwise(F.concat(F.lit("Amoxicillin 750mg + "), name, F.lit(" 10mg"))))
    other = F.when(kind == 4, F.concat("p_brand", F.lit(" X"))).otherwise(F.upper("p_brand"))
    told = I.compatible(dealt(table(spark, sf_dir, "part"), "p_partkey"), F.col("p_brand"), seen, other, [held, F.lit(None).cast("string")])
    return told.select(F.col("p_partkey").alias("id"), "compatible", "reason")


@query("""SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || '|' || lower(p_type) || '|' || CASE WHEN p_size % 3 = 0 THEN 'glaxosmithkline' ELSE trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') END AS key, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY 1""")
def equivalent_rows(spark, sf_dir):
    """Rows of one brand, salt and manufacturer, under any of its names."""
    maker = F.when(F.col("p_size") % 6 == 0, F.lit("GSK Pharma Pvt. Ltd.")).when(F.col("p_size") % 3 == 0, F.lit("Glaxo Smith Kline  Limited")).otherwise(F.concat("p_brand", F.lit(" Pharmaceuticals Co")))
    key = I.identity_key(F.col("p_name"), F.lower("p_type"), maker)
    return table(spark, sf_dir, "part").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("id"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'SALT_PROFILE' WHEN 3 THEN NULL ELSE 'MASTER_COMPOSITION' END AS source,
    CASE p_size % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'biotin' WHEN 2 THEN lower(p_name) || ':' || CAST(p_size AS VARCHAR) || 'mg' ELSE '' END AS told FROM part""")
def told_ingredients(spark, sf_dir):
    """Ingredients of each row from the first of profile, salts and texts that tells some."""
    kind = F.col("p_size") % 4
    none = F.lit(None).cast("string")

    def one(name):
        return F.array(F.struct(name.alias("ingredient"), none.alias("strength"), none.alias("unit")))

    profile = F.when(kind == 0, one(F.lower("p_type"))).when(kind == 1, F.array().cast("array<struct<ingredient:string,strength:string,unit:string>>"))
    text = F.when(kind == 2, F.concat("p_name", F.lit(" Tablets "), F.col("p_size").cast("string"), F.lit(" mg")))
    told = I.first_told(profile, F.when(kind == 1, one(F.lit("biotin"))), [F.lit(" "), text])
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), told.alias("t"))
    shown = F.array_join(F.transform("t.ingredients", lambda x: F.concat_ws(":", x["ingredient"], F.concat(x["strength"], x["unit"]))), ",")
    return rows.select("id", "t.source", shown.alias("told"))
