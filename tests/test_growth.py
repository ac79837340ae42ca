"""Steps that take much work a row are written once and run on all cores."""

from pyspark.sql import functions as F

from carelake.functions import compositions as K
from carelake.operators import clusters as C
from carelake.operators import identity as I
from carelake.plans import registry


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_compositions_patterns_stand_in_the_plan_a_few_times(spark):
    rows = spark.createDataFrame([("Biotin 5mg",)], "c string")
    assert _plan(rows.select(K.salt_key(F.col("c")))).count("million spores?") <= 40
    assert _plan(rows.select(I.base_molecule(F.col("c")))).count("film[- ]?coated") <= 2


def test_parts_are_dealt_to_all_cores_before_their_compositions_are_read(spark, sf_dir):
    for name in ("composition_keys", "package_compatibility", "told_ingredients"):
        assert registry.queries()[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_missed_doses_are_dealt_to_all_cores_and_meet_patients_before_caregivers(spark, sf_dir):
    found = registry.queries()["consented_escalations"](spark, sf_dir)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = _plan(found)
    assert plan.index("s_nationkey#") < plan.rindex("Join Inner, (c_custkey#")


def test_a_bills_patterns_are_looked_for_once_a_line_on_all_cores(spark, sf_dir):
    """Filters used to repeat the patterns of all steps below them, beyond what can be compiled."""
    found = registry.queries()["bill_medicines"](spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[|]") == 2  # in rows as printed and in lines
    assert plan.index("Generate posexplode") < plan.index("RepartitionByExpression [l_orderkey#")


def test_names_are_compared_only_where_mentions_stand_at_one_place(monkeypatch):
    asked = []
    monkeypatch.setattr(C, "same_name", lambda a, b: asked.append((a, b)) or a == b)
    fold = C.Leaders()
    for i, name in enumerate(("amlodipine", "amlodipina", "metformin", "amlodipine")):
        m = dict.fromkeys(C.COLUMNS) | {"mention_id": str(i), "evidence_id": str(i % 3), "line": i % 3, "normalized": name, "raw_text": name, "confidence": 1.0, "generator": "regex"}
        fold.add(*(m[c] for c in C.COLUMNS))
    assert asked == [("amlodipine", "amlodipine")] and len(fold.clusters) == 3


def test_mentions_are_dealt_to_all_cores_before_their_texts_are_made(spark, sf_dir):
    found = registry.queries()["mention_clusters"](spark, sf_dir)
    assert "RepartitionByExpression [l_orderkey#" in found._jdf.queryExecution().optimizedPlan().toString()
