"""Identity of packages and rows."""

import pytest
from pyspark.sql import functions as F

from carelake.functions import compositions as K
from carelake.operators import identity as I

CASES = [
    (("HP Kit", "Amoxicillin + Tinidazole + Omeprazole", "Pyloripan-DSR", "Domperidone 30mg + Pantoprazole 40mg"), (False, "composition_mismatch")),
    ((None, "Amoxycillin + Tinidazole + Omeprazole", None, "Omeprazole 20mg + Amoxicillin 750mg + Tinidazole 500mg"), (True, "composition_match")),
    (("Pylori", None, "Pyloripan-DSR", None), (False, "brand_mismatch")),
    (("Pyloripan DSR", " ", "PYLORIPAN-dsr", "Domperidone"), (True, "brand_match")),
    ((None, "Cefpodoxime 200mg", None, "Cefpodoxime 100mg"), (False, "composition_mismatch")),
    ((None, "Pantoprazole Sodium 40mg", None, "Pantoprazole"), (True, "composition_match")),
    ((None, "Metoprolo1 50mg", None, "Metoprolol Succinate 50mg"), (True, "composition_match")),
    ((None, "Rosuvastatn 10mg", None, "Rosuvastatin 10 mg"), (True, "composition_match")),
    ((None, "Iron 5mg", None, "Zinc 5mg"), (False, "composition_mismatch")),
    ((None, "Iron 5mg + Zinc 5mg", None, "Iron 5mg"), (False, "composition_mismatch")),
    ((None, None, None, None), (False, "brand_mismatch")),
]


def test_packages_go_with_rows_of_the_same_ingredients_or_brands(spark):
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], "i int, b string, c string, ob string, oc string")
    told = I.compatible(df, F.col("b"), F.col("c"), F.col("ob"), [F.col("oc"), F.lit(None).cast("string")])
    assert {r["i"]: (r["compatible"], r["reason"]) for r in told.collect()} == {i: c[1] for i, c in enumerate(CASES)}


@pytest.mark.parametrize(
    "name, base",
    [("Amlodipine Besylate", "amlodipine"), ("Levo Thyroxine Sodium", "thyroxine"), ("PCM", "paracetamol"), ("Folic Acid", "folic acid"), ("Metformin HCl", "metformin hydrochloride"), ("Sildenabl", "sildenafil")],
)
def test_base_molecules(spark, name, base):
    assert spark.createDataFrame([(name,)], "n string").select(I.base_molecule(F.col("n"))).first()[0] == base


def test_equivalent_rows_share_a_key(spark):
    rows = [("Crocin-650", "paracetamol", "GSK Pharma Ltd."), ("CROCIN 650", "paracetamol", "Glaxo Smith Kline Pharmaceuticals Limited"), ("Crocin 650", None, None), (None, "x", "Sun Pharma")]
    df = spark.createDataFrame(rows, "b string, s string, m string")
    assert [r["k"] for r in df.select(I.identity_key(F.col("b"), F.col("s"), F.col("m")).alias("k")).collect()] == ["crocin650|paracetamol|glaxosmithkline"] * 2 + ["crocin650", "x|sun"]


def test_the_first_source_that_tells_ingredients_counts(spark):
    kind = "array<struct<ingredient:string,strength:string,unit:string>>"
    rows = [([("a", None, None)], [("b", None, None)], "C 5mg"), ([], [("b", "1", "mg")], "C 5mg"), (None, None, "C 5mg"), (None, [], " "), (None, None, None)]
    df = spark.createDataFrame(rows, f"p {kind}, s {kind}, t string")
    found = [r["f"] for r in df.select(I.first_told(F.col("p"), F.col("s"), [F.col("t")]).alias("f")).collect()]
    assert [(f["source"], [tuple(x) for x in f["ingredients"]]) for f in found] == [
        ("SALT_PROFILE", [("a", None, None)]), ("MASTER_COMPOSITION", [("b", "1", "mg")]), ("MASTER_COMPOSITION", [("c", "5", "mg")]), (None, []), (None, []),
    ]


def test_ingredients_stay_as_they_were(spark):
    told = spark.createDataFrame([("Vit C 0.5 g & PCM 650",)], "c string").select(K.salt_key(F.col("c"))).first()[0]
    assert told == "ascorbic-acid-500mg+paracetamol-650mg"
