"""Search scores by branch, on a small catalogue whose answers are known."""

import pytest
from pyspark.sql import functions as F

from carelake.operators import search as S

ROW = "id long, brand string, strength string, composition string, generic string, salt_name string, salt_key string, ingredients array<string>, discontinued boolean, rank int"
CATALOGUE = [
    (1, "Crocin 650", "650 mg", "Paracetamol 650mg", "Paracetamol", "Paracetamol", "paracetamol650", ["Paracetamol"], False, 50),
    (2, "Crocin Advance", "500 mg", "Paracetamol 500mg", None, "Paracetamol", "paracetamol500", ["Paracetamol"], None, 0),
    (3, "Calpol", "500 mg", "Paracetamol 500mg", None, "Paracetamol", "paracetamol500", None, True, 80),
    (4, "Augmentin 625 Duo", "625 mg", "Amoxycillin 500mg + Clavulanic Acid 125mg", None, "Amoxycillin + Clavulanic Acid", "amoxycillinclavulanicacid", ["Amoxycillin", "Clavulanic Acid"], False, 5),
    (5, "Thyronorm 50", "50 mcg", "Thyroxine 50mcg", None, "Thyroxine", "thyroxine50", ["Thyroxine"], False, 5),
    (6, None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def score(spark):
    rows = spark.createDataFrame(CATALOGUE, ROW)
    asked = ["crocin 650", "Crocin", "crocin 500", "cro", "Cr0cin 650", "thyronorn 50", "paracetamol", "paracetam", "clavulanic acid 125mg", "Augmenti 625", "rocin", "x", "", "crocin advance"]
    found = S.scores(spark.createDataFrame([(q,) for q in asked] + [(None,)], "q string"), rows).collect()
    return {(r["q"], r["id"]): (r["score"], r["tier"], r["molecule"]) for r in found}


def test_names_strengths_and_looks_each_have_their_score(score):
    assert score["crocin 650", 1][0] == 1.0
    assert score["Crocin", 1][0] == 1.0 and score["Crocin", 2][0] == 1.0  # the first word alone, no strength asked for
    assert score["crocin 500", 2][0] == 1.0 and score["crocin 500", 1][0] == 0.9
    assert score["cro", 1][0] == 0.9
    assert score["thyronorn 50", 5][0] == 0.98
    assert score["Augmenti 625", 4][0] == 0.98
    assert score["crocin advance", 2][0] == 1.0 and score["crocin advance", 1][0] == 1.0
    assert score["rocin", 1][0] == 0.98  # by its look: one letter of six is missing


def test_molecules_put_compositions_before_names_and_discontinued_rows_back(score):
    assert score["paracetamol", 1] == (0.99, "exact", True)
    assert score["paracetamol", 3] == (0.79, "exact", True)
    assert score["paracetam", 2] == (0.97, "strong", True)
    assert score["clavulanic acid 125mg", 4][1] == "contains"


def test_short_empty_and_null_queries_find_nothing(score):
    assert not {q for q, _ in score} & {"x", "", None} and all(i != 6 for _, i in score)


def test_learned_readings_score_one_and_k_best_of_each_identity(spark):
    rows = spark.createDataFrame(CATALOGUE, ROW)
    queries, aliases = spark.createDataFrame([("crocin",)], "q string"), spark.createDataFrame([("crocin", 2)], "q string, id long")
    found = S.scores(queries, rows.union(rows.where("id = 1").withColumn("id", F.lit(7).cast("long")).select(rows.columns)), aliases)
    best = S.best(found, F.lower("brand"), 1).collect()
    assert [(r["id"], r["score"], r["place"]) for r in best] == [(1, 1.0, 1)]
    assert {r["id"]: r["score"] for r in found.collect()} == {1: 1.0, 2: 1.0, 7: 1.0}


def test_copies_of_rows_are_scored_once_with_the_same_best(spark):
    rows = spark.createDataFrame(CATALOGUE, ROW)
    copies = spark.range(1, 30).select((F.col("id") * 100).alias("more"))
    many = rows.crossJoin(copies).withColumns({"id": F.col("id") + F.col("more"), "rank": F.when(F.col("more") < 300, F.col("rank"))}).select(rows.columns)
    queries = spark.createDataFrame([("crocin",), ("paracetamol",), ("calpol",)], "q string")
    scored = S.scores(queries, S.leaders(many))
    assert scored.count() == S.scores(queries, rows).count() > 0

    def best(x):
        return [tuple(r) for r in S.best(x, F.col("brand"), 2).select("q", "id", "score", "place", "rank").orderBy("q", "place").collect()]

    assert best(scored) == best(S.scores(queries, many))
    assert [tuple(r) for r in S.leaders(many).where("brand is null or id = 103").select("id", "rank").orderBy("id").collect()] == [(103, 80), (106, None)]


def test_compositions_and_completeness(spark):
    row = {"composition": F.lit("Amoxycillin 500mg + Clavulanic Acid 125mg"), "generic": F.lit(None).cast("string"), "salt_name": F.lit(None).cast("string"), "salt_key": F.lit("x"), "verified": F.lit(True), "discontinued": F.lit(False)}
    lists = [["Amoxycillin", "acid clavulanic"], ["Amoxycillin", "Ibuprofen"], ["Ibuprofen"], []]
    df = spark.createDataFrame([(x,) for x in lists], "w array<string>")
    assert [r["s"] for r in df.select(S.composition_score(F.col("w"), row).alias("s")).collect()] == [0.91, 0.72, 0.65, None]
    gone = row | {"verified": F.lit(None).cast("boolean"), "discontinued": F.lit(True)}
    assert df.limit(1).select(S.composition_score(F.col("w"), gone).alias("s")).first()["s"] == 0.82
    packs = spark.createDataFrame([(True, [(True, None)]), (None, [(False, "p.png"), (None, "")]), (False, []), (False, None)], "v boolean, p array<struct<verified: boolean, image: string>>")
    assert [r["c"] for r in packs.select(S.completeness(F.col("v"), F.col("p")).alias("c")).collect()] == [85, 15, 0, 0]
