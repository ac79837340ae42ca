"""Compositions, import fields and file sources on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from carelake.functions import compositions as C
from carelake.functions import text as X
from carelake.operators import catalogue, matching, stock, vitals
from carelake.shipping import ship
from carelake.sources import files

#: Compositions and the keys that they must have.
KEYS = [
    ("Paracetamol 650mg", "paracetamol-650mg"),
    ("Acetaminophen 650 mg", "paracetamol-650mg"),
    ("PCM 500", "paracetamol-500mg"),
    ("METFORMIN (500 MG)", "metformin-hydrochloride-500mg"),
    ("Metformin hydrochloride 0.5g", "metformin-hydrochloride-500mg"),
    ("Amoxycillin  (500mg)  +   Clavulanic Acid (125mg)", "amoxicillin-500mg+clavulanic-acid-125mg"),
    ("Amoxycillin 875 mg / Potassium Clavulanate 125 mg", "amoxicillin-875mg+clavulanic-acid-125mg"),
    ("Domperidone 30 mg, Rabeprazole 20 mg", "domperidone-30mg+rabeprazole-20mg"),
    ("Methylcobalamin 1.5mg + Pregabalin 75 mg", "methylcobalamin-1.5mg+pregabalin-75mg"),
    ("Pregabalin 75mg + Methylcobalamin 1500mcg", "methylcobalamin-1500mcg+pregabalin-75mg"),
    ("Vit C 0.5 g", "ascorbic-acid-500mg"),
    ("Hydrochlorothiazide 12.5mg + Telmisartan 40mg", "hydrochlorothiazide-12.5mg+telmisartan-40mg"),
    ("Insulin Glargine 100 IU", "insulin-glargine-100iu"),
    ("Ambroxol (30mg/5ml)", "ambroxol-30mg-per-5ml"),
    ("Clobetasol (0.05% w/w)", "clobetasol-0.05%ww"),
    ("Lactobacillus 60 million spores", "lactobacillus-60million-spores"),
    ("ORS powder", "ors-powder"),
    ("Mupirocin 2%", "mupirocin-2%"),
    ("Budesonide 200 mcg + Formoterol 6 mcg", "budesonide-200mcg+formoterol-6mcg"),
    ("Pantoprazole Sodium 40 mg", "pantoprazole-sodium-40mg"),
]


def test_composition_keys(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(KEYS)] + [(90, None), (91, ""), (92, "()")], "i int, c string")
    found = {r["i"]: r["k"] for r in rows.select("i", C.salt_key(F.col("c")).alias("k")).collect()}
    assert [found[i] for i in range(len(KEYS))] == [k for _, k in KEYS]
    assert found[90] is found[91] is found[92] is None


def test_brands_and_forms(spark):
    rows = [("Abixim 100mg Tablet", "allopathy", "strip"), ("Syrup", None, None), ("Dolo 650", "", "15 caps"), ("x", "Kit", None)]
    df = spark.createDataFrame(rows, "b string, k string, p string")
    found = df.select(C.clean_brand(F.col("b")).alias("b"), C.form_of(F.col("k"), F.col("b"), F.col("p")).alias("f")).collect()
    assert [tuple(r) for r in found] == [("Abixim 100mg", "tablet"), ("Syrup", "syrup"), ("Dolo 650", "capsule"), ("x", "kit")]


def test_prescription_lines(spark):
    rows = [("Tab Amoxicillin Clavulanate 500mg BD",), ("Co-Amoxiclav 500/125mg once daily",), ("Paracetamol 650mg BD for 10 days qty 30",), ("x 1 - 0 - 1",)]
    c = F.col("c")
    found = spark.createDataFrame(rows, "c string").select(X.strength(c), X.frequency(c), X.duration_days(c), X.quantity(c)).collect()
    assert [tuple(r) for r in found] == [
        ("500mg", "TWICE_DAILY", None, None), ("500/125mg", "DAILY", None, None), ("650mg", "TWICE_DAILY", 10, 30), (None, "CUSTOM", None, None)
    ]


def test_addresses_prices_and_truth(spark):
    c = F.col("c")
    rows = spark.createDataFrame([("https://a.example/x",), ("ftp://a",), ("₹87.5",), ("1.23456",), ("yes",), (None,)], "c string")
    found = rows.select(C.web_address(c), X.price(c).cast("string"), X.truth(c)).collect()
    assert [tuple(r) for r in found] == [("https://a.example/x", None, None), (None, None, None), (None, "87.50", None), (None, None, None), (None, None, True), (None, None, None)]


def test_csv_with_quotes_line_ends_and_blank_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('brand Name ,GTIN,note\r\n"Dolo, ""650""",123,"two\nlines"\r\n , ,\r\n\r\nOther,,\r\n', newline="")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"))
    known = files.aliased(rows, {"brand": ["brandName"], "code": ["gtin"], "price": []}).orderBy("row_number").collect()
    assert [(r["row_number"], r["brand"], r["code"], r["price"]) for r in known] == [(1, 'Dolo, "650"', "123", None), (2, "Other", None, None)]
    assert rows.orderBy("row_number").first()["note"] == "two\nlines"


def test_annotations_and_arrays(spark, tmp_path):
    whole = {"images": [{"id": 1, "file_name": "a.png", "split": "train"}], "annotations": [{"id": 7, "image_id": 1, "bbox": [1, 2, 3, 4]}, {"id": 8, "image_id": 9, "bbox": []}]}
    (tmp_path / "c.json").write_text(json.dumps(whole))
    (tmp_path / "l.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "c.json")).collect()] == [(7, 1, "a.png", "train", 1.0, 2.0, 3.0, 4.0)]
    assert files.read_json_array(spark, str(tmp_path / "l.json"), "a int").count() == 2


def test_duplicates_count_only_against_rows_that_count(spark):
    """Row 2 repeats row 1's key and so isn't registered; row 3 shares only row 2's identity and stays; 5 is invalid."""
    rows = [(1, "k1", "x", True), (2, "k1", "y", True), (3, "k2", "y", True), (4, "k2", "z", True), (5, "k9", "w", False), (6, "k9", "w", True), (7, None, None, True)]
    df = spark.createDataFrame(rows, "n int, key string, identity string, valid boolean")
    found = {r["n"]: r["duplicate"] for r in catalogue.first_in_file(df, ["key", "identity"], "n", "valid").collect()}
    assert found == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}


def test_alerts_at_the_end_of_a_quiet_time_are_still_suppressed(spark):
    ship(spark)
    rows = [(1, "10:00", True), (2, "10:05", True), (3, "10:06", True), (4, "10:36", False), (5, "10:37", False)]
    df = spark.createDataFrame([(i, 1, "HR", c, f"2024-01-01 {t}:00") for i, t, c in rows], "id long, user_id long, metric string, critical boolean, at string")
    found = {r["id"]: r["sent"] for r in vitals.cooldown(df.withColumn("at", F.to_timestamp("at"))).collect()}
    assert found == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_places_beyond_the_date_line_and_at_the_poles_are_near(spark):
    points = spark.createDataFrame([(1, 0.0, 179.9), (2, 89.9, 0.0), (3, 0.0, 0.0)], "point_id long, lat double, lon double")
    places = spark.createDataFrame([(1, 0.0, -179.9), (2, 89.9, 180.0), (3, 40.0, 0.0)], "place_id long, plat double, plon double")
    found = {(r["point_id"], r["place_id"]) for r in matching.nearest(points, places, 100.0, 3).collect()}
    assert found == {(1, 1), (2, 2)}


def test_nearest_is_that_of_all_pairs(spark):
    point = [(i, (i * 37 % 180) - 90.0, (i * 101 % 360) - 180.0) for i in range(150)]
    place = [(i, (i * 53 % 180) - 90.0, (i * 71 % 360) - 180.0) for i in range(150)]
    p = spark.createDataFrame(point, "point_id long, lat double, lon double")
    q = spark.createDataFrame(place, "place_id long, plat double, plon double")
    km = matching.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    want = p.join(q).where(km <= 900).select("point_id", "place_id")
    assert sorted(map(tuple, matching.nearest(p, q, 900.0, 1000).select("point_id", "place_id").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("remaining,daily,threshold,status,days", [(20, 2.0, None, "ADEQUATE", 10), (6, 1.0, None, "LOW", 6), (None, 1.0, None, "UNKNOWN", -1), (30, 1.0, None, "GOOD", 30), (9, None, None, "UNKNOWN", -1), (9, None, 5, "GOOD", -1)])
def test_stock_levels(spark, remaining, daily, threshold, status, days):
    row = spark.createDataFrame([(1, remaining, daily, threshold)], "id int, remaining int, daily double, threshold int")
    found = stock.forecast(row, "2024-01-31").first()
    assert (found["status"], found["days"]) == (status, days)
    assert (found["suggested"] is None) == (days == -1)


def test_recognition_distances():
    """Look-alike letters are cheap, pairs that look like one letter are free, and case and signs don't count."""
    from carelake.functions.similarity import weighted_distance

    assert weighted_distance("Dolo-650", "d0l0 650") == pytest.approx(0.2)
    assert weighted_distance("corn", "COM") == 0
    assert weighted_distance("vvarfarin", "warfarin") == 0
    assert weighted_distance("zinc", "2inc") == pytest.approx(0.15)
    assert weighted_distance("abc", "") == 3 and weighted_distance("", "xy") == 2
    assert weighted_distance("gold", "gond") == 1.0


def test_points_and_places_of_one_position_meet_once(spark, monkeypatch):
    met, far = spark.sparkContext.accumulator(0), matching.haversine_km

    @F.udf("double")
    def counted(km):
        met.add(1)
        return km

    monkeypatch.setattr(matching, "haversine_km", lambda *a: counted(far(*a)))
    points = spark.createDataFrame([(i, 10.0, 20.0) for i in range(200)], "point_id long, lat double, lon double").repartition(2)
    places = spark.createDataFrame([(i, 10.0, 20.2 if i % 3 else 20.1) for i in range(300)], "place_id long, plat double, plon double").repartition(2)
    found = matching.nearest(points, places, 100.0, 4).select("point_id", "rank", "place_id").collect()
    assert sorted(map(tuple, found)) == [(i, n + 1, n * 3) for i in range(200) for n in range(4)]
    assert 0 < met.value <= 3 * 8  # 60,000 pairs of rows; Spark may tell a distance anew where it is used
