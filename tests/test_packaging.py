"""Batches and dates that are printed on packs."""

import pytest
from pyspark.sql import functions as F

from carelake.functions import text as X


@pytest.mark.parametrize(
    "text, told",
    [
        ("(01)08901234567890(10) ML-2026-X8 (17)270630", ("ML-2026-X8", "2027-06-30", None)),
        ("B.No: AB_12 Mfg Date: 06/2025 Exp. Date: 06/2027", ("AB_12", "06/2027", "06/2025")),
        ("Batch No. Q7 EXPIRY 2027-6", ("Q7", "2027-6", None)),
        ("lot no-9 (17) 2812 exp:1/27 mfg. 2024-01", ("9", "1/27", "2024-01")),
        ("(10)CODE b.no print", ("CODE", None, None)),
        ("no marks", (None, None, None)),
        ("", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_codes_come_before_print(spark, text, told):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(X.packaging(F.col("t")).alias("p")).first()["p"]) == told
