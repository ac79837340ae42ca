"""The query of distances as recognition sees them, compared with the rules row by row."""

import re
import unicodedata

from carelake.functions.similarity import weighted_distance
from carelake.plans import registry
from carelake.sources.views import table


def test_every_part_has_its_distance_and_compatible_form(spark, sf_dir):
    names = {r["p_partkey"]: r["p_name"] for r in table(spark, sf_dir, "part").select("p_partkey", "p_name").collect()}
    found = {r["id"]: r for r in registry.queries()["ocr_distances"](spark, sf_dir).collect()}
    assert set(found) == set(names)
    for i, name in names.items():
        assert found[i]["form"] == re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name)).strip()
        assert found[i]["distance"] == round(weighted_distance(name, name.translate(str.maketrans("leo", "1c0"))), 6)
