import random

from carelake.llm.near_dedup import near_duplicates
from carelake.llm.shared import table
from tests.llm.cases import awkward, docs_of, empty, roots, shingles, similar_links


def _expected(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = roots(sets, similar_links(sets, 75))
    return {(i, len(s), root[i], root[i] == i) for i, s in sets.items()}


def _found(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_same_as_brute_force_on_a_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert _found(near_duplicates(docs)) == _expected(texts)


def test_large_groups_of_near_copies(spark):
    draw = random.Random(3)
    base = [f"w{draw.randrange(900)}" for _ in range(120)]
    texts = {}
    for i in range(300):
        mine = list(base)
        mine[draw.randrange(120)] = f"x{i}"
        texts[1000 - i] = " ".join(mine)
    texts |= {2000 + i: " ".join(base[:60] + [f"y{i}-{j}" for j in range(40)]) for i in range(40)}
    found, expected = _found(near_duplicates(docs_of(spark, texts))), _expected(texts)
    assert found == expected


def test_similarity_of_exactly_three_quarters_links_and_below_does_not(spark):
    words = [f"a{i}" for i in range(18)]
    at = {0: " ".join(words[:18]), 1: " ".join(words[:14] + ["z1", "z2"])}  # 14 and 12 shingles, 10 shared
    near = {0: " ".join(words[:10]), 1: " ".join(words[:12])}  # 6 of 8
    assert {r[2] for r in _found(near_duplicates(docs_of(spark, near)))} == {0}
    assert {r[2] for r in _found(near_duplicates(docs_of(spark, at)))} == {0, 1}


def test_awkward_rows(spark):
    found = near_duplicates(awkward(spark)).collect()
    assert len(found) == 13
    of = {r["doc_id"]: r for r in found}
    assert of[2]["n_shingles"] == of[3]["n_shingles"] == of[4]["n_shingles"] == 0
    assert of[2]["kept"] and of[3]["kept"] and of[4]["kept"] and of[11]["kept"]
    assert (of[6]["component_id"], of[6]["kept"]) == (5, False)
    assert (of[9]["component_id"], of[9]["kept"]) == (8, False)
    assert of[None]["component_id"] is None and of[None]["kept"]
    assert [r["kept"] for r in found if r["doc_id"] == 1] == [True, True]


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0
