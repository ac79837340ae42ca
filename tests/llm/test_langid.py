import zlib

import numpy as np
import pandas as pd

from carelake.llm.langid import _solve, identify
from carelake.llm.shared import table
from tests.llm.cases import COLUMNS, awkward, empty


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    truth = {r["doc_id"]: r for r in docs.collect()}
    found = identify(docs).collect()
    assert len(found) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)
    asked = [r for r in found if r["held_out"] and truth[r["doc_id"]]["lang"] and len(truth[r["doc_id"]]["text"] or "") > 50]
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in asked)
    assert right >= 0.95 * len(asked) > 0


def test_und_for_exactly_the_texts_without_a_letter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in identify(docs).collect():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))


def test_predictions_rest_on_texts_alone(spark):
    rows = [(i, f"der hund und die katze {i}", "de", "x", None) for i in range(40)]
    rows += [(100 + i, f"the dog and the cat {i}", "en", "x", None) for i in range(40)]
    out = next(i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 4 == 2)  # its label is not learned
    rows += [(out, "the cat and the dog", "de", "y", None), (301, "the cat and the dog", None, None, None)]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found[out] == found[301]
    assert found[301][0] == "en"


def test_awkward_rows(spark):
    found = identify(awkward(spark)).collect()
    assert len(found) == 13
    of = {r["doc_id"]: r for r in found}
    assert {of[i]["lang_pred"] for i in (2, 3, 4, 7, 11)} == {"und"}
    assert {of[i]["score"] for i in (2, 3, 4, 7, 11)} == {0.0}
    assert {r["lang_pred"] for r in found} <= {"und", "aa", "bb"}
    assert of[None]["held_out"] is False and of[None]["lang_pred"] != "und"


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, None)], COLUMNS)
    assert [r["lang_pred"] for r in identify(docs).collect()] == ["und"]
    assert identify(empty(spark)).count() == 0


def _grams(text):
    raw = text.lower().encode()
    return {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}


def test_margins_are_those_of_a_brute_force_kernel():
    """Nyström kernel ridge regression on sets of n-grams, without folding anything into weights of n-grams."""
    draw = np.random.default_rng(2)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    texts = [(x, "".join(draw.choice(list(alphabets[x] + " "), 30))) for _ in range(12) for x in alphabets]
    langs, marks, ridge = sorted(alphabets), 9, 1e-2
    sets = [_grams(t) for _, t in texts]
    seen = set().union(*sets[:marks])
    sets = [s & seen for s in sets]

    def k(x, y):
        return len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1))

    kernel = np.array([[k(x, y) for y in sets[:marks]] for x in sets])
    values, vectors = np.linalg.eigh(kernel[:marks])
    features = kernel @ (vectors / np.sqrt(np.maximum(values, 1e-8)) @ vectors.T)
    wanted = np.array([[1.0 if x == y else -1.0 for y in langs] for x, _ in texts])
    gram = features.T @ features + ridge * len(texts) / 100 * np.eye(marks)
    expected = features @ np.linalg.solve(gram, features.T @ (wanted - wanted.mean(0))) + wanted.mean(0)

    def code(g):
        return int.from_bytes(g, "big") + (0, 256, 256 + (1 << 16))[len(g) - 1]

    codes = [np.array(sorted(code(g) for g in _grams(t)), np.int32) for _, t in texts]
    model = _solve(pd.DataFrame({"lang": [x for x, _ in texts], "codes": codes}), marks, ridge)
    for found, row in zip(codes, expected):
        mine = np.intersect1d(found, model.codes)
        margin = model.weights[np.searchsorted(model.codes, mine)].sum(0) / np.sqrt(max(len(mine), 1)) + model.bias
        assert np.allclose(margin, row, atol=1e-4)
