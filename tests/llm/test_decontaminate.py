import itertools
import random

import corpus_pipeline
from carelake.llm.decontaminate import HITS, MASKS, NEAR, contaminated
from carelake.llm.shared import table
from tests.llm.cases import COLUMNS, awkward, docs_of, empty, words

BENCH = "item_id long, text string, pos long, hash long"


def _bench(spark, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], BENCH)


def _prose(draw, n):
    return [f"w{draw.randrange(100_000)}" for _ in range(n)]


def _found(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    draw = random.Random(2)
    items = {i: _prose(draw, draw.randrange(12, 60)) for i in range(40)}
    texts, planted = {}, set()
    for doc in range(300):
        text = _prose(draw, draw.randrange(30, 200))
        if doc % 3 == 0:
            item = draw.randrange(40)
            passage = list(items[item])
            for at in range(draw.randrange(8), len(passage), draw.randrange(6, 12)):
                passage[at] = f"changed{doc}"  # at most one word in six
            at = draw.randrange(len(text))
            text[at:at] = passage
            planted.add((doc, item))
        texts[doc] = " ".join(text)
    bench = _bench(spark, [(i, " ".join(x).upper()) for i, x in items.items()])
    assert _found(contaminated(docs_of(spark, texts), bench)) == planted


def test_whole_passages_of_a_whole_table(spark, sf_dir):
    """Every document that holds an item word for word is found; every finding has the equal words it tells of."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    found = contaminated(docs, bench).collect()
    held = {(d, i) for d, t in texts.items() for i, x in items.items() if x and " ".join(["", *x, ""]) in " ".join(["", *t, ""])}
    assert held and held <= {(r["doc_id"], r["item_id"]) for r in found}
    for r in found:
        mine = texts[r["doc_id"]][r["doc_start"] : r["doc_end"]]
        theirs = items[r["item_id"]][r["item_start"] : r["item_start"] + len(mine)]
        same = sum(a == b for a, b in zip(mine, theirs))
        assert same == r["n_equal"] and 100 * same >= 75 * len(mine)


def test_short_items_must_be_held_whole(spark):
    bench = _bench(spark, [(1, "one two three"), (2, "four five six seven eight")])
    texts = {1: "zero One TWO three four", 2: "one two thre", 3: "four five six seven x eight"}
    assert _found(contaminated(docs_of(spark, texts), bench)) == {(1, 1)}


def test_awkward_rows(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = _bench(spark, [(1, passage), (1, passage), (2, None), (3, ""), (None, passage)])
    assert _found(contaminated(awkward(spark), bench)) == {(1, 1), (1, None), (None, 1), (None, None)}
    assert contaminated(awkward(spark), _bench(spark, [])).count() == 0
    assert contaminated(empty(spark), bench).count() == 0
    assert contaminated(spark.createDataFrame([(1, None, None, None, None)], COLUMNS), bench).count() == 0


def test_short_runs_with_any_words_substituted_are_found(spark):
    """Items of 8 to 30 words of which up to a quarter are substituted anywhere inside; brute force over diagonals."""
    draw = random.Random(5)
    items, texts, expected = {}, {}, set()
    for i in range(400):
        n = draw.randrange(8, 31)
        items[i] = _prose(draw, n)
        passage = list(items[i])
        for at in draw.sample(range(1, n - 1), min(n // 4, n - 8)):
            passage[at] = f"changed{i}"
        around = _prose(draw, 40)
        texts[i] = " ".join([*around[:20], *passage, *around[20:]])
        expected.add((i, i))
    assert _found(contaminated(docs_of(spark, texts), _bench(spark, [(i, " ".join(x)) for i, x in items.items()]))) == expected


def test_masks_hit_every_short_pattern_twice():
    """All ways to substitute words inside runs of 8 to 16 with at least 8 equal words, three in four or more."""
    for n, k in ((8, 0), (9, 1), (10, 2), (11, 2), (12, 3), (13, 3), (14, 3), (15, 3), (16, 4)):
        for gone in itertools.combinations(range(1, n - 1), k):
            hits = [
                at
                for mask in MASKS
                for at in range(n - len(mask) + 1)
                if not any(x == "1" and at + j in gone for j, x in enumerate(mask))
            ]
            assert len(hits) >= HITS and max(hits) - min(hits) <= NEAR


def test_large_ids_and_rows_of_one_id_or_none_keep_their_own_verdicts(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    big = 1 << 60
    rows = [(big + 1, passage), (big + 5, "x " + passage), (None, passage), (None, "clean words only"), (7, "clean"), (7, passage)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS)
    found = contaminated(docs, _bench(spark, [(big + 3, passage)]))
    assert _found(found) == {(i, big + 3) for i in (big + 1, big + 5, None, 7)}
    left = corpus_pipeline._without(docs, found).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == [(0, "clean words only"), (7, "clean")]
