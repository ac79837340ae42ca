import hashlib
import random

import pytest

from carelake.llm.exact_dedup import PatriciaTrie, exact_duplicates
from carelake.llm.shared import table
from tests.llm.cases import LOWER, ROWS, awkward, docs_of, empty


def _expected(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=repr)


def _found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("trie_bytes", [64 << 20, 2000])
def test_same_as_brute_force_on_a_whole_table_also_when_subtrees_spill(spark, sf_dir, trie_bytes):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _found(exact_duplicates(docs, trie_bytes=trie_bytes)) == _expected(rows)


def test_awkward_rows(spark):
    assert _found(exact_duplicates(awkward(spark))) == _expected([r[:2] for r in ROWS])


def test_only_ascii_letters_lose_their_case(spark):
    found = exact_duplicates(docs_of(spark, ["É", "é", "AbC", "aBc"])).collect()
    assert sorted(r["keep_id"] for r in found) == [0, 1, 3, 3]


def test_empty_table(spark):
    assert exact_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("largest", [True, False])
def test_trie_counts_and_owners(largest):
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab") for _ in range(draw.randrange(9))).encode() for _ in range(2000)]
    trie = PatriciaTrie(largest)
    for i, text in enumerate(texts):
        trie.insert(text, i)
    found = {text: (owner, n) for text, owner, n in trie.take()}
    pick = max if largest else min
    assert found == {t: (pick(i for i, x in enumerate(texts) if x == t), texts.count(t)) for t in set(texts)}
    assert trie.size == 0
