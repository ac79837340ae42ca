import hashlib
import random
import zlib

import pytest

from carelake.llm.merkle import ARITY, document_manifest, fold, levels_of, paths_of
from carelake.llm.shared import table
from tests.llm.cases import COLUMNS, ROWS, awkward, empty


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(*values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _expected(rows):
    """The tree by plain recursion over whole lists, with each row's siblings looked up level by level."""

    def grow(nodes):
        """(root, siblings of each node from there up)."""
        siblings, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, w in enumerate(where):
                run = range(w - w % 3, min(len(nodes), w - w % 3 + 3))
                siblings[i].append(([nodes[k] for k in run if k < w], [nodes[k] for k in run if k > w]))
            nodes = [_h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
            where = [w // 3 for w in where]
        return nodes[0], siblings

    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        changed = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        found = (doc_id is not None, doc_id or 0, _leaf(doc_id, source, lang, n_chars, text), _leaf(doc_id, source, lang, n_chars, changed), doc_id)
        groups.setdefault((source is not None, (source or "").encode()), []).append(found)
    trees = {k: grow([r[2] for r in sorted(groups[k], key=repr_key)]) for k in sorted(groups)}
    root, upper = grow([t[0] for t in trees.values()])
    out = []
    for (key, (subroot, below)), above in zip(trees.items(), upper):
        for row, own in zip(sorted(groups[key], key=repr_key), below):
            digest, steps = row[3], own + above
            for left, right in steps:
                digest = _h("".join(left) + digest + "".join(right))
            told = _h("".join("".join(left + right) for left, right in steps))
            out.append((row[4], row[2], subroot, root, told, digest, digest == root))
    return sorted(out, key=repr)


def repr_key(row):
    return row[:3]


def _found(df):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_same_as_brute_force_on_a_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = _found(document_manifest(docs))
    assert found == _expected(rows)
    assert {True, False} == {r[-1] for r in found}


@pytest.mark.parametrize("sizes", [dict(block_levels=1, top_nodes=4), dict(block_levels=2, top_nodes=30), dict(block_levels=1, top_nodes=1)])
def test_small_blocks_and_tops_take_several_steps_and_change_nothing(spark, sf_dir, sizes):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert _found(document_manifest(docs, **sizes)) == _expected(rows)


@pytest.mark.parametrize("sizes", [{}, dict(block_levels=1, top_nodes=2)])
def test_awkward_rows_have_an_order_and_a_leaf_each(spark, sizes):
    assert _found(document_manifest(awkward(spark), **sizes)) == _expected(ROWS)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_hot_groups_and_single_sources(spark, n):
    rows = [(i, f"line {i}\nend", "aa", "hot" if i % 4 else f"é{i}", i) for i in range(n)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    want = _expected([(i, t, lang, s, c) for i, t, lang, s, c in rows])
    assert _found(document_manifest(df, block_levels=1)) == want


def test_empty_table(spark):
    assert document_manifest(empty(spark)).count() == 0


def test_every_path_leads_to_the_root():
    draw = random.Random(3)
    for n in [*range(1, 40), 81, 82]:
        nodes = [_h(str(draw.random())) for _ in range(n)]
        levels = levels_of(nodes)
        assert {fold(d, p) for d, p in zip(nodes, paths_of(levels))} == {levels[-1][0]}
        assert len(levels) == 1 + next(k for k in range(9) if ARITY**k >= n)
