import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carelake.llm.shared import table
from carelake.llm.token_counts import PrefixCounter, at, cut, longest, running, token_prefixes
from tests.llm.cases import ROWS, awkward, docs_of, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    "a", "the", " ", "  ", "\n", "\n\n", " \n", "'s", "'re", "'", "'l", "'ll", "!", "--", "1", "2024", "é", "ß", "漢字", "\U0001f600",
    "<|endoftext|>", "<|endof", "text|>", "\t", "hello", "World", " '", "　", "\xa0", "é", "<", "|",
]


@pytest.fixture(scope="module")
def library():
    model = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return PrefixCounter(f.read())


def test_every_prefix_counts_as_the_library_encodes_it(library, counter):
    draw = random.Random(1)
    for _ in range(400):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randrange(1, 25)))
        assert running(counter.steps(text)).tolist() == library([text[:i] for i in range(len(text) + 1)]), text


def test_whole_texts_count_as_in_the_library_on_a_whole_table(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    want = {i: (len(t.encode()), n, n > 1024) for (i, t), n in zip(texts.items(), library(list(texts.values())))}
    assert {r[0]: r[1:4] for r in token_prefixes(docs, PATH, store=False).collect()} == want


def test_stored_counts_answer_truncation_and_budgets(spark, library):
    texts = ["one two  three\n\nfour's <|endoftext|> five", "", "漢字 \U0001f600 " * 50]
    rows = token_prefixes(docs_of(spark, texts), PATH, limit=7)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(45))).alias("k")
    told = rows.select("doc_id", "fit_chars", "steps", numbers).select("*", at(F.col("steps"), F.col("k")).alias("n"), cut(F.col("steps"), F.col("k")).alias("fits"))
    for doc_id, fit, _, k, n, fits in told.collect():
        counts = library([texts[doc_id][:i] for i in range(len(texts[doc_id]) + 1)])
        assert n == counts[min(k, len(counts) - 1)]
        assert fits == max(i for i, c in enumerate(counts) if c <= k)
        assert fit == max(i for i, c in enumerate(counts) if c <= 7)
    nulls = rows.select(at(F.lit(None).cast("binary"), F.lit(1)), cut(F.col("steps"), F.lit(None))).collect()
    assert {tuple(r) for r in nulls} == {(None, None)}


def test_awkward_rows_and_empty_tables(spark, library):
    want = sorted(((r[0], len((r[1] or "").encode()), n) for r, n in zip(ROWS, library([r[1] or "" for r in ROWS]))), key=repr)
    assert sorted((tuple(r)[:3] for r in token_prefixes(awkward(spark), PATH).collect()), key=repr) == want
    assert token_prefixes(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("text", ["漢字" * 3000, "ab" * 4000, " " * 9000, "\n" * 5001 + "x", "-" * 3000, "x" * 30 + "<|endoftext|>" * 40])
def test_long_units(library, counter, text):
    counts = running(counter.steps(text))
    at = [0, 1, len(text) // 3, len(text) - 1, len(text)]
    assert counts[at].tolist() == library([text[:i] for i in at])
    assert longest(counts, 10) == max(i for i, c in enumerate(counts) if c <= 10)


def test_a_full_cache_starts_anew(library, monkeypatch):
    from carelake.llm import token_counts

    monkeypatch.setattr(token_counts, "CACHED", 4)
    monkeypatch.setattr(token_counts, "CACHED_PAIRS", 4)
    with open(PATH, encoding="utf-8") as f:
        small = PrefixCounter(f.read())
    text = "The quick brown fox jumps over the lazy dog, again and again."
    assert running(small.steps(text)).tolist() == library([text[:i] for i in range(len(text) + 1)])


def test_other_vocabularies_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        PrefixCounter(f.read())
