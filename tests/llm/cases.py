"""Documents with awkward values in every column, and plain Python versions of what operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use inside.
EXTRA = ("id", "cls", "root", "rep", "key", "n", "row", "size", "hash", "line", "text_hash", "held_out", "blob", "_id", "digest")

SENTENCE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(60_000))
ROWS = [
    (1, SENTENCE, "aa", "s1", 66),
    (1, SENTENCE, "aa", "s1", 66),
    (2, None, "aa", "s1", None),
    (3, "", "bb", None, 0),
    (4, " \n\t ", None, "s2", 4),
    (None, SENTENCE, None, None, None),
    (5, LONG, "bb", "s2", None),
    (6, LONG.upper(), "bb", "s2", None),
    (7, "12345 !!! 678", "aa", "s1", 13),
    (8, "tiny", "aa", "s3", 4),
    (9, "TINY", None, "s3", 4),
    (10, "Ünï çödé \U0001f600 text\nsecond line of this text, long enough to count", "bb", "s1", None),
    (11, None, None, None, None),
]


def awkward(spark):
    """The rows above, with extra columns of clashing names."""
    schema = COLUMNS + ", " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in ROWS], schema)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def docs_of(spark, texts):
    """A table of (doc_id, text) from a list or a dict of texts."""
    pairs = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
    return spark.createDataFrame([(i, t, "aa", "s", None) for i, t in pairs], COLUMNS)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def roots(ids, links):
    """The smallest id reachable from each id."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar_links(sets, percent):
    """All links of a dict of sets, through an index of members."""
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    return [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
