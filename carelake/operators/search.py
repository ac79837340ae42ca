"""Catalogue search: candidates by what they contain of a query, scored by name, composition, strength and look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from carelake.functions import similarity as S
from carelake.functions import text as X
from carelake.shipping import ship

#: Words that are no part of a brand.
NO_BRAND = r"^(?:mg|mcg|ug|g|gm|ml|iu|units?|tablets?|capsules?|film|coated|uncoated|release|sr|cr|xr|er|ds|dr|dt)$"
#: From which similarity recognition may have read one for the other, and the weights of edits and trigrams.
SEEN_LEAST, SEEN_EDITS, SEEN_GRAMS = 0.78, 0.7, 0.3
#: Scores of what a composition says, for queries that are molecules and for others.
BASE = 0.35
COMPOSITION = {"exact": (0.99, 0.94), "strong": (0.97, 0.92), "contains": (0.9, 0.82)}
DISCONTINUED = 0.2


def parts(query: Column) -> Column:
    """A query's normal form, letters, first brand word, needles of its start, numbers and look-alike key."""
    low, key = F.lower(F.trim(query)), X.name_key(F.trim(query))
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$") & ~t.rlike(NO_BRAND))
    letters = F.regexp_replace(key, "[0-9]", "")
    stem = F.coalesce(F.get(words, F.lit(0)), letters)
    cuts = [F.when(F.length(c) >= n, F.substring(c, 1, n)) for c, n in ((stem, 6), (stem, 5), (stem, 4), (letters, 5), (letters, 4))]
    stems = F.array_distinct(F.filter(F.array(stem, letters, *cuts), lambda s: s.isNotNull() & (F.length(s) >= 3)))
    # The key of look-alikes keeps no capitals, which lower-casing has made letters before.
    look = X.lookalike_key(F.when(stem != "", stem).otherwise(key))
    numbers = F.array_distinct(F.regexp_extract_all(F.trim(query), F.lit(r"(\d+(?:\.\d+)?)"), 1))
    return F.struct(
        low.alias("low"), key.alias("key"), letters.alias("letters"), stem.alias("stem"), stems.alias("stems"), numbers.alias("strengths"), look.alias("look")
    )


def seen_similarity(a: Column, b: Column, distance: Column) -> Column:
    """0.7 of the similarity by look-alike edits and 0.3 of Dice's coefficient of trigrams, of letters and digits."""
    x, y = X.name_key(a), X.name_key(b)
    edit = F.greatest(F.lit(0.0), 1 - distance / F.greatest(F.length(x), F.length(y)))
    dice = X.dice(X.grams(x, 3), X.grams(y, 3))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(edit * SEEN_EDITS + dice * SEEN_GRAMS)


def _any(values: list[Column], test) -> Column:
    """Whether a test holds for one of some texts, of which null ones don't count."""
    out = F.lit(False)
    for v in values:
        out = out | F.coalesce(test(v), F.lit(False))
    return out


def composition_tier(q: Column, query: Column, row: dict[str, Column]) -> Column:
    """exact, strong or contains, where a query names what is in a row: its ingredients, composition, names or salt."""
    names = [X.name_key(row[c]) for c in ("composition", "generic", "salt_name")]
    salt = F.coalesce(X.name_key(row["salt_key"]), F.lit(""))
    within = F.coalesce(F.transform(row["ingredients"], X.name_key), F.array().cast("array<string>"))
    tokens = F.filter(F.transform(F.split(F.trim(query), r"\s+"), X.name_key), lambda t: F.length(t) >= 4)
    all_there = _any(names, lambda v: (F.size(tokens) > 0) & (v != "") & F.forall(tokens, lambda t: F.contains(v, t)))
    return (
        F.when(q == "", F.lit(None).cast("string"))
        .when(F.array_contains(within, q) | _any(names, lambda v: v == q), "exact")
        .when(salt.startswith(q) | _any(names, lambda v: v.startswith(q)), "strong")
        .when(F.exists(within, lambda v: F.contains(v, q)) | F.contains(salt, q) | _any(names, lambda v: F.contains(v, q)) | all_there, "contains")
    )


def _keys(text: Column, n: int) -> Column:
    """All runs of n letters of a text."""
    t = F.coalesce(text, F.lit(""))
    at = F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))
    return F.filter(F.transform(at, lambda i: F.substring(t, i, F.lit(n))), lambda x: F.length(x) == n)


FIELDS = ("id", "brand", "strength", "composition", "generic", "salt_name", "salt_key", "ingredients", "discontinued", "rank")
TEXTS = ("brand", "strength", "composition", "generic", "salt_name", "salt_key", "ingredients", "discontinued")


def candidates(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Queries with the rows that begin with or hold them, their first word, or its first letters.

    A needle of three letters or more that stands in a row's text shares its first three letters with it, so both meet on
    runs of three letters (or of two, for queries of two); what meets is tested for the needle itself. catalogue has
    TEXTS, a key of them in `said` and the brand's parts in `m`. Queries of a single letter have none.
    """
    p = F.col("p")
    asked = queries.where("q is not null").select("q").distinct().withColumn("p", parts(F.col("q"))).where(F.length(F.trim("q")) >= 2)
    needles = F.filter(F.array_distinct(F.concat(F.array(p["key"], p["low"]), p["stems"])), lambda x: F.length(x) >= 2)
    asked = asked.withColumn("k", F.explode(F.array_distinct(F.transform(needles, lambda x: F.substring(x, F.lit(1), F.lit(3))))))
    held = F.array(*[f(F.col(c)) for c in ("brand", "composition", "generic", "salt_name", "salt_key") for f in (F.lower, X.name_key)])
    runs = F.array_distinct(F.flatten(F.transform(held, lambda t: F.concat(_keys(t, 3), _keys(t, 2)))))
    # Only keys meet, and what meets on several of them is one pair; the rows' texts join it afterwards.
    met = asked.select("q", "k").join(catalogue.select("said", F.explode(runs).alias("k")), "k").select("q", "said").distinct()
    both = met.join(asked.select("q", "p").dropDuplicates(["q"]), "q").join(catalogue, "said")
    brand, normal = F.col("m.low"), F.col("m.key")
    texts = [F.lower(F.col(c)) for c in ("composition", "generic", "salt_name")]
    stem = p["stem"]
    begins = F.startswith(normal, p["key"]) | F.startswith(brand, p["low"]) | ((stem != "") & (F.startswith(normal, stem) | F.startswith(brand, stem)))
    inside = (F.length(p["key"]) >= 4) & (
        F.contains(normal, p["key"]) | F.contains(brand, p["low"]) | _any(texts, lambda v: F.contains(v, p["low"])) | F.coalesce(F.contains(F.lower("salt_key"), p["key"]), F.lit(False))
    )
    salted = F.coalesce((F.length(p["letters"]) >= 6) & (F.contains(F.lower("salt_key"), p["letters"]) | F.contains(F.lower("salt_name"), p["low"])), F.lit(False))
    fallback = F.exists(p["stems"], lambda s: F.startswith(normal, s) | F.startswith(brand, s))
    both = both.withColumn("salted", salted & (F.length(p["key"]) >= 4))
    return both.where(F.coalesce(begins | inside | F.col("salted") | fallback, F.lit(False)))


def scores(queries: DataFrame, catalogue: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(q, id, score, tier, rank, brand) of all candidates of all queries (q).

    catalogue has FIELDS. A query is a molecule when it has six letters or digits and a row found by its salt is made of
    it, exactly or to begin with; names count for less then. aliases (q, id) are learned readings, which score 1. A
    discontinued row loses 0.2. Queries and rows are scored once for each different text.
    """
    ship(queries.sparkSession)
    rows = catalogue.select(*FIELDS)
    said = [F.col(c) for c in TEXTS]
    distinct = rows.select(F.xxhash64(F.to_json(F.struct(*said))).alias("said"), *said).dropDuplicates(["said"])
    pairs = candidates(queries, distinct.withColumn("m", parts(F.col("brand"))))
    p = F.col("p")
    row = {c: F.col(c) for c in TEXTS}
    pairs = pairs.withColumn("tier", composition_tier(p["key"], F.col("q"), row))
    molecule = F.max(F.col("salted") & (F.length(p["key"]) >= 6) & F.coalesce(F.col("tier").isin("exact", "strong"), F.lit(False))).over(W.Window.partitionBy("q"))
    pairs = pairs.withColumn("molecule", molecule)
    # Look-alike distances take Python, so each pair of texts is compared once.
    looks = pairs.select(F.explode(F.array(F.struct(p["low"].alias("a"), F.col("m.low").alias("b")), F.struct(p["stem"].alias("a"), F.col("m.stem").alias("b")))).alias("x"))
    looks = looks.select("x.a", "x.b").distinct()
    looks = looks.select("a", "b", (seen_similarity(F.col("a"), F.col("b"), S.ocr_distance("a", "b")) >= SEEN_LEAST).alias("seen"))
    whole, first = looks.select(F.col("a").alias("wa"), F.col("b").alias("wb"), F.col("seen").alias("whole")), looks.select(F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("seen").alias("first"))
    pairs = pairs.join(whole, (F.col("p.low") == F.col("wa")) & (F.col("m.low") == F.col("wb"))).join(first, (F.col("p.stem") == F.col("sa")) & (F.col("m.stem") == F.col("sb")))

    brand, normal, low, key, stem = F.col("m.low"), F.col("m.key"), p["low"], p["key"], p["stem"]
    own = F.col("m.stem")
    exact = (normal == key) | (brand == low)
    stem_exact = (stem != "") & (own != "") & (stem == own)
    look_exact = (p["look"] != "") & (p["look"] == F.col("m.look"))
    four = F.length(stem) >= 4
    begins = ~exact & (F.startswith(brand, low) | F.startswith(normal, key) | (four & (F.startswith(own, stem) | F.startswith(stem, own))))
    holds = ~exact & ~begins & (F.contains(brand, low) | F.contains(normal, key) | (four & (F.contains(own, stem) | F.contains(stem, own))))
    far, longest = F.levenshtein(stem, own), F.greatest(F.length(stem), F.length(own))
    fuzzy = (stem != "") & (own != "") & (longest >= 5) & (far <= F.when(longest >= 8, 2).otherwise(1)) & (far / longest <= 0.22)
    texts = [brand, normal, *[F.lower(F.col(c)) for c in ("strength", "composition", "salt_name")], X.name_key(F.col("salt_key"))]
    strong = F.exists(p["strengths"], lambda s: _any(texts, lambda v: F.contains(v, s)))
    fits = strong | (F.size(p["strengths"]) == 0)
    seen_stem = F.col("first") & (stem != "") & (own != "")
    seen = seen_stem | F.col("whole")
    longest_stem = F.get(p["stems"], F.lit(0))
    head, inner = F.coalesce(F.startswith(normal, longest_stem), F.lit(False)), F.coalesce(F.contains(normal, longest_stem), F.lit(False))
    named = (
        F.when(exact | (stem_exact & fits), 1.0).when((look_exact | seen) & fits, 0.98).when(fuzzy & fits, 0.95).when(begins & strong, 0.96).when(begins, 0.9).when(seen, 0.92)
        .when(fuzzy, 0.88).when(holds & strong, 0.88).when(holds, 0.75).when(head & strong, 0.88).when(inner & strong, 0.78).otherwise(0.0)
    )
    beside = F.when(exact | stem_exact, 0.62).when(begins | look_exact, 0.5).when(F.col("whole"), 0.5).when(holds, 0.42).when(head & strong, 0.4).otherwise(0.0)
    told = F.lit(BASE)
    for tier, (pure, other) in COMPOSITION.items():
        told = F.when(F.col("tier") == tier, F.when(F.col("molecule"), pure).otherwise(other)).otherwise(told)
    score = F.when(F.col("molecule") & F.col("tier").isNull(), F.greatest(told, beside)).when(F.col("molecule"), F.greatest(told, named)).otherwise(F.greatest(told, named))
    pairs = pairs.select("q", "said", score.alias("score"), "tier", "discontinued", "molecule")
    ids = rows.select("id", "rank", "brand", F.xxhash64(F.to_json(F.struct(*said))).alias("said"))
    found = pairs.join(ids, "said")
    if aliases is None:
        learned = F.lit(False)
    else:
        found = found.join(aliases.select("q", "id", F.lit(True).alias("known")).distinct(), ["q", "id"], "left")
        learned = F.coalesce("known", F.lit(False))
    score = F.when(learned, 1.0).otherwise(F.col("score"))
    lost = F.when(F.coalesce("discontinued", F.lit(False)), DISCONTINUED).otherwise(0.0)
    return found.select("q", "id", F.round(F.greatest(F.lit(0.0), score - lost), 9).alias("score"), "tier", "molecule", "rank", "brand")


def leaders(catalogue: DataFrame) -> DataFrame:
    """Of catalogue rows with equal TEXTS the one that best() takes of them: by rank, then id.

    Equal texts score alike, so where each identity is told once and no aliases are learned, the others need no score.
    """
    first = F.min(F.struct(F.col("rank").isNull().alias("without"), (-F.col("rank")).alias("down"), "id", "rank")).alias("f")
    return catalogue.groupBy(*TEXTS).agg(first).select("f.id", *TEXTS, "f.rank")


def best(scored: DataFrame, identity: Column, k: int) -> DataFrame:
    """The k best rows of each query, one for each identity, by score, rank and brand, then id."""
    order = [F.desc("score"), F.desc("rank"), F.asc("brand"), F.asc("id")]
    one = F.row_number().over(W.Window.partitionBy("q", identity).orderBy(F.desc("rank"), *order))
    rows = scored.where("score > 0").withColumn("one", one).where("one = 1").drop("one")
    place = F.row_number().over(W.Window.partitionBy("q").orderBy(*order)).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= k)


def composition_score(ingredients: Column, row: dict[str, Column]) -> Column:
    """How much of a list of ingredients a row has: 0.62 and up to 0.14, 0.18 for all, 0.03 verified, less 0.12 if gone."""
    text = X.name_key(F.concat_ws(" ", *[row[c] for c in ("composition", "generic", "salt_name", "salt_key")]))

    def there(x: Column) -> Column:
        tokens = F.filter(F.transform(F.split(x, r"\s+"), X.name_key), lambda t: F.length(t) >= 3)
        return F.contains(text, X.name_key(x)) | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(text, t)))

    ratio = F.size(F.filter(ingredients, there)) / F.size(ingredients)
    sure = F.when(F.coalesce(row["verified"], F.lit(False)), 0.03).otherwise(0.0)
    gone = F.when(F.coalesce(row["discontinued"], F.lit(False)), 0.12).otherwise(0.0)
    score = 0.62 + ratio * 0.14 + F.when(ratio == 1, 0.18).otherwise(0.0) + sure - gone
    return F.when(F.size(ingredients) > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.91), score)), 9))


def completeness(verified: Column, packs: Column) -> Column:
    """A row's rank: verified salt 50, a verified pack 30, one with an image 10, any pack 5. packs: (verified, image)."""
    def some(test) -> Column:
        return F.coalesce(F.exists(packs, test), F.lit(False))

    points = (
        (F.coalesce(verified, F.lit(False)), 50), (some(lambda p: F.coalesce(p["verified"], F.lit(False))), 30),
        (some(lambda p: F.coalesce(p["image"] != "", F.lit(False))), 10), (F.coalesce(F.size(packs) > 0, F.lit(False)), 5),
    )
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))
