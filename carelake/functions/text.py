"""Text functions: normal forms, keys, extraction patterns and checks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def name_key(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9%]+", "-"), "^-+|-+$", "")


#: Characters that recognition confuses, and pairs of them, in the order in which they are replaced.
LOOKALIKES = ("01|!528", "olllszb")
LOOKALIKE_PAIRS = (("vv", "w"), ("rn", "m"), ("cl", "d"), ("ph", "f"))


def lookalike_key(c: Column) -> Column:
    out = F.translate(F.lower(c), *LOOKALIKES)
    for pair, one in LOOKALIKE_PAIRS:
        out = F.regexp_replace(out, pair, one)
    return F.regexp_replace(out, "[^a-z0-9]", "")


def squeezed(c: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, limit)


def masked_email(c: Column) -> Column:
    whole = F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1))
    return F.when(c.rlike("^[^@]+@[^@]+$"), whole).otherwise(F.lit("hidden"))


@F.pandas_udf(T.StringType())
def _compatible_form(text: pd.Series) -> pd.Series:
    clean = text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))
    return clean.str.replace("[​-‍﻿]", "", regex=True).str.replace(r"\s+", " ", regex=True).str.strip()


def compatible_form(c: Column) -> Column:
    """NFKC without zero-width characters and with single spaces; Spark has no function for normal forms.

    ASCII and the letters of Latin-1 are their own normal forms, so only texts with other characters go to Python.
    """
    plain = ~c.rlike(r"[^\x00-\x7f\u00c0-\u00ff]")
    return F.when(plain, F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f]+", " "))).otherwise(_compatible_form(F.when(~plain, c)))


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams; a shorter text is its own."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n))))


def dice(left: Column, right: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(left, right)) / (F.size(left) + F.size(right))


def jaccard(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right)) / F.greatest(F.size(F.array_union(left, right)), F.lit(1))


def edit_similarity(left: Column, right: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(left, right) / longest)


#: The patterns of a prescription line's parts.
STRENGTH = r"(?i)\b(\d+(?:\.\d+)?(?:\s*[/+-]\s*\d+(?:\.\d+)?)?)\s*(mcg|\u00b5g|ug|mg|g|ml|iu|units?)\b"
DURATION = r"(?i)\b(?:for\s+|x\s*)?(\d+)\s*(day|days|week|weeks|month|months)\b"
QUANTITY = r"(?i)(?:#|qty\s*[:-]?\s*)(\d+)|\b(\d+)\s*(?:tablets?|tabs?|capsules?|caps?|pills?)\b"
#: Frequencies in the order in which their patterns are tried.
FREQUENCIES = (
    (r"(?:^|\s)\d+\s*[-+]\s*\d+\s*[-+]\s*\d+(?:\s|$)", "CUSTOM"),
    (r"(?i)\b(?:as\s+needed|sos|prn)\b", "AS_NEEDED"),
    (r"(?i)\b(?:four\s+times\s+(?:a\s+)?day|qid)\b", "FOUR_TIMES_DAILY"),
    (r"(?i)\b(?:three\s+times\s+(?:(?:a\s+)?day|daily)|tds|tid)\b", "THREE_TIMES_DAILY"),
    (r"(?i)\b(?:twice\s+daily|twice\s+(?:a\s+)?day|bd|bid)\b", "TWICE_DAILY"),
    (r"(?i)\b(?:once\s+daily|once\s+(?:a\s+)?day|daily|od)\b", "DAILY"),
    (r"(?i)\b(?:once\s+weekly|weekly)\b", "WEEKLY"),
)
#: The same for lines that were matched with a dictionary, in their own order.
DICTIONARY_FREQUENCIES = (
    (r"(?i)\b(?:four\s+times\s+(?:a\s+)?day|qid)\b", "FOUR_TIMES_DAILY"),
    (r"(?i)\b(?:three\s+times\s+(?:a\s+)?day|tds|tid)\b", "THREE_TIMES_DAILY"),
    (r"(?i)\b(?:twice\s+daily|twice\s+(?:a\s+)?day|bd|bid)\b", "TWICE_DAILY"),
    (r"(?i)\b(?:once\s+daily|once\s+(?:a\s+)?day|daily|od)\b", "DAILY"),
    (r"(?i)\b(?:once\s+weekly|weekly)\b", "WEEKLY"),
    (r"(?i)\b(?:as\s+needed|sos|prn)\b", "AS_NEEDED"),
)


def strength(c: Column) -> Column:
    """The first strength of a line without spaces and in lower case, null where there is none."""
    found = F.regexp_extract(c, STRENGTH, 0)
    return F.when(found != "", F.lower(F.regexp_replace(found, r"\s+", "")))


def frequency(c: Column, patterns: tuple[tuple[str, str], ...] = FREQUENCIES) -> Column:
    """The first frequency whose pattern a line has, null where it has none."""
    return F.coalesce(*[F.when(c.rlike(pattern), F.lit(name)) for pattern, name in patterns])


def duration_days(c: Column) -> Column:
    n, unit = F.regexp_extract(c, DURATION, 1), F.lower(F.regexp_extract(c, DURATION, 2))
    factor = F.when(unit.startswith("week"), 7).when(unit.startswith("month"), 30).otherwise(1)
    return F.when(n != "", n.try_cast("long") * factor)


def quantity(c: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, QUANTITY, i), F.lit("")).try_cast("long") for i in (1, 2)])


#: What is said about food, in the order in which it is looked for.
INSTRUCTIONS = (
    (r"(?i)\bbefore\s+(?:food|meal|breakfast|lunch|dinner)\b", "BEFORE_FOOD"),
    (r"(?i)\bafter\s+(?:food|meal|breakfast|lunch|dinner)\b", "AFTER_FOOD"),
    (r"(?i)\bwith\s+food\b", "WITH_FOOD"),
)


def instructions(c: Column) -> Column:
    """The first instruction that a line has, null where it has none."""
    return F.coalesce(*[F.when(c.rlike(pattern), F.lit(name)) for pattern, name in INSTRUCTIONS])


#: How a pack's batch and its dates are marked, in codes and in print.
_CODE_BATCH, _CODE_EXPIRY = r"\(10\)\s*([A-Za-z0-9_-]+)", r"\(17\)\s*(\d{6})"
_BATCH = r"(?i)(?:b(?:atch)?\.?\s*no\.?|lot\.?\s*no\.?|b\.no\.?)\s*[:.-]?\s*([A-Za-z0-9_-]+)"
_EXPIRY = r"(?i)(?:exp(?:iry)?\.?\s*(?:date)?)\s*[:.-]?\s*(\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2})"
_MADE = r"(?i)(?:mfg\.?\s*(?:date)?)\s*[:.-]?\s*(\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2})"


def packaging(c: Column) -> Column:
    """(batch, expiry, made) of what is printed on a pack: codes first, whose expiry becomes a date, then marked words."""
    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))

    code = found(_CODE_EXPIRY)
    day = F.concat(F.lit("20"), F.concat_ws("-", *[F.substring(code, i, 2) for i in (1, 3, 5)]))
    return F.struct(
        F.coalesce(found(_CODE_BATCH), found(_BATCH)).alias("batch"), F.coalesce(F.when(code.isNotNull(), day), found(_EXPIRY)).alias("expiry"), found(_MADE).alias("made")
    )


def gtin_valid(c: Column) -> Column:
    """8, 12, 13 or 14 digits whose weighted sum, by 3 and 1 from the right, is a multiple of ten."""
    digits = F.reverse(F.transform(F.split(F.regexp_replace(c, r"\D", ""), ""), lambda d: d.try_cast("int")))
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.coalesce(d, F.lit(0)) * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x
    )
    return c.rlike(r"^(\d{8}|\d{12,14})$") & (total % 10 == 0)


def price(c: Column) -> Column:
    """A price of up to four decimals without rupee signs, commas and spaces; null where anything else is left."""
    bare = F.regexp_replace(c, r"[₹,\s]", "")
    return F.when(bare.rlike(r"^\d+(\.\d{1,4})?$"), bare.try_cast("decimal(18,2)"))


def truth(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "1", "yes", "y"), True).when(low.isin("false", "0", "no", "n"), False)
