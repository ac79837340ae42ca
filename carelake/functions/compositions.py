"""Compositions of medicines as sorted arrays of ingredients with strengths, and the other fields of an import row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelake.functions.text import slug

#: Other names of ingredients.
INGREDIENTS = {
    "acetaminophen": "paracetamol",
    "pcm": "paracetamol",
    "metformin": "metformin hydrochloride",
    "metformin hcl": "metformin hydrochloride",
    "amoxycillin": "amoxicillin",
    "amoxycilline": "amoxicillin",
    "clavulanate potassium": "clavulanic acid",
    "potassium clavulanate": "clavulanic acid",
    "clavulanate": "clavulanic acid",
    "vit c": "ascorbic acid",
    "vitamin c": "ascorbic acid",
    "d-biotin": "biotin",
    "vitamin b7": "biotin",
    "vitamin h": "biotin",
    "ubiquinone": "coenzyme q10",
    "mecobalamin": "methylcobalamin",
    "vitamin b12": "cyanocobalamin",
    "vitamin d3": "cholecalciferol",
    "folate": "folic acid",
    "vitamin b9": "folic acid",
}
#: Other names of units.
UNITS = {
    "gm": "g",
    "gms": "g",
    "gram": "g",
    "grams": "g",
    "milligram": "mg",
    "milligrams": "mg",
    "microgram": "mcg",
    "micrograms": "mcg",
    "ug": "mcg",
    "units": "iu",
    "unit": "iu",
    "million spores": "million-spores",
    "million spore": "million-spores",
    "spore": "spores",
}
_NUMBER = r"(\d+(?:\.\d+)?)"
_BASE = "mg|milligrams?|g|gm|gms|grams?|mcg|micrograms?|ug|ml|iu|units?"
_UNIT = _BASE + "|million spores?|spores?|%"
#: A strength's patterns in the order in which they are tried, each with the groups of its number and its unit.
_PERCENT = _NUMBER + r"\s*%\s*(ww|wv)"
_SHARE = rf"{_NUMBER}\s*({_UNIT})\s*per\s*(\d+(?:\.\d+)?)?\s*({_BASE})\b"
_SIMPLE = rf"{_NUMBER}\s*({_UNIT})(?:\b|$)"
_BARE = _NUMBER + r"\s*$"
_STRENGTHS = (_PERCENT, _SHARE, _SIMPLE, _BARE)
_NOISE = (
    r"\b(?:tab|tabs|tablet|tablets|cap|caps|capsule|capsules|syrup|inj|injection|oral|solution|drops?|cream|ointment|gel"
    r"|film[- ]?coated|uncoated)\b|\b(?:ip|i\.?p\.?|usp|bp|ep|jp|j\.?p\.?|nf|ih)\b"
)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c worked out once however often use() names it; within functions of arrays nothing else shares it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _alias(names: dict[str, str], c: Column) -> Column:
    return once(c, lambda x: F.coalesce(F.create_map(*[F.lit(y) for kv in names.items() for y in kv])[x], x))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _number(c: Column) -> Column:
    """A number without needless zeros."""
    return F.regexp_replace(c.try_cast("decimal(24,6)").cast("string"), r"\.?0+$", "")


def _parts(c: Column) -> Column:
    """A composition's ingredients: by plus, ampersand, slash or `with`, else by commas if each part has a strength."""
    low = F.lower(F.regexp_replace(F.regexp_replace(c, "﻿", ""), "Â?µ", "u"))
    low = _squeezed(F.regexp_replace(low, "[()]", " "))
    low = F.regexp_replace(low, r"%\s*w\s*/\s*([wv])", "%w$1")
    low = F.regexp_replace(low, rf"(\d+(?:\.\d+)?\s*(?:{_UNIT}))\s*/\s*(\d+(?:\.\d+)?\s*)?({_BASE})\b", "$1 per $2$3")

    def split(text: Column, by: str) -> Column:
        return F.filter(F.transform(F.split(text, by), lambda x: F.trim(x)), lambda x: x != "")

    def by_commas(listed: Column, commas: Column) -> Column:
        told = F.forall(commas, lambda x: x.rlike(f"{_PERCENT}|{_SHARE}|{_SIMPLE}"))
        return F.when((F.size(commas) > 1) & told, commas).otherwise(listed)

    def of(text: Column) -> Column:
        return once(split(text, r"\s*[+&/]\s*|\s+with\s+"), lambda listed: F.when(F.size(listed) > 1, listed).otherwise(once(split(text, ","), lambda commas: by_commas(listed, commas))))

    return once(low, of)


def ingredient(c: Column) -> Column:
    """An ingredient's lower-case text without forms and pharmacopoeias, under its usual name."""
    text = F.regexp_replace(F.regexp_replace(c, _NOISE, " "), r"\bh\.?c\.?l\.?\b", " hydrochloride ")
    return _alias(INGREDIENTS, _squeezed(F.regexp_replace(text, "[^a-z0-9 ]+", " ")))


def _kind(part: Column) -> Column:
    """A part with the number of the first strength's pattern that it has, from 0; the number of patterns if none."""
    kind = F.lit(len(_STRENGTHS))
    for i in reversed(range(len(_STRENGTHS))):
        kind = F.when(part.rlike(_STRENGTHS[i]), i).otherwise(kind)
    return F.struct(part.alias("part"), kind.alias("kind"))


def _pieces(x: Column) -> Column:
    """What stands before a part's strength and around it, and the strength's number, unit and share."""
    part, kind = x["part"], x["kind"]

    def each(at: Callable[[str], Column]) -> Column:
        return F.coalesce(*[F.when(kind == i, at(p)) for i, p in enumerate(_STRENGTHS)])

    def of(pattern: str, group: int) -> Column:
        return F.regexp_extract(part, pattern, group)

    before = F.coalesce(each(lambda p: F.trim(of(rf"^(.*?)(?:{p})", 1))), part)
    rest = F.when(before != "", before).otherwise(F.coalesce(each(lambda p: F.trim(F.regexp_replace(part, p, ""))), part))
    unit = F.when(kind == 0, of(_PERCENT, 2)).when(kind == 1, of(_SHARE, 2)).when(kind == 2, of(_SIMPLE, 2)).otherwise(F.lit("mg"))
    of_share = [F.when(kind == 1, of(_SHARE, i)) for i in (3, 4)]
    return F.struct(
        kind.alias("kind"), rest.alias("text"), each(lambda p: of(p, 1)).alias("value"), F.when(kind == 0, unit).otherwise(_alias(UNITS, unit)).alias("unit"),
        of_share[0].alias("per"), of_share[1].alias("of"),
    )


def _told(x: Column) -> Column:
    """Ingredient, strength and unit of pieces; grams are told in milligrams."""
    kind, unit = x["kind"], x["unit"]
    grams = (kind != 0) & (unit == "g")
    value = x["value"].try_cast("decimal(18,6)")
    value = _number(F.when(grams, value * 1000).otherwise(value).cast("string"))
    unit = F.when(grams, F.lit("mg")).otherwise(unit)
    share = F.concat(unit, F.lit("-per-"), F.coalesce(_number(F.nullif(x["per"], F.lit(""))), F.lit("")), _alias(UNITS, x["of"]))
    unit = F.when(kind == 0, F.concat(F.lit("%"), x["unit"])).when(kind == 1, share).when(kind < len(_STRENGTHS), unit)
    return F.struct(ingredient(x["text"]).alias("ingredient"), value.alias("strength"), unit.alias("unit"))


def _keyed(x: Column) -> Column:
    key = F.concat_ws("-", slug(x["ingredient"]), F.concat(x["strength"], x["unit"]))
    return F.struct(key.alias("key"), x["ingredient"].alias("ingredient"), x["strength"].alias("strength"), x["unit"].alias("unit"))


def ingredients(c: Column) -> Column:
    """A composition as array<struct<key, ingredient, strength, unit>>, sorted by key; empty where none can be read.

    A part's strength and unit are null where it has none.
    """
    read = _parts(c)
    for step in (_kind, _pieces, _told):  # one after the other, so each is worked out once a part
        read = F.transform(read, step)
    return F.array_sort(F.transform(F.filter(read, lambda x: x["ingredient"] != ""), _keyed))


def salt_key(c: Column) -> Column:
    """The keys of a composition's ingredients joined by plus, so neither order nor spelling changes it."""
    return F.nullif(F.array_join(F.transform(ingredients(c), lambda x: x["key"]), "+"), F.lit(""))


#: Forms that end a brand name, and the patterns that tell a form, in the order in which they are tried.
FORMS = "tablet|tablets|capsule|capsules|syrup|suspension|injection|drops|drop|cream|ointment|gel|lotion|powder|spray|inhaler|solution"
FORM_PATTERNS = (
    (r"\btablets?\b|\btabs?\b", "tablet"),
    (r"\bcapsules?\b|\bcaps?\b", "capsule"),
    (r"\bsyrup\b", "syrup"),
    (r"\bsuspension\b", "suspension"),
    (r"\binjections?\b|\binj\b", "injection"),
    (r"\bdrops?\b", "drops"),
    (r"\bcreams?\b", "cream"),
    (r"\bointments?\b", "ointment"),
    (r"\bgels?\b", "gel"),
    (r"\blotions?\b", "lotion"),
    (r"\bpowders?\b", "powder"),
    (r"\bsprays?\b", "spray"),
    (r"\binhalers?\b", "inhaler"),
    (r"\bsolutions?\b", "solution"),
)


def clean_brand(c: Column) -> Column:
    """A brand without the form at its end; a name that is a form alone stays."""
    bare = _squeezed(F.regexp_replace(c, rf"(?i)\b(?:{FORMS})\b\.?$", ""))
    return F.when(bare == "", F.trim(c)).otherwise(bare)


def form_of(kind: Column, name: Column, pack: Column) -> Column:
    """A row's own kind unless that is a school of medicine, else the form that its name or pack tells, else null."""
    own = F.lower(F.trim(kind))
    source = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(pack, F.lit(""))))
    told = F.coalesce(*[F.when(source.rlike(p), F.lit(x)) for p, x in FORM_PATTERNS])
    return F.when(own.isNotNull() & (own != "") & ~own.isin("allopathy", "homeopathy", "ayurvedic"), own).otherwise(told)


def web_address(c: Column) -> Column:
    """A URL of http or https; null for anything else."""
    return F.when(c.rlike(r"(?i)^https?://[^\s/?#]+[^\s]*$"), c)
