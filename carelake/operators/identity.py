"""Identity of medicines: base molecules, equal sets of ingredients, manufacturers, and which source tells ingredients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions import compositions as K
from carelake.functions import text as X

#: Molecules of which salts and misspellings are other names.
MOLECULES = {
    "choline fenofibrate": "fenofibrate", "fenofibric acid": "fenofibrate", "pantoprazole sodium": "pantoprazole", "rabeprazole sodium": "rabeprazole",
    "omeprazole magnesium": "omeprazole", "esomeprazole magnesium": "esomeprazole", "atorvastatin calcium": "atorvastatin", "rosuvastatin calcium": "rosuvastatin",
    "amlodipine besylate": "amlodipine", "amlodipine maleate": "amlodipine", "losartan potassium": "losartan", "montelukast sodium": "montelukast",
    "levocetirizine dihydrochloride": "levocetirizine", "cetirizine dihydrochloride": "cetirizine", "ciprofloxacin hydrochloride": "ciprofloxacin",
    "levofloxacin hemihydrate": "levofloxacin", "azithromycin dihydrate": "azithromycin", "clopidogrel bisulfate": "clopidogrel",
    "metoprolol succinate": "metoprolol", "metoprolol tartrate": "metoprolol", "sildenafil citrate": "sildenafil", "sildenabl citrate": "sildenafil",
    "sildenabl": "sildenafil", "sacubitril sodium": "sacubitril", "valsartan sodium": "valsartan", "tolperisone hydrochloride": "tolperisone",
    "tolperisone hcl": "tolperisone", "tolperisone": "tolperisone", "folic acid": "folic acid", "clavulanic acid": "clavulanic acid",
    "salicylic acid": "salicylic acid", "valproic acid": "valproic acid", "ascorbic acid": "ascorbic acid", "tranexamic acid": "tranexamic acid",
    "mefenamic acid": "mefenamic acid", "fusidic acid": "fusidic acid", "azelaic acid": "azelaic acid", "ursodeoxycholic acid": "ursodeoxycholic acid",
    "isosorbide mononitrate": "isosorbide mononitrate", "isosorbide dinitrate": "isosorbide dinitrate", "ferrous ascorbate": "ferrous ascorbate",
}
#: Other names of manufacturers, and words that their names are told without.
MANUFACTURERS = {"gsk": "glaxosmithkline", "glaxo-smith-kline": "glaxosmithkline", "glaxosmithkline": "glaxosmithkline"}
FIRM = r"\b(?:pharmaceuticals?|pharma|private|pvt|limited|ltd|inc|llp|company|co)\b\.?"
#: What stands before and behind a molecule's own name.
BEFORE = r"^(?:choline|levo|dextro|elemental)\s+"
BEHIND = (
    r"\s+(?:hydrochloride|dihydrochloride|monohydrochloride|hcl|besylate|maleate|succinate|tartrate|fumarate|citrate|phosphate|sulfate|sulphate|bisulfate"
    r"|mesylate|valerate|propionate|dipropionate|acetate|dihydrate|trihydrate|monohydrate|hemihydrate|gluconate|zinc|calcium|sodium|potassium|magnesium"
    r"|hydrate|acid)$"
)
#: How far base molecules may be apart.
LONG, EDITS, SHARE = 6, 2, 0.25


def _named(names: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def base_molecule(ingredient: Column) -> Column:
    """An ingredient's molecule without salts and prefixes, under its usual name."""
    def of(own: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.regexp_replace(own, BEFORE, ""), BEHIND, ""))
        return F.coalesce(_named(MOLECULES, own), _named(K.INGREDIENTS, own), K.once(bare, lambda x: F.coalesce(_named(MOLECULES, x), _named(K.INGREDIENTS, x), x)))

    return K.once(K.ingredient(F.lower(ingredient)), of)


def _told(ingredients: Column) -> Column:
    """(ingredient, base, strength) of each ingredient."""
    strength = lambda x: F.when(x["strength"].isNotNull() & x["unit"].isNotNull(), F.concat(x["strength"], x["unit"]))
    return F.transform(ingredients, lambda x: F.struct(x["ingredient"].alias("ingredient"), base_molecule(x["ingredient"]).alias("base"), strength(x).alias("strength")))


def _different(told: Column) -> Column:
    """Each different ingredient with the look of its base; of one that comes twice the last strength counts."""
    once = F.filter(told, lambda x, i: ~F.exists(F.slice(told, i + 2, F.size(told)), lambda y: y["ingredient"] == x["ingredient"]))
    return F.transform(once, lambda x: x.withField("look", X.lookalike_key(x["base"])))


def same_ingredients(a: Column, b: Column) -> Column:
    """Whether arrays of different ingredients are as long and each left one has its like on the right.

    Alike are equal ones, those of one base molecule, of one look, and long ones at most two edits and a quarter apart.
    The first of the right that is alike must not have another strength; one that has none fits any.
    """

    def alike(x: Column, y: Column) -> Column:
        longest, far = F.greatest(F.length(x["base"]), F.length(y["base"])), F.levenshtein(x["base"], y["base"])
        near = (longest >= LONG) & (far <= EDITS) & (far / longest <= SHARE)
        return (x["ingredient"] == y["ingredient"]) | (x["base"] == y["base"]) | (x["look"] == y["look"]) | near

    def fits(x: Column) -> Column:
        first = F.get(F.filter(b, lambda y: alike(x, y)), F.lit(0))
        return first.isNotNull() & F.coalesce(x["strength"] == first["strength"], F.lit(True))

    return (F.size(a) == F.size(b)) & F.forall(a, fits)


def compatible(rows: DataFrame, brand: Column, composition: Column, other_brand: Column, other_compositions: list[Column]) -> DataFrame:
    """rows with `compatible` and `reason`: by ingredients where both sides tell them, else by equal brands.

    Of the other side's compositions the first that isn't null counts, as it is the catalogue's own word. Compositions
    are read in steps, each once a row.
    """
    def name(c: Column) -> Column:
        return F.regexp_replace(X.slug(F.coalesce(c, F.lit(""))), "-", "")

    rows = rows.withColumns({"_c": composition, "_o": F.coalesce(*other_compositions), "_n": name(brand), "_m": name(other_brand)})
    for side in ("_c", "_o"):
        rows = rows.withColumn(side, F.when(F.coalesce(F.trim(side), F.lit("")) != "", K.ingredients(F.col(side))))
    for step in (_told, _different):
        rows = rows.withColumns({c: step(F.col(c)) for c in ("_c", "_o")})
    both = F.col("_c").isNotNull() & F.col("_o").isNotNull()
    ok = F.when(both, same_ingredients(F.col("_c"), F.col("_o"))).otherwise((F.col("_n") != "") & (F.col("_n") == F.col("_m")))
    rows = rows.withColumn("compatible", ok)
    reason = F.concat(F.when(both, "composition_").otherwise("brand_"), F.when(F.col("compatible"), "match").otherwise("mismatch"))
    return rows.withColumn("reason", reason).drop("_c", "_o", "_n", "_m")


def manufacturer(c: Column) -> Column:
    """A manufacturer's key without words of firms, under its usual name."""
    key = X.slug(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), FIRM, " "), r"\s+", " ")))
    return F.when(c != "", F.coalesce(_named(MANUFACTURERS, key), _named(MANUFACTURERS, F.regexp_replace(key, "-", "")), key))


def identity_key(brand: Column, salt_key: Column, maker: Column) -> Column:
    """The key under which equivalent rows are one: brand, salt and manufacturer, those that are there."""
    named = F.when(brand != "", F.regexp_replace(X.slug(brand), "-", ""))
    return F.concat_ws("|", *[F.nullif(c, F.lit("")) for c in (named, salt_key, manufacturer(maker))])


def first_told(profile: Column, salts: Column, texts: list[Column]) -> Column:
    """(ingredients, source): a salt profile's, else a catalogue row's salts, else the first text that tells some.

    Arrays of (ingredient, strength, unit); what is null or empty is passed over, and where nothing is told the array is empty.
    """
    kind = "array<struct<ingredient:string,strength:string,unit:string>>"

    def plain(c: Column) -> Column:
        return F.transform(c, lambda x: F.struct(x["ingredient"].alias("ingredient"), x["strength"].alias("strength"), x["unit"].alias("unit")))

    def given(c: Column, source: str) -> Column:
        return F.when(F.coalesce(F.size(c) > 0, F.lit(False)), F.struct(c.cast(kind).alias("ingredients"), F.lit(source).alias("source")))

    read = [plain(K.ingredients(F.when(F.coalesce(F.trim(c), F.lit("")) != "", c))) for c in texts]
    none = F.struct(F.array().cast(kind).alias("ingredients"), F.lit(None).cast("string").alias("source"))
    return F.coalesce(given(profile, "SALT_PROFILE"), given(salts, "MASTER_COMPOSITION"), *[given(r, "MASTER_COMPOSITION") for r in read], none)
