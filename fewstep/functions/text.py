"""Text records to sections, lines, ids and features, as column expressions.

The lexicons are this package's own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lexicons: words before or after an ingredient's name, names of two words, and techniques.
MEASURES = "cups?|tablespoons?|tbsp|teaspoons?|tsp|ounces?|oz|pounds?|lbs?|grams?|g|kg|ml|cans?|cloves?|pinch|slices?|sticks?"
PREPARED = "chopped|diced|minced|sliced|grated|fresh|large|small|medium|ground|melted|softened|crushed|dried|cooked|peeled"
TWO_WORDS = ("brown sugar", "olive oil", "sour cream", "cream cheese", "baking powder", "baking soda", "soy sauce", "lemon juice")
TECHNIQUES = {"stir fry": "stir-fry", "bring to a boil": "boil", "bake": "bake", "boil": "boil", "chop": "chop", "fry": "fry", "grill": "grill", "mix": "mix", "roast": "roast", "simmer": "simmer", "stir": "stir", "whisk": "whisk"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"^\s+", ""), r"\s+$", "")


def parts(text) -> Column:
    """The non-empty blocks between blank lines."""
    return F.filter(F.transform(F.split(strip(text), "\n\n"), strip), lambda x: x != "")


def lines(block) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(block), F.lit("")), "\n"), strip), lambda x: x != "")


def split_sections(text) -> Column:
    """Positional: title, ingredients, instructions are blocks 1 to 3, whatever heads them; the rest is ignored."""
    p = parts(text)
    return F.struct(
        F.coalesce(F.get(p, F.lit(0)), F.lit("")).alias("title"),
        lines(F.regexp_replace(F.get(p, F.lit(1)), r"(?i)^ingredients:\s*", "")).alias("ingredients"),
        lines(F.regexp_replace(F.get(p, F.lit(2)), r"(?i)^(directions|instructions):\s*", "")).alias("instructions"),
    )


def split_sections_prefixed(text) -> Column:
    """A section counts only if its heading is there; else that section is the whole text."""
    p = F.split(_c(text), "\n\n")

    def section(k: int, heading: str) -> Column:
        block = F.get(p, F.lit(k))
        return F.when(block.rlike(f"(?i)^{heading}:"), F.regexp_replace(block, rf"(?i)^{heading}:\s*", "")).otherwise(_c(text))

    return F.struct(F.get(p, F.lit(0)).alias("title"), section(1, "ingredients").alias("ingredients"), section(2, "(instructions|directions)").alias("instructions"))


def missing_sections(text) -> Column:
    """Names of the sections that a strict reader misses."""
    s = split_sections(text)
    return F.array_compact(F.array(*[F.when(F.size(s[c]) == 0, F.lit(c)) for c in ("ingredients", "instructions")]))


def clean_line(x) -> Column:
    """Without bullets, numbering and step labels."""
    return strip(F.regexp_replace(strip(x), r"(?i)^([-•*]\s*|[0-9]+[.)]\s+|step\s+[0-9]+\s*[:.]\s*)+", ""))


def normalised_for_id(text) -> Column:
    t = F.regexp_replace(_c(text), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "[ \t]+(?=\n|$)", ""), "\n{3,}", "\n\n")


def recipe_id(text, *ids) -> Column:
    """The first non-empty id, else the SHA-1 of the normalised text."""
    return F.coalesce(*[F.nullif(_c(i).cast("string"), F.lit("")) for i in ids], F.sha1(normalised_for_id(text).cast("binary")))


def normalise_ingredient(line) -> Column:
    """Lower case, without parentheses, quantities, measures and words of preparation."""
    x = F.regexp_replace(F.lower(_c(line)), r"\([^)]*\)", " ")
    x = F.regexp_replace(x, r"[0-9]+([./][0-9]+)?", " ")
    x = F.regexp_replace(x, rf"\b({MEASURES}|{PREPARED}|of)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z -]", " "), " +", " "))


def head(line) -> Column:
    """The known two-word name in a normalised line, else its last word without a plural s."""
    x = normalise_ingredient(line)
    known = F.regexp_extract(x, r"\b(" + "|".join(TWO_WORDS) + r")\b", 1)
    last = F.element_at(F.split(x, " "), -1)
    single = F.when(last.rlike("(ss|us)$"), last).otherwise(F.regexp_replace(last, "s$", ""))
    return F.nullif(F.when(known != "", known).otherwise(single), F.lit(""))


def techniques(text) -> Column:
    """The distinct techniques that a text names, sorted."""
    low = F.lower(_c(text))
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(rf"\b{p}"), F.lit(t)) for p, t in TECHNIQUES.items()]))))


def fmt_list(items, most: int = 3) -> Column:
    """'', 'a', 'a and b' or 'a, b, and c' of the first non-empty items."""
    x = F.slice(F.filter(_c(items), lambda i: i.isNotNull() & (i != "")), 1, most)
    n = F.size(x)
    return (
        F.when(n <= 0, F.lit("")).when(n == 1, F.get(x, F.lit(0))).when(n == 2, F.array_join(x, " and "))
        .otherwise(F.concat(F.array_join(F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(x, -1)))
    )


def numeric_id(x) -> Column:
    """The id as a number if it is digits only, else null."""
    return F.when(_c(x).rlike("^[0-9]+$"), _c(x).try_cast("long"))
