"""Commodity of a designation, and the section each check cites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that name a commodity; the last one in a text decides.
WORDS = {
    "malt": "beer|ale|lager|stout|porter|pilsner|pilsener|ipa|malt beverage|malt liquor|bock|hefeweizen|weissbier|saison|k[oö]lsch|hard seltzer|barley\\s*wine",
    "wine": "wine|champagne|sparkling|cabernet|sauvignon|chardonnay|merlot|pinot|riesling|zinfandel|syrah|shiraz|malbec|ros[eé]|port|sherry|madeira|vermouth|sake|cider|mead|prosecco|cava|grenache|tempranillo|sangiovese|chianti|moscato|muscat|claret",
    "spirits": "whiskey|whisky|bourbon|scotch|rye|vodka|gin|rum|tequila|mezcal|brandy|cognac|armagnac|liqueur|cordial|schnapps|absinthe|grappa|pisco|spirits?|aquavit|soju|shochu|baijiu",
}
# Section by field for (wine, spirits, malt), and the subject.
SECTIONS = {
    "brand_name": ("4.33", "5.64", "7.64", "brand name"),
    "class_type": ("4.34 and subpart C", "5.63(a)(2) and subpart I", "7.63(a)(2) and 7.141", "class and type"),
    "alcohol_content": ("4.36", "5.65", "7.65", "alcohol content"),
    "alcohol_format": ("4.36", "5.65(b)", "7.65", "alcohol content statement"),
    "proof_consistency": ("4.36", "5.65", "7.65", "alcohol content"),
    "net_contents": ("4.37", "5.70", "7.70", "net contents"),
    "bottler_name": ("4.35", "5.66-5.68", "7.66-7.68", "name and address"),
    "bottler_address": ("4.35", "5.66-5.68", "7.66-7.68", "name and address"),
    "country_of_origin": ("4.35(e)", "5.69", "7.69", "country of origin"),
}
_ANY = "(?iu)" + "|".join(rf"\b(?:{w})\b" for w in WORDS.values())


def _commodity(text: Column) -> Column:
    # One text in an array: the last word is found once, whatever is asked of it.
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), F.lit(-1))
    return F.get(F.transform(F.array(last), _kind), F.lit(0))


def _kind(last: Column) -> Column:
    return F.when(last.rlike(f"(?iu)^(?:{WORDS['malt']})$"), "malt").when(last.rlike(f"(?iu)^(?:{WORDS['wine']})$"), "wine").when(last.isNotNull(), "spirits")


def commodity_of(*texts: Column) -> Column:
    """The commodity that the first of the texts with a commodity word names."""
    return F.coalesce(*(_commodity(t) for t in texts))


def _texts() -> dict[tuple[str, str], str]:
    out = {}
    for field, (wine, spirits, malt, subject) in SECTIONS.items():
        cbp = " and 19 CFR 134.11" if field == "country_of_origin" else ""
        for name, section in (("wine", wine), ("spirits", spirits), ("malt", malt)):
            out[field, name] = f"27 CFR {section}{cbp} ({subject})"
        out[field, ""] = f"27 CFR {spirits} (spirits), {wine} (wine) or {malt} (malt beverages){cbp}: {subject}"
    return out


def citation_of(field: str, commodity: Column) -> Column:
    """``citation`` of one field."""
    table = {c: text for (f, c), text in _texts().items() if f == field}
    none = F.lit(None).cast("string")
    return reduce(lambda rest, c: F.when(commodity == c, table[c]).otherwise(rest), [c for c in table if c], F.when(F.coalesce(commodity, F.lit("")) == "", table[""])) if table else none


def citation(field: Column, commodity: Column) -> Column:
    """The section for a field; null for fields outside the table."""
    table = F.create_map(*(F.lit(x) for (f, c), text in _texts().items() for x in (f"{f}/{c}", text)))
    return F.try_element_at(table, F.concat(field, F.lit("/"), F.coalesce(commodity, F.lit(""))))
