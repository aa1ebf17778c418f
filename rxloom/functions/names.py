"""Normalisers of names, ingredients, brands, forms, patent numbers and flags, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxloom.functions.text import squeeze

#: Pattern of the words that carry no identity of a firm in a comparison of periods; those without \\b leave the rest of a word.
CORPORATE_WORDS = r"incorporated|inc|limited|limitee|ltee|ltd\b|llc|llp|ulc|corporation|corp|co\b|sa\b|ag\b|gmbh|plc|sencrl|senc|sec\b|a division of|division|healthcare|health|consumer|canada"
#: What ends a brand: a strength or count, or a dosage form.
BRAND_TAIL = r"\s+\d[\d.\s]*(?:%|mg|mcg|ug|g\b|ml|iu|miu|units?|cap|capsule|tablet|tab|pak\b|pack).*$"
BRAND_FORM = r"\s+(?:tablets?|capsules?|caps?|injections?|solution|suspension|cream|ointment|gel|patch|spray|drops?|syrup|elixir|lotion)\s*$"
#: Salt and pharmacopoeia words that carry no identity of a molecule.
SALT_WORDS = ["hydrochloride", "hcl", "hydrobromide", "sulfate", "sulphate", "mesylate", "besylate", "maleate", "fumarate", "succinate", "tartrate", "acetate", "sodium", "potassium", "calcium", "magnesium", "dihydrate", "monohydrate", "usp", "bp", "ep"]
#: Units of a dose at the end of an ingredient.
DOSE_TAIL = r"\s+\d[\d.,]*\s*(?:mcg|mg|miu|iu|meq|ml|kg|ug|units?|g|l|%)(?:\s*/\s*[\d.,]*\s*(?:mcg|mg|ug|ml|g|l)?)?\s*$"
ACCENTED, PLAIN = "ÀÂÄÇÉÈÊËÎÏÔÖÙÛÜàâäçéèêëîïôöùûü", "AAACEEEEIIOOUUUaaaceeeeiioouuu"


def plain_letters(c: Column) -> Column:
    """Accents of French letters off."""
    return F.translate(c, ACCENTED, PLAIN)


def normalize_name(c: Column) -> Column:
    """Upper case, single blanks, without commas and semicolons around."""
    return F.upper(squeeze(F.regexp_replace(squeeze(c), r"^[ ,;]+|[ ,;]+$", "")))


def ingredient_key(c: Column) -> Column:
    """Sorted distinct names of the ingredients, split at ; and +, doses at their end off."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;+]"), lambda p: normalize_name(F.regexp_replace(F.trim(p), f"(?i){DOSE_TAIL}", "")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def molecule_tokens(c: Column) -> Column:
    """Sorted distinct words of three letters and more, salt words left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]{3,})"), 1)
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, SALT_WORDS))))


def label(key: Column, separator: str = " + ") -> Column:
    return F.coalesce(F.nullif(F.array_join(key, separator), F.lit("")), F.lit("UNKNOWN / UNPARSED"))


def company_identity(c: Column) -> Column:
    """Lower case without accents, punctuation and corporate words."""
    t = F.regexp_replace(F.lower(plain_letters(F.coalesce(c, F.lit("")))), "[.,/&]", " ")
    return squeeze(F.regexp_replace(t, rf"\b(?:{CORPORATE_WORDS})", " "))


def brand_identity(c: Column) -> Column:
    """Lower case up to the first strength, without a dosage form at the end."""
    t = F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), f"(?i){BRAND_TAIL}", "")
    return F.lower(F.trim(F.regexp_replace(t, f"(?i){BRAND_FORM}", "")))


def base_form(c: Column) -> Column:
    """Upper case text before the first bracket or comma."""
    return F.upper(F.trim(F.regexp_extract(c, r"^([^(,]*)", 1)))


def solution_strength(strength: Column, form: Column) -> Column:
    """A bare mass of a solution is a mass per millilitre."""
    bare = ~F.contains(strength, F.lit("/")) & F.trim(strength).rlike(r"(?i)^\d[\d.,]*\s*(?:mg|mcg|g|ug)$")
    return F.when(F.contains(F.lower(form), F.lit("solution")) & bare, F.concat(F.trim(strength), F.lit("/ML"))).otherwise(strength)


def patent_numbers(c: Column) -> Column:
    """Array of the numbers in a field: CA, commas and blanks off; 14 digits are two numbers run together."""
    n = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^ca\s*", ""), r"[,\s]+", "")
    return F.when(n.rlike(r"^\d{14}$"), F.array(F.substring(n, 1, 7), F.substring(n, 8, 7))).when(n != "", F.array(n)).otherwise(F.array().cast("array<string>"))


TERM_CHANGE = "1989-10-01"
UNSURE_TERM = "verify: filed before the change of term"


def computed_expiry(filing: Column) -> Column:
    """Twenty years after filing as text; a flag for filings before the change of the term; null without a date."""
    return F.when(filing >= F.lit(TERM_CHANGE).cast("date"), F.date_format(F.add_months(filing, 240), "yyyy-MM-dd")).when(filing.isNotNull(), F.lit(UNSURE_TERM))


def yes_flag(c: Column) -> Column:
    return F.when(F.upper(F.trim(F.coalesce(c, F.lit("")))).isin("YES", "Y", "1", "OUI"), "Yes").otherwise("No")


#: Entries that stand for a missing value, apart from blanks.
SENTINELS = ["not in dpd", "not in pm", "no pm available", "no noc record", "needs ocr / manual check", "n/a", "na", "n/a (uncoated)", "not applicable", "none", "nan"]


def real_value(c: Column) -> Column:
    """Neither null nor blank nor a sentinel."""
    t = F.lower(F.trim(c.cast("string")))
    return F.coalesce((t != "") & ~t.isin(SENTINELS), F.lit(False))


#: Pattern of the words of a manufacturer that a register leaves out, and of a strength within an ingredient.
REGISTER_WORDS = r"\b(?:inc|ltd|llc|ulc|corp|corporation|gmbh|limited|canada|pharmaceuticals|pharmaceutical|pharma|laboratories|laboratory|labs|biotechnology|biosciences|therapeutics|sciences|healthcare|health)\b\.?"
REGISTER_STRENGTH = r"\b\d+(?:\.\d+)?\s*(?:mg/ml|mg/l|mcg/ml|mcg|μg|ug|mmol|meq|mg|ml|iu|g|l)\b"


def register_ingredient(c: Column) -> Column:
    """Lower case, strengths and what is in brackets off."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), REGISTER_STRENGTH, "")
    return squeeze(F.regexp_replace(t, r"\(.*?\)", ""))


def register_manufacturer(c: Column) -> Column:
    """Lower case, legal and trade words and punctuation off."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), REGISTER_WORDS, "")
    return squeeze(F.regexp_replace(t, "[.,;']", ""))


#: Entries that are no product number, in an approval and in a mart.
NO_NUMBER, NOT_A_DIN = ("N/A", "NA", "NOT APPLICABLE"), ("", "not applicable", "n/a", "na", "none")


def approval_din(c: Column) -> Column:
    """Product number of an approval; null where words say that there is none."""
    t = F.trim(c)
    return F.when((t != "") & ~F.upper(t).isin(*NO_NUMBER), t)


def excluded_din(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*NOT_A_DIN)


def first_iso_date(c: Column) -> Column:
    """First year-month-day anywhere in a text; null if it is no date."""
    return F.try_to_date(F.regexp_extract(c, r"(\d{4}-\d{1,2}-\d{1,2})", 1), "y-M-d")


def number_or_zero(c: Column) -> Column:
    """A metric as a number; null, blank, NaN and anything else is 0."""
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(n)


def whole(c: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.rint(c).cast("long")


def trimmed_strength(c: Column) -> Column:
    """A strength without the zeros that end its leading number's decimals, and one blank before the unit."""
    t = F.trim(c)
    n, unit = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1), F.trim(F.regexp_replace(t, r"^\d+(?:\.\d+)?\s*", ""))
    plain = F.regexp_replace(F.regexp_replace(n, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(n == "", t).otherwise(F.trim(F.concat_ws(" ", plain, unit)))


def named_strength(name: Column, strength: Column, unit: Column) -> Column:
    """`NAME STRENGTH UNIT` where both are there, else the name."""
    s, u = F.trim(F.coalesce(strength, F.lit(""))), F.trim(F.coalesce(unit, F.lit("")))
    return F.when((s != "") & (u != ""), F.concat_ws(" ", name, s, u)).otherwise(name)
