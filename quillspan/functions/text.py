"""Text normalisation as Column functions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as "no value", in lower case; zero-width characters; honorifics; signs of broken encoding.
MISSING = ["", "n/a", "na", "nil", "null", "none", "nan", "#n/a", "-", "--", "—", "not available"]
ZERO_WIDTH = "​‌‍⁠﻿"
HONORIFICS = ["shri", "shree", "sri", "smt", "shrimati", "dr", "prof", "kumari", "adv", "ms", "mr", "mrs"]
SUSPECT = "�|Ã.|â€"
#: Java's \s is ASCII only; this is Unicode white space.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def collapse(text: Column) -> Column:
    """Without zero-width characters, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, ZERO_WIDTH, ""), f"{SPACE}+", " "))


def normalize_text(text: Column) -> Column:
    """The cleaned text; null where it is empty or a placeholder."""
    clean = collapse(text)
    return F.when(~F.lower(clean).isin(MISSING), clean)


def missing_kind(text: Column) -> Column:
    """'empty', 'placeholder', or null for a real value."""
    clean = collapse(text)
    return F.when(text.isNull() | (clean == ""), "empty").when(F.lower(clean).isin(MISSING), "placeholder")


def fold_text(text: Column) -> Column:
    """A key for comparison: lower case, runs of anything but letters and digits one space; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\W_]+", " "))


def fold_person_name(text: Column) -> Column:
    """``fold_text`` without the honorifics in front."""
    return F.regexp_replace(fold_text(text), "^(?:(?:" + "|".join(HONORIFICS) + ")(?: |$))+", "")


def has_suspect_encoding(text: Column) -> Column:
    """Whether a text looks like UTF-8 that was read as something else."""
    return text.rlike(SUSPECT)


def values_equal(a: Column, b: Column, exact: bool = False) -> Column:
    """Equal after folding, or exactly; two missing values are equal, and '' is missing."""
    a, b = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
    return a.eqNullSafe(b) if exact else F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((a == b) | (fold_text(a) == fold_text(b)))


def clean_description(text: Column) -> Column:
    """White space collapsed; null if empty or a placeholder."""
    return normalize_text(text)


def token_count(text: Column) -> Column:
    """Tokens between spaces of a cleaned text; null for null."""
    return F.when(text.isNotNull(), F.size(F.split(text, " ")))


def financial_year(day: Column) -> Column:
    """The year from 1 April on, as 2024-2025."""
    start = F.year(F.add_months(day, -3))
    return F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string"))


def decimal_text(value: Column) -> Column:
    """Plain decimal text without zeros at the end."""
    text = value.cast("string")
    cut = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(cut.isin("-0", ""), "0").otherwise(cut)


def to_float(text: Column) -> Column:
    """A finite double, else null."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def to_int(text: Column) -> Column:
    """A whole number, halves to even; else null."""
    return F.rint(to_float(text)).cast("long")


def to_flag(text: Column) -> Column:
    """true/yes/y/t/1 and false/no/n/f/0 in any case; else null."""
    low = F.lower(F.trim(text.cast("string")))
    return F.when(low.isin("1", "true", "yes", "y", "t", "1.0"), True).when(low.isin("0", "false", "no", "n", "f", "0.0"), False)


def to_iso_date(text: Column) -> Column:
    """The date in the first ten characters, else null."""
    head = F.substring(F.trim(text.cast("string")), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))
