"""Text similarity as Column functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which of many like entries a description means.
STOPWORDS = (
    "construction of repair renovation maintenance installation supply fixing erection fitting work works at in to towards from "
    "for near nearby under mp mplads scheme nag no nos km mtr meter meters cc road c.c. paver block rasta marg "
    "light led solar pole high mast pipe pipeline drain drainage boundary wall community hall bhavan bhawan school "
    "vidyalaya shala room shed building area para vistar nagar ward village gram panchayat house ghar mandir temple and the "
    "a an with by as per estimate approved interlocking providing laying development arrangement"
).split()
# What a number in a description numbers, in order of weight.
CONTEXTS = [
    ("ward", r"(?i)\b(?:ward|w\.?\s*no\.?|ward\s*no\.?|ward\s*number)\s*[:#-]?\s*(\d+[a-z]?)\b"),
    ("pole", r"(?i)\b(?:pole|pole\s*no\.?|pole\s*number|khamba|khambha)\s*[:#-]?\s*(\d+[a-z]?)\b"),
    ("house", r"(?i)\b(?:house|h\.?\s*no\.?|house\s*no\.?|house\s*number|makan\s*no\.?|ghar\s*no\.?)\s*[:#-]?\s*(\d+[a-z]?)\b"),
    ("km", r"(?i)\b(?:km|kilometer|k\.?m\.?|chainage|ch\.?)\s*[:#-]?\s*(\d+(?:\.\d+)?)\b"),
    ("sector_block", r"(?i)\b(?:sector|sec\.?|block|phase|booth)\s*[:#-]?\s*(\d+[a-z]?)\b"),
    ("generic_no", r"(?i)\b(?:no\.?|number|kramank|sankhya)\s*[:#-]?\s*(\d+[a-z]?)\b"),
]


def normalize_description(text: Column) -> Column:
    """Lower case, anything but a-z and 0-9 to one space; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def trigrams(text: Column) -> Column:
    """The distinct character trigrams of the lower-cased text; of a shorter one the text itself; none of an empty one."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    chars = F.split(low, "")
    triples = F.transform(F.sequence(F.lit(0), F.char_length(low) - 3), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
    return F.when(low == "", F.array().cast("array<string>")).when(F.char_length(low) < 3, F.array(low)).otherwise(F.array_distinct(triples))


def dice(a: Column, b: Column) -> Column:
    """Twice the common members over all; 0 if a set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Common members over the union; 0 if a set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def core_tokens(normal: Column) -> Column:
    """Distinct tokens of a normalised description that are longer than one letter, no number and no stopword."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: (F.char_length(t) > 1) & ~t.rlike("^[0-9]+$") & ~t.isin(STOPWORDS)))


def numerals(normal: Column) -> Column:
    """Distinct tokens of a normalised description that are numbers."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: t.rlike("^[0-9]+$")))


def plain_number(text: Column) -> Column:
    """A numeral without the zeros in front; all zeros are '0' if it is digits only."""
    low = F.lower(F.trim(text))
    cut = F.regexp_replace(low, "^0+", "")
    return F.when(low.rlike("^[0-9]+$") & (cut == ""), "0").otherwise(cut)


def contextual_numerals(text: Column) -> Column:
    """A struct with an array of plain numbers for each context."""
    return F.struct(*[F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), plain_number)).alias(c) for c, p in CONTEXTS])


def numeric_conflict(ctx_a: Column, ctx_b: Column, nums_a: Column, nums_b: Column) -> Column:
    """Whether two descriptions number different things: in a context that both have, or by their numerals as a whole."""
    found = F.lit(False)
    for name, _ in CONTEXTS:
        a, b = ctx_a[name], ctx_b[name]
        found = found | ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b))
    a, b = (F.array_distinct(F.transform(x, plain_number)) for x in (nums_a, nums_b))
    only_a, only_b = F.array_except(a, b), F.array_except(b, a)
    short = lambda x: F.exists(x, lambda n: F.char_length(n) <= 3)
    apart = (F.size(only_a) > 0) & (F.size(only_b) > 0) & (~F.arrays_overlap(a, b) | (short(only_a) & short(only_b)))
    return found | apart


def name_divergence(core_a: Column, core_b: Column) -> Column:
    """Whether the core tokens share one at most and differ in two or more."""
    common = F.size(F.array_intersect(core_a, core_b))
    return (F.size(core_a) > 0) & (F.size(core_b) > 0) & (common <= 1) & (F.size(core_a) + F.size(core_b) - 2 * common >= 2)


def first_positive(*amounts: Column) -> Column:
    """The first amount above zero."""
    return F.coalesce(*[F.when(a > 0, a) for a in amounts])


def is_consecutive(a: Column, b: Column) -> Column:
    """Whether two structured keys differ by one in their serial only."""
    pa, pb = F.split(F.trim(a), "/"), F.split(F.trim(b), "/")
    gap = F.abs(F.get(pa, F.lit(3)).try_cast("long") - F.get(pb, F.lit(3)).try_cast("long"))
    return F.coalesce((F.size(pa) == 4) & (F.size(pb) == 4) & (F.slice(pa, 1, 3) == F.slice(pb, 1, 3)) & (gap == 1), F.lit(False))
