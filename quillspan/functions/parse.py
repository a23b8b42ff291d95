"""Three-state parsers for amounts, dates and structured keys.

A parsed cell is a struct: value, status ('ok', 'missing' or 'invalid') and notes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import MISSING, SPACE, ZERO_WIDTH, collapse

AMOUNT = "decimal(27,12)"
# Shapes of numbers and dates.
CURRENCY = r"(?i)(?:₹|rs\.?|inr\.?)"
PLAIN = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
WESTERN = r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$"
INDIAN = r"^[+-]?[0-9]{1,2}(?:,[0-9]{2})*,[0-9]{3}(?:\.[0-9]+)?$"
DMY_TEXT = r"^([0-9]{1,2})[\s\-/.,]+([A-Za-z]{3,9})\.?[\s\-/.,]+([0-9]{4})$"
MDY_TEXT = r"^([A-Za-z]{3,9})\.?\s+([0-9]{1,2}),?\s+([0-9]{4})$"
ISO = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
DMY_NUMBER = r"^([0-9]{1,2})([/\-.])([0-9]{1,2})\2([0-9]{4})$"
STANDARD_DATE = r"^[0-9]{2}-[A-Za-z]{3}-[0-9]{4}$"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
LAST_SERIAL = 2_958_465


def _notes(*notes: Column) -> Column:
    return F.array_compact(F.array(*notes))


def _parsed(value: Column, status: Column, notes: Column) -> Column:
    return F.struct(value.alias("value"), status.alias("status"), notes.alias("notes"))


def _note(text: str) -> Column:
    return F.array(F.lit(text))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a variable that is computed once, however often it is used; a plain Column would be computed for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_amount(text: Column) -> Column:
    """Whether ``parse_amount`` finds an amount. Cells without a digit, or with a sign that no amount has, aren't parsed."""
    may = text.rlike("[0-9]") & ~text.rlike("[A-DF-HJ-MO-QT-Za-df-hj-mo-qt-z/:;#]")
    return F.when(may, parse_amount(text)["status"] == "ok").otherwise(False)


def parse_amount(text: Column) -> Column:
    """An amount in plain, Western or Indian grouping, with a currency sign or in accountants' brackets.

    Below 1e15 in magnitude, with 12 decimal places at most. Notes say what was normalised, or why a cell is invalid.
    """
    bare = F.trim(F.translate(text, ZERO_WIDTH, ""))
    bare = F.regexp_replace(bare, f"^{SPACE}+|{SPACE}+$", "")
    return _let(bare, lambda x: _let(F.trim(F.regexp_replace(x, CURRENCY, "")), lambda y: _amount(x, y)))


def _amount(bare: Column, signless: Column) -> Column:
    bracket = signless.rlike(r"^\(.*\)$")
    inner = F.when(bracket, F.trim(F.regexp_replace(signless, r"^\((.*)\)$", "$1"))).otherwise(signless)
    shapes = lambda x: F.struct(x.alias("inner"), x.rlike(PLAIN).alias("plain"), (x.rlike(WESTERN) | x.rlike(INDIAN)).alias("grouped"))
    digits = lambda k: F.when(k["plain"], k["inner"]).when(k["grouped"], F.replace(k["inner"], F.lit(","), F.lit("")))
    return _let(inner, lambda x: _let(shapes(x), lambda k: _let(digits(k), lambda d: _let(_size(d), lambda m: _judged(bare, signless, bracket, k, d, m)))))


def _size(digits: Column) -> Column:
    mantissa, power = F.regexp_extract(digits, r"^([^eE]*)", 1), F.coalesce(F.nullif(F.regexp_extract(digits, r"[eE]([+-]?[0-9]+)$", 1), F.lit("")).try_cast("int"), F.lit(0))
    places = F.greatest(F.lit(0), F.char_length(F.regexp_extract(mantissa, r"\.([0-9]*)$", 1)) - power)
    return F.struct(places.alias("places"), F.abs(digits.try_cast("double")).alias("size"))


def _judged(bare: Column, signless: Column, bracket: Column, shape: Column, digits: Column, measure: Column) -> Column:
    plain, grouped, places, size = shape["plain"], shape["grouped"], measure["places"], measure["size"]
    value = digits.try_cast(AMOUNT)
    value = F.when(bracket, -value).otherwise(value)
    missing, placeholder = F.coalesce(bare, F.lit("")) == "", F.lower(bare).isin(MISSING)
    status = F.when(missing | placeholder, "missing").when(digits.isNull() | (size >= 1e15) | size.isNull() | (places > 12), "invalid").otherwise("ok")
    good = _notes(
        F.when(signless != bare, F.lit("currency_symbol")),
        F.when(bracket, F.lit("accounting_negative")),
        F.when(~plain & grouped, F.lit("thousands_separator")),
        F.when(places > 2, F.lit("more_than_2_decimals")),
    )
    none = F.array().cast("array<string>")
    notes = F.when(missing, none).when(placeholder, _note("placeholder")).when(digits.isNull(), _note("unparseable"))
    notes = notes.when((size >= 1e15) | size.isNull(), _note("magnitude_out_of_range")).when(places > 12, _note("excessive_precision")).otherwise(good)
    return _parsed(F.when(status == "ok", value), status, notes)


def _month(name: Column) -> Column:
    low = F.lower(name)
    found = F.when(low == "sept", 9)
    for i, m in enumerate(MONTHS, 1):
        found = found.when(low.isin(m, m[:3]), i)
    return found


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year != "0000", F.try_to_date(text, "yyyy-MM-dd"))


def parse_date(text: Column) -> Column:
    """DD-Mon-YYYY, other texts with a month's name, ISO with or without a time, or day-first numbers."""
    return _let(collapse(text), lambda x: _let(F.struct(*[x.rlike(p).alias(n) for n, p in (("dmy", DMY_TEXT), ("iso", ISO), ("number", DMY_NUMBER), ("mdy", MDY_TEXT))]), lambda k: _dated(x, k)))


def _dated(clean: Column, shape: Column) -> Column:
    low = F.lower(clean)
    part = lambda pattern, i: F.regexp_extract(clean, pattern, i)
    missing, placeholder = F.coalesce(clean, F.lit("")) == "", low.isin(MISSING)
    dmy, iso, number, mdy = (shape[n] for n in ("dmy", "iso", "number", "mdy"))
    month = F.when(dmy, part(DMY_TEXT, 2)).otherwise(part(MDY_TEXT, 1))

    def value(month):
        value = F.when(dmy, _day(part(DMY_TEXT, 3), month, part(DMY_TEXT, 1))).when(iso, _day(part(ISO, 1), part(ISO, 2), part(ISO, 3)))
        return value.when(number, _day(part(DMY_NUMBER, 4), part(DMY_NUMBER, 3), part(DMY_NUMBER, 1))).when(mdy, _day(part(MDY_TEXT, 3), month, part(MDY_TEXT, 2)))

    def judged(month, value):
        status = F.when(missing | placeholder, "missing").when(value.isNotNull(), "ok").otherwise("invalid")
        none = F.array().cast("array<string>")
        notes = F.when(missing, none).when(placeholder, _note("placeholder"))
        notes = notes.when((dmy | ~iso & ~number & mdy) & month.isNull(), _note("unknown_month_name"))
        notes = notes.when(~(dmy | iso | number | mdy), _note("unrecognised_format")).when(value.isNull(), _note("impossible_calendar_date"))
        notes = notes.when(clean.rlike(STANDARD_DATE), none).when(~dmy & ~iso & number, F.array(F.lit("alt_format"), F.lit("numeric_day_first_assumed"))).otherwise(_note("alt_format"))
        return _parsed(F.when(~(missing | placeholder), value), status, notes)

    return _let(_let(month, _month), lambda m: _let(value(m), lambda v: judged(m, v)))


def serial_date(number: Column) -> Column:
    """A spreadsheet's day number as a parsed date."""
    good = number.between(1, LAST_SERIAL)
    value = F.when(good, F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int")))
    status = F.when(number.isNull(), "missing").when(good, "ok").otherwise("invalid")
    return _parsed(value, status, F.when(number.isNull(), F.array().cast("array<string>")).when(good, _note("excel_serial")).otherwise(_note("number_not_a_date")))


def lenient_date(text: Column) -> Column:
    """A date in one of four fixed formats, else null; for rule evaluation."""
    clean = F.trim(text)
    shapes = [(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d")]
    return F.coalesce(*[F.when(clean.rlike(p), F.try_to_date(F.initcap(clean), f)) for p, f in shapes])


CANONICAL_KEY = r"^[A-Z]{1,4}/[A-Z]{1,4}[0-9]{1,7}/[0-9]{4}-[0-9]{4}/[0-9]{1,12}$"


def is_canonical_key(text: Column) -> Column:
    return F.coalesce(text.rlike(CANONICAL_KEY), F.lit(False))


def parse_key(text: Column, bare: bool = False) -> Column:
    """PREFIX/CODE/YYYY-YYYY/SERIAL at the start of a text, as a struct.

    Fields: key, remainder, prefix, code, year, serial, warnings, error. error is the first of: empty, placeholder,
    wrong_segment_count, bad_prefix, bad_mp_code, bad_financial_year, bad_serial, serial_not_terminated. ``bare``: text
    after the key is a warning. Full-width forms and dashes of the Basic Multilingual Plane are unified.
    """
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    dashes = "‐‑‒–—―−﹘﹣－"
    unified = F.translate(F.translate(F.translate(text, dashes, "-" * len(dashes)), "⁄∕", "//"), wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))
    named = lambda *columns: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return _let(collapse(unified), lambda x: _let(F.split(x, "/", 4), lambda p: _let(named(*_segments(p)), lambda k: _keyed(x, p, [k[f"c{i}"] for i in range(5)], bare))))


def _segments(parts: Column) -> list[Column]:
    flat = [F.replace(F.trim(F.get(parts, i)), F.lit(" "), F.lit("")) for i in range(3)]
    tail = F.trim(F.get(parts, 3))
    serial = F.regexp_extract(tail, r"^([0-9]+)", 1)
    return [*flat, serial, F.substring(tail, F.char_length(serial) + 1, F.char_length(tail))]


def _keyed(clean: Column, parts: Column, found: list[Column], bare: bool) -> Column:
    flat, (serial, rest) = found[:3], found[3:]
    raw = [F.get(parts, i) for i in range(3)]
    prefix, code, year = F.upper(flat[0]), F.upper(flat[1]), flat[2]
    remainder = F.trim(F.regexp_replace(rest, "^[ :-]+", ""))
    error = (
        F.when(F.coalesce(clean, F.lit("")) == "", "empty")
        .when(F.lower(clean).isin(MISSING), "placeholder")
        .when(F.size(parts) < 4, "wrong_segment_count")
        .when(~prefix.rlike("^[A-Z]{1,4}$"), "bad_prefix")
        .when(~code.rlike("^[A-Z]{1,4}[0-9]{1,7}$"), "bad_mp_code")
        .when(~year.rlike("^[0-9]{4}-[0-9]{4}$"), "bad_financial_year")
        .when((serial == "") | (F.char_length(serial) > 12), "bad_serial")
        .when(rest.rlike("^[^ :-]"), "serial_not_terminated")
    )
    spaced = F.lit(False)
    for p in raw:
        spaced = spaced | p.contains(" ")
    first, second = F.substring(year, 1, 4).try_cast("int"), F.substring(year, 6, 4).try_cast("int")
    warnings = _notes(
        F.when(spaced, F.lit("whitespace_normalized")),
        F.when((prefix != flat[0]) | (code != flat[1]), F.lit("case_normalized")),
        F.when(second != first + 1, F.lit("financial_year_not_consecutive")),
        F.when((remainder != "") & F.lit(bare), F.lit("trailing_text_after_id")),
    )

    def kept(error):
        ok = error.isNull()
        keep = lambda c: F.when(ok, c)
        return F.struct(
            keep(F.concat_ws("/", prefix, code, year, serial)).alias("key"),
            F.when(ok, remainder).otherwise("").alias("remainder"),
            keep(prefix).alias("prefix"),
            keep(code).alias("code"),
            keep(year).alias("year"),
            keep(serial).alias("serial"),
            F.when(ok, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"),
            error.alias("error"),
        )

    return _let(error, kept)


def is_unkeyed(text: Column) -> Column:
    """Whether a key cell says NA, alone or before a description."""
    return F.coalesce(collapse(text).rlike(r"(?i)^NA\b"), F.lit(False))
