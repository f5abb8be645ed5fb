"""Token cleaning and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column-name words that mark a header row.
HEADER_WORDS = [
    "flight", "flightno", "flightnumber", "flt", "fltno", "fltnr",
    "std", "sta", "atd", "ata",
    "scheduleddepart", "scheduledarrival", "actualdepart", "actualarrival",
    "scheduleddeparture", "actualdeparture",
    "origin", "from", "source", "destination", "to",
    "airline", "carrier", "operator",
    "tail", "registration", "reg",
    "date", "day", "localdate", "utcdate",
    "runway", "gate", "stand", "bay",
]

# Header spellings of each canonical column, in normalised form.
SYNONYMS = {
    "origin": ["origin", "from", "source", "src", "org", "departureairport", "depairport"],
    "destination": ["destination", "to", "dest", "destinationairport", "arrairport"],
    "sched_dep": ["scheduleddeparture", "std", "scheduleddep", "scheddep", "scheduleddepart", "scheduledtimedeparture", "schdep", "schdeparture"],
    "act_dep": ["actualdeparture", "atd", "actualdep", "actdep", "actualtimedeparture"],
    "sched_arr": ["scheduledarrival", "sta", "scheduledarr", "schedarr", "scheduledtimearrival", "scharr", "scharrival"],
    "act_arr": ["actualarrival", "ata", "actualarr", "actarr", "actualtimearrival"],
    "carrier": ["airline", "carrier", "operator"],
    "flight_number": ["flightno", "flightnumber", "fltno", "fltnumber", "flight", "fl.no", "fltnr", "flt"],
    "tail_number": ["tailnumber", "tail", "registration", "reg"],
    "runway": ["runway", "rwy"],
    "gate": ["gate", "stand", "bay"],
    "airport": ["airport", "apt", "ap", "station", "city"],
    "date": ["date", "flightdate", "utcdate", "localdate", "day"],
}

# Texts that stand for a missing cell, and for a missing label part.
MISSING_MARKS = ["", "<NA>", "NaT", "nan"]
NULL_WORDS = ["none", "null", "nil", "na", "n/a", "n.a", "na.", "n.a.", "n-a", "—", "-"]


#: White space at the ends of a cell: ASCII, no-break and the Unicode spaces and line ends.
SPACE = "".join(chr(i) for i in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.trim(c, F.lit(SPACE))


def is_filled(c: Column) -> Column:
    """Whether a text holds more than white space; looks no further than the first such letter."""
    return c.rlike(f"[^{SPACE}]")


def normalise_token(c: Column) -> Column:
    """Stripped, lower case, without spaces and underscores."""
    return F.translate(F.lower(strip(c)), " _", "")


def normalise_word(word: str) -> str:
    """Driver-side twin of :func:`normalise_token` for header lists."""
    return word.strip(SPACE).lower().translate({ord(" "): None, ord("_"): None})


def clean_token(c: Column) -> Column:
    """Stripped text, NULL for the markers of a missing cell."""
    t = strip(c)
    return F.when(~t.isin(MISSING_MARKS), t)


def blank_null_words(c: Column) -> Column:
    """Stripped text; NULL and whole-value null words become ''."""
    t = strip(c)
    missing = t.isNull() | t.isin("<NA>", "nan", "NaN") | F.lower(t).isin(NULL_WORDS)
    return F.when(missing, "").otherwise(t)


# Fixed value: a whole number that a spreadsheet wrote with a decimal.
WHOLE_NUMBER = r"^(\d+)\.0$"


def strip_number(c: Column) -> Column:
    """'123.0' to '123', no spaces, upper case."""
    return F.upper(F.replace(F.regexp_replace(c, WHOLE_NUMBER, "$1"), F.lit(" "), F.lit("")))


def clean_flight_number(c: Column) -> Column:
    """Flight number for labels; '' unless it holds a digit."""
    t = strip_number(blank_null_words(c))
    return F.when(t.rlike(r"[0-9]"), t).otherwise("")


def join_carrier(carrier: Column, number: Column) -> Column:
    """Carrier + number without repeating a carrier prefix; inputs use '' for missing."""
    has_prefix = F.startswith(number, carrier) & F.substring(number, F.length(carrier) + 1, F.lit(1)).rlike("[0-9]")
    bare = (carrier == "") | (number == "") | has_prefix
    return F.trim(F.when(bare, number).otherwise(F.concat(carrier, number)))


def flight_id(carrier: Column, number: Column, row_id: Column) -> Column:
    """Upper-case carrier + number, or the row id when there is no number."""
    c = F.upper(F.coalesce(clean_token(carrier), F.lit("")))
    n = strip_number(F.coalesce(clean_token(number), F.lit("")))
    return F.coalesce(F.nullif(join_carrier(c, n), F.lit("")), row_id.cast("string"))
