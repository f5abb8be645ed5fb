"""Time expressions on naive timestamps (session time zone must be UTC)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a naive timestamp."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_div(value: Column, width: int) -> Column:
    """Exact integer division towards minus infinity."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def require_window(minutes: int) -> int:
    """Windows must tile a day, so that epoch and midnight binning agree."""
    if minutes <= 0 or 1440 % minutes:
        raise ValueError(f"window of {minutes} min does not divide a day")
    return minutes


def slot_start(ts: Column | str, minutes: int) -> Column:
    """Start of the tumbling window that holds ``ts`` (NULL stays NULL)."""
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(require_window(minutes) * MINUTE)))


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MINUTE))


def add_minutes(ts: Column | str, minutes: Column) -> Column:
    return from_micros(micros(ts) + minutes.cast("bigint") * F.lit(MINUTE))


def clock_on(ts: Column | str, day: Column) -> Column:
    """The clock of ``ts``, to the second, on another calendar day."""
    of_day = F.pmod(micros(ts), F.lit(DAY))
    return from_micros(micros(day.cast("timestamp_ntz")) + of_day - F.pmod(of_day, F.lit(1_000_000)))


# ---- text to time -----------------------------------------------------------------

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:[.]\d+)?)?"  # hours and minutes, then seconds and their fraction
_HALF = r"([AaPp][Mm])\s*$"
_YEAR_FIRST = r"^\s*(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)"
_DAY_FIRST = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)"
_SHORT_YEAR = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.]([0-6]\d)(?!\d)"
_SHORT_YEAR_1900 = r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.]([7-9]\d)(?!\d)"
_NAMED_MONTH = rf"(?i)^\s*(\d{{1,2}})[-/ ]({_MONTHS.replace(' ', '|')})[a-z]*[-/ ,]+(\d{{4}})(.*)$"


# What may be read as a time once it is in year-month-day order: a day, alone or with a clock
# and an offset. A bare number (HHMM without a colon, a year, a spreadsheet's day number) is none.
# Years are those that nanoseconds since 1970 can express: 1678 to 2261.
_YEAR = r"(?:16(?:7[89]|[89]\d)|1[7-9]\d\d|2[01]\d\d|22(?:[0-5]\d|6[01]))"
_READABLE = rf"^{_YEAR}-\d{{1,2}}-\d{{1,2}}(?:[ T]{_CLOCK}(?:Z|[+-]\d{{2}}:\d{{2}})?)?$"


def is_clock_only(text: Column) -> Column:
    """Only a clock, perhaps with AM or PM."""
    return text.rlike(rf"^\s*{_CLOCK}(?:\s*[AaPp][Mm])?\s*$")


def read_time(text: Column) -> Column:
    """Timestamp of a text in one of the readable shapes; NULL for everything else."""
    return F.regexp_extract(iso_text(text), _READABLE, 0).try_cast("timestamp_ntz")


def half_of_day(text: Column) -> Column:
    """'am', 'pm' or ''."""
    return F.lower(F.regexp_extract(text, _HALF, 1))


def _named_month(text: Column) -> Column:
    """D-Mon-Y rewritten as Y-M-D."""
    part = lambda i: F.regexp_extract(text, _NAMED_MONTH, i)
    number = F.call_function("div", F.instr(F.lit(_MONTHS), F.lower(part(2))) - 1, F.lit(4)) + 1
    return F.when(part(3) != "", F.concat(part(3), F.lit("-"), number.cast("string"), F.lit("-"), part(1), part(4)))


def iso_text(text: Column) -> Column:
    """Day and clock in year-month-day order, without AM/PM; a clock alone stands on 1970-01-01."""
    bare = F.regexp_replace(text, r"\s*" + _HALF, "")
    numeric = F.regexp_replace(F.regexp_replace(bare, _DAY_FIRST, "$3-$2-$1"), _YEAR_FIRST, "$1-$2-$3")
    short = F.regexp_replace(F.regexp_replace(bare, _SHORT_YEAR, "20$3-$2-$1"), _SHORT_YEAR_1900, "19$3-$2-$1")
    return F.trim(
        F.when(is_clock_only(text), F.concat(F.lit("1970-01-01 "), F.trim(bare)))
        .when(bare.rlike("[A-Za-z]{3}"), _named_month(bare))
        .when(bare.rlike(r"^\s*\d{1,2}[-/.]\d{1,2}[-/.]\d{2}(?!\d)"), short)
        .otherwise(numeric)
    )


def parse_day(text: Column) -> Column:
    """Calendar day of a text: Y-M-D as written, otherwise day first; junk gives NULL."""
    return F.when(~is_clock_only(text), read_time(text).cast("date"))


def _on_24h(ts: Column, half: Column) -> Column:
    """A 12 h reading on the 24 h clock; an hour outside 1-12 is no time."""
    late = F.when(half == "pm", F.when(F.hour(ts) == 12, 0).otherwise(12)).otherwise(
        F.when(F.hour(ts) == 12, -12).otherwise(0)
    )
    return F.when(half == "", ts).when(F.hour(ts).between(1, 12), add_minutes(ts, late * 60))


def resolve_times(df: DataFrame, columns: Sequence[str], day: str) -> DataFrame:
    """Replace text columns by timestamps: a full date-time as written, a clock on ``day``."""
    read = {}
    for c in columns:
        read[f"__t_{c}"] = read_time(F.col(c))
        read[f"__h_{c}"] = half_of_day(F.col(c))
        read[f"__c_{c}"] = is_clock_only(F.col(c))
    out = df.withColumns(read)
    turned = out.withColumns({f"__t_{c}": _on_24h(F.col(f"__t_{c}"), F.col(f"__h_{c}")) for c in columns})
    placed = {}
    for c in columns:
        t = F.col(f"__t_{c}")
        placed[c] = F.when(~F.col(f"__c_{c}"), t).otherwise(
            from_micros(micros(F.col(day).cast("timestamp_ntz")) + micros(t))
        )
    return turned.withColumns(placed).drop(*read)
