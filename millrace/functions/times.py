"""ISO text, epoch milliseconds and zone-less UTC timestamps.

Nothing here depends on the session time zone: zone-less columns hold UTC wall
clock, and text without an offset is read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ZONE = r"[+-]\d{2}(:?\d{2})?"
_ISO_SHAPE = rf"^(?!0000)\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}(:\d{{2}}(:\d{{2}}(\.\d+)?)?)?(Z|{_ZONE})?)?\z"
#: The form most writers use: in full, to the second or the microsecond, at +00:00.
_PLAIN = r"^(?!0000)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?\+00:00\z"
_DAY_MINUTES = 24 * 60


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def to_utc_ntz(instant: Column) -> Column:
    """UTC wall clock of an instant, whatever the session time zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch())


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from one zone-less timestamp to another."""
    return F.timestamp_diff("MICROSECOND", start, end)


def parse_iso(text: Column) -> Column:
    """Zone-less UTC timestamp from ISO 8601 text; null when it is not ISO.

    A cast alone would also take ``2024`` or a bare time, so the shape is checked and
    missing parts of the clock are filled in. The offset is taken off in minutes: any
    below a day counts, also those that no zone on earth has. The usual form takes a
    shorter way to the same result.
    """
    plain = F.substr(text, F.lit(1), F.length(text) - 6).try_cast("timestamp_ntz")
    return F.when(text.rlike(_PLAIN), plain).otherwise(_parse_any(text))


def _parse_any(text: Column) -> Column:
    rest = F.substring(text, 12, 60)
    zone = F.regexp_extract(rest, rf"{_ZONE}\z", 0)
    clock = F.regexp_extract(rest, r"^[0-9:.]*", 0)
    filled = (
        F.when(F.length(clock) == 0, F.lit("00:00:00"))
        .when(F.length(clock) == 2, F.concat(clock, F.lit(":00:00")))
        .when(F.length(clock) == 5, F.concat(clock, F.lit(":00")))
        .otherwise(clock)
    )
    local = F.try_to_timestamp(F.concat(F.substring(text, 1, 10), F.lit("T"), filled, F.lit("Z")))
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    ahead = F.when(F.substring(zone, 1, 1) == "-", -minutes).otherwise(minutes)
    utc = F.timestamp_add("MINUTE", F.lit(0) - ahead, to_utc_ntz(local))
    return F.when(text.rlike(_ISO_SHAPE) & (minutes < _DAY_MINUTES), utc)


def from_epoch_millis(millis: Column) -> Column:
    """Zone-less UTC timestamp; null and 0 both mean "no timestamp"."""
    return F.when(millis != 0, F.timestamp_add("MILLISECOND", millis, _epoch()))


def iso_text(ts: Column) -> Column:
    """ISO text with a +00:00 offset; six fraction digits, or none when it is zero."""
    text = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    padded = F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
    return F.concat(padded, F.lit("+00:00"))
