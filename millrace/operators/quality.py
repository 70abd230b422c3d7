"""Validation: every rule is evaluated, and each failing rule leaves a reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import parse_number
from ..functions.times import parse_iso
from ..schemas import PAYLOAD_TEXT

REQUIRED_KEYS = PAYLOAD_TEXT.names

# The accepted readings.
MIN_TEMPERATURE = 20.0
MAX_TEMPERATURE = 95.0
MAX_VIBRATION = 4.95

_REPLACEMENT = "\ufffd"
_ASIDE = "\ufdd0"  # a noncharacter, which no text contains
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_CONTROL = r"[\x00-\x1f]"
_CLEAN_STRING = r'"[^"\\\x00-\x1f]*+(?:\\.[^"\\\x00-\x1f]*+)*+"'


def decode_value(raw: Column) -> Column:
    """Message text of a binary value: UTF-8, with undecodable bytes dropped."""
    text = raw.cast("string")
    # a replacement character the sender wrote is set aside while bad bytes become one
    aside = F.replace(text, F.lit(_REPLACEMENT), F.lit(_ASIDE))
    dropped = F.replace(F.make_valid_utf8(aside), F.lit(_REPLACEMENT), F.lit(""))
    repaired = F.replace(dropped, F.lit(_ASIDE), F.lit(_REPLACEMENT))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def temperature_ok(value: Column) -> Column:
    """Inclusive range; null stays null, which a filter drops."""
    return value.between(F.lit(MIN_TEMPERATURE), F.lit(MAX_TEMPERATURE))


def vibration_ok(value: Column) -> Column:
    """Upper limit only; NaN fails."""
    return value <= F.lit(MAX_VIBRATION).cast("double")


def _fails(rule: Column) -> Column:
    """Null counts as a failure."""
    return ~F.coalesce(rule, F.lit(False))


def _reason_list(*rules: tuple[Column, str]) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(broken, F.array(F.lit(name))).otherwise(none) for broken, name in rules])


def check_readings(readings: DataFrame) -> DataFrame:
    """Add ``reasons`` to typed readings (range rules only)."""
    return readings.withColumn(
        "reasons",
        _reason_list(
            (_fails(temperature_ok(F.col("temperature"))), "temperature_range"),
            (_fails(vibration_ok(F.col("vibration"))), "vibration_limit"),
        ),
    )


def valid_readings(readings: DataFrame) -> DataFrame:
    """Typed readings that pass, as plain comparisons a scan can push down."""
    return readings.where(
        temperature_ok(F.col("temperature")) & vibration_ok(F.col("vibration"))
    )


def hot_or_cold(readings: DataFrame) -> DataFrame:
    return readings.where(_fails(temperature_ok(F.col("temperature"))))


def shaking(readings: DataFrame) -> DataFrame:
    return readings.where(_fails(vibration_ok(F.col("vibration"))))


def _one_object(value: Column) -> Column:
    """True when no text follows the JSON object that ``value`` starts with.

    A first closing brace at the very end proves it. Otherwise the text is wrapped
    in an array with one more element: trailing text changes the length or breaks
    the parse.
    """
    ends_once = F.instr(value, "}") == F.length(F.rtrim(value))
    wrapped = F.concat(F.lit("["), value, F.lit(",0]"))
    return F.when(ends_once, True).otherwise(
        F.coalesce(F.json_array_length(wrapped) == 2, F.lit(False))
    )


def _strict_quotes(value: Column) -> Column:
    """False for what the parser would let pass in quotes, and JSON does not.

    With all double-quoted strings removed, no apostrophe may be left; with all those
    removed that hold no control character, no quote.
    """
    outside = F.regexp_replace(value, _STRING, "")
    unclean = F.regexp_replace(value, _CLEAN_STRING, "")
    single = F.when(value.contains("'"), ~outside.contains("'")).otherwise(True)
    return single & F.when(value.rlike(_CONTROL), ~unclean.contains('"')).otherwise(True)


def _typed_fields(log: DataFrame) -> DataFrame:
    """Parse each message once and turn its texts into typed columns.

    ``_keys`` is only worked out where some field is null.
    """
    texts = PAYLOAD_TEXT.names
    parsed = log.select(
        *log.columns,
        F.json_tuple("value", *texts).alias(*[f"_{t}" for t in texts]),
    )
    some_null = reduce(lambda a, b: a | b, [F.col(f"_{t}").isNull() for t in texts])
    all_null = reduce(lambda a, b: a & b, [F.col(f"_{t}").isNull() for t in texts])
    value = F.col("value")
    keys = F.when(some_null, F.json_object_keys("value"))
    # Text that no string can hold, such as half a surrogate pair, empties every field.
    # Only where no field could be read is the key's own value looked at; a message that
    # repeats keys is no variant, and is judged by how the key is written.
    whole = F.try_parse_json("value")
    own_null = F.is_variant_null(F.try_variant_get(whole, f"$.{texts[0]}", "variant"))
    written_null = value.rlike(rf'"{texts[0]}"\s*:\s*null')
    said_null = F.when(whole.isNull(), written_null).otherwise(own_null)
    unreadable = all_null & F.array_contains(keys, texts[0]) & F.when(all_null, ~said_null)
    return parsed.select(
        *log.columns,
        F.col("_event_id").alias("event_id"),
        F.col("_device_id").alias("device_id"),
        parse_iso(F.col("_timestamp")).alias("event_time"),
        parse_number(F.col("_temperature")).alias("temperature"),
        parse_number(F.col("_vibration")).alias("vibration"),
        F.col("_status").alias("status"),
        keys.alias("_keys"),
        some_null.alias("_some_null"),
        F.coalesce(
            _one_object(value) & _strict_quotes(value) & (~some_null | keys.isNotNull()) & ~F.coalesce(unreadable, F.lit(False)),
            F.lit(False),
        ).alias("_object"),
    )


def check_messages(log: DataFrame) -> DataFrame:
    """Parse the JSON ``value`` of a log and add typed fields and ``reasons``.

    Rules on a field apply only where its key is present: a missing key reports
    just ``missing_keys``. Columns of ``log`` are kept; the message time comes out
    as ``event_time``.

    The reasons come out of a generator on purpose: a filter on them is not pushed
    below it, so no message is parsed a second time to evaluate the filter.
    """
    typed = _typed_fields(log)
    obj, nulls = F.col("_object"), F.col("_some_null")

    def null_value(key: str, column: str | None = None) -> Column:
        """The key is there, but gives no usable value."""
        present = ~nulls | F.array_contains("_keys", key)
        return obj & F.col(column or key).isNull() & present

    temperature, vibration = F.col("temperature"), F.col("vibration")
    required = F.array(*[F.lit(k) for k in REQUIRED_KEYS])
    reasons = _reason_list(
        (~obj, "malformed"),
        (obj & nulls & (F.size(F.array_except(required, "_keys")) > 0), "missing_keys"),
        (null_value("timestamp", "event_time"), "timestamp_invalid"),
        (null_value("temperature"), "temperature_not_numeric"),
        (obj & temperature.isNotNull() & _fails(temperature_ok(temperature)), "temperature_range"),
        (null_value("vibration"), "vibration_not_numeric"),
        (obj & vibration.isNotNull() & _fails(vibration_ok(vibration)), "vibration_limit"),
        (
            null_value("event_id") | null_value("device_id") | null_value("status"),
            "null_required",
        ),
    )
    kept = [c for c in typed.columns if c not in ("_keys", "_some_null", "_object")]
    return typed.select(*kept, F.inline(F.array(F.struct(reasons.alias("reasons")))))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("reasons")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0)


def quarantine_rows(checked: DataFrame) -> DataFrame:
    """Rejected messages with their raw text and reasons."""
    return rejected_rows(checked).select(
        "partition", "offset", F.col("value").alias("raw_value"), "reasons"
    )


def reason_counts(checked: DataFrame) -> DataFrame:
    """Rows per reason; a row with two reasons counts in both."""
    return (
        checked.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("rejected"))
    )
