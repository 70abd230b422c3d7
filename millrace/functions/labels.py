"""Bands, statuses and display names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Upper bounds in seconds and their labels.
REAL_TIME_BELOW = 5
MINOR_DELAY_BELOW = 30
REAL_TIME = "Real-time"
MINOR_DELAY = "Minor delay"
SIGNIFICANT_LAG = "Significant lag"


def lag_band(seconds: Column) -> Column:
    return (
        F.when(seconds < REAL_TIME_BELOW, REAL_TIME)
        .when(seconds < MINOR_DELAY_BELOW, MINOR_DELAY)
        .otherwise(SIGNIFICANT_LAG)
    )


def metric_label(name: Column) -> Column:
    """``latest_message_timestamp`` to ``Latest Message``."""
    words = F.regexp_replace(name, "_", " ")
    # only the first " timestamp" goes
    words = F.regexp_replace(words, "^(.*?) timestamp", "$1")
    starts = F.split(words, r"(?<=\W)(?=\w)")
    capitalised = F.transform(
        starts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    )
    return F.array_join(capitalised, "")


def service_key(description: Column) -> Column:
    """``Object Store`` to ``object_store``."""
    return F.replace(F.lower(description), F.lit(" "), F.lit("_"))


def probe_status(error: Column, tcp: Column, https: Column, auth: Column) -> Column:
    """missing / available / misconfigured from one probe's flags; first match wins."""
    tcp, https = F.coalesce(tcp, F.lit(False)), F.coalesce(https, F.lit(False))
    failed = F.coalesce(error, F.lit("")) != ""
    return (
        F.when(failed & ~tcp, "missing")
        .when(auth == "success", "available")
        .when(auth == "unauthorized", "misconfigured")
        .when(tcp | https, "available")
        .otherwise("missing")
    )


def probe_message(error: Column, port: Column, auth: Column) -> Column:
    """The probe's error, else its port and authentication state."""
    state = F.concat(
        F.lit("Port "), port.cast("string"), F.lit(" - "), F.coalesce(auth, F.lit("unknown"))
    )
    return F.coalesce(F.nullif(error, F.lit("")), state)
