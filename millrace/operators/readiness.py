"""Expected against present resources, service probes and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import probe_message, probe_status, service_key
from ..functions.numbers import round_half_up

TABLE = "table"  # the kind whose names may be written without their qualifier


def _accepted_names(expected: DataFrame) -> DataFrame:
    """One row per name that satisfies an expectation: its own, and for a table
    every part after a dot. Turns the suffix rule into an equi-join."""
    parts = F.split("name", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    names = F.when(F.col("kind") == TABLE, suffixes).otherwise(F.array("name"))
    return expected.withColumn("accepted", F.explode(names))


def reconcile(expected: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add ``present`` to expected (layer, kind, name) rows."""
    have = inventory.select(
        F.col("kind").alias("_kind"), F.col("name").alias("_name"), F.lit(True).alias("_hit")
    ).distinct()
    accepted = _accepted_names(expected.select("layer", "kind", "name").distinct())
    same = (F.col("kind") == F.col("_kind")) & (F.col("accepted") == F.col("_name"))
    return (
        accepted.join(have, same, "left")
        .groupBy("layer", "kind", "name")
        .agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("present"))
    )


def layer_readiness(reconciled: DataFrame) -> DataFrame:
    """A layer is ready when all its pieces are present; ``reconcile`` has the pieces."""
    return reconciled.groupBy("layer").agg(
        F.when(F.every("present"), "ready").otherwise("missing").alias("status"),
        F.count(F.lit(1)).alias("expected"),
        F.count_if("present").alias("present"),
    )


def readiness_details(reconciled: DataFrame) -> DataFrame:
    """Each expected piece with its own status and that of its layer.

    Rows rather than a list per layer: a layer may expect any number of pieces.
    """
    layers = layer_readiness(reconciled).select("layer", F.col("status").alias("layer_status"))
    return reconciled.join(layers, "layer").select(
        "layer",
        "layer_status",
        "kind",
        "name",
        F.when(F.col("present"), "ready").otherwise("missing").alias("status"),
    )


def expected_only(inventory: DataFrame, expected: DataFrame) -> DataFrame:
    """Inventory rows some expectation asks for, by the same match rule."""
    accepted = (
        _accepted_names(expected.select("kind", "name").distinct())
        .select(F.col("kind").alias("_kind"), "accepted")
        .distinct()
    )
    same = (inventory["kind"] == F.col("_kind")) & (inventory["name"] == F.col("accepted"))
    return inventory.join(accepted, same, "left_semi")


def service_statuses(probes: DataFrame) -> DataFrame:
    """Service key, status and message of each probe."""
    flags = [F.col(c) for c in ("error", "tcp_available", "https_available", "auth_status")]
    return probes.select(
        service_key(F.col("description")).alias("service_name"),
        probe_status(*flags).alias("status"),
        probe_message(F.col("error"), F.col("port"), F.col("auth_status")).alias("message"),
        "required",
        "auth_status",
        "checked_at",
        *[c for c in ("probe_id",) if c in probes.columns],
    )


def readiness_score(statuses: DataFrame) -> DataFrame:
    """Share of required services that are available, in whole percent."""
    required = F.col("required")
    counts = statuses.agg(
        F.count_if(required).alias("total_required"),
        F.count_if(required & (F.col("status") == "available")).alias("available_required"),
        F.count_if(F.col("auth_status") == "success").alias("authenticated"),
        F.count(F.lit(1)).alias("services"),
    )
    share = F.col("available_required").cast("double") / F.col("total_required").cast("double")
    return counts.withColumn(
        "score",
        F.when(
            F.col("total_required") > 0, round_half_up(share * F.lit(100.0), 0).cast("bigint")
        ).otherwise(F.lit(0).cast("bigint")),
    )
