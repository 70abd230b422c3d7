"""The JSON summary of pipeline state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_LAST = 5
_KINDS = {"topics": "topic", "tables": "table", "buckets": "bucket"}


def _newest_list(rows: DataFrame, time: str, tie: str) -> Column:
    """Array of the newest five rows, newest first; the list is bounded before it is built."""
    few = rows.orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc()).limit(_LAST)
    whole = F.struct(*rows.columns).alias("row")
    keyed = few.select(F.struct(F.col(time).alias("_t"), F.col(tie).alias("_k"), whole).alias("r"))
    listed = keyed.agg(
        F.transform(F.sort_array(F.collect_list("r"), asc=False), lambda r: r["row"])
    )
    return listed.scalar()


def _json(*fields: Column | str) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def context_summary(
    expected_inventory: DataFrame, readiness: DataFrame, silver: DataFrame, gold: DataFrame
) -> DataFrame:
    """One row, one JSON column: resource and layer counts and the last rows of each table.

    ``expected_inventory`` holds the resources that some expectation asks for.
    """
    counts = expected_inventory.agg(
        F.struct(*[F.count_if(F.col("kind") == k).alias(name) for name, k in _KINDS.items()])
    ).scalar()
    layers = readiness.agg(
        F.struct(
            F.count(F.lit(1)).alias("layers"), F.count_if(F.col("status") == "ready").alias("ready")
        )
    ).scalar()
    return expected_inventory.sparkSession.range(1).select(
        _json(
            F.struct(*[counts[n].alias(n) for n in _KINDS], layers.alias("readiness")).alias("dashboard"),
            F.struct(_newest_list(silver, "timestamp", "event_id").alias("last_5_records")).alias("silver_layer"),
            F.struct(_newest_list(gold, "window_start", "window_end").alias("last_5_records")).alias("gold_layer"),
        ).alias("context")
    )


def context_document(
    expected_inventory: DataFrame,
    details: DataFrame,
    readiness: DataFrame,
    metrics: DataFrame,
    silver: DataFrame,
    gold: DataFrame,
) -> DataFrame:
    """The context in parts: (part, name, context), a JSON text per row.

    A ``summary`` row, a ``topic`` row for each topic, a ``layer`` row for each layer and a
    ``piece`` row for each expected resource. Layers, topics and pieces are rows of their
    own, so none of them is cut or has to fit in one value.
    """
    summary = context_summary(expected_inventory, readiness, silver, gold)
    return (
        summary.select(F.lit("summary").alias("part"), F.lit("").alias("name"), "context")
        .unionAll(
            metrics.select(
                F.lit("topic"),
                "topic",
                _json("topic", "total_messages", "lag_seconds", "processing_rate"),
            )
        )
        .unionAll(readiness.select(F.lit("layer"), "layer", _json("layer", "status", "expected", "present")))
        .unionAll(
            details.select(
                F.lit("piece"),
                F.concat_ws("/", "layer", "kind", "name"),
                _json("layer", "kind", "name", "status"),
            )
        )
    )
