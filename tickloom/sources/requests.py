"""Ingest requests: strict JSON bodies exploded to one row per tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schema import MAX_BODY_BYTES

TEXT_FIELDS = ("symbol", "value", "volume", "calendar")
FIELDS = (*TEXT_FIELDS, "timestamp")

_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _member(members: Column, name: str) -> Column:
    """A member by name, its case ignored when the exact name is absent."""
    close = F.map_values(F.map_filter(members, lambda k, _: F.lower(k) == name))
    return F.coalesce(F.try_element_at(members, F.lit(name)), F.get(close, F.lit(0)))


def _present(value: Column) -> Column:
    return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))


def _unknown_names(members: Column, known: tuple[str, ...]) -> Column:
    return F.exists(F.map_keys(members), lambda k: ~F.lower(k).isin(*known))


def parse_requests(requests: DataFrame, max_body_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """``(request_id, received_at, body)`` to one row per tick, texts unchecked.

    Columns: request_id, received_at, malformed, pos, then the five fields as
    text. A request without ticks, or one that cannot be read, keeps one row
    with ``pos`` NULL. Bodies must be one JSON object with nothing after it, no
    unknown member, and strings wherever a value is given.
    """
    # The body is read as the first item of an array closed by a mark taken from
    # the body itself: text after the value, or a bracket in it, loses the mark.
    mark = F.xxhash64("body")
    items = F.from_json(
        F.concat(F.lit("["), F.col("body"), F.lit(","), mark.cast("string"), F.lit("]")),
        "array<variant>",
        _JSON,
    )
    whole = (F.size("items") == 2) & (
        F.try_variant_get(F.get("items", F.lit(1)), "$", "bigint") == mark
    )
    root = F.get("items", F.lit(0))
    ticks = _member(F.col("members"), "ticks")
    parsed = (
        requests.select(
            "request_id",
            "received_at",
            "body",
            F.when(F.octet_length("body") <= max_body_bytes, items).alias("items"),
        )
        .select(
            "request_id",
            "received_at",
            F.when(whole, root).alias("root"),
        )
        .select("request_id", "received_at", "root", _object(F.col("root")).alias("members"))
        .select(
            "request_id",
            "received_at",
            F.when(F.col("members").isNotNull(), _unknown_names(F.col("members"), ("ticks",)))
            .otherwise(F.col("root").isNull() | _present(F.col("root")))
            .alias("bad_root"),
            F.when(F.col("members").isNotNull(), ticks).alias("ticks"),
        )
        .select(
            "request_id",
            "received_at",
            "bad_root",
            _present(F.col("ticks")).alias("has_ticks"),
            F.try_variant_get("ticks", "$", "array<variant>").alias("elements"),
        )
        .select(
            "request_id",
            "received_at",
            (F.col("bad_root") | (F.col("has_ticks") & F.col("elements").isNull())).alias("malformed"),
            "elements",
        )
    )
    exploded = parsed.select(
        "request_id",
        "received_at",
        "malformed",
        F.posexplode_outer(F.when(~F.col("malformed"), F.col("elements"))).alias("pos", "tick"),
    ).withColumn("members", _object(F.col("tick")))
    fields = exploded.select(
        "request_id",
        "received_at",
        (
            F.col("malformed")
            | (_present(F.col("tick")) & F.col("members").isNull())
            | F.coalesce(_unknown_names(F.col("members"), FIELDS), F.lit(False))
        ).alias("malformed"),
        "pos",
        *(_member(F.col("members"), name).alias(name) for name in FIELDS),
    )
    wrong_type = F.lit(False)
    for name in FIELDS:
        wrong_type = wrong_type | (
            _present(F.col(name)) & (F.schema_of_variant(F.col(name)) != "STRING")
        )
    text = {name: F.try_variant_get(name, "$", "string") for name in FIELDS}
    return fields.select(
        "request_id",
        "received_at",
        (F.col("malformed") | F.coalesce(wrong_type, F.lit(False))).alias("malformed"),
        "pos",
        *(
            F.when(F.col("pos").isNotNull(), F.coalesce(text[name], F.lit(""))).alias(name)
            for name in TEXT_FIELDS
        ),
        text["timestamp"].alias("timestamp"),
    )
