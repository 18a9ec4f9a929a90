"""Validation and routing of raw events, and tumbling windows over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed signals.
SIGNALS = ("metrics", "logs", "traces")


def validate(raw: DataFrame, value: str, signal: str) -> DataFrame:
    """Adds `error`: null for accepted rows, else the first failed rule: unsupported signal, invalid encoding, invalid JSON, not an object."""
    text = F.col(value).cast("string")
    # the parser stops after one value; inside an array and inside an object, nothing but that value fits
    listed, parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    kind = F.schema_of_variant(F.variant_get(parsed, "$.v", "variant"))
    error = (
        F.when(~F.coalesce(F.col(signal).isin(*SIGNALS), F.lit(False)), "unsupported_signal").when(text.isNull() | ~F.is_valid_utf8(text), "invalid_encoding")
        .when(parsed.isNull() | listed.isNull(), "invalid_json").when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "not_an_object")
    )
    return raw.withColumn("error", error)


def route(raw: DataFrame, value: str, signal: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, dead letters): the latter with the error and the payload as unbroken base64."""
    v = validate(raw, value, signal)
    dead = v.where("error is not null").withColumn("payload_base64", F.regexp_replace(F.base64(F.col(value)), r"\r\n", ""))
    return v.where("error is null").drop("error"), dead


def closed_windows(stream: DataFrame, ts: str, by: list[str], value: str, seconds: int, late: str) -> DataFrame:
    """Counts and sums of tumbling windows that the watermark has closed; later rows are dropped by that watermark."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), *by, "n", "total")
