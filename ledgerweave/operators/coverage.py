"""Coverage of what was expected, and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage_map(expected: DataFrame, found: DataFrame, explained: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, expected, found, explained, unexplained), a row for each expectation; found and explained are rows to count."""
    count = lambda d, name: d.groupBy(*keys, "kind").agg(F.count("*").alias(name))
    out = expected.select(*keys, "kind", "expected").join(count(found, "found"), [*keys, "kind"], "left").join(count(explained, "explained"), [*keys, "kind"], "left").fillna(0, ["found", "explained"])
    return out.withColumn("unexplained", F.col("expected") - F.col("found") - F.col("explained"))


def disputes(expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind): kinds for which several different counts are expected."""
    return expected.groupBy(*keys, "kind").agg(F.count_distinct("expected").alias("n")).where("n > 1").select(*keys, "kind")


def completeness(documents: DataFrame, coverage: DataFrame, keys: list[str], doubts: DataFrame | None = None, mechanisms_missing: bool = False) -> DataFrame:
    """(keys, completeness): doubts, no expectation or disputed ones are unknown; then partial; then missing mechanisms; then complete."""
    per = coverage.groupBy(*keys, "kind").agg(F.count_distinct("expected").alias("n"), F.max((F.col("unexplained") != 0).cast("int")).alias("open"), F.count("*").alias("rows"))
    per = per.groupBy(*keys).agg((F.max("n") > 1).alias("disputed"), (F.max("open") > 0).alias("open"))
    out = documents.select(*keys).join(per, keys, "left")
    doubted = F.lit(False)
    if doubts is not None:
        out = out.join(doubts.select(*keys).distinct().withColumn("doubted", F.lit(True)), keys, "left")
        doubted = F.coalesce("doubted", F.lit(False))
    state = F.when(doubted | F.col("open").isNull() | F.col("disputed"), "unknown").when(F.col("open"), "partial").when(F.lit(mechanisms_missing), "unknown").otherwise("complete")
    return out.select(*keys, state.alias("completeness"))


def evidence_summary(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fields, with_address, complete): provenance is complete when there is evidence and none lacks an address or its reason.

    evidence: keys, field, address, reason.
    """
    n = evidence.groupBy(*keys).agg(F.count("*").alias("fields"), F.count("address").alias("with_address"), F.count_if(F.col("address").isNull() & F.col("reason").isNull()).alias("bad"))
    return n.select(*keys, "fields", "with_address", ((F.col("fields") > 0) & (F.col("bad") == 0)).alias("complete"))
