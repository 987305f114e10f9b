"""Recheck selection: triggers, seeded samples, modes and their gate; corpus split and leakage."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_key(seed: str, record: Column) -> Column:
    """The first 8 bytes of SHA-256 of seed, bar and id, in hexadecimal: its order is the integer order."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(seed), record.cast("string")), 256), 1, 16)


def triggers(features: dict[str, Column]) -> Column:
    """Names of the features that call for a recheck, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), name) for name, c in features.items())))


#: Rows at the edge of a draw that are ranked one by one; hexadecimal digits of the key that a round of counting looks at.
EDGE, DIGITS = 10_000, 3


def first_by_hash(rows: DataFrame, seed: str, record: str, quota: int) -> DataFrame:
    """The quota rows that come first in the seeded order.

    Counts by the key's leading digits tell where the quota ends: what lies below
    is a filter, and only the rows of that last bin are ranked. A round counts
    16**DIGITS bins at most; rounds go on until the bin is small.
    """
    key, prefix, need = sample_key(seed, F.col(record)), "", quota
    while quota > 0:
        bins = rows.where(F.startswith(key, F.lit(prefix))).groupBy(F.substring(key, len(prefix) + 1, DIGITS).alias("digits")).agg(F.count("*").alias("n")).collect()  # 16**DIGITS rows at most
        for digits, n in sorted(map(tuple, bins)):
            if n >= need:
                prefix += digits
                break
            need -= n
        else:
            return rows  # all are wanted
        if n == need:
            return rows.where(F.substring(key, 1, len(prefix)) <= prefix)
        if n <= EDGE or len(prefix) + DIGITS > 16:
            edge = rows.where(F.startswith(key, F.lit(prefix))).orderBy(key, record).limit(need)
            return rows.where(F.substring(key, 1, len(prefix)) < prefix).unionByName(edge)
    return rows.limit(0)


def select_for_recheck(rows: DataFrame, record: str, mode: str, share: Decimal | str | float | None = None, seed: str | None = None) -> DataFrame:
    """(record, reasons): who is rechecked, and why (K03). rows: record, reasons.

    Calibration and high risk take everyone. Stable takes those with a reason,
    and of the others the first ceil(share * all) in the seeded order; the share
    is a decimal and isn't rounded. Rows are counted when the plan is built.
    """
    if mode in ("calibration", "high_risk"):
        return rows.select(record, F.array(F.lit(mode)).alias("reasons"))
    part = Decimal(str(share)) if share is not None else None
    if mode != "stable" or part is None or not 0 < part <= 1 or seed is None:
        raise ValueError("a stable mode needs a share within (0, 1] and a seed")
    quota = math.ceil(part * rows.count())
    drawn = first_by_hash(rows.where(F.size("reasons") == 0).select(record), seed, record, quota)
    return rows.where(F.size("reasons") > 0).select(record, "reasons").unionByName(drawn.select(record, F.array(F.lit("random")).alias("reasons")))


def gate(metrics: DataFrame, keys: list[str], threshold: float | None, sampling: bool = True) -> DataFrame:
    """(keys, gate): the first condition that isn't met, else `open` (K05). metrics: keys, observations, errors, same_version."""
    n = F.col("observations")
    state = (
        F.when(F.lit(threshold is None), "threshold").when(F.lit(not sampling), "sampling").when(n.isNull() | F.col("errors").isNull(), "metrics").when(~F.col("same_version"), "version").when(n <= 0, "metrics")
        .when(F.lit(3.0) / F.when(n > 0, n) > (threshold or 0.0), "rule_of_three").when(F.col("errors").cast("double") / F.when(n > 0, n) > (threshold or 0.0), "error_share").otherwise("open")
    )
    return metrics.select(*keys, "observations", "errors", state.alias("gate"))


def choose_mode(gated: DataFrame, high_risk: Column, drifted: Column) -> DataFrame:
    """gated with mode: risk, then drift, then the gate."""
    return gated.withColumn("mode", F.when(high_risk, "high_risk").when(drifted, "calibration").when(F.col("gate") == "open", "stable").otherwise("calibration"))


PARTS = {"development": 0.6, "check": 0.2, "closed": 0.2}


def split_corpus(clusters: DataFrame, seed: str, parts: dict[str, float] = PARTS) -> DataFrame:
    """(cluster, part): each cluster whole to the part that lacks most; clusters in a hashed order.

    Every choice depends on all before it, so one task streams the clusters'
    sizes in that order and holds one sum for each part. clusters: cluster, size.
    Fewer clusters than parts, or an empty closed part, is an error.
    """
    n, total = clusters.agg(F.count("*"), F.sum("size")).first()
    if n < len(parts):
        raise ValueError("fewer clusters than parts")
    names, kind = list(parts), clusters.schema["cluster"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled = dict.fromkeys(names, 0)
        for b in batches:
            out = []
            for size in b["size"]:
                part = min(names, key=lambda p: (filled[p] - parts[p] * total, names.index(p)))
                filled[part] += int(size)
                out.append(part)
            yield pd.DataFrame({"cluster": b["cluster"], "part": out})

    # The hash is of the seed and the cluster's key in order of their text, as one string.
    name = F.col("cluster").cast("string")
    order = F.sha2(F.concat(F.least(F.lit(seed), name), F.greatest(F.lit(seed), name)), 256)
    told = clusters.select("cluster", "size", order.alias("order")).repartition(1).sortWithinPartitions("order", "cluster").select("cluster", "size").mapInPandas(fold, f"cluster {kind}, part string")
    if not told.where(F.col("part") == names[-1]).limit(1).count():
        raise ValueError("the closed part is empty")
    return told


def leaked(seen: DataFrame, closed: DataFrame, key: str) -> DataFrame:
    """Rows of the closed part that the system has seen."""
    return closed.join(seen.select(key).distinct(), key, "left_semi")
