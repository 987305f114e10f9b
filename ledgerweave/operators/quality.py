"""Measurement of quality: nine metrics, segments, percentiles, cost, labour, markup."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "all"


def ratio(part: Column, whole: Column) -> Column:
    """A share at twelve significant digits' worth of DOUBLE; null of nothing."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def compare_with_gold(observed: DataFrame, gold: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """observed with correct: true, false, or null where gold lacks the record or a critical field; compared as text."""
    g = gold.select(*keys, *(F.col(c).cast("string").alias(f"gold_{c}") for c in fields))
    both = observed.join(g, keys, "left")
    known, same, wrong = F.lit(True), F.lit(True), F.lit(0)
    for c in fields:
        known = known & F.col(f"gold_{c}").isNotNull()
        hit = F.coalesce(F.col(c).cast("string") == F.col(f"gold_{c}"), F.lit(False))
        same, wrong = same & hit, wrong + (~hit).cast("int")
    return both.withColumn("correct", F.when(known, same)).withColumn("wrong_fields", F.when(known, wrong)).drop(*(f"gold_{c}" for c in fields))


def by_segments(rows: DataFrame, labels: list[str]) -> DataFrame:
    """rows repeated for the whole and for each label's value: columns segment, value."""
    cells = F.array(F.struct(F.lit(ALL).alias("segment"), F.lit(ALL).alias("value")), *(F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value")) for c in labels))
    return rows.withColumn("__s", F.explode(cells)).select(*rows.columns, "__s.*")


def metrics(rows: DataFrame, by: list[str], fields: int, source: str, document: str | None = None, threshold: str | None = None) -> DataFrame:
    """The metrics of each group in one aggregation.

    rows: status, eligible, correct (tri-state), wrong_fields, source. Records
    whose gold is unknown leave the denominators of FAR, false alarm and error
    rate; automation keeps every eligible record in its own. The 3/N bound is
    told where FAR counts nothing wrong, with N distinct sources; with a
    threshold (a decimal text), shortage is how many sources it still lacks, and
    null where no number would do. With a document, its distinct values count
    beside records and sources.
    """
    needed = None if threshold is None or Decimal(threshold) <= 0 else math.ceil(3 / Decimal(threshold))
    auto, review = F.col("status") == "accepted_auto", F.col("status") == "review"
    n = rows.groupBy(*by).agg(
        F.count("*").alias("records"),
        F.count_distinct(source).alias("sources"), *([F.count_distinct(document).alias("documents")] if document else []),
        F.count_if(auto & F.col("correct").isNotNull()).alias("auto_known"),
        F.count_if(auto & ~F.col("correct")).alias("auto_wrong"),
        F.count_if(F.col("eligible")).alias("eligible"),
        F.count_if(F.col("eligible") & auto & F.col("correct")).alias("auto_right"),
        F.count_if(review).alias("in_review"),
        F.count_if(review & F.col("correct").isNotNull()).alias("review_known"),
        F.count_if(review & F.col("correct")).alias("review_right"),
        F.count_if(F.col("correct").isNotNull()).alias("known"),
        F.sum(F.coalesce("wrong_fields", F.lit(0))).alias("wrong"),
    )
    return n.select(
        *by, "records", *(["documents"] if document else []), "sources",
        ratio(F.col("auto_wrong"), F.col("auto_known")).alias("far"), ratio(F.col("auto_right"), F.col("eligible")).alias("automation"), ratio(F.col("in_review"), F.col("records")).alias("review_load"),
        ratio(F.col("wrong"), F.col("known") * fields).alias("field_error"), ratio(F.col("review_right"), F.col("review_known")).alias("false_alarm"),
        F.when((F.col("auto_wrong") == 0) & (F.col("sources") > 0), F.lit(3.0) / F.col("sources")).alias("rule_of_three"),
        *([F.when(F.lit(needed is not None), F.greatest(F.lit(0), F.lit(needed or 0) - F.col("sources"))).cast("long").alias("shortage")] if threshold is not None else []),
    )


#: The nine metrics in their order.
METRICS = ("far", "automation", "review_load", "field_error", "coverage_loss", "false_alarm", "throughput_p95", "full_cost", "template_drift")


def nine_metrics(measured: DataFrame, coverage: DataFrame, timings: DataFrame, costs: DataFrame, drifted: DataFrame) -> DataFrame:
    """(segment, value, metric, measure): all nine metrics of the whole and of each segment in one result.

    measured: metrics() by segment and value. coverage (coverage_loss), timings
    (p95), costs (cost) and drifted (changes of a template's metrics; the largest
    counts) are told of the whole only: for segments they are null, not missing.
    """
    whole = F.col("segment") == ALL
    one = lambda rows, c, name: rows.agg(F.max(c).cast("double").alias("measure")).select(F.lit(ALL).alias("segment"), F.lit(ALL).alias("value"), F.lit(name).alias("metric"), "measure")
    shared = [one(coverage, "coverage_loss", "coverage_loss"), one(timings, "p95", "throughput_p95"), one(costs, "cost", "full_cost"), one(drifted, F.abs("change"), "template_drift")]
    cell = lambda name, c: F.struct(F.lit(name).alias("metric"), c.alias("measure"))
    own = [cell(m, F.col(m)) for m in METRICS if m in measured.columns]
    absent = [F.when(~whole, cell(m, F.lit(None).cast("double"))) for m in METRICS if m not in measured.columns]
    out = measured.select("segment", "value", F.explode(F.array_compact(F.array(*own, *absent))).alias("__m")).select("segment", "value", "__m.*")
    for rows in shared:
        out = out.unionByName(rows)
    return out


def coverage_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, coverage_loss): records of gold that weren't found, and unknown ones, over gold's."""
    n = rows.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), F.col("gold") - F.col("found")) + F.col("unknown")).alias("lost"), F.sum("gold").alias("gold"))
    return n.select(*by, ratio(F.col("lost"), F.col("gold")).alias("coverage_loss"))


def weakest(segments: DataFrame, metric: str) -> DataFrame:
    """The segment with the largest value of a metric; ties go to the first by name."""
    rows = segments.where((F.col("segment") != ALL) & F.col(metric).isNotNull())
    return rows.orderBy(F.desc(metric), "segment", "value").limit(1)


#: Cuts that a group's values are dealt out by, and how closely a sketch places them.
CUTS, ACCURACY = 128, 10_000


def percentiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by, n, p50, p95...): elements at number ceil(share * n) in order, exactly; nulls don't count.

    No group's values meet in one task's memory: a sketch of each group gives
    cuts, exact counts between them tell in which piece an element lies and at
    which number, and only those pieces are ordered. The cuts make pieces small,
    never the result: pieces are counted, not estimated.
    """
    own = rows.select(F.struct(*by).alias("__g"), F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    steps = F.array(*(F.lit(k / CUTS) for k in range(1, CUTS)))
    cuts = own.groupBy(F.col("__g").alias("__of")).agg(F.array_distinct(F.percentile_approx("__v", steps, ACCURACY)).alias("__cuts"))
    below = F.size(F.filter("__cuts", lambda x: x < F.col("__v")))
    pieces = own.join(cuts, F.col("__g").eqNullSafe(F.col("__of"))).select("__g", "__v", below.alias("__piece"))
    counts = pieces.groupBy("__g", "__piece").agg(F.count("*").alias("__n"))
    # A row for each piece of a group from here on.
    counts = counts.withColumn("__upto", F.sum("__n").over(Window.partitionBy("__g").orderBy("__piece"))).withColumn("n", F.sum("__n").over(Window.partitionBy("__g")))
    number = F.array(*(F.struct(F.lit(k).alias("share"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(str(x)).cast("decimal(9,6)"))).cast("long").alias("number")) for k, x in enumerate(shares)))
    wanted = counts.select(F.col("__g").alias("__of"), F.col("__piece").alias("__in"), "__n", "__upto", "n", F.explode(number).alias("__w")).where("__w.number <= __upto AND __w.number > __upto - __n")
    wanted = wanted.select("__of", "__in", "n", F.col("__w.share").alias("__share"), (F.col("__w.number") - F.col("__upto") + F.col("__n")).alias("__nth"))
    same = F.col("__g").eqNullSafe(F.col("__of")) & (F.col("__piece") == F.col("__in"))
    few = pieces.join(wanted.select("__of", "__in").distinct(), same, "left_semi").groupBy("__g", "__piece", "__v").agg(F.count("*").alias("__c"))
    few = few.withColumn("__end", F.sum("__c").over(Window.partitionBy("__g", "__piece").orderBy("__v")))
    hit = few.join(wanted, same & (F.col("__nth") <= F.col("__end")) & (F.col("__nth") > F.col("__end") - F.col("__c")))
    out = hit.groupBy("__g", "n").agg(*(F.max(F.when(F.col("__share") == k, F.col("__v"))).alias(f"p{round(x * 100)}") for k, x in enumerate(shares)))
    return out.select("__g.*", "n", *(f"p{round(x * 100)}" for x in shares))


def full_cost(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, documents, cost): compute, api and storage, and minutes at their price, for each document."""
    total = F.sum(F.col("compute") + F.col("api") + F.col("storage") + F.col("minutes") * F.col("minute_price")).cast("decimal(38,4)")
    n = rows.groupBy(*by).agg(F.count_distinct("document").alias("documents"), total.alias("total"))
    return n.select(*by, "documents", "total", (F.col("total").cast("double") / F.col("documents")).alias("cost"))


def labour(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, single, grouped, records, seconds_per_record): per-record time comes from single decisions alone."""
    single = F.col("records") == 1
    n = rows.groupBy(*by).agg(F.count_if(single).alias("single"), F.count_if(~single).alias("grouped"), F.sum("records").alias("records"), F.sum(F.when(single, F.col("seconds"))).alias("s"))
    return n.select(*by, "single", "grouped", "records", ratio(F.col("s"), F.col("single")).alias("seconds_per_record"))


def load_forecast(groups: DataFrame, total: int | None = None) -> DataFrame:
    """(one_by_one, by_group, share): decisions that groups of doubts need each way (A21). groups: group, records."""
    n = groups.agg(F.sum("records").alias("one_by_one"), F.count("*").alias("by_group"))
    return n.withColumn("share", ratio(F.col("one_by_one"), F.lit(total) if total else F.col("one_by_one")))


def savings(seconds: Column, baseline: Column) -> Column:
    """Share of time saved; null without a baseline."""
    return F.when(baseline > 0, (baseline - seconds) / baseline)


def admission(measured: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """measured with unmet: names of metrics that are unknown or beyond their limit; each has its own direction."""
    failed = []
    for name, (direction, limit) in limits.items():
        fine = F.col(name) <= limit if direction == "most" else F.col(name) >= limit
        failed.append(F.when(~F.coalesce(fine, F.lit(False)), name))
    return measured.withColumn("unmet", F.array_compact(F.array(*failed)))


def template_drift(current: DataFrame, admitted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, change): metrics of a template against its admitted version."""
    a, b = current.select(*keys, *(F.col(c).alias(f"now_{c}") for c in names)), admitted.select(*keys, *(F.col(c).alias(f"was_{c}") for c in names))
    cells = F.array(*(F.struct(F.lit(c).alias("metric"), (F.col(f"now_{c}") - F.col(f"was_{c}")).alias("change")) for c in names))
    return a.join(b, keys).select(*keys, F.explode(cells).alias("__cell")).select(*keys, "__cell.*")


def doubt_groups(doubts: DataFrame, kind: str, record: str, field: str) -> DataFrame:
    """(kind, records, fields, first, middle, last): groups of records that share a doubt, with examples by record; the largest comes first."""
    one = doubts.groupBy(kind, record).agg(F.collect_set(field).alias("f"))
    n = one.groupBy(kind).agg(F.count("*").alias("records"))
    fields = doubts.select(kind, field).distinct().groupBy(kind).agg(F.sort_array(F.collect_list(field)).alias("fields"))
    at = one.withColumn("at", F.row_number().over(Window.partitionBy(kind).orderBy(record)) - 1).join(n, kind)
    spot = lambda k: F.max(F.when(F.col("at") == k, F.col(record)))
    return at.groupBy(kind, "records").agg(spot(F.lit(0)).alias("first"), spot(F.floor(F.col("records") / 2)).alias("middle"), spot(F.col("records") - 1).alias("last")).join(fields, kind).orderBy(F.desc("records"), kind)
