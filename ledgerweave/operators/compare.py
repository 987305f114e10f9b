"""Comparison of two sides: sets, readings, annotators, snapshots, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fate): survived, vanished or appeared, for each distinct key of either side."""
    sides = before.select(*keys, F.lit(1).alias("side")).unionByName(after.select(*keys, F.lit(2).alias("side")))
    seen = sides.groupBy(*keys).agg(F.bit_or("side").alias("seen"))
    return seen.select(*keys, F.when(F.col("seen") == 3, "survived").when(F.col("seen") == 1, "vanished").otherwise("appeared").alias("fate"))


def match_readings(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, status, first_value, second_value): two readings by address; one that lacks a pair is UNKNOWN."""
    a, b = first.select(*keys, F.col(value).alias("first_value"), F.lit(True).alias("in_first")), second.select(*keys, F.col(value).alias("second_value"), F.lit(True).alias("in_second"))
    both = a.join(b, keys, "full_outer")
    status = F.when(F.col("in_first").isNull(), "UNKNOWN").when(F.col("in_second").isNull(), "UNKNOWN").when(F.col("first_value").eqNullSafe(F.col("second_value")), "PASS").otherwise("FAIL")
    return both.select(*keys, status.alias("status"), "first_value", "second_value")


def disagreements(first: DataFrame, second: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, first_value, second_value) where two annotators differ; field is null for a row that one side lacks."""
    a = first.select(*keys, *(F.col(c).cast("string").alias(f"a_{c}") for c in fields), F.lit(True).alias("in_a"))
    b = second.select(*keys, *(F.col(c).cast("string").alias(f"b_{c}") for c in fields), F.lit(True).alias("in_b"))
    both = a.join(b, keys, "full_outer")
    one_sided = F.col("in_a").isNull() | F.col("in_b").isNull()
    cell = lambda name, x, y: F.struct(F.lit(name).cast("string").alias("field"), x.alias("first_value"), y.alias("second_value"))
    side = lambda c: F.when(c.isNotNull(), "present").otherwise("absent")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), cell(c, F.col(f"a_{c}"), F.col(f"b_{c}"))) for c in fields)))
    found = F.when(one_sided, F.array(cell(None, side(F.col("in_a")), side(F.col("in_b"))))).otherwise(differ)
    return both.select(*keys, F.explode(found).alias("__cell")).select(*keys, "__cell.*")


def gold(first: DataFrame, second: DataFrame, resolutions: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, fields..., accepted): agreement, or a third party's resolution of a field; anything unresolved rejects the row.

    resolutions: keys, field, value.
    """
    found = disagreements(first, second, keys, fields)
    settled = found.join(resolutions, [*keys, "field"], "left")
    open_rows = settled.groupBy(*keys).agg(F.count_if(F.col("value").isNull()).alias("open"), F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field", "value")))).alias("told"))
    rows = first.join(second.select(*keys), keys, "left_semi").join(open_rows, keys, "left")
    picked = [F.coalesce(F.col("told")[F.lit(c)], F.col(c).cast("string")).alias(c) for c in fields]
    lone = found.where("field IS NULL").select(*keys, *(F.lit(None).cast("string").alias(c) for c in fields), F.lit(False).alias("accepted"))
    return rows.select(*keys, *picked, (F.coalesce("open", F.lit(0)) == 0).alias("accepted")).unionByName(lone)


def multiset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost (side `before`) or added (side `after`), with how many times more."""
    names = before.columns
    n = before.select(*names, F.lit(1).alias("n")).unionByName(after.select(*names, F.lit(-1).alias("n"))).groupBy(*names).agg(F.sum("n").alias("n"))
    return n.where("n <> 0").select(*names, F.when(F.col("n") > 0, "before").otherwise("after").alias("side"), F.abs("n").alias("times"))


def field_diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, kind): value, type, missing or extra, from long tables with keys, path, type, value."""
    a, b = (d.select(*keys, "path", F.col("type").alias(f"{s}_type"), F.col("value").alias(f"{s}_value")) for d, s in ((expected, "a"), (actual, "b")))
    both = a.join(b, [*keys, "path"], "full_outer")
    kind = F.when(F.col("b_type").isNull(), "missing").when(F.col("a_type").isNull(), "extra").when(F.col("a_type") != F.col("b_type"), "type").when(~F.col("a_value").eqNullSafe(F.col("b_value")), "value")
    return both.select(*keys, "path", kind.alias("kind")).where("kind IS NOT NULL")


def form_snapshot(pages: DataFrame, lines: DataFrame, records: DataFrame, fields: DataFrame, keys: list[str], columns: int) -> DataFrame:
    """(keys, columns, orientation, rotation, whole_lines, doubtful, unread): what a form looks like, never how much of it there is.

    pages: keys, page, width, height, rotation (the first page counts); lines:
    keys, cells; records: keys, doubts; fields: keys, refusal. A share of nothing
    is 0. columns: how many columns the form declares.
    """
    one = pages.groupBy(*keys).agg(F.min_by(F.struct("width", "height", "rotation"), "page").alias("__p"))
    share = lambda rows, hit, name: rows.groupBy(*keys).agg((F.count_if(hit) / F.count("*")).alias(name))
    out = one.join(share(lines, F.col("cells") >= max(1, columns - 1), "whole_lines"), keys, "left").join(share(records, F.col("doubts") > 0, "doubtful"), keys, "left").join(share(fields, F.col("refusal").isNotNull(), "unread"), keys, "left")
    w, h = F.col("__p.width"), F.col("__p.height")
    orientation = F.when((w > 0) & (h > 0), F.when(w > h, "landscape").otherwise("portrait")).otherwise("unknown")
    shares = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("whole_lines", "doubtful", "unread")]
    return out.select(*keys, F.lit(columns).alias("columns"), orientation.alias("orientation"), F.coalesce("__p.rotation", F.lit(0)).alias("rotation"), *shares)


def drift(old: DataFrame, new: DataFrame, key: str | list[str], shares: list[str], edges: list[str], structure: list[str], edge_tolerance: float = 0.01, share_tolerance: float = 0.10) -> DataFrame:
    """(key, verdict): `different form` where the structure differs or a side lacks the form, `drift` where an edge or a share moved, else `same`."""
    keys = [key] if isinstance(key, str) else key
    a = old.select(*keys, F.lit(True).alias("in_a"), *(F.col(c).alias(f"a_{c}") for c in [*shares, *edges, *structure]))
    b = new.select(*keys, F.lit(True).alias("in_b"), *(F.col(c).alias(f"b_{c}") for c in [*shares, *edges, *structure]))
    moved = lambda c, by: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > by
    other, drifted = F.col("in_a").isNull() | F.col("in_b").isNull(), F.lit(False)
    for c in structure:
        other = other | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    for c, by in [*((c, edge_tolerance) for c in edges), *((c, share_tolerance) for c in shares)]:
        drifted = drifted | F.coalesce(moved(c, by), F.lit(True))
    return a.join(b, keys, "full_outer").select(*keys, F.when(other, "different form").when(drifted, "drift").otherwise("same").alias("verdict"))


def qualification(reference: DataFrame, pupil: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(missed, extra, compared, agreed): a pupil's rows against the reference's; how much is enough isn't decided here."""
    a = reference.select(*keys, *(F.col(c).cast("string").alias(f"a_{c}") for c in fields), F.lit(True).alias("in_a"))
    b = pupil.select(*keys, *(F.col(c).cast("string").alias(f"b_{c}") for c in fields), F.lit(True).alias("in_b"))
    both = a.join(b, keys, "full_outer")
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    agreed = F.lit(0).cast("long")
    for c in fields:
        agreed = agreed + F.count_if(shared & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")))
    return both.agg(F.count_if(F.col("in_b").isNull()).alias("missed"), F.count_if(F.col("in_a").isNull()).alias("extra"), (F.count_if(shared) * len(fields)).alias("compared"), agreed.alias("agreed"))
