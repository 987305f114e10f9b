"""Second readings, text layers, trials of a template, the review screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.rules import PASS, UNKNOWN

TEXT_LAYER, IMAGE = "text_layer", "image"
PATHS = (TEXT_LAYER, IMAGE)


def independence(first_path: Column, first_engine: Column, second_path: Column, second_engine: Column) -> Column:
    """none, partial or full: judged by physical path and engine; an undeclared path gives none, and neither do two engines on one text layer."""
    known = F.coalesce(first_path.isin(*PATHS) & second_path.isin(*PATHS), F.lit(False))
    return F.when(~known, "none").when(first_path != second_path, "full").when(first_engine.eqNullSafe(second_engine) | (first_path == TEXT_LAYER), "none").otherwise("partial")


def layer_rule(layer: Column, second_reading: Column) -> Column:
    """A page by its text layer: a broken, empty or sound layer passes only with a second reading; scans and unread pages can't be told."""
    return F.when(layer.isin("broken", "empty", "text", "mixed") & F.coalesce(second_reading, F.lit(False)), PASS).otherwise(UNKNOWN)


def conjunction(rows: DataFrame, keys: list[str], conjuncts: list[str]) -> DataFrame:
    """(keys, gate, unmet): open where every conjunct is YES; names of those that aren't, a missing one included."""
    unmet = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(c) == "YES", F.lit(False)), c) for c in conjuncts)))
    return rows.select(*keys, F.when(F.size(unmet) == 0, "open").otherwise("closed").alias("gate"), F.concat_ws(",", unmet).alias("unmet"))


def queue_counters(documents: DataFrame, by: list[str], state: str, waiting: str) -> DataFrame:
    """(by, blocked, to_review, ready, in_work): documents by state; to_review counts records that wait for a person."""
    s = F.col(state)
    blocked, review = s == "blocked", (s != "blocked") & (F.col(waiting) > 0)
    ready = (s == "completed") & (F.col(waiting) == 0)
    n = documents.groupBy(*by).agg(F.count_if(blocked).alias("blocked"), F.sum(F.when(review, F.col(waiting)).otherwise(0)).cast("long").alias("to_review"), F.count_if(ready).alias("ready"), F.count_if(~blocked & ~review & ~ready).alias("in_work"))
    return n


def trial(records: DataFrame, fields: list[str], document: list[str], order: list[str], first: int = 10) -> DataFrame:
    """(document, field, state): whether a template's declared fields got cells among a document's first records.

    records: document, order, fields (array of names that got a cell), extra (cells outside all bands).
    """
    rank = F.row_number().over(Window.partitionBy(*document).orderBy(*order))
    tried = records.withColumn("__n", rank).where(F.col("__n") <= first)
    n = tried.groupBy(*document).agg(F.array_distinct(F.flatten(F.collect_list("fields"))).alias("seen"), F.sum("extra").alias("extra"))
    cells = [F.struct(F.lit(c).alias("field"), F.when(F.array_contains("seen", c), "matched").otherwise("vanished").alias("state")) for c in fields]
    cells.append(F.when(F.col("extra") > 0, F.struct(F.lit("outside").alias("field"), F.lit("to_decide").alias("state"))))
    return n.select(*document, F.explode(F.array_compact(F.array(*cells))).alias("__cell")).select(*document, "__cell.*")


def review_screen(fields: DataFrame, evidence: DataFrame, warnings: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of records that wait for a person, with their source fragment and warnings."""
    told = warnings.groupBy(*keys, "field").agg(F.array_sort(F.collect_set("kind")).alias("warnings"))
    waiting = decisions.where("status = 'review'").select(*keys)
    return fields.join(waiting, keys, "left_semi").join(evidence, [*keys, "field"], "left").join(told, [*keys, "field"], "left")


def critical_fields(doubts: DataFrame, group: str, field: str, critical: list[str]) -> DataFrame:
    """(group, fields): the critical fields that a group of doubts touches."""
    return doubts.where(F.col(field).isin(critical)).groupBy(group).agg(F.concat_ws(",", F.array_sort(F.collect_set(field))).alias("fields"))
