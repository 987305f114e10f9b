"""Layout: objects to lines, records, columns and tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of a font's height, and of the page where there is no font, within which objects stand on one line.
LINE_SHARE, LINE_PLAIN = 0.5, 0.004


def sessions(lines: DataFrame, page: list[str], order: list[str], starts: Column) -> DataFrame:
    """lines with record: the number of the record on its page, 0 for lines before the first start."""
    w = Window.partitionBy(*page).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("record", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w).cast("long"))


def record_lengths(lines: DataFrame, page: list[str]) -> DataFrame:
    """(lines, records): how many records have how many lines."""
    n = lines.where("record > 0").groupBy(*page, "record").agg(F.count("*").alias("lines"))
    return n.groupBy("lines").agg(F.count("*").alias("records"))


def cluster_lines(objects: DataFrame, page: list[str], x: str, y: str, font: str | None = None, key: str = "object_id") -> DataFrame:
    """objects with line: by (-y, x), an object joins the line while it is near the line's first object.

    The anchor is the first object and not the one before, so this is a fold
    over a page's objects; a page is one group, and its objects are few.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema) + ", line int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([y, x, key], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        line, anchor, out = 0, None, []
        for row_y, height in zip(pdf[y], pdf[font] if font else [None] * len(pdf), strict=True):
            near = LINE_SHARE * height if height else LINE_PLAIN
            if anchor is None or abs(anchor - row_y) > near:
                line, anchor = line + 1, row_y
            out.append(line)
        return pdf.assign(line=out)

    return objects.groupBy(*page).applyInPandas(fold, schema)


def detect_tables(cells: DataFrame, page: list[str], line: str, x: str, tolerance: float = 0.02, least_lines: int = 2, least_columns: int = 2) -> DataFrame:
    """(page, table, first_line, last_line, columns): runs of consecutive lines that share columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*page).schema) + ", table int, first_line long, last_line long, columns int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [(int(k), sorted(g[x])) for k, g in pdf.groupby(line)]
        found: list[tuple] = []

        def close(run: list[tuple[int, list[float]]], shared: list[float]) -> None:
            if len(run) >= least_lines and len(shared) >= least_columns:
                found.append((len(found) + 1, run[0][0], run[-1][0], len(shared)))

        run: list[tuple[int, list[float]]] = []
        shared: list[float] = []
        for k, xs in lines:
            common = [a for a in shared if any(abs(a - b) <= tolerance for b in xs)]
            if run and k == run[-1][0] + 1 and len(common) >= least_columns:
                run, shared = [*run, (k, xs)], common
            else:
                close(run, shared)
                run, shared = [(k, xs)], xs
        close(run, shared)
        out = pd.DataFrame(found, columns=["table", "first_line", "last_line", "columns"])
        for c in page:
            out[c] = pdf[c].iloc[0]
        return out[[*page, "table", "first_line", "last_line", "columns"]]

    return cells.groupBy(*page).applyInPandas(fold, schema)


def layout_method(objects: DataFrame, document: list[str], kind: str) -> DataFrame:
    """(document, method): how lines are built, by what most objects are."""
    n = objects.groupBy(*document).agg(F.count_if(F.col(kind) == "cell").alias("cells"), F.count_if(F.col(kind) == "record").alias("whole"), F.count("*").alias("n"))
    method = F.when(F.col("cells") * 2 > F.col("n"), "grid").when(F.col("whole") * 2 > F.col("n"), "whole").otherwise("coordinates")
    return n.select(*document, method.alias("method"))


def grid_lines(cells: DataFrame, page: list[str], row: str, column: str, text: str) -> DataFrame:
    """(page, row, cells): the cells of each row of a sheet, in order."""
    return cells.groupBy(*page, row).agg(F.transform(F.sort_array(F.collect_list(F.struct(column, text))), lambda s: s[text]).alias("cells"))


def whole_lines(objects: DataFrame, document: list[str], page: str, path: str, kind: str, text: str, cells: str, label: str) -> DataFrame:
    """(document, line, place, cells, unparsed): whole records are lines of their own, fields of a message one line for each message.

    objects: document, page (the message's number), path, kind, text, cells (a
    map of a record's cells), label (of a message's field). What is neither is
    told as unparsed and not put together by a guess.
    """
    record = F.col(kind) == "record"
    shown = F.when(F.size(cells) > 0, F.transform(F.array_sort(F.map_entries(cells)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).otherwise(F.array(F.coalesce(text, F.lit(""))))
    own = objects.where(record).select(*document, F.col(path).alias("line"), F.lit("record").alias("place"), shown.alias("cells"), F.lit(False).alias("unparsed"))
    fields = objects.where(~record & F.col(label).isNotNull()).groupBy(*document, page).agg(F.transform(F.sort_array(F.collect_list(F.struct(path, label, text))), lambda e: F.concat(e[label], F.lit("="), F.coalesce(e[text], F.lit("")))).alias("cells"))
    told = fields.select(*document, F.concat(F.lit("message["), F.col(page).cast("string"), F.lit("]")).alias("line"), F.lit("message").alias("place"), "cells", F.lit(False).alias("unparsed"))
    rest = objects.where(~record & F.col(label).isNull()).select(*document, F.col(path).alias("line"), F.lit("none").alias("place"), F.array(F.coalesce(text, F.lit(""))).alias("cells"), F.lit(True).alias("unparsed"))
    return own.unionByName(told).unionByName(rest)


def into_bands(cells: DataFrame, x: str, bands: list[tuple[str, float, float]]) -> DataFrame:
    """cells with fields (names of the bands that x falls into) and verdict: one, conflict or extra.

    Bands are declared, so they are expressions and no join is needed.
    """
    names = F.array_compact(F.array(*(F.when((F.col(x) >= low) & (F.col(x) <= high), name) for name, low, high in bands)))
    n = F.size("fields")
    return cells.withColumn("fields", names).withColumn("verdict", F.when(n == 1, "one").when(n > 1, "conflict").otherwise("extra"))


def next_cell(cells: DataFrame, line: list[str], order: list[str], label: Column, text: str) -> DataFrame:
    """(line, name, value): the cell after a label, its first occurrence on each line's document (J09); label is the name or null."""
    w = Window.partitionBy(*line).orderBy(*order)
    told = cells.withColumn("__value", F.lead(text).over(w)).withColumn("__name", label).withColumn("__at", F.row_number().over(w))
    hits = told.where(F.col("__name").isNotNull() & F.col("__value").isNotNull())
    return hits.groupBy(*line, F.col("__name").alias("name")).agg(F.min_by("__value", "__at").alias("value"))


def cleaned_requisite(value: Column, tail: str | None = None, vocabulary: dict[str, str] | None = None) -> Column:
    """A requisite without its declared tail, through its vocabulary."""
    out = F.trim(value)
    if tail:
        out = F.when(out.endswith(tail), F.trim(F.substring(out, F.lit(1), F.char_length(out) - len(tail)))).otherwise(out)
    if vocabulary:
        out = F.coalesce(*(F.when(out == k, v) for k, v in vocabulary.items()), out)
    return out


def repeating_header(lines: DataFrame, document: list[str], page: str, line: str, text: str, most: int = 12, share: float = 0.9) -> DataFrame:
    """(document, text, pages): texts on at least max(2, share of the pages), the first few by line."""
    pages = lines.groupBy(*document).agg(F.count_distinct(page).alias("of"))
    n = lines.groupBy(*document, text).agg(F.count_distinct(page).alias("pages"), F.min(line).alias("at")).join(pages, document)
    often = n.where(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("of") * share)))
    first = F.row_number().over(Window.partitionBy(*document).orderBy("at", text))
    return often.withColumn("k", first).where(F.col("k") <= most).select(*document, text, "pages")


def context(lines: DataFrame, document: list[str], order: list[str], text: str, around: int) -> DataFrame:
    """lines with context: the texts of so many neighbours on each side, in order."""
    w = Window.partitionBy(*document).orderBy(*order).rowsBetween(-around, around)
    return lines.withColumn("context", F.collect_list(text).over(w))


#: How many lines a level of context shows at most; fixed values.
LEVELS = {"field": 0, "line": 1, "neighbours": 3, "table": 12, "page": 120}


def context_levels(lines: DataFrame, page: list[str], order: list[str], text: str, field: str, levels: dict[str, int] = LEVELS) -> DataFrame:
    """(page, order, level, shown, at): what each level shows around a line, from the field alone to the page, and the line's place in it.

    A level shows so many lines with the line in the middle, fewer at the page's
    ends; a page that is longer than its level is cut around the line.
    """
    every = Window.partitionBy(*page).orderBy(*order)
    rows, cells = lines, []
    for name, most in levels.items():
        if most <= 1:
            cells.append(F.struct(F.lit(name).alias("level"), F.array(F.col(field if most == 0 else text)).alias("shown"), F.lit(0).alias("at")))
            continue
        w = every.rowsBetween(-(most // 2), most - most // 2 - 1)
        rows = rows.withColumn(f"__{name}", F.collect_list(text).over(w)).withColumn(f"__{name}_at", F.least(F.row_number().over(every) - 1, F.lit(most // 2)))
        cells.append(F.struct(F.lit(name).alias("level"), F.col(f"__{name}").alias("shown"), F.col(f"__{name}_at").alias("at")))
    return rows.select(*page, *order, F.explode(F.array(*cells)).alias("__l")).select(*page, *order, "__l.*")


def stitch(tables: DataFrame, document: list[str], page: str, must_repeat: bool | None = None, tolerance: float = 0.02) -> DataFrame:
    """(document, page, header_repeated, verdict, chain): a page's last table with the next page's first.

    tables: document, page, first_columns, last_columns (array<double>),
    first_header, last_header. A repeated header stitches and is dropped; one that
    isn't repeated stitches only where the spec says that it isn't; a silent spec
    leaves the pair unresolved.
    """
    w = Window.partitionBy(*document).orderBy(page)
    prev = {c: F.lag(c).over(w) for c in (page, "last_columns", "last_header")}
    rows = tables.withColumn("__page", prev[page]).withColumn("__columns", prev["last_columns"]).withColumn("__header", prev["last_header"])
    same = (F.size("__columns") == F.size("first_columns")) & F.forall(F.arrays_zip(F.col("__columns").alias("a"), F.col("first_columns").alias("b")), lambda p: F.abs(p["a"] - p["b"]) <= tolerance)
    follows = (F.col(page) == F.col("__page") + 1) & same
    repeated = F.col("first_header").eqNullSafe(F.col("__header"))
    open_verdict = {True: "separate", False: "stitched", None: "unresolved"}[must_repeat]
    verdict = F.when(~F.coalesce(follows, F.lit(False)), "separate").when(repeated, "stitched").otherwise(open_verdict)
    rows = rows.withColumn("verdict", verdict).withColumn("header_repeated", F.coalesce(follows & repeated, F.lit(False)))
    chain = F.sum((F.col("verdict") != "stitched").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return rows.withColumn("chain", chain).select(*document, page, "header_repeated", "verdict", "chain")


def stitch_counters(stitched: DataFrame) -> DataFrame:
    """(verdict, pages, headers): how many pages were stitched, left apart or left open, and how many repeated headers were dropped."""
    return stitched.groupBy("verdict").agg(F.count("*").alias("pages"), F.count_if("header_repeated").alias("headers"))


def record_anchor(cells: DataFrame, record: list[str], page: str, x: str, y: str, key: str) -> DataFrame:
    """(record, key): the topmost, then leftmost cell of each record."""
    first = F.min(F.struct(page, (-F.col(y)).alias("up"), x, key)).alias("a")
    return cells.groupBy(*record).agg(first).select(*record, F.col(f"a.{key}").alias(key))


