"""Canonical records: exact JSON text with sorted keys, and its comparison with another reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = "record/1"


def quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and controls escaped."""
    out = F.regexp_replace(text, '([\\\\"])', "\\\\$1")
    for raw, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        out = F.replace(out, F.lit(raw), F.lit("\\" + name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _object(cells: dict[str, Column]) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), cells[k]) for k in sorted(cells)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical(record_id: Column, anchors: Column, template: Column, decision: Column, fields: dict[str, dict[str, Column]]) -> Column:
    """The canonical text of a record: keys in order, numbers as exact text, no blanks. Null cells are left out."""
    own = {name: _object({k: quoted(c) for k, c in cells.items()}) for name, cells in fields.items()}
    ids = F.concat(F.lit("["), F.concat_ws(",", F.transform(anchors, quoted)), F.lit("]"))
    return _object({"schema_version": F.lit(f'"{SCHEMA_VERSION}"'), "record_id": quoted(record_id), "source_anchor_ids": ids, "template_version": quoted(template), "decision": quoted(decision), "fields": _object(own)})


def differences(first: Column, second: Column, fields: list[str]) -> Column:
    """How many of the fields' raw texts and values differ between two canonical texts, read by JSON paths."""
    count = F.lit(0)
    for name in fields:
        for part in ("raw", "value"):
            path = f"$.fields.{name}.{part}"
            count = count + (~F.get_json_object(first, path).eqNullSafe(F.get_json_object(second, path))).cast("int")
    return count
