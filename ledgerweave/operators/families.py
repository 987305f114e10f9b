"""Recognition of a document's family by markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    name: str
    positive: list[str]
    negative: list[str]


def fits(text: Column, family: Family) -> Column:
    """No negative marker, and a positive one."""
    low = F.lower(text)
    yes, no = F.lit(False), F.lit(False)
    for m in family.positive:
        yes = yes | low.contains(m.lower())
    for m in family.negative:
        no = no | low.contains(m.lower())
    return F.coalesce(yes & ~no, F.lit(False))


def choose_family(text: Column, families: list[Family]) -> Column:
    """Struct (families, family, refusal): the single family that fits, else a refusal."""
    found = F.array_compact(F.array(*(F.when(fits(text, f), f.name) for f in families)))
    n = F.size(found)
    refusal = F.when(n == 0, "E_FAMILY_NONE").when(n > 1, "E_FAMILY_SEVERAL")
    return F.struct(n.cast("long").alias("families"), F.when(n == 1, found[0]).alias("family"), refusal.alias("refusal"))
