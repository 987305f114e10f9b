"""A family's specification: declarative JSON, validated on the driver and compiled to Columns; data, never code."""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.values import MoneyRules
from ledgerweave.operators import rules as R
from ledgerweave.operators.families import Family

#: Groups that every specification has, with the keys that each needs; fixed values.
GROUPS = {
    "identification": ("family", "issuer", "form_version", "languages", "positive_markers", "negative_markers"), "schema": ("fields",), "addressing": ("tables", "continuation", "record_boundary", "columns", "requisites"),
    "normalisation": ("date_order", "decimal_separator", "group_separator", "currency"), "coverage": ("expected", "allowed_exclusions"), "checks": ("totals", "cross_field", "order", "sequence", "duplicates"),
    "risk": ("critical_fields", "class"), "admission": ("required_rules", "thresholds"), "versioning": ("owner", "approved", "rollback"),
}
TYPES = ("money", "date", "text", "vocabulary", "number")
KINDS = {"date_order": ("first", "second", "relation"), "currency_match": ("own", "other"), "composition": ("condition", "values", "required", "forbidden"), "admissible": ("condition", "when", "value", "allowed"), "bounds": ("value", "low", "high")}
CODE_LIKE = ("eval", "exec", "lambda", "script", "code", "import", "python", "sql")


@dataclass(frozen=True)
class FamilySpec:
    content: dict

    @property
    def family(self) -> Family:
        i = self.content["identification"]
        return Family(i["family"], i["positive_markers"], i["negative_markers"])

    @property
    def money(self) -> MoneyRules:
        n = self.content["normalisation"]
        return MoneyRules(n["decimal_separator"], n["group_separator"], n.get("parentheses_sign", False), n.get("implicit_cents"), n["currency"], n.get("currency_labels", {}))

    def schema(self) -> list[R.Field]:
        """The declared fields as schema_check() takes them."""
        return [R.Field(f["name"], f["type"], f["required"], tuple(f["terms"]) if f.get("terms") is not None else None, f.get("max_digits")) for f in self.content["schema"]["fields"]]

    def bands(self) -> list[tuple[str, float, float]]:
        return [(c["field"], float(Decimal(c["from"])), float(Decimal(c["to"]))) for c in self.content["addressing"]["columns"]]

    def cross_field(self, columns: list[str]) -> list[R.Rule]:
        """The declared rules over a table's columns; a reference is a column or, as requisite:name, a requisite's column."""

        def ref(name: str) -> Column:
            own = f"requisite_{name[10:]}" if name.startswith("requisite:") else name
            return F.col(own) if own in columns else F.lit(None).cast("string")

        made = []
        for n, rule in enumerate(self.content["checks"]["cross_field"]):
            a, kind = rule, rule["kind"]
            status = {
                "date_order": lambda a=a: R.date_order(ref(a["first"]), ref(a["second"]), a["relation"]), "currency_match": lambda a=a: R.currency_match(ref(a["own"]), ref(a["other"])),
                "composition": lambda a=a: R.composition(ref(a["condition"]), a["values"], [ref(x) for x in a["required"]], [ref(x) for x in a["forbidden"]]),
                "admissible": lambda a=a: R.admissible(ref(a["condition"]), a["when"], ref(a["value"]), a["allowed"]), "bounds": lambda a=a: R.bounds(ref(a["value"]), a["low"], a["high"]),
            }.get(kind, lambda: F.lit(R.UNKNOWN))()
            made.append(R.Rule(f"cross_field/{n}/{kind}", status, R.CRITICAL if rule.get("critical") else R.FIXABLE))
        return made or [R.Rule("cross_field/declared", F.lit(R.UNKNOWN))]


def faults(content: object) -> list[str]:
    """What is wrong with a specification's content; empty for a sound one."""
    if not isinstance(content, dict):
        return ["E_SPEC_NOT_OBJECT"]
    found = [f"E_SPEC_GROUP_MISSING {g}" for g in GROUPS if not isinstance(content.get(g), dict)] + [f"E_SPEC_GROUP_UNKNOWN {g}" for g in content if g not in GROUPS]
    found += [f"E_SPEC_KEY_MISSING {g}.{k}" for g, keys in GROUPS.items() if isinstance(content.get(g), dict) for k in keys if k not in content[g]]

    def walk(x: object, path: str) -> None:
        if isinstance(x, float):
            found.append(f"E_SPEC_FLOAT {path}")
        for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
            if isinstance(k, str) and k.lower() in CODE_LIKE:
                found.append(f"E_SPEC_CODE {path}.{k}")
            walk(v, f"{path}.{k}")

    walk(content, "$")
    if found:
        return found
    names = set()
    for f in content["schema"]["fields"]:
        if f.get("type") not in TYPES or not isinstance(f.get("required"), bool) or not f.get("name") or f["name"] in names:
            found.append(f"E_SPEC_FIELD {f.get('name')}")
        names.add(f.get("name"))
    for c in content["addressing"]["columns"]:
        try:
            low, high = Decimal(c["from"]), Decimal(c["to"])
            if not 0 <= low < high <= 1:
                found.append(f"E_SPEC_BAND {c.get('field')}")
        except (InvalidOperation, KeyError, TypeError):
            found.append(f"E_SPEC_BAND {c.get('field')}")
    for r in content["checks"]["cross_field"]:
        if missing := [k for k in KINDS.get(r.get("kind"), ()) if k not in r]:
            found.append(f"E_SPEC_RULE {r.get('kind')} lacks {','.join(missing)}")
    return found


def load(text: str) -> FamilySpec:
    """A specification from JSON text; duplicate keys, floats and code are refused."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("E_SPEC_DUPLICATE_KEY")
        return dict(pairs)

    content = json.loads(text, object_pairs_hook=unique)
    if found := faults(content):
        raise ValueError("; ".join(found))
    return FamilySpec(content)
