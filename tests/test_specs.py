"""Specifications, migrations, roles and what may leave."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from ledgerweave import specs
from ledgerweave.operators import families, governance, recheck
from ledgerweave.operators import rules as R
from ledgerweave.plans.governance import SPEC


def broken(change):
    content = copy.deepcopy(SPEC)
    change(content)
    return specs.faults(content)


def test_a_sound_specification_has_no_faults():
    assert specs.faults(SPEC) == [] and specs.load(json.dumps(SPEC)).bands() == [("o_totalprice", 0.1, 0.4)]


def test_faults_are_named():
    assert broken(lambda c: c.pop("risk")) == ["E_SPEC_GROUP_MISSING risk"]
    assert broken(lambda c: c.update(extra={})) == ["E_SPEC_GROUP_UNKNOWN extra"]
    assert broken(lambda c: c["risk"].pop("class")) == ["E_SPEC_KEY_MISSING risk.class"]
    assert broken(lambda c: c["risk"].update(share=0.1)) == ["E_SPEC_FLOAT $.risk.share"]
    assert broken(lambda c: c["risk"].update(eval="x")) == ["E_SPEC_CODE $.risk.eval"]
    assert broken(lambda c: c["schema"]["fields"][0].update(type="guess")) == ["E_SPEC_FIELD o_totalprice"]
    assert broken(lambda c: c["addressing"]["columns"][0].update({"from": "0.9"})) == ["E_SPEC_BAND o_totalprice"]
    assert broken(lambda c: c["checks"]["cross_field"][0].pop("low")) == ["E_SPEC_RULE bounds lacks low"]
    assert specs.faults([]) == ["E_SPEC_NOT_OBJECT"]
    with pytest.raises(ValueError, match="DUPLICATE_KEY"):
        specs.load('{"risk": {}, "risk": {}}')


def test_rules_hold_under_renamed_fields(spark):
    """The same results when a field has another name: the engine knows no names of its own."""
    df = spark.createDataFrame([(1, 500), (2, 5000), (3, None)], "k int, o_totalprice int")
    renamed = json.loads(json.dumps(SPEC).replace("o_totalprice", "betrag"))
    a = R.apply_rules(df, ["k"], specs.FamilySpec(SPEC).cross_field(df.columns)).where("rule_id LIKE '%bounds'")
    b = R.apply_rules(df.withColumnRenamed("o_totalprice", "betrag"), ["k"], specs.FamilySpec(renamed).cross_field(["k", "betrag"])).where("rule_id LIKE '%bounds'")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == [(1, "cross_field/0/bounds", "FAIL", "critical"), (2, "cross_field/0/bounds", "PASS", "critical"), (3, "cross_field/0/bounds", "UNKNOWN", "critical")]


def test_no_rules_are_unknown(spark):
    content = copy.deepcopy(SPEC)
    content["checks"]["cross_field"] = []
    df = spark.range(1)
    assert [r["status"] for r in R.apply_rules(df, ["id"], specs.FamilySpec(content).cross_field(["id"])).collect()] == ["UNKNOWN"]
    content["checks"]["cross_field"] = [{"kind": "invented"}]
    assert [r["status"] for r in R.apply_rules(df, ["id"], specs.FamilySpec(content).cross_field(["id"])).collect()] == ["UNKNOWN"]


def test_families(spark):
    declared = [families.Family("a", ["ALPHA"], ["omega"]), families.Family("b", ["beta"], [])]
    df = spark.createDataFrame([("Alpha",), ("alpha beta",), ("alpha omega",), (None,)], "t string").select(families.choose_family(F.col("t"), declared).alias("c"))
    assert [(r["c"]["family"], r["c"]["refusal"]) for r in df.collect()] == [("a", None), (None, "E_FAMILY_SEVERAL"), (None, "E_FAMILY_NONE"), (None, "E_FAMILY_NONE")]


def test_migrations(spark):
    m = governance.Migrations()
    keep = lambda d: d
    for a, b in (("1", "2"), ("2", "3"), ("1", "2b"), ("2b", "4"), ("3", "4")):
        m.add("x", a, b, keep)
    m.add("x", "4", "5", lambda d: d.where("id <> 1"))
    assert m.route("x", "1", "4") == [("1", "2b"), ("2b", "4")] and m.route("x", "3", "3") == []
    with pytest.raises(ValueError, match="no route"):
        m.route("x", "5", "1")
    with pytest.raises(ValueError, match="is there"):
        m.add("x", "1", "2", keep)
    now, lost = m.migrate(spark.range(3), "x", "1", "5", ["id"])
    assert now.count() == 2 and [tuple(r) for r in lost.collect()] == [(1, "before", 1)] and now.first()["migrated"] == "1>2b>4>5"


def test_roles_and_outgoing(spark):
    df = spark.createDataFrame([("operator", "confirm"), ("auditor", "confirm"), ("nobody", "confirm"), (None, "confirm"), ("administrator", "grant")], "r string, w string")
    assert [r[0] for r in df.select(governance.permitted(F.col("r"), F.col("w"))).collect()] == [True, False, False, False, True]
    rows = spark.createDataFrame([("extract", "1.0a", 5, True, "x"), ("40817810", "v1", 5, True, "x"), ("extract", "v1", -5, True, "x"), ("some words", "v1", 1, None, "x")], "stage string, version string, records int, ok boolean, secret string")
    out = governance.outgoing(rows)
    assert "secret" not in out.columns and [r["refusal"] for r in out.collect()] == [None, "stage", "records", "stage"]


def test_independence_and_layers(spark):
    of = lambda a, x, b, y: spark.range(1).select(recheck.independence(F.lit(a), F.lit(x), F.lit(b), F.lit(y))).first()[0]
    assert of("text_layer", "a", "image", "a") == "full" and of("text_layer", "a", "text_layer", "b") == "none" and of("image", "a", "image", "b") == "partial"
    assert of("image", "a", "image", "a") == "none" and of("image", "a", "paper", "b") == "none" and of(None, "a", "image", "b") == "none"
    layer = lambda name, second: spark.range(1).select(recheck.layer_rule(F.lit(name), F.lit(second))).first()[0]
    assert layer("broken", True) == layer("text", True) == layer("empty", True) == "PASS" and layer("text", None) == layer("scan", True) == layer("odd", True) == "UNKNOWN"
