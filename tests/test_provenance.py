"""Manifests, packages, anchors, priors, stored runs, and the engine over its training document."""

import copy
import io
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerweave import fixtures, manifest
from ledgerweave.functions import values as V
from ledgerweave.operators import journal, provenance
from ledgerweave.plans.governance import SPEC
from ledgerweave.sources import store

KEY = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")


def test_signatures_are_those_of_the_standard():
    """The first test vector of RFC 8032."""
    assert manifest.public_key(KEY).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = manifest.sign(KEY, b"")
    assert signature.hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert manifest.verify(manifest.public_key(KEY), b"", signature) and not manifest.verify(manifest.public_key(KEY), b"x", signature)
    assert not manifest.verify(b"short", b"", signature) and not manifest.verify(manifest.public_key(KEY), b"", signature[:-1] + b"\xff")


def test_manifests_and_rights():
    m = manifest.build([("a", "1"), ("b", "2")], KEY)
    assert manifest.check(m, manifest.public_key(KEY)) == []
    bad = copy.deepcopy(m)
    bad["parts"].pop(0)
    assert manifest.check(bad) == ["E_MANIFEST_POSITIONS", "E_MANIFEST_SIGNATURE"] and manifest.check(m, b"0" * 32) == ["E_MANIFEST_KEY"]
    right = {"owner": "o", "from": "2024-01-01", "to": "2024-12-31", "families": ["f"], "public_key": manifest.public_key(KEY).hex()}
    right["signature"] = manifest.sign(KEY, manifest._canonical(right)).hex()
    assert manifest.right_of_use(right, "2024-06-01", "o", "f") == []
    assert manifest.right_of_use(right, "2025-01-01", "p", "g") == ["E_RIGHT_DATES", "E_RIGHT_OWNER", "E_RIGHT_FAMILY"]
    assert manifest.after_upgrade({"language": "1"}, "2", ("1",), {}) == "keep" and manifest.after_upgrade({"language": "1"}, "2", ("2",), {("1", "2"): 1}) == "convert" and manifest.after_upgrade({"language": "1"}, "2", ("2",), {}, "1.9") == "go back to 1.9"


def test_packages():
    data = json.dumps(SPEC).encode()
    spec, print_ = store.install(data)
    assert spec.content == SPEC and len(print_) == 64

    def packed(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in parts.items():
                z.writestr(k.replace("_", "."), v)
        return out.getvalue()

    assert store.install(packed(spec_json=data))[0].content == SPEC
    with pytest.raises(ValueError, match="E_PACKAGE_CONTENT"):
        store.install(packed(spec_json=data, run_py=b"x"))
    later = copy.deepcopy(SPEC)
    later["versioning"]["min_core"] = "9.0"
    with pytest.raises(ValueError, match="E_PACKAGE_CORE"):
        store.install(json.dumps(later).encode())


def test_runs_are_kept(spark, tmp_path):
    path = str(tmp_path / "run")
    store.save_run({"records": spark.range(3), "decisions": spark.range(2)}, path)
    assert {k: d.count() for k, d in store.load_run(spark, path, ["records", "decisions"]).items()} == {"records": 3, "decisions": 2}
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        store.save_run({"records": spark.range(1)}, path)


def test_anchors_and_evidence(spark):
    df = spark.createDataFrame([("d", 1, "amount", "share", "0.100,0.200"), ("d", 1, "amount", "share", "0.100,0.200"), ("d", 2, "amount", "share", "0.100,0.200"), ("d", 1, "amount", "path", "row[3]")], "document string, page int, role string, system string, place string")
    ids = [r[0] for r in df.select(provenance.anchor_id(*map(F.col, df.columns))).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 32 and ids[3] is None
    fields = spark.createDataFrame([(1, "a", "1", "1", "x", "money"), (1, "b", None, "2", None, "sum"), (1, "c", "3", "3", None, "text")], "r int, field string, raw string, value string, address string, rule string")
    assert [r["reason"] for r in provenance.evidence(fields, ["r"]).orderBy("field").collect()] == [None, "not in the document", "source without places"]


def test_prior_decisions_and_recovery(spark):
    events = spark.createDataFrame([("d", ["a1", "a2"], "confirm", "o", 1), ("d", ["a2"], "reject", "o", 2), ("e", ["a1"], "confirm", "o", 3)], "document_id string, anchors array<string>, action string, operator string, at int")
    records = spark.createDataFrame([("d", "r1", ["a2", "a9"]), ("d", "r2", ["a1"]), ("d", "r3", ["a7"])], "document_id string, record_id string, anchors array<string>")
    assert sorted(map(tuple, provenance.prior_decisions(events, records, ["at"]).collect())) == [("r1", "reject", "o"), ("r2", "confirm", "o")]
    rows = spark.createDataFrame([("s", 1, "p"), ("t", 1, "p"), ("u", 1, "p")], "s string, k int, p string")
    chain = journal.chained(rows, "s", ["k"], "p")
    seen = journal.verify_chain(chain.withColumn("p", F.when(F.col("s") == "u", "x").otherwise(F.col("p"))), "s", "p")
    results = spark.createDataFrame([("s", True), ("t", False), ("v", True)], "s string, complete boolean")
    assert sorted((r[0], r[1]) for r in provenance.recovery(seen, "s", results).collect()) == [("s", "finished"), ("t", "run again"), ("u", "journal broken"), ("v", "no journal")]
    parts = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("t", 1, True)], "s string, part int, linked boolean")
    space = spark.createDataFrame([("s", True, 10), ("t", True, 5), ("v", False, 100)], "s string, writable boolean, free long")
    got = {r["s"]: (r["verdict"], r["codes"]) for r in provenance.recovery(seen, "s", results, parts, space, 8).collect()}
    assert got["s"] == ("journal broken", "E_JOURNAL_PARTS") and got["t"] == ("no room", "E_RESULT_INCOMPLETE,E_NO_SPACE") and got["v"] == ("no journal", "E_JOURNAL_MISSING,E_NOT_WRITABLE")


def test_training_document(spark):
    doc = fixtures.training_document(spark)
    assert doc.count() == 840 and doc.agg(F.max("page")).first()[0] == 53
    typed = V.with_money(doc, F.col("amount_raw"), "m", V.MoneyRules(decimal=",", group=" ")).withColumn("d", V.date(F.col("date_raw"), "DMY"))
    assert typed.where("m.refusal IS NOT NULL OR d.refusal IS NOT NULL").count() == 0
    assert typed.agg(F.sum("m.value")).first()[0] == sum(Decimal(1000 + 137 * i) + Decimal(7 * i % 100) / 100 for i in range(840))
    assert typed.where("record = 839").first()["amount_raw"] == "115 943,73"
    for kind in fixtures.CORRUPTIONS:
        changed = fixtures.corrupted(doc, kind)
        assert changed.exceptAll(doc).count() + doc.exceptAll(changed).count() > 0, kind
