"""Operators on literal rows: every branch of a tri-state, ties, nulls and empty tables."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import values as V
from ledgerweave.operators import compare, coverage, journal, layout, quality, sampling, totals
from ledgerweave.operators import rules as R
from ledgerweave.operators.graph import connected_components


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def money(spark, texts, **rules):
    df = V.with_money(frame(spark, list(enumerate(texts)), "k int, t string"), F.col("t"), "m", V.MoneyRules(**rules))
    return [(None if r["m"]["value"] is None else str(r["m"]["value"].normalize() + 0), r["m"]["currency"], r["m"]["refusal"]) for r in df.orderBy("k").collect()]


def test_money_separators(spark):
    texts = ["1.234,50", "1,234.50", "1.234.567", "1.234", "12.5", "1 234,5", "12", "", None, "abc", "-", "1.2x"]
    want = ["1234.5", "1234.5", "1234567", "E_TYPE_AMBIGUOUS_AMOUNT", "12.5", "1234.5", "E_TYPE_AMBIGUOUS_AMOUNT", "E_TYPE_EMPTY", "E_TYPE_EMPTY", "E_TYPE_NOT_A_NUMBER", "E_TYPE_NOT_A_NUMBER", "E_TYPE_NOT_A_NUMBER"]
    out = money(spark, texts)
    assert [str(Decimal(v)) if v and "E" not in v else (v and format(Decimal(v), "f")) or e for v, _, e in out] == want


def test_money_declared(spark):
    assert money(spark, ["1.5", "1,50", "1,5,0"], decimal=",") == [(None, None, "E_TYPE_NO_RULE"), ("1.5", None, None), (None, None, "E_TYPE_NOT_A_NUMBER")]
    assert money(spark, ["1.500", "1.500,25"], decimal=",", group=".") == [(None, None, "E_TYPE_AMBIGUOUS_AMOUNT"), ("1500.25", None, None)]
    assert money(spark, ["5", "12345"], implicit_cents=True) == [("0.05", None, None), ("123.45", None, None)]
    assert money(spark, ["(1,5)"], decimal=",") == [(None, None, "E_TYPE_NO_RULE")]
    assert money(spark, ["(1,5)", "1,5-", "+1,5", "- 1,5"], decimal=",", parentheses=True) == [("-1.5", None, None), ("-1.5", None, None), ("1.5", None, None), ("-1.5", None, None)]
    labels = {"R": "XXX", "RUR": "RUB", "eur": "EUR"}
    assert money(spark, ["-6,75 rur", "1,5 EUR", "1,5 R", "1,5", "1,5 USD"], decimal=",", currency="USD", labels=labels) == [("-6.75", "RUB", None), ("1.5", "EUR", None), ("1.5", "XXX", None), ("1.5", "USD", None), (None, None, "E_TYPE_NOT_A_NUMBER")]


def test_dates(spark):
    texts = ["2024-02-29", "2023-02-29", "03.04.2024", "31/12/2024", "1.2.24", "31.02.2024", "x", None, " 5-6-2024 "]
    df = frame(spark, list(enumerate(texts)), "k int, t string")
    of = lambda order: [(str(r["d"]["value"]) if r["d"]["value"] else r["d"]["refusal"]) for r in df.select("k", V.date(F.col("t"), order).alias("d")).orderBy("k").collect()]
    bad = ["E_TYPE_NOT_A_DATE", "E_TYPE_NOT_A_DATE"]
    assert of("DMY") == ["2024-02-29", "E_TYPE_DATE_INVALID", "2024-04-03", "2024-12-31", "E_TYPE_AMBIGUOUS_DATE", "E_TYPE_DATE_INVALID", *bad, "2024-06-05"]
    assert of("MDY")[2:4] == ["2024-03-04", "E_TYPE_DATE_INVALID"]
    assert of(None)[2:] == ["E_TYPE_AMBIGUOUS_DATE"] * 4 + bad + ["E_TYPE_AMBIGUOUS_DATE"]


def test_text_and_rounding(spark):
    row = frame(spark, [("é \t x y\u0007ﬁ", Decimal("2.50"), Decimal("-2.50"), Decimal("0.0625"))], "t string, a decimal(9,2), b decimal(9,2), c decimal(9,4)")
    r = row.select(V.normal_text(F.col("t")).alias("n"), V.policy_text(F.col("t"), compat=True, nbsp="space").alias("p")).first()
    assert r["n"] == "é x y\u0007ﬁ" and r["p"]["value"].endswith("yfi") and r["p"]["compat_changed"]
    for mode, want in {"half_up": (3, -3), "half_down": (2, -2), "half_even": (2, -2), "up": (3, -3), "down": (2, -2)}.items():
        assert tuple(int(x) for x in row.select(V.rounded(F.col("a"), 0, mode), V.rounded(F.col("b"), 0, mode)).first()) == want
    assert str(row.select(V.snapped(F.col("c"))).first()[0]) in ("0.062", "0.063")
    assert row.select(V.percent(F.lit(2), F.lit(3)), V.percent(F.lit(1), F.lit(0))).first() == (66, 0)


def test_cross_field_rules_are_tri_state(spark):
    df = frame(spark, [(1, 2, "a"), (2, 1, "b"), (None, 1, None)], "x int, y int, c string")
    of = lambda c: [r[0] for r in df.select(c).collect()]
    assert of(R.date_order(F.col("x"), F.col("y"), "not_later")) == ["PASS", "FAIL", "UNKNOWN"] and of(R.date_order(F.col("x"), F.col("y"), "both")) == ["UNKNOWN"] * 3
    assert of(R.currency_match(F.col("x"), F.col("y"))) == ["FAIL", "FAIL", "UNKNOWN"]
    assert of(R.composition(F.col("c"), ["a"], [F.col("x")], [F.col("y")])) == ["FAIL", "PASS", "UNKNOWN"]
    assert of(R.admissible(F.col("c"), ["a", "b"], F.col("x"), [1])) == ["PASS", "FAIL", "UNKNOWN"]
    assert of(R.bounds(F.col("x"), "1.5", None)) == ["FAIL", "PASS", "UNKNOWN"] and of(R.bounds(F.col("x"), None, None)) == ["UNKNOWN"] * 3
    assert of(R.bounds(F.lit("NaN"), "0", "1")) == ["FAIL"] * 3 and of(R.cross_field("other")) == ["UNKNOWN"] * 3


def test_order_gaps_duplicates(spark):
    df = frame(spark, [("a", 1, 1), ("a", 2, 1), ("a", 3, 5), ("a", 4, 4), ("b", 1, None), ("b", 2, 3), ("c", 1, 9)], "d string, pos int, v int")
    assert got(R.order_check(df, ["d"], ["pos"], "v", "ascending")) == [("a", "FAIL", 1), ("b", "UNKNOWN", 0), ("c", "PASS", 0)]
    assert {r[1] for r in got(R.order_check(df, ["d"], ["pos"], "v", None))} == {"UNKNOWN"} and {r[1] for r in got(R.order_check(df, ["d"], ["pos"], "v", "insignificant"))} == {"PASS"}
    assert got(R.gap_check(df, ["d"], "v", "forbidden")) == [("a", "FAIL", 2, 1, [2, 3]), ("b", "UNKNOWN", 0, 0, []), ("c", "PASS", 0, 0, [])]
    of = lambda *how: [r[1] for r in got(R.gap_check(df, ["d"], "v", *how))]
    assert of("allowed") == ["PASS", "UNKNOWN", "PASS"] and of("silent") == ["UNKNOWN", "UNKNOWN", "PASS"] and of(None) == ["UNKNOWN"] * 3
    assert of("not_a_sequence", "numbers of others") == ["PASS"] * 3 and of("not_a_sequence") == ["UNKNOWN"] * 3
    far = frame(spark, [("a", 1), ("a", 10**9), ("b", 1), ("b", 3), ("b", 40)], "d string, v long")
    assert got(R.gap_check(far, ["d"], "v", "forbidden")) == [("a", "FAIL", 10**9 - 2, 1, list(range(2, 22))), ("b", "FAIL", 37, 2, [2, *range(4, 23)])]
    assert got(R.gap_check(frame(spark, [("a", 1.5), ("a", 3.0)], "d string, v double"), ["d"], "v", "forbidden"))[0][1] == "UNKNOWN"
    assert got(R.inversions(df, ["d"], ["pos"], "v", "ascending")) == [("a", 4, 5, 4)] and got(R.inversions(df, ["d"], ["pos"], "v", "descending")) == [("a", 3, 1, 5)]
    assert got(R.parse_duplicates(df, ["d", "v"]))[:3] == [("a", 1, "FAIL", 2), ("a", 4, "PASS", 1), ("a", 5, "PASS", 1)]
    assert ("b", None, "UNKNOWN", 1) in got(R.parse_duplicates(df, ["d", "v"]))
    assert sorted(r[1] for r in got(R.source_duplicates(df, F.coalesce(F.col("v").cast("string"), F.lit("")), "pos", "forbidden"))) == ["FAIL", "PASS", "PASS", "PASS", "PASS", "PASS"][:1] + ["PASS"] * 5
    empty = df.limit(0)
    assert got(R.order_check(empty, ["d"], ["pos"], "v", "ascending")) == [] == got(R.gap_check(empty, ["d"], "v", None))


def test_fold_and_decide(spark):
    df = frame(spark, [("a", "x", "PASS", "critical"), ("b", "x", "UNKNOWN", "critical"), ("b", "x", "PASS", "critical"), ("c", "x", "FAIL", "fixable"), ("d", "x", "FAIL", "critical"), ("d", "x", "UNKNOWN", "critical"), ("e", "x", "odd", "critical")], "r string, conjunct string, status string, severity string")
    folded = R.fold(df, ["r", "conjunct"])
    assert [(r[0], r[2], r[3]) for r in got(folded)] == [("a", "YES", False), ("b", "UNKNOWN", False), ("c", "NO", False), ("d", "NO", True), ("e", "UNKNOWN", False)]
    records = frame(spark, [(k,) for k in "abcdef"], "r string")
    decided = R.decide(records, folded, ["r"], ["x"])
    assert [(r[0], r[1], r[2]) for r in got(decided)] == [("a", "accepted_auto", "DATA"), ("b", "review", "REVIEW"), ("c", "review", "REVIEW"), ("d", "rejected", "REJECTED"), ("e", "review", "REVIEW"), ("f", "review", "REVIEW")]
    assert {r[1] for r in got(R.decide(records, folded, ["r"], ["x"], run_ok=False))} == {None}
    assert [r[3] for r in got(R.decide(records, folded, ["r"], ["x", "missing"]))] == [1, 2, 2, 2, 2, 2]
    both = folded.unionByName(frame(spark, [("a", "x", "NO", True)], "r string, conjunct string, state string, critical boolean"))
    assert got(R.decide(records, both, ["r"], ["x"]))[0][1:] == (None, "ERRORS", 1, "E_CONJUNCT_CONTRADICTED")
    odd = folded.unionByName(frame(spark, [("a", "y", "NO", True)], "r string, conjunct string, state string, critical boolean"))
    assert got(R.decide(records, odd, ["r"], ["x"]))[0][1:] == (None, "ERRORS", 0, "E_CONJUNCT_UNKNOWN") and len(R.CONJUNCTS) == 11
    assert {r[1] for r in got(R.decide(records, folded, ["r"]))} == {None, "review"}  # x isn't of the formula
    runs = decided.withColumn("run", F.when(F.col("r") == "a", 1).otherwise(2))
    assert got(R.run_state(runs, ["run"])) == [(1, "completed"), (2, "partial")] and got(R.run_state(runs, ["run"], F.col("r") == "a", F.col("r") == "b")) == [(1, "blocked"), (2, "failed")]


def test_folding_in_the_row_is_the_same(spark):
    df = frame(spark, [(k, a, b, c) for k, (a, b, c) in enumerate([(x, y, z) for x in ("PASS", "FAIL", "UNKNOWN", None) for y in ("PASS", "FAIL", "odd", None) for z in ("PASS", "FAIL", None)])], "k int, a string, b string, c string")
    rules = {"one": [R.Rule("a", F.col("a")), R.Rule("b", F.col("b"), R.FIXABLE)], "two": [R.Rule("c", F.col("c"))]}
    results = None
    for name, own in rules.items():
        part = R.fold(R.apply_rules(df, ["k"], own), ["k"]).withColumn("conjunct", F.lit(name))
        results = part if results is None else results.unionByName(part)
    assert got(R.decide(df, R.observe(df, ["k"], rules), ["k"], ["one", "two"])) == got(R.decide(df, results, ["k"], ["one", "two"]))
    bad = frame(spark, [(1, "PASS"), (1, "FAIL"), (1, "PASS"), (2, "PASS"), (2, None), (3, None)], "k int, a string")
    assert got(R.observe(bad, ["k"], {"c": [R.Rule("a", F.col("a"))]})) == [(1, "c", "NO", True), (2, "c", "YES", False), (3, "c", "UNKNOWN", False)]  # one bad row of several decides
    assert got(R.decide_in_row(df, ["k"], rules)) == got(R.decide(df, results, ["k"], ["one", "two"]))
    assert {r[1] for r in got(R.decide_in_row(df, ["k"], rules, run_ok=False))} == {None}


def test_schema_rules(spark):
    spec = [R.Field("a", "money", True, max_digits=2), R.Field("v", "vocabulary", terms=("x",)), R.Field("w", "vocabulary"), R.Field("q", None)]
    cells = "r int, a struct<raw: string, kind: string, refusal: string, value_text: string, digits: int>, v struct<raw: string, kind: string, refusal: string, value_text: string, digits: int>, w struct<raw: string, kind: string, refusal: string, value_text: string, digits: int>, z struct<raw: string, kind: string, refusal: string, value_text: string, digits: int>, more array<string>"
    rows = [(1, ("1.5", "money", None, "1.5", 1), ("y", "vocabulary", None, "y", None), ("q", "vocabulary", None, "q", None), ("?", "text", None, "?", None), ["odd"]), (2, (" ", "money", None, None, None), ("bad", None, "E", None, None), None, None, []), (3, None, None, None, None, []), (4, ("1.555", "money", None, "1.555", 3), None, None, None, [])]
    records = frame(spark, rows, cells)
    out = {(r, f, rule): s for r, f, rule, s in got(R.schema_check(records, ["r"], spec, {c: F.col(c) for c in ("a", "v", "w", "z")}, F.col("more")))}
    assert out[4, "a", "precision"] == "FAIL" and out[1, "odd", "unknown_field"] == "FAIL" and (2, "z", "unknown_field") not in out and out[3, "q", "presence"] == "PASS"
    assert [r[1:] for r in got(R.schema_check(records.limit(1), ["r"], [], {}))] == [(None, "declared", "UNKNOWN")]
    assert out[1, "a", "type"] == out[1, "a", "precision"] == "PASS" and out[1, "v", "vocabulary"] == "FAIL" and out[1, "w", "vocabulary"] == "UNKNOWN" and out[1, "z", "unknown_field"] == "FAIL"
    assert out[2, "a", "empty_value"] == "FAIL" and (2, "a", "type") not in out and out[2, "v", "uninterpreted"] == "FAIL"
    assert out[3, "a", "presence"] == "FAIL" and out[3, "v", "presence"] == "PASS"


def test_totals(spark):
    rows = frame(spark, [(1, "A", Decimal("10.00"), "in"), (1, "A", Decimal("4.00"), "out"), (1, "B", Decimal("1.00"), "in"), (2, "A", Decimal("1.00"), "?"), (3, "A", Decimal("-1.00"), "in")], "d int, c string, a decimal(18,2), m string")
    records = rows.select("d", F.col("c").alias("currency"), totals.side(F.col("a"), F.col("m"), ["in"], ["out"]).alias("s")).select("d", "currency", "s.*")
    declared = frame(spark, [(d, n, c, Decimal(v)) for d, n, c, v in [(1, "opening", "A", "1"), (1, "closing", "A", "7"), (1, "opening", "B", "0"), (1, "closing", "B", "2"), (1, "opening", "C", "5"), (2, "opening", "A", "0"), (2, "closing", "A", "1"), (3, "opening", "A", "0"), (3, "closing", "A", "-1")]], "d int, name string, currency string, value decimal(38,2)")
    assert [(r[0], r[1], r[2]) for r in got(totals.balance(records, declared, ["d"]))] == [(1, "A", "PASS"), (1, "B", "FAIL"), (1, "C", "UNKNOWN"), (2, "A", "UNKNOWN"), (3, "A", "UNKNOWN")]
    again = declared.unionByName(frame(spark, [(1, "closing", "A", Decimal("8"))], "d int, name string, currency string, value decimal(38,2)"))
    assert {r[2] for r in got(totals.balance(records, again, ["d"])) if r[0] == 1} == {"UNKNOWN"}
    assert [r[1] for r in got(totals.single_currency_sum(rows, ["d"], "a", "c"))] == ["FAIL", "PASS", "PASS"]
    big = frame(spark, [(1, "A", Decimal(9 * 10**35)), (1, "A", Decimal(9 * 10**35))], "d int, c string, a decimal(38,2)")
    assert got(totals.single_currency_sum(big, ["d"], "a", "c"))[0][1] == "UNKNOWN"  # beyond 38 digits: told, not wrapped
    control = frame(spark, [(1, Decimal("15")), (2, None), (3, Decimal("1")), (4, Decimal("0"))], "d int, value decimal(18,2)")
    assert [(r[0], r[1], r[2]) for r in got(totals.control_totals(rows.select("d", F.col("a").alias("amount")), control, ["d"]))] == [(1, "PASS", "fixable"), (2, "UNKNOWN", "fixable"), (3, "FAIL", "critical"), (4, "PASS", "fixable")]
    scopes = frame(spark, [("s", 1), ("t", 1), ("t", 2)], "name string, d int")
    assert got(totals.scope_cover(control.select("d"), scopes, "d")) == [(1, "overlap"), (3, "uncovered"), (4, "uncovered")]
    assert totals.in_scope(control, scopes, "d", "t").count() == 2 and totals.in_scope(control, scopes, "d", "whole").count() == 4


def test_money_is_never_rounded(spark):
    assert money(spark, ["1.005", "12.3456", "0.0000001", "1.50", "-0.00", "007.10", "9" * 32 + ".5", "9" * 33 + ".5"], decimal=".") == [
        ("1.005", None, None), ("12.3456", None, None), (None, None, "E_TYPE_PRECISION"), ("1.5", None, None), ("0", None, None), ("7.1", None, None), (money(spark, ["9" * 32 + ".5"], decimal=".")[0][0], None, None), (None, None, "E_TYPE_PRECISION")
    ]
    df = V.with_money(frame(spark, [("1.50",), ("-0.00",), ("007.100",), (".5",), ("12.3456",)], "t string"), F.col("t"), "m", V.MoneyRules(decimal="."))
    assert [(r["m"]["text"], r["m"]["digits"]) for r in df.collect()] == [("1.50", 2), ("0.00", 2), ("7.100", 3), ("0.5", 1), ("12.3456", 4)]


def test_sums_keep_their_digits(spark):
    side = lambda rows: rows.select("d", "currency", totals.side(F.col("a")).alias("s")).select("d", "currency", "s.*")
    ends = lambda *rows: frame(spark, [(d, n, "A", Decimal(v)) for d, n, v in rows], "d int, name string, currency string, value decimal(38,3)")
    halves = frame(spark, [(1, "A", Decimal("0.005")), (1, "A", Decimal("0.005"))], "d int, currency string, a decimal(9,3)")
    assert [(r[2], str(r[3])) for r in got(totals.balance(side(halves), ends((1, "opening", "0"), (1, "closing", "0.01")), ["d"]))] == [("PASS", "0.010")]
    assert got(totals.balance(side(halves), ends((1, "opening", "0"), (1, "closing", "0.02")), ["d"]))[0][2] == "FAIL"
    nines = frame(spark, [(1, Decimal("9" * 36))] * 3, "d int, amount decimal(38,2)")
    zero = frame(spark, [(1, Decimal("0.00")), (2, Decimal("0.00"))], "d int, value decimal(38,2)")
    assert [(r[0], r[1], r[3]) for r in got(totals.control_totals(nines, zero, ["d"]))] == [(1, "UNKNOWN", None), (2, "PASS", Decimal("0.00"))]  # beyond 38 digits isn't a sum of nothing
    big = nines.select("d", F.lit("A").alias("currency"), F.col("amount").alias("a"))
    assert got(totals.balance(side(big), frame(spark, [(1, "opening", "A", Decimal(0)), (1, "closing", "A", Decimal(0))], "d int, name string, currency string, value decimal(38,2)"), ["d"]))[0][2:4] == ("UNKNOWN", None)
    assert got(totals.parts_vs_whole(nines, zero, ["d"], "amount", "value"))[0][1] == "UNKNOWN"
    # Digits that differ are compared by a declared rounding only.
    three, two = frame(spark, [(1, Decimal("1.005"))], "d int, amount decimal(9,3)"), frame(spark, [(1, Decimal("1.01"))], "d int, value decimal(9,2)")
    of = lambda rule: got(totals.control_totals(three, two, ["d"], rounding=rule))[0][1]
    assert of(None) == "UNKNOWN" and of((2, "half_up")) == "PASS" and of((2, "half_even")) == "FAIL" and of((2, "down")) == "FAIL"
    with pytest.raises(TypeError, match="E_TYPE_FLOAT_FORBIDDEN"):
        totals.control_totals(three.withColumn("amount", F.col("amount").cast("double")), two, ["d"])
    wide = frame(spark, [(1, Decimal("0.123456789012"))] * 3, "d int, amount decimal(38,12)")
    assert got(totals.control_totals(wide, frame(spark, [(1, Decimal("0.370370367036"))], "d int, value decimal(38,12)"), ["d"]))[0][1] == "PASS"


def test_troubles_and_the_whole_set(spark):
    rows = frame(spark, [(1, 1, Decimal("5"), "A"), (1, 2, Decimal("7"), "A"), (2, 1, None, "A"), (2, 2, Decimal("1"), ""), (3, 1, Decimal("2"), "A"), (4, 1, Decimal("2"), "A"), (4, 2, Decimal("3"), "B")], "d int, r int, amount decimal(9,2), currency string")
    assert got(totals.collect_amounts(rows, ["d"], "amount", "currency")[1]) == [(2, "no_currency", "UNKNOWN", 1), (2, "no_value", "UNKNOWN", 1)]
    doubles = frame(spark, [(1, 1.5, "A"), (1, float("nan"), "A"), (1, float("inf"), "A"), (1, None, "A")], "d int, amount double, currency string")
    assert {(r[1], r[2], r[3]) for r in got(totals.collect_amounts(doubles, ["d"], "amount", "currency")[1])} == {("binary_fraction", "FAIL", 1), ("not_a_number", "FAIL", 2), ("no_value", "UNKNOWN", 1)}
    declared = frame(spark, [(1, "all", "A", Decimal("12")), (1, "p", "A", Decimal("5")), (1, "q", "A", Decimal("7")), (2, "all", "A", Decimal("1")), (4, "all", "A", Decimal("2")), (4, "all", None, Decimal("2"))], "d int, name string, currency string, value decimal(9,2)")
    scopes = frame(spark, [(1, 1, "p"), (1, 2, "q")], "d int, r int, name string")
    out = {(r["d"], r["rule_id"], r["name"], r["currency"]): r["status"] for r in totals.control_set(rows, declared, ["d"], "r", scopes=scopes).collect()}
    assert out == {
        (1, "sum/control", "all", "A"): "PASS", (1, "sum/control", "p", "A"): "PASS", (1, "sum/control", "q", "A"): "PASS", (1, "sum/parts", "all", "A"): "PASS", (1, "sum/cover", None, None): "PASS",
        (2, "sum/control", "all", "A"): "UNKNOWN", (2, "money/no_value", None, None): "UNKNOWN", (2, "money/no_currency", None, None): "UNKNOWN", (3, "sum/declared", None, None): "UNKNOWN",
        (4, "sum/control", "all", "A"): "PASS", (4, "sum/control", "all", None): "UNKNOWN",
    }
    twice = scopes.unionByName(frame(spark, [(1, 1, "q")], "d int, r int, name string"))
    again = {(r["rule_id"], r["status"]) for r in totals.control_set(rows.where("d = 1"), declared.where("d = 1"), ["d"], "r", scopes=twice).collect()}
    assert ("sum/overlap", "FAIL") in again and ("sum/control", "FAIL") in again
    short = totals.control_set(rows.where("d = 1"), declared.where("d = 1 AND name <> 'q'"), ["d"], "r", scopes=scopes)
    assert {(r["rule_id"], r["status"]) for r in short.collect()} >= {("sum/cover", "UNKNOWN"), ("sum/parts", "FAIL")}
    assert got(totals.totals_hold(short, ["d"])) == [(1, False)] and totals.control_set(rows.limit(0), declared.limit(0), ["d"], "r").count() == 0


def test_vocabulary_folds_case(spark):
    df = frame(spark, [("STRASSE",), ("Straße",), (" straße\t",), ("ΣΊΣΥΦΟΣ",), ("cafe\u0301",), ("",), (None,), ("x",)], "t string")
    out = [(r[0]["value"], r[0]["refusal"]) for r in df.select(V.vocabulary_term(F.col("t"), {"Straße": "street", "σίσυφος": "s", "Café": "c"})).collect()]
    assert out == [("street", None)] * 3 + [("s", None), ("c", None), (None, "E_TYPE_EMPTY"), (None, "E_TYPE_EMPTY"), (None, "E_TYPE_NOT_IN_VOCABULARY")]
    with pytest.raises(ValueError, match="CONTRADICTION"):
        V.vocabulary_term(F.col("t"), {"A": "1", "a": "2"})


def test_completeness(spark):
    docs = frame(spark, [(k,) for k in range(1, 6)], "d int")
    expected = frame(spark, [(1, "x", 2), (2, "x", 2), (4, "x", 1), (4, "x", 2), (5, "x", 1)], "d int, kind string, expected long")
    found = frame(spark, [(1, "x"), (2, "x"), (2, "x"), (5, "x")], "d int, kind string")
    over = coverage.coverage_map(expected, found, frame(spark, [(1, "x")], "d int, kind string"), ["d"])
    assert [(r[0], r[-1]) for r in got(over)] == [(1, 0), (2, 0), (4, 1), (4, 2), (5, 0)] and got(coverage.disputes(expected, ["d"])) == [(4, "x")]
    assert got(coverage.completeness(docs, over, ["d"], doubts=frame(spark, [(5,)], "d int"))) == [(1, "complete"), (2, "complete"), (3, "unknown"), (4, "unknown"), (5, "unknown")]
    assert {r[1] for r in got(coverage.completeness(docs, over, ["d"], mechanisms_missing=True))} == {"unknown"}


def test_components(spark):
    for seed in range(4):
        rng = random.Random(seed)
        links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3), (7, 8), (7, 8)] + [(100 + k, 101 + k) for k in range(40)]
        parent = {n: n for e in links for n in e if n is not None}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            if a is not None and b is not None:
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        linked = {n for a, b in links if a is not None and b is not None and a != b for n in (a, b)}
        assert dict(got(connected_components(frame(spark, links, "a int, b int")))) == {n: root(n) for n in linked}
    assert connected_components(frame(spark, [], "a int, b int")).count() == 0


def test_selection(spark):
    rows = frame(spark, [(k, ["low"] if k % 10 == 0 else []) for k in range(200)], "id int, reasons array<string>")
    out = dict(got(sampling.select_for_recheck(rows, "id", "stable", 0.1, "s")))
    assert len(out) == 40 and out == dict(got(sampling.select_for_recheck(rows.repartition(7), "id", "stable", 0.1, "s")))
    assert sampling.select_for_recheck(rows, "id", "calibration").count() == 200
    with pytest.raises(ValueError):
        sampling.select_for_recheck(rows, "id", "stable", 0.1)
    m = frame(spark, [(1, 100, 1, True), (2, 10, 0, True), (3, 100, 50, True), (4, 100, 1, False), (5, None, 1, True)], "k int, observations long, errors long, same_version boolean")
    assert [r[-1] for r in got(sampling.gate(m, ["k"], 0.1))] == ["open", "rule_of_three", "error_share", "version", "metrics"] and {r[-1] for r in got(sampling.gate(m, ["k"], None))} == {"threshold"}
    none = frame(spark, [(k,) for k in range(1000)], "id int").withColumn("reasons", F.array().cast("array<string>"))
    assert [sampling.select_for_recheck(none, "id", "stable", x, "s").count() for x in ("0.00004", 0.001, "0.5005", 1)] == [1, 1, 501, 1000]
    first = [r["id"] for r in none.orderBy(sampling.sample_key("s", F.col("id")), "id").limit(501).collect()]
    sampling_edge, sampling.EDGE = sampling.EDGE, 3  # so that several rounds of counting are needed
    assert sorted(r["id"] for r in sampling.select_for_recheck(none, "id", "stable", "0.5005", "s").collect()) == sorted(first)
    sampling.EDGE = sampling_edge
    clusters = frame(spark, [(k, 1 + k % 5) for k in range(50)], "cluster int, size long")
    parts = sampling.split_corpus(clusters, "z")
    sizes = {r["part"]: r["n"] for r in parts.join(clusters, "cluster").groupBy("part").agg(F.sum("size").alias("n")).collect()}
    assert parts.count() == 50 and abs(sizes["development"] - 90) <= 5 and abs(sizes["closed"] - 30) <= 5
    with pytest.raises(ValueError):
        sampling.split_corpus(clusters.limit(2), "z")


def test_line_clustering_is_anchored(spark):
    rows = [(1, k, 0.1 * k, y) for k, y in enumerate([0.5, 0.4971, 0.4942, 0.4913, 0.2])]
    out = layout.cluster_lines(frame(spark, rows, "page int, object_id int, x double, y double"), ["page"], "x", "y")
    assert [r["line"] for r in out.orderBy("object_id").collect()] == [1, 1, 2, 2, 3]  # neighbours are near, but not the line's first object


def test_tables_and_stitching(spark):
    cells = [(1, line, x) for line in (1, 2, 3) for x in (0.1, 0.5 + line * 0.005)] + [(1, 5, 0.1), (1, 6, 0.1), (1, 6, 0.5)]
    assert got(layout.detect_tables(frame(spark, cells, "page int, line int, x double"), ["page"], "line", "x")) == [(1, 1, 1, 3, 2)]
    pages = [(1, p, [0.1, 0.5 + (p == 4) * 0.1], [0.1, 0.5 + (p == 4) * 0.1], "h" if p != 3 else "g", "h" if p != 3 else "g") for p in (1, 2, 3, 4, 6)]
    t = frame(spark, pages, "d int, page int, first_columns array<double>, last_columns array<double>, first_header string, last_header string")
    of = lambda must: [r[3] for r in got(layout.stitch(t, ["d"], "page", must))]
    assert of(None) == ["separate", "stitched", "unresolved", "separate", "separate"] and of(True)[2] == "separate" and of(False)[2] == "stitched"
    assert [r[4] for r in got(layout.stitch(t, ["d"], "page"))] == [1, 1, 2, 3, 4]


def test_spans_meet(spark, monkeypatch):
    """Checks over a document or a stream in spans give what they give in one piece."""
    rng = random.Random(3)
    numbers = frame(spark, [(d, n) for d in "abc" for n in rng.sample(range(-40, 160), 90)] + [("c", 900), ("d", 5)], "d string, v long")
    chain = journal.chained(frame(spark, [(s, k, f"p{k}") for s in "st" for k in range(1, 40)], "s string, k int, p string"), "s", ["k"], "p").withColumn("p", F.when((F.col("s") == "t") & (F.col("k") == 17), "x").otherwise(F.col("p"))).cache()
    broken = chain.where("NOT (s = 's' AND k = 8)").withColumn("previous_hash", F.when((F.col("s") == "t") & (F.col("k") == 25), None).otherwise(F.col("previous_hash")))
    want = got(R.gap_check(numbers, ["d"], "v", "forbidden")), got(journal.verify_chain(chain, "s", "p")), got(journal.verify_chain(broken, "s", "p"))
    assert want[1] == [("s", 39, 0, None), ("t", 39, 1, 17)] and want[2] == [("s", 38, 31, 9), ("t", 39, 2, 17)]
    cut = lambda: got(journal.cut_parts(chain.select("s", "sequence"), "s", F.col("sequence") % 5 + 1, 7))
    sizes, want_parts = [k % 5 + 1 for k in range(1, 40)], cut()
    assert {r[1]: r[2] for r in want_parts if r[0] == "s"} == {k + 1: sum(sizes[:k]) // 7 for k in range(39)}
    monkeypatch.setattr(R, "SPAN", 8)
    monkeypatch.setattr(journal, "SPAN", 8)
    assert cut() == want_parts
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    marks = frame(spark, [("a", at(s)) for s in (0, 100, 400, 86_300, 86_500, 400_000, 400_000)] + [("b", at(5))], "k string, t timestamp")
    assert [r[3] for r in got(journal.stalls(marks, "k", "t", 210))] == [300.0, 85_900.0, 313_500.0] and [r[3] for r in got(journal.stalls(marks, "k", "t", 200))][-2:] == [200.0, 313_500.0]
    assert want == (got(R.gap_check(numbers, ["d"], "v", "forbidden")), got(journal.verify_chain(chain, "s", "p")), got(journal.verify_chain(broken, "s", "p")))


def test_chain(spark):
    rows = frame(spark, [("s", k, f"p{k}") for k in range(1, 8)], "s string, k int, p string")
    chain = journal.chained(rows, "s", ["k"], "p")
    assert got(journal.verify_chain(chain, "s", "p")) == [("s", 7, 0, None)]
    assert got(journal.verify_chain(chain.withColumn("p", F.when(F.col("k") == 3, "x").otherwise(F.col("p"))), "s", "p")) == [("s", 7, 1, 3)]
    assert got(journal.verify_chain(chain.where("k <> 4"), "s", "p"))[0][1:3] == (6, 3)
    parts = chain.withColumn("part", F.expr("k div 3"))
    assert [r[2] for r in got(journal.verify_parts(parts, "s", "part"))] == [True, True, True] and [r[2] for r in got(journal.verify_parts(parts.where("k <> 2"), "s", "part"))] == [True, False, True]
    pins = chain.where("k = 5").select("s", F.col("sequence").alias("pinned_sequence"), F.col("hash").alias("pinned_hash"))
    assert got(journal.compare_head(chain, pins, "s")) == [("s", "extended", 2)] and got(journal.compare_head(chain.where("k <= 5"), pins, "s")) == [("s", "same", 0)]
    assert got(journal.compare_head(chain.where("k <= 3"), pins, "s"))[0][1] == "diverged"


def test_comparisons(spark):
    a, b = (frame(spark, rows, "k int, x int, y int") for rows in ([(1, 1, 1), (2, 1, 1), (3, 1, 1)], [(1, 1, 2), (2, 1, 1), (4, 1, 1)]))
    assert got(compare.disagreements(a, b, ["k"], ["x", "y"])) == [(1, "y", "1", "2"), (3, None, "present", "absent"), (4, None, "absent", "present")]
    told = frame(spark, [(1, "y", "9")], "k int, field string, value string")
    assert got(compare.gold(a, b, told, ["k"], ["x", "y"])) == [(1, "1", "9", True), (2, "1", "1", True), (3, None, None, False), (4, None, None, False)]
    assert got(compare.gold(a, b, told.limit(0), ["k"], ["x", "y"]))[0][-1] is False
    paths = "r int, path string, type string, value string"
    x, y = frame(spark, [(1, "a", "s", "1"), (1, "b", "s", "1"), (1, "c", "s", "1")], paths), frame(spark, [(1, "a", "n", "1"), (1, "b", "s", "2"), (1, "d", "s", "1")], paths)
    assert got(compare.field_diff(x, y, ["r"])) == [(1, "a", "type"), (1, "b", "value"), (1, "c", "missing"), (1, "d", "extra")]
    assert got(compare.multiset_diff(a, a.unionByName(a.limit(1)))) == [(*got(a.limit(1))[0], "after", 1)]


def test_quality(spark):
    gold = frame(spark, [(1, "x"), (2, "x"), (3, None)], "k int, f string")
    seen = frame(spark, [(1, "s1", "accepted_auto", True, "x"), (2, "s1", "accepted_auto", True, "y"), (3, "s2", "accepted_auto", True, "x"), (4, "s2", "review", False, "x")], "k int, source string, status string, eligible boolean, f string")
    rows = quality.compare_with_gold(seen, gold, ["k"], ["f"])
    assert [r[5] for r in got(rows)] == [True, False, None, None]
    m = quality.metrics(rows.withColumn("g", F.lit(1)), ["g"], 1, "source").first()
    assert (m["far"], m["automation"], m["review_load"], m["false_alarm"], m["rule_of_three"]) == (0.5, pytest.approx(1 / 3), 0.25, None, None)
    more = quality.metrics(rows.withColumn("g", F.lit(1)), ["g"], 1, "source", "k", "0.7").first()
    assert (more["documents"], more["sources"], more["shortage"]) == (4, 2, 3) and quality.metrics(rows.withColumn("g", F.lit(1)), ["g"], 1, "source", threshold="0").first()["shortage"] is None
    lost = frame(spark, [(1, 10, 8, 1), (1, 5, 9, 0)], "g int, gold long, found long, unknown long")
    assert got(quality.coverage_loss(lost, ["g"])) == [(1, 0.2)]
    values = frame(spark, [(1, float(v)) for v in (1, 2, 3, 4)], "g int, v double")
    assert got(quality.percentiles(values, ["g"], "v")) == [(1, 4, 2.0, 4.0)]
    rng = random.Random(6)
    odd = [(None, 2.5), (None, None), ("one", -1.0), ("none", None)] + [("many", float(rng.choice([-3, 0, 7, 7, 7, rng.random()]))) for _ in range(3000)] + [("same", 4.0)] * 700
    out = {r["g"]: tuple(r)[1:] for r in quality.percentiles(frame(spark, odd, "g string, v double").repartition(5), ["g"], "v", (0.001, 0.5, 0.95, 1)).collect()}
    for g in (None, "one", "many", "same"):
        own = sorted(v for k, v in odd if k == g and v is not None)
        assert out[g] == (len(own), *(own[max(1, -(-len(own) * x // 1000)) - 1] for x in (1, 500, 950, 1000)))
    assert set(out) == {None, "one", "many", "same"} and quality.percentiles(values.limit(0), ["g"], "v").count() == 0
