"""Tri-state rule results: PASS, FAIL or UNKNOWN, never a Boolean null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASS, FAIL, UNKNOWN = "PASS", "FAIL", "UNKNOWN"
CRITICAL, FIXABLE = "critical", "fixable"


def tri(holds: Column) -> Column:
    """PASS where it holds, FAIL where it doesn't, UNKNOWN where that can't be told."""
    return F.when(holds.isNull(), UNKNOWN).when(holds, PASS).otherwise(FAIL)


@dataclass(frozen=True)
class Rule:
    """A named check of one record; status is a Column of PASS, FAIL or UNKNOWN (null: the rule says nothing)."""

    rule_id: str
    status: Column
    severity: str = CRITICAL


def apply_rules(records: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """(keys, rule_id, status, severity), one row for each record and rule; the input is scanned once."""
    results = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), r.status.alias("status"), F.lit(r.severity).alias("severity")) for r in rules))
    return records.select(*keys, F.explode(results).alias("__rule")).select(*keys, "__rule.*").where("status IS NOT NULL")


# The closed set of cross-field rules. A reference value that is missing makes UNKNOWN.


def date_order(first: Column, second: Column, relation: str) -> Column:
    """`not_later`: first <= second; `not_earlier`: first >= second; anything else is not a declared relation."""
    if relation not in ("not_later", "not_earlier"):
        return F.lit(UNKNOWN)
    return tri(first <= second if relation == "not_later" else first >= second)


def currency_match(own: Column, other: Column) -> Column:
    return tri(own == other)


def composition(condition: Column, values: list, required: list[Column], forbidden: list[Column]) -> Column:
    """Where the condition's value is one of `values`, required fields are there and forbidden ones aren't."""
    met = condition.isin(values)
    holds = F.lit(True)
    for c in required:
        holds = holds & c.isNotNull()
    for c in forbidden:
        holds = holds & c.isNull()
    return F.when(condition.isNull(), UNKNOWN).when(~met, PASS).when(holds, PASS).otherwise(FAIL)


def admissible(condition: Column, when: list, value: Column, allowed: list) -> Column:
    """Where the condition's value is one of `when`, the value is one of `allowed`."""
    return F.when(condition.isNull(), UNKNOWN).when(~condition.isin(when), PASS).when(value.isNull(), UNKNOWN).when(value.isin(allowed), PASS).otherwise(FAIL)


def bounds(value: Column, low: str | None, high: str | None) -> Column:
    """Between decimals given as text; without bounds UNKNOWN; NaN and infinite values fail."""
    if low is None and high is None:
        return F.lit(UNKNOWN)
    text = value.cast("string")
    broken = F.lower(text).isin("nan", "infinity", "-infinity")
    number = value.try_cast("decimal(38,9)")
    holds = F.lit(True)
    if low is not None:
        holds = holds & (number >= F.lit(low).cast("decimal(38,9)"))
    if high is not None:
        holds = holds & (number <= F.lit(high).cast("decimal(38,9)"))
    return F.when(value.isNull(), UNKNOWN).when(broken | number.isNull(), FAIL).when(holds, PASS).otherwise(FAIL)


CROSS_FIELD = {"date_order": date_order, "currency_match": currency_match, "composition": composition, "admissible": admissible, "bounds": bounds}


def cross_field(kind: str, *args, **options) -> Column:
    """A declared rule by kind; an unknown kind is UNKNOWN, not an error."""
    made = CROSS_FIELD.get(kind)
    return made(*args, **options) if made else F.lit(UNKNOWN)


# the schema of a record's fields, in long form.


@dataclass(frozen=True)
class Field:
    """A declared field: its name, its kind, whether it must be there, its terms and its digits after the point, if declared."""

    name: str
    kind: str | None
    required: bool = False
    terms: tuple[str, ...] | None = None
    max_digits: int | None = None


#: What is known of a record's field; a null struct is a field that the record lacks.
CELL = "struct<raw: string, kind: string, refusal: string, value_text: string, digits: int>"


def schema_check(records: DataFrame, keys: list[str], spec: list[Field], cells: dict[str, Column], extra: Column | None = None) -> DataFrame:
    """(keys, field, rule_id, status): presence, then the first of empty and uninterpreted, then type, vocabulary, precision.

    cells: for each field of the record a struct CELL; spec: the declared fields.
    Everything is told within the record's row, so there is no join. Fields that
    the spec doesn't name fail: those among cells, and names in the array extra.
    A precision is never cut to fit. Without a spec the whole check is UNKNOWN.
    """
    if not spec:
        return records.select(*keys, F.lit(None).cast("string").alias("field"), F.lit("declared").alias("rule_id"), F.lit(UNKNOWN).alias("status"))
    told = lambda name, rule, status: F.struct(F.lit(name).alias("field"), F.lit(rule).alias("rule_id"), status.alias("status"))
    rows = records.select(*keys, *(c.cast(CELL).alias(f"__cell_{n}") for n, c in cells.items()), (extra if extra is not None else F.array().cast("array<string>")).alias("__extra"))
    results = []
    for f in spec:
        cell = F.col(f"__cell_{f.name}") if f.name in cells else F.lit(None).cast(CELL)
        present, raw = cell.isNotNull(), cell["raw"]
        empty = present & (F.coalesce(F.trim(raw), F.lit("")) == "")
        unread = present & ~empty & cell["refusal"].isNotNull()
        sound = present & ~empty & ~unread
        results.append(told(f.name, "presence", F.when(present | F.lit(not f.required), PASS).otherwise(FAIL)))
        results.append(told(f.name, "empty_value", F.when(empty, FAIL if f.required else PASS)))
        results.append(told(f.name, "uninterpreted", F.when(unread, FAIL)))
        results.append(told(f.name, "type", F.when(sound, F.when(F.lit(f.kind is None), UNKNOWN).when(cell["kind"] == F.lit(f.kind), PASS).otherwise(FAIL))))
        if f.kind == "vocabulary":
            results.append(told(f.name, "vocabulary", F.when(sound, F.when(F.lit(f.terms is None), UNKNOWN).when(cell["value_text"].isin(*(f.terms or [""])), PASS).otherwise(FAIL))))
        if f.max_digits is not None:
            results.append(told(f.name, "precision", F.when(sound, F.when(cell["digits"] <= f.max_digits, PASS).otherwise(FAIL))))
    declared = {f.name for f in spec}
    foreign = [told(n, "unknown_field", F.when(F.col(f"__cell_{n}").isNotNull(), FAIL)) for n in cells if n not in declared]
    more = F.transform("__extra", lambda x: F.struct(x.alias("field"), F.lit("unknown_field").alias("rule_id"), F.lit(FAIL).alias("status")))
    out = rows.select(*keys, F.explode(F.concat(F.array(*results, *foreign), more)).alias("__r"))
    return out.select(*keys, "__r.*").where("status IS NOT NULL")


# Rules over the set of a document's records.


def order_check(rows: DataFrame, document: list[str], position: list[str], value: str, declared: str | None) -> DataFrame:
    """(document, status, inversions): adjacent pairs out of the declared order (ascending, descending, insignificant, None)."""
    if declared is None or declared == "insignificant":
        status = UNKNOWN if declared is None else PASS
        return rows.select(*document).distinct().select(*document, F.lit(status).alias("status"), F.lit(0).cast("long").alias("inversions"))
    before = F.lag(value).over(Window.partitionBy(*document).orderBy(*position))
    wrong = before > F.col(value) if declared == "ascending" else before < F.col(value)
    seen = rows.withColumn("wrong", wrong.cast("int"))
    out = seen.groupBy(*document).agg(F.sum(F.coalesce("wrong", F.lit(0))).alias("inversions"), F.count_if(F.col(value).isNull()).alias("missing"))
    status = F.when(F.col("missing") > 0, UNKNOWN).when(F.col("inversions") > 0, FAIL).otherwise(PASS)
    return out.select(*document, status.alias("status"), F.when(F.col("missing") > 0, 0).otherwise(F.col("inversions")).cast("long").alias("inversions"))


def inversions(rows: DataFrame, document: list[str], position: list[str], value: str, declared: str) -> DataFrame:
    """(document, position, before, after): every adjacent pair out of the declared order, a row for each."""
    before = F.lag(value).over(Window.partitionBy(*document).orderBy(*position))
    told = rows.withColumn("before", before).withColumn("after", F.col(value))
    return told.where(F.col("before") > F.col("after") if declared == "ascending" else F.col("before") < F.col("after")).select(*document, *position, "before", "after")


#: How many of the missing numbers are named, and how many numbers a window goes over at most.
NAMED, SPAN = 20, 65_536


def gap_check(rows: DataFrame, document: list[str], number: str, policy: str | None, basis: str | None = None) -> DataFrame:
    """(document, status, missing, runs, first): numbers absent between the least and the largest, counted by islands, the first few named.

    policy: None (nothing is declared: UNKNOWN), `not_a_sequence` (PASS with a
    basis, UNKNOWN without one), else by what is found: `allowed` PASS,
    `forbidden` FAIL, any other UNKNOWN where numbers are absent. A number that
    is null makes UNKNOWN; so do numbers that aren't whole.
    """
    whole = isinstance(rows.schema[number].dataType, T.IntegralType)
    own = rows.select(*document, F.col(number).alias("__n")) if whole else rows.select(*document, F.when(F.col(number) == F.floor(number), F.col(number)).try_cast("long").alias("__n"))
    given = own.groupBy(*document).agg(F.count_if(F.col("__n").isNull()).alias("nulls"))
    # Windows go over spans of numbers, not over whole documents: one document may hold most rows. Spans meet at their edges.
    held = own.where(F.col("__n").isNotNull()).distinct().withColumn("__span", F.floor(F.col("__n") / SPAN))
    inside = held.withColumn("hole", F.lead("__n").over(Window.partitionBy(*document, "__span").orderBy("__n")) - F.col("__n") - 1)
    edges = held.groupBy(*document, "__span").agg(F.min("__n").alias("__low"), F.max("__n").alias("__n"))
    edges = edges.withColumn("hole", F.lead("__low").over(Window.partitionBy(*document).orderBy("__span")) - F.col("__n") - 1)
    found = inside.select(*document, "__n", "hole").unionByName(edges.select(*document, "__n", "hole")).where("hole > 0")
    holes = found.groupBy(*document).agg(F.sum("hole").alias("missing"), F.count("*").alias("runs"))
    nth = F.row_number().over(Window.partitionBy(*document).orderBy("__n"))
    some = F.sequence(F.col("__n") + 1, F.col("__n") + F.least(F.col("hole"), F.lit(NAMED)))
    named = found.withColumn("nth", nth).where(F.col("nth") <= NAMED).groupBy(*document).agg(F.slice(F.sort_array(F.flatten(F.collect_list(some))), 1, NAMED).alias("first"))
    holes = holes.join(named, document)
    out = given.join(holes, document, "left").fillna(0, ["missing", "runs"])
    absent = F.col("missing") > 0
    if policy is None or (policy == "not_a_sequence" and not basis):
        status = F.lit(UNKNOWN)
    elif policy == "not_a_sequence":
        status = F.lit(PASS)
    else:
        status = F.when(F.col("nulls") > 0, UNKNOWN).when(~absent, PASS).otherwise({"allowed": PASS, "forbidden": FAIL}.get(policy, UNKNOWN))
    first = F.coalesce(F.transform("first", lambda x: x.cast("long")), F.array().cast("array<long>"))
    return out.select(*document, status.alias("status"), F.col("missing").cast("long").alias("missing"), F.col("runs").cast("long").alias("runs"), first.alias("first"))


def parse_duplicates(rows: DataFrame, address: list[str]) -> DataFrame:
    """(address, status, records): one address on several records is the parser's fault; no address is UNKNOWN."""
    absent = F.lit(False)
    for c in address:
        absent = absent | F.col(c).isNull()
    n = rows.groupBy(*address).agg(F.count("*").alias("records"))
    return n.select(*address, F.when(absent, UNKNOWN).when(F.col("records") > 1, FAIL).otherwise(PASS).alias("status"), "records")


def source_duplicates(rows: DataFrame, content: Column, address: str, policy: str | None) -> DataFrame:
    """(content_hash, status, records, addresses): equal content at different addresses, judged by the declaration."""
    n = rows.select(F.sha2(content, 256).alias("content_hash"), F.col(address).alias("a")).groupBy("content_hash").agg(F.count("*").alias("records"), F.count_distinct("a").alias("addresses"))
    found = F.lit({"allowed": PASS, "forbidden": FAIL}.get(policy, UNKNOWN))
    repeated = (F.col("addresses") > 1) | ((F.col("addresses") == 0) & (F.col("records") > 1))
    return n.select("content_hash", F.when(repeated, found).otherwise(PASS).alias("status"), "records", "addresses")


# Folding results, deciding records and runs.


def fold(results: DataFrame, keys: list[str], known: tuple[str, ...] = (PASS, FAIL, UNKNOWN)) -> DataFrame:
    """(keys, state, critical): NO if any fails, UNKNOWN if any is unknown or foreign, else YES; counted, never bool_and."""
    n = results.groupBy(*keys).agg(
        F.count_if(F.col("status") == FAIL).alias("failed"),
        F.count_if((F.col("status") == FAIL) & (F.col("severity") == CRITICAL)).alias("critical"),
        F.count_if((F.col("status") == UNKNOWN) | ~F.col("status").isin(*known) | F.col("status").isNull()).alias("open"),
    )
    state = F.when(F.col("failed") > 0, "NO").when(F.col("open") > 0, "UNKNOWN").otherwise("YES")
    return n.select(*keys, state.alias("state"), (F.col("critical") > 0).alias("critical"))


#: The closed formula of automatic admission: a record is accepted where every conjunct holds. Fixed values.
CONJUNCTS = (
    "run_not_blocked",
    "coverage_complete",
    "provenance_complete",
    "required_types_valid",
    "order_and_duplicate_checks_passed",
    "required_totals_passed",
    "domain_rules_passed",
    "independent_check_passed_or_not_required_by_versioned_policy",
    "reversibility_check_passed",
    "no_value_warning",
    "template_is_admitted",
)


#: Conjuncts whose states one number holds, four bits each.
FOLDED = 15


def observe(rows: DataFrame, keys: list[str], conjuncts: dict[str, list[Rule]]) -> DataFrame:
    """(keys, conjunct, state, critical): the rules of all rows of a record folded into one observation of each conjunct.

    One aggregation, whatever the number of rules. A rule that says nothing (null)
    doesn't count; a conjunct that no rule tells a thing about is unknown.
    """
    told = {(c, k): f"__{c}_{k}" for c, rules in conjuncts.items() for k in range(len(rules))}
    flat = rows.select(*keys, *(conjuncts[c][k].status.alias(name) for (c, k), name in told.items()))
    # Four bits for each conjunct: failed, failed critically, open, told at all. A record's rows fold by or, FOLDED conjuncts in a number.
    names, masks = list(conjuncts), []
    for at in range(0, len(names), FOLDED):
        mask = F.lit(0).cast("long")
        for place, c in enumerate(names[at : at + FOLDED]):
            for k, rule in enumerate(conjuncts[c]):
                s = F.col(told[c, k])
                bits = F.when(s.isNull(), 0).when(s == PASS, 8).when(s == FAIL, 11 if rule.severity == CRITICAL else 9).otherwise(12).cast("long")
                mask = mask.bitwiseOR(F.shiftleft(bits, 4 * place))
        masks.append(mask)
    n = flat.select(*keys, *(m.alias(f"__mask_{i}") for i, m in enumerate(masks))).groupBy(*keys).agg(*(F.bit_or(f"__mask_{i}").alias(f"__mask_{i}") for i in range(len(masks))))
    cells = []
    for place, c in enumerate(names):
        own = F.shiftright(f"__mask_{place // FOLDED}", 4 * (place % FOLDED)).bitwiseAND(15)
        state = F.when(own.bitwiseAND(1) > 0, "NO").when((own.bitwiseAND(4) > 0) | (own == 0), "UNKNOWN").otherwise("YES")
        cells.append(F.struct(F.lit(c).alias("conjunct"), state.alias("state"), (own.bitwiseAND(2) > 0).alias("critical")))
    return n.select(*keys, F.explode(F.array(*cells)).alias("__o")).select(*keys, "__o.*")


def decide(records: DataFrame, observations: DataFrame, keys: list[str], conjuncts: list[str] | tuple[str, ...] = CONJUNCTS, run_ok: bool = True) -> DataFrame:
    """(keys, status, sheet, unmet, error): the closed conjunction; a conjunct without an observation is unknown.

    observations: keys, conjunct, state, critical. An observation of a conjunct
    that the formula hasn't, or two states for one conjunct, is an error: such a
    record gets no status, and goes to the sheet ERRORS with its code. A blocked
    or failed run gives no status either.
    """
    if len(conjuncts) > FOLDED:
        raise ValueError("a formula has fifteen conjuncts at most")
    # Four bits for each conjunct tell which states were seen of it: one number for each record, folded in one pass.
    place = F.coalesce(*(F.when(F.col("conjunct") == c, 4 * k) for k, c in enumerate(conjuncts)))
    code = F.when(F.col("state") == "NO", 1).when(F.col("state") == "UNKNOWN", 2).when(F.col("state") == "YES", 4).otherwise(8).cast("long")
    seen = observations.select(*keys, place.isNull().alias("__foreign"), F.call_function("shiftleft", code, place).alias("__seen"), F.when((code == 1) & F.col("critical"), 1).otherwise(0).alias("__hard"))
    per = seen.groupBy(*keys).agg(F.max("__foreign").alias("__foreign"), F.coalesce(F.bit_or("__seen"), F.lit(0).cast("long")).alias("__seen"), F.max("__hard").alias("__hard"))
    out = records.select(*keys).join(per, keys, "left").fillna(0, ["__seen", "__hard"]).fillna(False, ["__foreign"])
    yes, twice = F.lit(0), F.lit(False)
    for k in range(len(conjuncts)):
        own = F.shiftright("__seen", 4 * k).bitwiseAND(15)
        yes, twice = yes + (own == 4).cast("int"), twice | (F.bit_count(own) > 1)
    error = F.when(F.col("__foreign"), "E_CONJUNCT_UNKNOWN").when(twice, "E_CONJUNCT_CONTRADICTED")
    out = out.select(*keys, error.alias("error"), yes.alias("__yes"), (F.col("__hard") > 0).alias("__rejected"))
    return _decided(out, keys, F.lit(len(conjuncts)) - F.col("__yes"), F.col("__rejected"), run_ok)


def _decided(rows: DataFrame, keys: list[str], unmet: Column, rejected: Column, run_ok: bool) -> DataFrame:
    sound = F.when(rejected, "rejected").when(unmet > 0, "review").otherwise("accepted_auto")
    status = F.when(F.col("error").isNull() & F.lit(run_ok), sound)
    sheet = F.when(F.col("error").isNotNull() & F.lit(run_ok), "ERRORS").when(status == "accepted_auto", "DATA").when(status == "review", "REVIEW").when(status == "rejected", "REJECTED")
    return rows.select(*keys, status.alias("status"), sheet.alias("sheet"), unmet.cast("long").alias("unmet"), "error")


def decide_in_row(records: DataFrame, keys: list[str], conjuncts: dict[str, list[Rule]], run_ok: bool = True) -> DataFrame:
    """decide() where every conjunct comes from rules of the record's only row: folded within it, without a shuffle.

    Rows that share their keys are decided each for itself: observe() folds them. A rule that says nothing (null) doesn't count; a conjunct without a result is unknown.
    """
    told = {(c, k): f"__{c}_{k}" for c, rules in conjuncts.items() for k in range(len(rules))}
    rows = records.select(*keys, *(conjuncts[c][k].status.alias(name) for (c, k), name in told.items()))
    states, critical = [], F.lit(False)
    for c, rules in conjuncts.items():
        own = [F.col(told[c, k]) for k in range(len(rules))]
        failed, open_, none = F.lit(False), F.lit(False), F.lit(True)
        for s, rule in zip(own, rules, strict=True):
            failed = failed | F.coalesce(s == FAIL, F.lit(False))
            open_ = open_ | F.coalesce(~s.isin(PASS, FAIL), F.lit(False))
            none = none & s.isNull()
            if rule.severity == CRITICAL:
                critical = critical | F.coalesce(s == FAIL, F.lit(False))
        states.append(failed | open_ | none)
    unmet = F.lit(0)
    for x in states:
        unmet = unmet + x.cast("int")
    rows = rows.select(*keys, unmet.alias("__unmet"), critical.alias("__critical"), F.lit(None).cast("string").alias("error"))
    return _decided(rows, keys, F.col("__unmet"), F.col("__critical"), run_ok)


def run_state(decisions: DataFrame, run: list[str], blocked: Column | None = None, failed: Column | None = None) -> DataFrame:
    """(run, run_state): blocked, then failed, then partial (no decision, no status, or some in review), then completed."""
    none = F.lit(False)
    n = decisions.groupBy(*run).agg(
        F.max(blocked if blocked is not None else none).alias("blocked"), F.max(failed if failed is not None else none).alias("failed"),
        F.count("*").alias("n"), F.count_if(F.col("status").isNull() | (F.col("status") == "review")).alias("open"),
    )
    state = F.when(F.col("blocked"), "blocked").when(F.col("failed"), "failed").when((F.col("n") == 0) | (F.col("open") > 0), "partial").otherwise("completed")
    return n.select(*run, state.alias("run_state"))


def decision_summary(decisions: DataFrame, by: list[str]) -> DataFrame:
    """(by, records, data, review, rejected, automation): counts by sheet and the share decided without a person."""
    n = decisions.groupBy(*by).agg(F.count("*").alias("records"), *(F.count_if(F.col("sheet") == s).alias(s.lower()) for s in ("DATA", "REVIEW", "REJECTED")))
    return n.withColumn("automation", F.col("data").cast("double") / F.col("records"))


def rule_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, passed, failed, unknown): results of rules by status."""
    return results.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in ((PASS, "passed"), (FAIL, "failed"), (UNKNOWN, "unknown"))))


def release_gate(decisions: DataFrame, batch: list[str], totals_ok: str = "totals_ok") -> DataFrame:
    """(batch, gate, unmet): open when the run completed, nothing waits for review, totals hold and some record is accepted."""
    n = decisions.groupBy(*batch).agg(F.count_if(F.col("status").isNull() | (F.col("status") == "review")).alias("open"), F.count_if(F.col("status") == "accepted_auto").alias("accepted"), F.min(totals_ok).alias("totals"), F.count("*").alias("n"))
    unmet = (F.col("n") == 0).cast("int") + (F.col("open") > 0).cast("int") + (~F.coalesce(F.col("totals"), F.lit(False))).cast("int") + (F.col("accepted") == 0).cast("int")
    return n.select(*batch, F.when(unmet == 0, "open").otherwise("closed").alias("gate"), unmet.cast("long").alias("unmet"))
