"""Sums, balances, declared totals and their scopes.

Currencies never add up. Sums are exact: amounts keep the digits of their type,
nothing is rounded but by a declared rule, and a sum that 38 digits don't hold is
told apart from a sum of no rows. Binary fractions aren't money.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions.values import rounded
from ledgerweave.operators.rules import CRITICAL, FAIL, FIXABLE, PASS, UNKNOWN

#: A declared rounding: digits after the point, and a mode of values.rounded().
Rounding = tuple[int, str]


def exact_kind(*columns: tuple[DataFrame, str]) -> T.DecimalType:
    """The decimal type that holds all digits after the point of these columns; binary fractions and texts are refused."""
    scale = 0
    for rows, name in columns:
        kind = rows.schema[name].dataType
        if isinstance(kind, T.DecimalType):
            scale = max(scale, kind.scale)
        elif not isinstance(kind, (T.IntegralType, T.NullType)):
            raise TypeError(f"E_TYPE_FLOAT_FORBIDDEN {name} is {kind.simpleString()}")
    return T.DecimalType(38, scale)


def exact_sum(amount: Column) -> Column:
    """A decimal sum with the amounts' own digits; null where 38 digits don't hold it, and where there is no amount."""
    return F.try_sum(amount)


def _summed(amount: Column, name: str) -> list[Column]:
    """The sum, and whether there were amounts that it doesn't hold."""
    return [exact_sum(amount).alias(name), (exact_sum(amount).isNull() & (F.count(amount) > 0)).alias(f"{name}_lost")]


def single_currency_sum(rows: DataFrame, keys: list[str], amount: str, currency: str) -> DataFrame:
    """(keys, status, total): the sum of one currency; several currencies fail, unknown ones and sums beyond 38 digits are UNKNOWN."""
    exact_kind((rows, amount))
    n = rows.groupBy(*keys).agg(exact_sum(F.col(amount)).alias("total"), F.count_distinct(currency).alias("currencies"), F.count_if(F.col(amount).isNull() | F.col(currency).isNull()).alias("open"))
    status = F.when(F.col("currencies") > 1, FAIL).when((F.col("open") > 0) | F.col("total").isNull(), UNKNOWN).otherwise(PASS)
    return n.select(*keys, status.alias("status"), F.when(F.col("currencies") == 1, F.col("total")).alias("total"))


#: The four troubles of amounts, and what each makes of a check.
TROUBLES = {"binary_fraction": FAIL, "no_value": UNKNOWN, "not_a_number": FAIL, "no_currency": UNKNOWN}


def with_trouble(rows: DataFrame, amount: str, currency: str) -> DataFrame:
    """rows with trouble: why an amount can't be summed, or null (A02). A text amount is one that wasn't interpreted."""
    kind, a = rows.schema[amount].dataType, F.col(amount)
    trouble = F.when(a.isNull(), "no_value")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        trouble = trouble.when(F.isnan(a) | (F.abs(a) == float("inf")), "not_a_number").otherwise("binary_fraction")
    elif isinstance(kind, T.StringType):
        trouble = trouble.when(F.lower(F.trim(a)).isin("nan", "inf", "-inf", "infinity", "-infinity"), "not_a_number").otherwise("no_value")
    else:
        exact_kind((rows, amount))
        trouble = trouble.when(F.coalesce(F.trim(F.col(currency).cast("string")), F.lit("")) == "", "no_currency")
    return rows.withColumn("trouble", trouble)


def collect_amounts(rows: DataFrame, keys: list[str], amount: str, currency: str) -> tuple[DataFrame, DataFrame]:
    """Rows that can be summed, and (keys, trouble, status, records) of the others: with any trouble no sum proves a thing."""
    told = with_trouble(rows, amount, currency)
    status = F.coalesce(*(F.when(F.col("trouble") == k, v) for k, v in TROUBLES.items()))
    bad = told.where("trouble IS NOT NULL").groupBy(*keys, "trouble").agg(F.count("*").alias("records"))
    return told.where("trouble IS NULL").drop("trouble"), bad.select(*keys, "trouble", status.alias("status"), "records")


def side(amount: Column, marker: Column | None = None, inflow: list | None = None, outflow: list | None = None) -> Column:
    """Struct (inflow, outflow, status): by a declared marker, else by sign; the side that it isn't on is null.

    A marker that is declared for neither side, or for both, is UNKNOWN; a
    negative amount with a marker contradicts it.
    """
    if marker is None:
        return F.struct(F.when(amount >= 0, amount).alias("inflow"), F.when(amount < 0, -amount).alias("outflow"), F.when(amount.isNull(), UNKNOWN).otherwise(PASS).alias("status"))
    into, out = F.coalesce(marker.isin(inflow or []), F.lit(False)), F.coalesce(marker.isin(outflow or []), F.lit(False))
    status = F.when(amount.isNull() | (into == out), UNKNOWN).when(amount < 0, FAIL).otherwise(PASS)
    return F.struct(F.when(into & ~out, amount).alias("inflow"), F.when(out & ~into, amount).alias("outflow"), status.alias("status"))


def compared(computed: Column, declared: Column, computed_digits: Column, declared_digits: Column, rounding: Rounding | None) -> Column:
    """PASS or FAIL: exactly where both have as many digits after the point; else rounded as declared, UNKNOWN without a rule."""
    exact = F.when(computed == declared, PASS).otherwise(FAIL)
    if rounding is None:
        other = F.lit(UNKNOWN)
    else:
        other = F.when(rounded(computed, *rounding) == rounded(declared, *rounding), PASS).otherwise(FAIL)
    return F.when(computed.isNull() | declared.isNull(), UNKNOWN).when(computed_digits == declared_digits, exact).otherwise(other)


def _digits(rows: DataFrame, name: str) -> Column:
    """Digits after the point: the rows' own, where they carry them, else those of the type."""
    kind = rows.schema[name].dataType
    return F.col("digits").cast("int") if "digits" in rows.columns else F.lit(kind.scale if isinstance(kind, T.DecimalType) else 0)


def declared_by_currency(declared: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, currency, opening, closing, contradicted) from rows keys, name, currency, value."""
    of = lambda name, c="value": F.when(F.col("name") == name, F.col(c))
    rows = declared.where("currency IS NOT NULL").withColumn("__d", _digits(declared, "value"))
    contradicted = (F.count_distinct(of("opening")) > 1) | (F.count_distinct(of("closing")) > 1)
    return rows.groupBy(*keys, "currency").agg(F.max(of("opening")).alias("opening"), F.max(of("closing")).alias("closing"), contradicted.alias("contradicted"), F.max(of("opening", "__d")).alias("opening_digits"), F.max(of("closing", "__d")).alias("closing_digits"))


def balance(records: DataFrame, declared: DataFrame, keys: list[str], rounding: Rounding | None = None) -> DataFrame:
    """(keys, currency, status, computed, closing): opening + inflow - outflow = closing for each currency.

    records: keys, currency, inflow, outflow, status (of side()), and digits if
    they are known. Any trouble in a document (a status that isn't PASS, no
    currency, totals that contradict each other) makes each of its currencies
    UNKNOWN; so does a missing opening or closing for that currency, and a sum
    that 38 digits don't hold. A currency without records has sums of nothing.
    """
    at, kind = [*keys, "currency"], exact_kind((records, "inflow"), (records, "outflow"), (declared, "value"))
    digits = F.max(F.greatest(_digits(records, "inflow"), _digits(records, "outflow"))).alias("__d")
    bad = F.count_if((F.col("status") != PASS) | F.col("status").isNull() | F.col("currency").isNull())
    sums = records.groupBy(*at).agg(*_summed(F.col("inflow"), "__i"), *_summed(F.col("outflow"), "__o"), bad.alias("trouble"), digits)
    both = sums.join(declared_by_currency(declared, keys), at, "full_outer").fillna(0, ["trouble"]).fillna(False, ["contradicted", "__i_lost", "__o_lost"])
    over = both.groupBy(*keys).agg((F.max("trouble") > 0).alias("__t"), F.max("contradicted").alias("__c"))
    # The three parts add up in an aggregation: a binary operation would give up digits of wide decimals.
    wide = {c: F.col(c).try_cast(kind) for c in ("opening", "__i", "__o", "closing")}
    lost = F.col("__i_lost") | F.col("__o_lost")
    for c, x in wide.items():
        lost = lost | (x.isNull() & F.col(c).isNotNull())
    parts = both.where("currency IS NOT NULL").select(*at, lost.alias("lost"), F.greatest("__d", "opening_digits").alias("computed_digits"), F.col("opening").isNull().alias("unopened"), wide["closing"].alias("closing"), "closing_digits", F.explode(F.array(wide["opening"], wide["__i"], -wide["__o"])).alias("part"))
    total = parts.groupBy(*at, "lost", "computed_digits", "unopened", "closing", "closing_digits").agg(*_summed(F.col("part"), "computed"))
    total = total.join(over, keys)
    computed = F.when(~(F.col("lost") | F.col("computed_lost") | F.col("unopened")), F.col("computed"))
    status = F.when(F.col("__t") | F.col("__c"), UNKNOWN).otherwise(compared(computed, F.col("closing"), F.coalesce("computed_digits", "closing_digits"), F.col("closing_digits"), rounding))
    return total.select(*at, status.alias("status"), computed.alias("computed"), "closing")


def control_totals(records: DataFrame, declared: DataFrame, keys: list[str], condition: Column | None = None, rounding: Rounding | None = None) -> DataFrame:
    """(keys, status, severity, computed, declared): each declared control sum against its records.

    records: keys, amount; declared: keys, value. An optional condition narrows
    the records. A declaration without a value is UNKNOWN; so is one with an
    amount that can't be read or a sum that 38 digits don't hold.
    """
    kind = exact_kind((records, "amount"), (declared, "value"))
    own = records if condition is None else records.where(condition)
    sums = own.groupBy(*keys).agg(*_summed(F.col("amount"), "__s"), F.count_if(F.col("amount").isNull()).alias("__open"), F.max(_digits(records, "amount")).alias("__sum_digits"))
    both = declared.select(*keys, F.col("value").alias("__v"), _digits(declared, "value").alias("__declared_digits")).join(sums, keys, "left")
    none = F.col("__open").isNull()
    computed = F.when(none, F.lit(0).cast(kind)).when(~F.col("__s_lost"), F.coalesce("__s", F.lit(0).cast(kind)).try_cast(kind))
    rows = both.withColumn("computed", computed).withColumn("declared", F.col("__v").try_cast(kind))
    equal = compared(F.col("computed"), F.col("declared"), F.coalesce("__sum_digits", "__declared_digits"), F.col("__declared_digits"), rounding)
    status = F.when(F.coalesce("__open", F.lit(0)) > 0, UNKNOWN).otherwise(equal)
    return rows.select(*keys, status.alias("status"), F.when(status == FAIL, CRITICAL).otherwise(FIXABLE).alias("severity"), "computed", "declared")


RESULT = ("rule_id", "name", "currency", "status", "severity", "computed", "declared", "records")


def control_set(records: DataFrame, declared: DataFrame, keys: list[str], record: str, conditions: dict[str, Column] | None = None, scopes: DataFrame | None = None, rounding: Rounding | None = None) -> DataFrame:
    """(keys, RESULT): all rules over a document's control sums in one result.

    records: keys, record, amount, currency; declared: keys, name, currency, value;
    scopes: keys, record, name. A total covers the whole document, or the records
    that its condition or its scope names.

    - money/TROUBLE: amounts that can't be summed; with any of them the
      document's sums are UNKNOWN and its cover isn't told.
    - sum/declared: a document without a declared total is UNKNOWN.
    - sum/control: each declared total; without a currency or a value UNKNOWN.
    - sum/parts: totals of parts against the document's, for each currency.
    - sum/overlap: a record in two parts fails; else sum/cover: records in none
      are UNKNOWN.
    """
    exact = not isinstance(records.schema["amount"].dataType, (T.FractionalType, T.StringType)) or isinstance(records.schema["amount"].dataType, T.DecimalType)
    kind = exact_kind((declared, "value"), *([(records, "amount")] if exact else []))
    conditions = conditions or {}
    names = F.array_compact(F.array(*(F.when(c, name) for name, c in conditions.items()))) if conditions else F.array().cast("array<string>")
    rows = with_trouble(records, "amount", "currency")
    rows = rows.select(*keys, F.col(record).alias("__record"), "currency", "trouble", F.col("amount").try_cast(kind).alias("__amount"), (_digits(records, "amount") if exact else F.lit(0)).alias("__d"), names.alias("__names"))
    if scopes is not None:
        given = scopes.groupBy(*keys, F.col(record).alias("__record")).agg(F.collect_set("name").alias("__scoped"))
        rows = rows.join(given, [*keys, "__record"], "left").withColumn("__names", F.array_union("__names", F.coalesce("__scoped", F.array().cast("array<string>"))))
    # One pass over the records: sums by the set of totals that a record belongs to. All that follows reads a few rows for each document.
    base = rows.groupBy(*keys, F.sort_array("__names").alias("__names"), "currency", "trouble").agg(*_summed(F.col("__amount"), "__s"), F.count("*").alias("__n"), F.max("__d").alias("__d"))
    fine = base.where("trouble IS NULL")
    status = F.coalesce(*(F.when(F.col("trouble") == k, v) for k, v in TROUBLES.items()))
    bad = base.where("trouble IS NOT NULL").groupBy(*keys, "trouble").agg(F.sum("__n").alias("records")).withColumn("status", status)
    member = base.select(*keys, F.explode("__names").alias("name")).distinct()
    parted = member.withColumn("__part", F.lit(True))
    totals = declared.join(parted, [*keys, "name"], "left").withColumn("__part", F.coalesce("__part", F.col("name").isin(*conditions) if conditions else F.lit(False), F.lit(False)))
    troubled = bad.groupBy(*keys).agg(F.sum("records").alias("__bad"))
    lost = F.max("__s_lost") | (exact_sum(F.col("__s")).isNull() & (F.count("__s") > 0))
    sums_of = lambda rows, *by: rows.groupBy(*keys, *by, "currency").agg(exact_sum(F.col("__s")).alias("__sum"), lost.alias("__lost"), F.sum("__n").alias("__count"), F.max("__d").alias("__d"))
    whole, inside = sums_of(fine), sums_of(fine.withColumn("name", F.explode("__names")), "name")
    of = lambda sums, on, part: totals.where(F.col("__part") == part).join(sums, on, "left")
    told = of(whole, [*keys, "currency"], False).unionByName(of(inside, [*keys, "name", "currency"], True)).join(troubled, keys, "left")
    zero = F.lit(0).cast(kind)
    computed = F.when(F.col("currency").isNotNull() & F.col("__bad").isNull() & ~F.coalesce("__lost", F.lit(False)), F.coalesce("__sum", zero).try_cast(kind))
    value = F.col("value").try_cast(kind)
    told = told.select(*keys, "name", "currency", "__part", computed.alias("computed"), value.alias("declared"), F.coalesce("__count", F.lit(0)).alias("records"), "__d", _digits(declared, "value").alias("__v"))
    status = compared(F.col("computed"), F.col("declared"), F.coalesce("__d", "__v"), F.col("__v"), rounding)
    severity = lambda s: F.when(s == PASS, FIXABLE).otherwise(CRITICAL)
    result = lambda rows, **made: rows.select(*keys, *(made.get(c, F.lit(None).cast({"computed": kind, "declared": kind, "records": T.LongType()}.get(c, T.StringType()))).alias(c) for c in RESULT))
    control = result(told, rule_id=F.lit("sum/control"), name=F.col("name"), currency=F.col("currency"), status=status, severity=severity(status), computed=F.col("computed"), declared=F.col("declared"), records=F.col("records"))
    troubles = result(bad, rule_id=F.concat(F.lit("money/"), "trouble"), status=F.col("status"), severity=F.lit(CRITICAL), records=F.col("records"))
    silent = result(records.select(*keys).distinct().join(declared.select(*keys).distinct(), keys, "left_anti"), rule_id=F.lit("sum/declared"), status=F.lit(UNKNOWN), severity=F.lit(FIXABLE))
    sums = told.where("__part AND currency IS NOT NULL AND declared IS NOT NULL").groupBy(*keys, "currency").agg(*_summed(F.col("declared"), "__sum"), F.count("*").alias("__n"))
    pages = told.where("NOT __part AND declared IS NOT NULL").join(sums, [*keys, "currency"]).withColumn("__p", F.col("__sum").try_cast(kind))
    agree = compared(F.col("__p"), F.col("declared"), F.lit(0), F.lit(0), rounding)
    parts = result(pages, rule_id=F.lit("sum/parts"), name=F.col("name"), currency=F.col("currency"), status=agree, severity=severity(agree), computed=F.col("__p"), declared=F.col("declared"), records=F.col("__n"))
    held = totals.where("__part").groupBy(*keys).agg(F.collect_set("name").alias("__held"))
    over = fine.join(held, keys).join(troubled, keys, "left_anti").withColumn("__of", F.size(F.array_intersect("__names", "__held")))
    cover = over.groupBy(*keys).agg(F.sum(F.when(F.col("__of") > 1, F.col("__n")).otherwise(0)).alias("__twice"), F.sum(F.when(F.col("__of") == 0, F.col("__n")).otherwise(0)).alias("__never"), F.sum("__n").alias("__n"))
    twice, never = F.col("__twice") > 0, F.col("__never") > 0
    cover = result(cover, rule_id=F.when(twice, "sum/overlap").otherwise("sum/cover"), status=F.when(twice, FAIL).when(never, UNKNOWN).otherwise(PASS), severity=F.when(twice, CRITICAL).otherwise(FIXABLE), records=F.when(twice, F.col("__twice")).when(never, F.col("__never")).otherwise(F.col("__n")))
    out = control
    for more in (troubles, silent, parts, cover):
        out = out.unionByName(more)
    return out


def totals_set(balances: DataFrame, controls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, RESULT): the results of balance() and of control_set() together; whether totals hold asks that all of them pass."""
    none = lambda kind: F.lit(None).cast(kind)
    kind = controls.schema["computed"].dataType
    made = {"rule_id": F.lit("balance"), "name": none("string"), "currency": F.col("currency").cast("string"), "status": F.col("status"), "severity": F.lit(CRITICAL), "computed": F.col("computed").try_cast(kind), "declared": F.col("closing").try_cast(kind), "records": none("long")}
    return balances.select(*keys, *(c.alias(n) for n, c in made.items())).unionByName(controls.select(*keys, *RESULT))


def totals_hold(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hold): true only where there are results and every one passes."""
    return results.groupBy(*keys).agg((F.count_if(F.col("status").eqNullSafe(F.lit(PASS))) == F.count("*")).alias("hold"))


def parts_vs_whole(parts: DataFrame, whole: DataFrame, keys: list[str], part_amount: str, whole_amount: str, rounding: Rounding | None = None) -> DataFrame:
    """(keys, status, parts, whole): totals of parts add up to the whole's; a sum beyond 38 digits is UNKNOWN."""
    kind = exact_kind((parts, part_amount), (whole, whole_amount))
    p = parts.groupBy(*keys).agg(exact_sum(F.col(part_amount)).try_cast(kind).alias("parts"))
    w = whole.select(*keys, F.col(whole_amount).try_cast(kind).alias("whole"))
    status = compared(F.col("parts"), F.col("whole"), _digits(parts, part_amount), _digits(whole, whole_amount), rounding)
    return p.join(w, keys, "full_outer").select(*keys, status.alias("status"), "parts", "whole")


def scope_cover(records: DataFrame, scopes: DataFrame, key: str) -> DataFrame:
    """(key, cover): records that several totals cover (`overlap`), or none (`uncovered`); scopes: name, key."""
    n = scopes.groupBy(key).agg(F.count_distinct("name").alias("n"))
    told = records.select(key).join(n, key, "left")
    return told.select(key, F.when(F.col("n") > 1, "overlap").when(F.col("n").isNull(), "uncovered").alias("cover")).where("cover IS NOT NULL")


def in_scope(records: DataFrame, scopes: DataFrame, key: str, name: str) -> DataFrame:
    """Records of one total's scope; a total without a scope covers the whole document.

    Whether there is one is a subquery of the plan: nothing runs while it is built.
    """
    own = scopes.where(F.col("name") == name)
    told = records.join(own.select(F.col(key).alias("__of")).distinct(), F.col(key) == F.col("__of"), "left")
    return told.where(F.col("__of").isNotNull() | ~own.exists()).select(*records.columns)
