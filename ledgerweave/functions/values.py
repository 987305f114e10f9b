"""Raw text to typed values, as Column expressions: no guess is made, and every refusal has a code."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blanks that may separate groups of digits.
GROUP_BLANKS = (" ", " ", " ", " ")
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


@dataclass(frozen=True)
class MoneyRules:
    decimal: str | None = None
    group: str | None = None
    parentheses: bool = False
    implicit_cents: bool | None = None
    currency: str | None = None
    labels: dict[str, str] = field(default_factory=dict)
    #: Digits after the point that a value may have; one with more is refused, never rounded.
    scale: int = 6


def _first(*cases: tuple[Column, Column], default: Column | None = None) -> Column:
    made = reduce(lambda w, c: w.when(*c), cases[1:], F.when(*cases[0]))
    return made if default is None else made.otherwise(default)


def with_money(rows: DataFrame, raw: Column, name: str, rules: MoneyRules) -> DataFrame:
    """rows with a struct column `name` (value, currency, text, digits, refusal): an exact decimal, or a code and nulls.

    text has the value's own digits and digits counts those after the point, so
    that precision is a rule of its own. What decimal(38, scale) can't hold is
    E_TYPE_PRECISION: nothing is rounded. Each step is a projection of its own, so that no expression is repeated in the next.
    """
    kept, c = rows.columns, F.col
    longest_first = sorted(rules.labels, key=lambda x: (-len(x), x))
    rows = rows.withColumn("__raw", raw).withColumn("__text", F.trim("__raw"))
    found = F.coalesce(*(F.when(F.lower("__text").endswith(x.lower()), x) for x in longest_first), F.lit(None).cast("string"))
    rows = rows.withColumn("__label", found)
    own = F.coalesce(*(F.when(c("__label") == k, v) for k, v in rules.labels.items()), F.lit(rules.currency).cast("string"))
    rows = rows.withColumn("__currency", own).withColumn("__text", F.when(c("__label").isNull(), c("__text")).otherwise(F.trim(F.substring("__text", F.lit(1), F.char_length("__text") - F.char_length("__label")))))
    rows = rows.withColumn("__brackets", c("__text").startswith("(") & c("__text").endswith(")"))
    rows = rows.withColumn("__text", F.when(c("__brackets"), F.trim(F.substring("__text", F.lit(2), F.char_length("__text") - 2))).otherwise(c("__text")))
    rows = rows.withColumn("__lead", F.substring("__text", 1, 1).isin("+", "-")).withColumn("__tail", ~c("__lead") & F.substring("__text", -1, 1).isin("+", "-"))
    rows = rows.withColumn("__minus", _first((c("__lead"), c("__text").startswith("-")), (c("__tail"), c("__text").endswith("-")), default=c("__brackets")))
    removed = "".join(GROUP_BLANKS) + (rules.group if rules.group and rules.group not in GROUP_BLANKS else "")
    bare = _first((c("__lead"), F.substring("__text", F.lit(2), F.char_length("__text"))), (c("__tail"), F.substring("__text", F.lit(1), F.char_length("__text") - 1)), default=c("__text"))
    rows = rows.withColumn("__bare", F.translate(bare, removed, ""))
    count = lambda mark: F.char_length("__bare") - F.char_length(F.translate("__bare", mark, ""))
    rows = rows.withColumn("__dots", count(".")).withColumn("__commas", count(","))
    rows = rows.withColumn("__both", (c("__dots") > 0) & (c("__commas") > 0)).withColumn("__one", F.when(c("__dots") > 0, ".").when(c("__commas") > 0, ","))
    declared = F.lit(rules.decimal).cast("string")
    rows = rows.withColumn("__point", c("__one").eqNullSafe(declared)).withColumn("__group", c("__one").eqNullSafe(F.lit(rules.group).cast("string")))
    three = F.char_length(F.call_function("substring_index", c("__bare"), F.coalesce("__one", F.lit(".")), F.lit(-1))) == 3
    rows = rows.withColumn("__three", three).withColumn("__left", F.translate("__bare", "0123456789", "")).withColumn("__digits", (c("__left") == "") & (c("__bare") != ""))
    plain, pointed = F.translate("__bare", ".,", ""), F.translate("__bare", ",", ".")
    last_dot = F.instr(F.reverse("__bare"), ".") < F.instr(F.reverse("__bare"), ",")
    cents = F.lpad(c("__bare"), F.greatest(F.char_length("__bare"), F.lit(3)), "0")
    whole = {None: F.lit(None).cast("string"), False: c("__bare"), True: F.concat(F.substring(cents, F.lit(1), F.char_length(cents) - 2), F.lit("."), F.substring(cents, -2, 2))}[rules.implicit_cents]
    number = _first(
        (c("__both"), F.when(last_dot, F.translate("__bare", ",", "")).otherwise(F.translate("__bare", ",.", "."))),
        (c("__one").isNull(), F.when(c("__digits"), whole)),
        (c("__dots") + c("__commas") > 1, F.when(~c("__point"), plain)),
        (c("__point"), pointed),
        (c("__group"), plain),
        (declared.isNull() & ~c("__three"), pointed),
    )
    rows = rows.withColumn("__number", number)
    shape = F.translate("__number", "0123456789", "").isin("", ".") & ~c("__number").isin("", ".")
    rows = rows.withColumn("__number", F.when(shape, c("__number")))
    whole = F.ltrim(F.substring_index("__number", ".", 1), F.lit("0"))
    fraction = F.when(F.contains(c("__number"), F.lit(".")), F.substring_index("__number", ".", -1)).otherwise("")
    rows = rows.withColumn("__whole", F.when(whole == "", "0").otherwise(whole)).withColumn("__fraction", F.when(c("__number").isNotNull(), fraction))
    fits = (F.char_length(F.rtrim("__fraction", F.lit("0"))) <= rules.scale) & (F.char_length("__whole") <= 38 - rules.scale)
    plain_text = F.when(c("__fraction") == "", c("__whole")).otherwise(F.concat(c("__whole"), F.lit("."), c("__fraction")))
    signed = F.when(c("__minus") & (F.translate(plain_text, "0.", "") != ""), F.concat(F.lit("-"), plain_text)).otherwise(plain_text)
    rows = rows.withColumn("__fits", F.when(c("__number").isNotNull(), fits)).withColumn("__exact", signed)
    rows = rows.withColumn("__value", F.when(c("__fits"), c("__exact").try_cast(f"decimal(38,{rules.scale})")))
    lone = ~c("__both") & c("__one").isNotNull() & (c("__dots") + c("__commas") == 1) & ~c("__point") & ~c("__group")
    refusal = _first(
        (c("__raw").isNull() | (F.trim("__raw") == ""), F.lit("E_TYPE_EMPTY")),
        (c("__brackets") & F.lit(not rules.parentheses), F.lit("E_TYPE_NO_RULE")),
        ((c("__bare") == "") | (~c("__left").isin("", ".", ",") & c("__left").rlike("\\p{L}")), F.lit("E_TYPE_NOT_A_NUMBER")),
        (c("__one").isNull() & c("__digits") & F.lit(rules.implicit_cents is None), F.lit("E_TYPE_AMBIGUOUS_AMOUNT")),
        (lone & declared.isNotNull(), F.lit("E_TYPE_NO_RULE")),
        (lone & declared.isNull() & c("__three"), F.lit("E_TYPE_AMBIGUOUS_AMOUNT")),
        (c("__fits").isNull(), F.lit("E_TYPE_NOT_A_NUMBER")),
        (c("__value").isNull(), F.lit("E_TYPE_PRECISION")),
    )
    rows = rows.withColumn("__refusal", refusal)
    sound = lambda x: F.when(c("__refusal").isNull(), x)
    typed = F.struct(sound(c("__value")).alias("value"), sound(c("__currency")).alias("currency"), sound(c("__exact")).alias("text"), sound(F.char_length("__fraction")).alias("digits"), c("__refusal").alias("refusal"))
    # A generator of one row: filters on the result stay above it, or the planner would write out every step within every step.
    return rows.select(*kept, F.explode(F.array(typed)).alias(name))


def date(raw: Column, order: str | None) -> Column:
    """Struct (value, refusal) of a date text: ISO always, else parts in the declared order (DMY, MDY, YMD)."""
    text = F.trim(raw)
    iso = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    numeric = "^([0-9]{1,4})[./-]([0-9]{1,2})[./-]([0-9]{1,4})$"
    parts = {c: F.regexp_extract(text, numeric, k + 1) for k, c in enumerate(order or "DMY")}
    year, month, day = (parts[c].try_cast("int") for c in "YMD")
    built = F.when(iso, text).otherwise(F.format_string("%04d-%02d-%02d", year, month, day))
    sound = iso | ((year >= 100) & month.between(1, 12) & day.between(1, 31))
    value = F.when(sound, F.to_date(F.try_to_timestamp(built, F.lit("yyyy-MM-dd"))))
    year_of = F.when(iso, F.substring(text, 1, 4).try_cast("int")).otherwise(year)
    refusal = _first(
        (raw.isNull() | ~(iso | text.rlike(numeric)), F.lit("E_TYPE_NOT_A_DATE")),
        (~iso & F.lit(order is None), F.lit("E_TYPE_AMBIGUOUS_DATE")),
        (year_of < 100, F.lit("E_TYPE_AMBIGUOUS_DATE")),
        (value.isNull(), F.lit("E_TYPE_DATE_INVALID")),
    )
    return F.struct(F.when(refusal.isNull(), value).alias("value"), refusal.alias("refusal"))


def ambiguous_date(raw: Column) -> Column:
    """Whether day and month of a numeric date could be taken for each other."""
    parts = [F.regexp_extract(F.trim(raw), "^([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{1,4})$", k).try_cast("int") for k in (1, 2)]
    return F.coalesce((parts[0] <= 12) & (parts[1] <= 12) & (parts[0] != parts[1]), F.lit(False))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC").str.casefold().str.normalize("NFC")


def _beyond_ascii(text: Column, of) -> Column:
    """What a Python function makes of a text; one of ASCII alone stays in the JVM, and nulls travel in its place."""
    return F.coalesce(of(F.when(~text.rlike("^[\\x00-\\x7F]*$"), text)), text)


def nfc(text: Column) -> Column:
    """Unicode NFC; Spark has no function for it."""
    return _beyond_ascii(text, _nfc)


def nfkc(text: Column) -> Column:
    return _beyond_ascii(text, _nfkc)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normal_text(raw: Column) -> Column:
    """NFC, blanks collapsed to one, ends trimmed."""
    return collapsed(nfc(raw))


def policy_text(raw: Column, compat: bool = False, keep_control: bool = False, nbsp: str = "keep") -> Column:
    """Struct (value, compat_changed) under a field's policy: NFC, NFKC only where declared; controls and NBSP as declared."""
    composed = nfc(raw)
    value = nfkc(raw) if compat else composed
    if not keep_control:
        value = F.regexp_replace(value, "\\p{Cc}", "")
    if nbsp == "space":
        value = F.replace(value, F.lit(" "), F.lit(" "))
    return F.struct(value.alias("value"), (nfkc(raw) != composed).alias("compat_changed"))


def term_key(text: Column) -> Column:
    """What terms are compared by: NFC, full case folding (ß is ss), blanks collapsed."""
    return F.lower(collapsed(_beyond_ascii(text, _folded)))


def vocabulary_term(text: Column, terms: dict[str, str]) -> Column:
    """Struct (value, refusal): the term that a text names; a declared list of terms becomes one map, so no join is needed."""
    known: dict[str, str] = {}
    for term, value in terms.items():
        key = " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", term).casefold()).lower().split())
        if known.setdefault(key, value) != value:
            raise ValueError(f"E_VOCABULARY_CONTRADICTION {term}")
    value = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair)), term_key(text)) if known else F.lit(None).cast("string")
    refusal = F.when(text.isNull() | (F.trim(text) == ""), "E_TYPE_EMPTY").when(value.isNull(), "E_TYPE_NOT_IN_VOCABULARY")
    return F.struct(F.when(refusal.isNull(), value).alias("value"), refusal.alias("refusal"))


def snapped(x: Column) -> Column:
    """A share of the page on the 0.001 grid, within 0..1; halves go to the even neighbour."""
    return F.bround(F.least(F.greatest(x.cast("decimal(18,9)"), F.lit(0).cast("decimal(18,9)")), F.lit(1).cast("decimal(18,9)")), 3)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, cut off; 0 of nothing."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(part.cast("long") * 100 / F.when(whole != 0, whole)).cast("long"))


def rounded(x: Column, digits: int, mode: str) -> Column:
    """A decimal at fewer digits by a declared mode: half_up, half_down, half_even, up, down."""
    if mode == "half_up":
        return F.round(x, digits)
    if mode == "half_even":
        return F.bround(x, digits)
    down, up = (F.when(x < 0, a).otherwise(b).cast(f"decimal(38,{digits})") for a, b in ((F.ceil(x, F.lit(digits)), F.floor(x, F.lit(digits))), (F.floor(x, F.lit(digits)), F.ceil(x, F.lit(digits)))))
    half = F.lit(f"0.{'0' * digits}5").cast(f"decimal({digits + 2},{digits + 1})")
    return {"up": up, "down": down, "half_down": F.when(F.abs(x - down) > half, up).otherwise(down)}[mode]


def run_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit("run/1"), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def ordinal_path(path: Column) -> Column:
    """Whether an address counts items, so that it moves when one is put in before it."""
    return path.rlike("\\[[0-9]+\\]")
