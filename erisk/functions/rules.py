"""Entity rules as column expressions: dates, labels, scope, hash sample, readings."""
from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, functions as F

from erisk.settings import ScopeRules, Settings

SPACES = " \t\n\r\f\v"


def any_of(conditions) -> Column:
    return functools.reduce(operator.or_, conditions)


def text_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def day(column) -> Column:
    """Calendar day of a date, a timestamp or ISO text; unreadable text gives NULL."""
    return F.substring(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"),
                       1, 10).try_cast("date")


def start_day(first_used="first_used_date", registered="registration_date", blank_is_missing=False) -> Column:
    """First-use day, else registration day. Text input may treat '' as missing."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (first_used, registered)]
    if blank_is_missing:
        parts = [F.when(c.cast("string") != "", c) for c in parts]
    return day(F.coalesce(*parts))


def clean_text(column) -> Column:
    """P10: trimmed and upper-cased."""
    c = F.col(column) if isinstance(column, str) else column
    return F.upper(F.btrim(c, F.lit(SPACES)))


def clean_label(column, rules: ScopeRules) -> Column:
    """P5: trimmed, upper-cased, spelling variants merged, blank or NULL -> UNKNOWN."""
    label = clean_text(column)
    merged = F.try_element_at(text_map(rules.merges), label) if rules.merges else F.lit(None).cast("string")
    return F.coalesce(merged, F.nullif(label, F.lit("")), F.lit("UNKNOWN"))


def in_scope(make, model, rules: ScopeRules) -> Column:
    """1 when the entity is covered. Deny-list of labels, allow-list of first words, deny pattern."""
    label = clean_label(make, rules)
    name = F.coalesce(clean_text(model), F.lit(""))
    flag = F.when(label.isin(*rules.excluded) if rules.excluded else F.lit(False), F.lit(False))
    for key, words in rules.allowed_first_words.items():
        flag = flag.when(label == key, F.split_part(name, F.lit(" "), F.lit(1)).isin(*words))
    for key, pattern in rules.denied_patterns.items():
        flag = flag.when(label == key, ~name.isin(*rules.unknown_models) & ~name.rlike(pattern))
    return flag.otherwise(F.lit(True)).cast("int")


def hash_bucket(key) -> Column:
    """md5(key) as a number, modulo 100, without big integers.

    The 128-bit number is folded in four 32-bit steps; 2**32 % 100 == 96.
    """
    c = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.coalesce(c.cast("string"), F.lit("")))
    folded = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        folded = (folded * 96 + part) % 100
    return folded


def in_sample(key, pct: int) -> Column:
    return (hash_bucket(key) < pct).cast("int")


def family(make: str, model_label: str, model_pattern: str, make_col="make", model_col="model") -> Column:
    """Exact label, or a case-sensitive model pattern anchored by the caller."""
    return (F.col(make_col) == make) & ((F.col(model_col) == model_label) | F.col(model_col).rlike(model_pattern))


LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def reading(value, unit, kind, factor: float) -> Column:
    """The reading in miles; NULL unless it was really READ. Of text the leading number counts ("61000 miles")."""
    head = F.regexp_extract(value.cast("string"), LEADING_NUMBER, 1)
    v = F.coalesce(value.try_cast("double"), head.try_cast("double"))
    return (F.when(F.upper(F.coalesce(kind, F.lit(""))) != "READ", F.lit(None).cast("double"))
             .when(F.lower(unit).startswith("k"), v * F.lit(factor))
             .otherwise(v))


def known_source(column, s: Settings) -> Column:
    """Source test, case-insensitive; NULL or blank source only when the settings allow it."""
    c = F.col(column) if isinstance(column, str) else column
    if s.source is None:
        return F.lit(True)
    same = F.upper(c) == s.source
    return (F.coalesce(c, F.lit("")) == "") | same if s.null_source_ok else same


def result_text(column, s: Settings) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.upper(c) if s.fold_result_case else c


def year_of(date_col) -> Column:
    return F.year(F.col(date_col) if isinstance(date_col, str) else date_col)


def generation(year: Column, s: Settings) -> Column:
    """Ordered year thresholds, one definition for every report."""
    out = None
    for last, label in s.generations:
        out = F.when(year <= last, label) if out is None else out.when(year <= last, label)
    return F.when(year.isNotNull(), out.otherwise(s.last_generation) if out is not None else F.lit(s.last_generation))


def age_rounded(event_day: Column, start: Column) -> Column:
    """Whole years, half up, then cut toward zero."""
    return (F.datediff(event_day, start) / F.lit(365.25) + F.lit(0.5)).cast("int")


def age_years(event_day: Column, start: Column) -> Column:
    """Years with two decimals."""
    return F.round(F.datediff(event_day, start) / F.lit(365.25), 2)


def age_int(age: Column) -> Column:
    """Whole years, half to even."""
    return F.bround(age, 0).cast("int")


def annual_rate(amount: Column, days: Column) -> Column:
    """Yearly rate of a complete interval; NULL if a reading is missing, no days, or it fell."""
    return F.when((amount >= 0) & (days != 0), F.bround(amount / days * F.lit(365.25), 0))


def projected(last: Column, yearly: Column, days: Column) -> Column:
    """Last reading plus the usual rate times the days since."""
    return F.bround(last + yearly * days / F.lit(365.25), 0)


def clean_key(column) -> Column:
    """Key without white space, upper-cased."""
    c = F.col(column) if isinstance(column, str) else column
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def valid_key(column) -> Column:
    return clean_key(column).rlike("^[A-Z0-9]{2,8}$")


def split_label(date_col, s: Settings) -> Column:
    """Train / validation / test as one column, so one pass serves every split."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return (F.when(c < F.lit(s.validation_start).cast("date"), "train")
             .when(c < F.lit(s.test_start).cast("date"), "validation")
             .otherwise("test"))


def collapse(column, keep, other: str) -> Column:
    """Labels outside the list become one label (NULL too)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isin(*keep), c).otherwise(F.lit(other))


def one_hot(column, labels, prefix: str) -> list[Column]:
    """P20: one 0/1 column per label."""
    c = F.col(column) if isinstance(column, str) else column
    return [F.coalesce((c == v).cast("double"), F.lit(0.0)).alias(f"{prefix}{v}") for v in labels]


def clamp(column: Column, low=None, high=None) -> Column:
    """NULL stays NULL."""
    out = column
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return out


def add_three_years(d: Column, years: int = 3) -> Column:
    """Calendar anniversary; 29 February moves to 1 March in a common year."""
    moved = F.add_months(d, 12 * years)
    return F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29) & (F.dayofmonth(moved) == 28),
                  F.date_add(moved, 1)).otherwise(moved)
