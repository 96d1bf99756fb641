"""Ordered phrase classification of free text (T1-T6). Whole texts, JVM string functions only."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from erisk.functions.rules import any_of
from erisk.settings import TextRules


def has_any(lowered: Column, phrases) -> Column:
    return any_of([lowered.contains(p) for p in phrases])


def first_match(lowered: Column, table, default: str) -> Column:
    """The first rule with a phrase in the text wins."""
    out = None
    for label, phrases in table:
        hit = has_any(lowered, phrases)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def is_note(lowered: Column, rules: TextRules) -> Column:
    """T1."""
    return has_any(lowered, rules.notes) if rules.notes else F.lit(False)


def is_coded(text: Column, rules: TextRules) -> Column:
    """T2."""
    return text.rlike(rules.code_pattern)


def code_category(lowered: Column, rules: TextRules) -> Column:
    return first_match(lowered, rules.codes, rules.default)


def keyword_category(lowered: Column, rules: TextRules) -> Column:
    return first_match(lowered, rules.keywords, rules.default)


def item_answers(text: Column, kind: Column, advisory: str, rules: TextRules) -> Column:
    """T5 before the day is known: the category for events before the regime date, and from it on."""
    lowered = F.lower(text)
    word, note = keyword_category(lowered, rules), F.coalesce(is_note(lowered, rules), F.lit(False))
    coded = F.coalesce(is_coded(text, rules), F.lit(False))
    before = F.when(kind == advisory, F.when(note, "note").otherwise(word))
    since = F.when(kind == advisory, F.when(note, "note").when(coded, code_category(lowered, rules)).otherwise(word))
    return F.struct(before.alias("before"), since.alias("since"))


def item_category(text: Column, event_day: Column, kind: Column, advisory: str, regime_date: str,
                  rules: TextRules) -> Column:
    """T5: note, else code category for coded text since the regime date, else keyword; other items NULL."""
    lowered = F.lower(text)
    return F.when(kind == advisory,
                  F.when(is_note(lowered, rules), "note")
                   .when(is_coded(text, rules) & (event_day >= F.lit(regime_date).cast("date")),
                         code_category(lowered, rules))
                   .otherwise(keyword_category(lowered, rules)))
