"""Literal entities, events and items, and a plain-Python reading of the history rules."""
from __future__ import annotations

import datetime as dt

from erisk.sources.tables import ENTITY_SCHEMA, EVENT_SCHEMA, ITEM_SCHEMA


def d(text):
    return None if text is None else dt.date.fromisoformat(text)


def entities(spark, rows):
    """(registration, make, model, first_used, registered[, fuel[, engine]])"""
    full = [(*r, *("PETROL", 1600.0)[len(r) - 5:]) for r in rows]
    return spark.createDataFrame([(a, b, c, d(e), d(f), g, h) for a, b, c, e, f, g, h in full], ENTITY_SCHEMA)


def event(number, reg, at, result, value=None, unit="mi", kind="READ", expiry=None, source="DVSA"):
    at = at if " " in at else f"{at} 10:00:00"
    return (number, reg, dt.datetime.fromisoformat(at), result, value, unit, kind, d(expiry), source)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def items(spark, rows):
    """(event, type, text)"""
    return spark.createDataFrame([(*r, False) if len(r) == 3 else r for r in rows], ITEM_SCHEMA)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def plain_cycles(rows, gap):
    """Brute force: rows are (key, day, time, failed, id); returns the ids that start a cycle."""
    kept, last = [], {}
    for key, day, at, failed, number in sorted(rows, key=lambda r: (r[0], r[2], -r[3], r[4])):
        if key not in last or (day - last[key]).days > gap:
            kept.append(number)
        last[key] = day
    return kept
