"""Banding a number into labels."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def interval_labels(edges, right=True):
    """'(a, b]' or '[a, b)' for each pair of neighbours."""
    show = lambda v: str(int(v)) if float(v).is_integer() else str(v)
    left, close = ("(", "]") if right else ("[", ")")
    return [f"{left}{show(a)}, {show(b)}{close}" for a, b in zip(edges, edges[1:])]


def right_closed(column, edges, labels=None, include_lowest=False) -> Column:
    """P25: (low, high] bands; a value outside every band, or NULL, gives NULL."""
    c, labels = _col(column), labels or interval_labels(edges)
    first = (c >= edges[0]) if include_lowest else (c > edges[0])
    out = F.when(first & (c <= edges[1]), labels[0])
    for low, high, label in list(zip(edges, edges[1:], labels))[1:]:
        out = out.when((c > low) & (c <= high), label)
    return out


def left_closed(column, edges, labels=None) -> Column:
    """[low, high) bands."""
    c, labels = _col(column), labels or interval_labels(edges, right=False)
    out = None
    for low, high, label in zip(edges, edges[1:], labels):
        cond = (c >= low) if high == INF else (c >= low) & (c < high)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def first_edge(column, edges, labels, missing="no history") -> Column:
    """The first edge the value does not exceed; the last label takes the rest."""
    c = _col(column)
    out = F.when(c.isNull(), missing)
    for edge, label in zip(edges, labels):
        out = out.when(c <= edge, label)
    return out.otherwise(labels[-1])


def presence(column, missing="no history") -> Column:
    """Yes / no / no history."""
    c = _col(column)
    return F.when(c.isNull(), missing).when(c > 0, "yes").otherwise("no")


def age_key(column) -> Column:
    """Peer group of whole years, at least 3, 25 and over together; NULL stays NULL."""
    whole = F.floor(_col(column))
    return F.when(whole >= 25, "25+").when(whole.isNotNull(), F.greatest(whole, F.lit(3).cast("long")).cast("string"))


AGE_KEYS = tuple(str(a) for a in range(3, 25)) + ("25+",)


def order_of(column, order) -> Column:
    """O2: position in a fixed order (1-based); labels outside it come last."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), _col(column))
    return F.when(pos > 0, pos).otherwise(F.lit(len(order) + 1))
