"""Spark-native analytics for entities with an event history and a pass/fail outcome."""
from erisk.settings import INSPECTION_TEXT, ScopeRules, Settings, TextRules

__all__ = ["INSPECTION_TEXT", "ScopeRules", "Settings", "TextRules"]
