"""Parameters every operator takes explicitly: dates, thresholds, domains and rule tables."""
from __future__ import annotations

from dataclasses import dataclass, field, replace


# Label spellings, excluded labels and allow-lists that decide which entities are in scope.
LABEL_MERGES = {
    "MERCEDES": "MERCEDES-BENZ",
    "MERCEDES BENZ": "MERCEDES-BENZ",
    "SMART (MCC)": "SMART",
    "CHRYSLER-JEEP": "JEEP",
    "HARLEY DAVIDSON": "HARLEY-DAVIDSON",
    "LANDROVER": "LAND ROVER",
    "LAND-ROVER": "LAND ROVER",
    "VW": "VOLKSWAGEN",
    "ROLLS ROYCE": "ROLLS-ROYCE",
    "ALFA-ROMEO": "ALFA ROMEO",
}
EXCLUDED_LABELS = (
    "YAMAHA", "KAWASAKI", "PIAGGIO", "APRILIA", "KTM", "DUCATI", "HARLEY-DAVIDSON",
    "LEXMOTO", "PUCH", "ROYAL ENFIELD", "VESPA", "SINNIS", "MOTO GUZZI", "MV AGUSTA",
    "BENELLI", "KYMCO", "SYM", "HUSQVARNA", "HUSABERG", "BSA", "NORTON", "ZONTES",
    "BUELL", "CAGIVA", "GILERA", "INDIAN", "LAMBRETTA", "MUTT", "BRIXTON", "CCM",
    "HYOSUNG", "DAELIM", "JINLUN", "PIONEER", "SKYJET", "SUKIDA", "ZONGSHEN", "LONCIN",
    "KEEWAY", "WK", "AJS", "MASH", "SUPER SOCO", "NIU", "HERALD", "DERBI", "RIEJU",
    "SHERCO", "BETA", "GAS GAS", "TGB", "PEUGEOT MOTOCYCLES", "MOTORINI", "QUADRO",
    "TRIUMPH",
)
ALLOWED_FIRST_WORDS = {
    "HONDA": (
        "CIVIC", "JAZZ", "CR-V", "ACCORD", "HR-V", "PRELUDE", "FR-V", "CONCERTO",
        "S2000", "INSIGHT", "CR-Z", "LEGEND", "STREAM", "SHUTTLE", "LOGO", "CRX",
        "CR-X", "INTEGRA", "NSX", "E", "E:NY1", "ZR-V", "CITY", "BALLADE", "AERODECK",
        "ODYSSEY", "QUINTET",
    ),
    "SUZUKI": (
        "SWIFT", "VITARA", "GRAND", "ALTO", "SX4", "IGNIS", "JIMNY", "WAGON-R+",
        "WAGON-R", "WAGON", "CELERIO", "SPLASH", "BALENO", "CARRY", "SUPER", "LIANA",
        "S-CROSS", "KIZASHI", "SAMURAI", "SJ410", "SJ413", "SJ", "X-90", "ACROSS",
        "SWACE", "CAPPUCCINO", "ESCUDO", "CULTUS",
    ),
}
DENIED_PATTERNS = {"BMW": r"^([RKFGCS] ?\d{2,4}|R SERIES|K SERIES|R NINE|HP\d|CE ?0)"}
UNKNOWN_MODELS = ("", "UNKNOWN")
KNOWN_SMALL_LABELS = ("SMART", "DAEWOO", "DACIA", "FIAT", "CHEVROLET", "PERODUA",
                      "SUZUKI", "DAIHATSU", "TOYOTA", "UNKNOWN")


@dataclass(frozen=True)
class ScopeRules:
    """Which entities are covered, as plain data (exported with the model)."""

    merges: dict = field(default_factory=lambda: dict(LABEL_MERGES))
    excluded: tuple = EXCLUDED_LABELS
    allowed_first_words: dict = field(default_factory=lambda: dict(ALLOWED_FIRST_WORDS))
    denied_patterns: dict = field(default_factory=lambda: dict(DENIED_PATTERNS))
    unknown_models: tuple = UNKNOWN_MODELS


@dataclass(frozen=True)
class TextRules:
    """Ordered phrase tables for item text: the first label whose phrase occurs wins."""

    notes: tuple
    code_pattern: str
    codes: tuple       # ((label, (phrase, ...)), ...) on section codes
    keywords: tuple    # ((label, (phrase, ...)), ...) on words
    flags: tuple       # ((flag, phrase), ...) independent of the category
    default: str = "other"
    categories: tuple = ("tyres", "brakes", "suspension", "steering", "leaks", "other")
    recurring: tuple = ("tyres", "brakes", "suspension", "steering", "leaks", "corrosion")

    @property
    def count_names(self):
        return tuple(self.categories) + tuple(name for name, _ in self.flags)


# Note phrases, section codes and keywords that decide an item's category.
INSPECTION_TEXT = TextRules(
    notes=("child seat", "undertray", "under tray", "items removed", "covid",
           "headlight adjuster", "headlamp adjuster"),
    code_pattern=r"\([0-9]\.[0-9]",
    codes=(
        ("tyres", ("(5.2.",)),
        ("suspension", ("(5.1.", "(5.3.")),
        ("brakes", ("(1.",)),
        ("steering", ("(2.",)),
        ("leaks", ("(8.4.",)),
    ),
    keywords=(
        ("tyres", ("tyre",)),
        ("brakes", ("brake",)),
        ("steering", ("steering", "track rod")),
        ("other", ("exhaust",)),
        ("leaks", ("leak",)),
        ("suspension", ("shock absorber", "suspension", "spring", "anti-roll", "sub-frame",
                        "subframe", "bush", "ball joint", "wheel bearing")),
    ),
    flags=(("corrosion", "corro"), ("tyre_limit", "legal limit")),
)


@dataclass(frozen=True)
class Settings:
    """One set of data rules. Defaults are the inspection-history rules; override with ``with_``."""

    regime_date: str = "2018-05-20"       # predict only from here; codes are reliable from here
    snapshot_end: str | None = "2026-02-04"   # None: no cut (the record path)
    validation_start: str = "2023-01-01"
    test_start: str = "2024-01-01"
    gap_days: int = 60                    # an event this close to the previous one is a repeat
    sample_pct: int = 20
    min_cell: int = 30
    min_age: int = 3
    source: str | None = "DVSA"           # None: no source filter
    null_source_ok: bool = False
    fold_result_case: bool = False        # True: compare results and item types upper-cased
    passed: str = "PASSED"
    failed: str = "FAILED"
    advisory_type: str = "ADVISORY"
    minor_type: str = "MINOR"
    fail_types: tuple = ("FAIL", "MAJOR", "DANGEROUS", "PRS")
    km_factor: float = 0.621371
    # ordered (last year included, label); the final label takes the rest
    generations: tuple = ((1990, "E30 and older"), (1998, "E36"), (2005, "E46"),
                          (2012, "E90"), (2019, "F30"))
    last_generation: str = "G20"

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    @property
    def generation_order(self):
        return tuple(label for _, label in self.generations) + (self.last_generation,)
