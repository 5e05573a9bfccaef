"""Reconciliation policy as data: how far each source is trusted, who owns a field, how risky a change of it is.

Every function takes a Policy, so callers can pass their own tables; DEFAULT holds the standing ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import mapping

# Reliabilities, independence groups, display names, owners and sensitivities.
SOURCES = {
    "nppes": (0.85, "nppes", "NPI Registry"),
    "nppes_bulk": (0.85, "nppes", "NPI Registry (bulk)"),
    "cms": (0.85, "cms", "CMS"),
    "state_board": (0.90, "state", "State Medical Board"),
    "practice_site": (0.75, "practice", "Practice Website"),
    "clinic_site": (0.80, "practice", "Practice Website"),
}
OWNERS = {"phone": "practice_site", "zip": "practice_site", "unit": "practice_site", "street": "practice_site", "city": "practice_site",
          "state": "practice_site", "specialty": "nppes", "name": "nppes", "is_active": "nppes"}
SENSITIVITY = {"phone": 0.2, "zip": 0.3, "unit": 0.3, "street": 0.4, "city": 0.4, "state": 0.4, "specialty": 0.7, "name": 0.8, "is_active": 0.9}


@dataclass(frozen=True)
class Policy:
    sources: dict = field(default_factory=lambda: dict(SOURCES))
    owners: dict = field(default_factory=lambda: dict(OWNERS))
    sensitivity: dict = field(default_factory=lambda: dict(SENSITIVITY))
    unknown_reliability: float = 0.60
    other_sensitivity: float = 0.5
    authority_bonus: float = 0.15
    auto_base: float = 0.80
    sensitivity_weight: float = 0.15
    conflict_factor: float = 0.7

    def bar_of(self, name: str) -> float:
        return round(self.auto_base + self.sensitivity_weight * self.sensitivity.get(name, self.other_sensitivity), 4)

    def group_of(self, source: str) -> str:
        return self.sources[source][1] if source in self.sources else source

    def reliability(self, source: Column) -> Column:
        return _lookup({k: v[0] for k, v in self.sources.items()}, source, F.lit(self.unknown_reliability))

    def group(self, source: Column) -> Column:
        return _lookup({k: v[1] for k, v in self.sources.items()}, source, source)

    def pretty(self, source: Column) -> Column:
        return _lookup({k: v[2] for k, v in self.sources.items()}, source, source)

    def bar(self, name: Column) -> Column:
        return _lookup({k: self.bar_of(k) for k in self.sensitivity}, name, F.lit(self.bar_of("")))

    def is_authority(self, name: Column, source: Column) -> Column:
        """A source speaks for a field if it is of the same independence group as the field's owner."""
        owner = _lookup({k: self.group_of(v) for k, v in self.owners.items()}, name, F.lit(None).cast("string"))
        return F.coalesce(self.group(source) == owner, F.lit(False))


def _lookup(table: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping(table), key), default)


DEFAULT = Policy()
