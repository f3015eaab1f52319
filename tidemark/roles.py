"""Column roles and the constants that every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

# Labels for missing and rare categories, and the smallest share used by PSI.
MISSING = "__MISSING__"
OTHER = "__OTHER__"
EPS = 1e-6


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in the monitored table."""

    target: str = "Default"
    time: str = "issue_d"
    id: str = "id"
    text: tuple[str, ...] = ("title", "desc")


@dataclass(frozen=True)
class FeatureGroups:
    """Column names by kind, in table order."""

    features: tuple[str, ...]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    text: tuple[str, ...] = ()

    def require(self) -> "FeatureGroups":
        if not self.features:
            raise ValueError("no feature columns were given")
        return self
