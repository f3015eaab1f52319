"""Temporal model monitoring on Spark: splits, drift, thresholds, calibration, reliance."""

from tidemark.roles import FeatureGroups, Roles

__all__ = ["FeatureGroups", "Roles"]
