"""Experiment analytics on Spark: events -> sessions -> A/B groups -> KPIs -> segments -> reports."""

from upliftlens.config import ExperimentConfig

__all__ = ["ExperimentConfig"]
