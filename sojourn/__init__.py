"""Cohort building and time-to-event statistics as Spark jobs."""

from sojourn.config import StudyConfig

__all__ = ["StudyConfig"]
