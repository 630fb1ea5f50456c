"""lullwatch: predictive-maintenance analytics over sensor event journals, as Spark DataFrame programs."""

from lullwatch.spec import JournalSpec, RiskBounds

__all__ = ["JournalSpec", "RiskBounds"]
