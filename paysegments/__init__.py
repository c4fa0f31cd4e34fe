"""Features and segments of paying companies, on Spark."""

from paysegments.config import SegmentConfig, analysis

__all__ = ["SegmentConfig", "analysis"]
