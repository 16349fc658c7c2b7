"""fieldloom: analytics for dense, time-stamped vector fields on Spark."""

__version__ = "0.1.0"
