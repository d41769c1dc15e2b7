"""gridlark: situational-awareness analytics as plain PySpark DataFrame functions."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
