"""PySpark-native analytics over a music library: listings, statistics, rules, matching, search and sync."""

__version__ = "0.1.0"
