"""A PySpark-native analytics engine for market and event time-series."""
