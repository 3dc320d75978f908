"""tracemill: a PySpark-native analytics engine for semi-structured activity traces."""
